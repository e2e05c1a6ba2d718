"""Rankings of alternatives whose criteria are fuzzy numbers, given as struct columns.

Triangular numbers have l, m, u; interval-valued intuitionistic ones mu_l, mu_u, nu_l, nu_u; picture fuzzy ones pos, neu,
neg; spherical ones mu, nu, pi; rough ones lo, hi. Extremes of columns are one small aggregate that is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.operators.mcda import _shares, _total, ranked


def _with_extremes(df: DataFrame, names: list[str], *others: Column) -> DataFrame:
    """``df`` with lo_<name>, hi_<name> and sum_<name> of each column, and other one-row aggregates."""
    makers = [f(c).alias(f"{a}_{c}") for c in names for a, f in (("lo", F.min), ("hi", F.max), ("sum", F.sum))]
    return df.crossJoin(F.broadcast(df.agg(*makers, *others)))


def _distance(parts: list[tuple[Column, Column]], factor: float) -> Column:
    return F.sqrt(F.lit(factor) * _total([(a - b) * (a - b) for a, b in parts]))


def fuzzy_topsis(df: DataFrame, cols: list[str], weights: list[tuple[float, float, float]], benefit: list[bool]) -> DataFrame:
    """Triangular TOPSIS: vertex distances to the best and worst weighted number of each criterion, summed."""
    raw = df.select("id", *(F.col(f"{c}.{p}").alias(f"{p}{j}") for j, c in enumerate(cols) for p in "lmu"))
    box = _with_extremes(raw, [f"{p}{j}" for j in range(len(cols)) for p in "lu"])
    rows = []
    for j, (good, w) in enumerate(zip(benefit, weights)):
        if good:
            top = F.greatest(F.col(f"hi_u{j}"), F.lit(1e-12))
            v = [F.col(f"{p}{j}") / top for p in "lmu"]
        else:
            v = [F.col(f"lo_l{j}") / F.col(f"{p}{j}") for p in "uml"]
        rows += [(x * F.lit(float(k))).alias(f"v{p}{j}") for x, k, p in zip(v, w, "lmu")]
    names = [f"v{p}{j}" for j in range(len(cols)) for p in "lmu"]
    s = _with_extremes(box.select("id", *rows), names)
    gap = lambda end: _total([_distance([(F.col(f"v{p}{j}"), F.col(f"{end}_v{p}{j}")) for p in "lmu"], 1 / 3) for j in range(len(cols))])
    s = s.withColumn("_b", gap("hi")).withColumn("_w", gap("lo"))
    return ranked(s, F.coalesce(F.try_divide("_w", F.col("_b") + F.col("_w")), F.lit(0.0)))


def fuzzy_vikor(df: DataFrame, cols: list[str], weights: list[tuple[float, float, float]], benefit: list[bool], v: float = 0.5) -> DataFrame:
    """VIKOR on centroids (least first), with s, r and whether the alternative is in the compromise set."""
    raw = df.select("id", *(((F.col(f"{c}.l") + F.col(f"{c}.m") + F.col(f"{c}.u")) / 3).alias(f"x{j}") for j, c in enumerate(cols)))
    s = _with_extremes(raw, [f"x{j}" for j in range(len(cols))])
    terms = []
    for j, (good, w) in enumerate(zip(benefit, weights)):
        span = F.col(f"hi_x{j}") - F.col(f"lo_x{j}")
        best = F.col(f"{'hi' if good else 'lo'}_x{j}")
        terms.append(F.lit(sum(w) / 3) * F.abs(best - F.col(f"x{j}")) / F.when(span > 0, span).otherwise(F.lit(1e-9)))
    s = s.select("id", _total(terms).alias("s"), (F.greatest(*terms) if len(terms) > 1 else terms[0]).alias("r"))
    s = _with_extremes(s, ["s", "r"], F.count("*").alias("_n"))
    part = lambda c: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).otherwise(F.lit(0.0))
    q = ranked(s, F.lit(v) * part("s") + F.lit(1 - v) * part("r"), descending=False).join(s.select("id", "s", "r", "lo_s", "lo_r", "_n"), "id")
    # the least and second least q, and whether the least is also best in s or r
    first = q.agg(F.min("score").alias("_q1"), F.min(F.when(F.col("rank") == 2, F.col("score"))).alias("_q2"), F.max(F.when((F.col("rank") == 1) & ((F.col("s") == F.col("lo_s")) | (F.col("r") == F.col("lo_r"))), 1).otherwise(0)).alias("_stable"))
    out = q.crossJoin(F.broadcast(first)).withColumn("_dq", F.coalesce(F.try_divide(F.lit(1.0), F.col("_n") - 1), F.lit(0.0)))
    clear = (F.col("_n") > 1) & (F.coalesce(F.col("_q2") - F.col("_q1") >= F.col("_dq"), F.lit(False)))
    inside = F.when(clear & (F.col("_stable") == 1), F.col("rank") == 1).when(~clear, F.col("score") - F.col("_q1") < F.col("_dq")).otherwise(F.col("rank") <= 2)
    return out.select("id", "score", "rank", "s", "r", inside.alias("compromise"))


def ivif_topsis(df: DataFrame, cols: list[str], weights: list[float], benefit: list[bool]) -> DataFrame:
    """TOPSIS over interval-valued intuitionistic numbers, weighted as powers."""
    w = _shares(weights)
    power = lambda x, k: F.pow(x, F.lit(float(k)))
    rows = []
    for j, c in enumerate(cols):
        rows += [(1 - power(1 - F.col(f"{c}.{p}"), w[j])).alias(f"{p}{j}") for p in ("mu_l", "mu_u")]
        rows += [power(F.col(f"{c}.{p}"), w[j]).alias(f"{p}{j}") for p in ("nu_l", "nu_u")]
    parts = ("mu_l", "mu_u", "nu_l", "nu_u")
    s = _with_extremes(df.select("id", *rows), [f"{p}{j}" for j in range(len(cols)) for p in parts])

    def gap(best: bool) -> Column:
        ends = lambda j, p: F.col(f"{'hi' if (p.startswith('mu') == benefit[j]) == best else 'lo'}_{p}{j}")
        return _total([_distance([(F.col(f"{p}{j}"), ends(j, p)) for p in parts], 0.25) for j in range(len(cols))])

    s = s.withColumn("_b", gap(True)).withColumn("_w", gap(False))
    return ranked(s, F.coalesce(F.try_divide("_w", F.col("_b") + F.col("_w")), F.lit(0.0)))


def _unit(df: DataFrame, values: list[Column]) -> DataFrame:
    """(id, u0, u1, ..): the values from 0 to 1 over their range; 0 where there is none."""
    s = _with_extremes(df.select("id", *(v.cast("double").alias(f"x{j}") for j, v in enumerate(values))), [f"x{j}" for j in range(len(values))])
    span = lambda j: F.col(f"hi_x{j}") - F.col(f"lo_x{j}")
    return s.select("id", *(((F.col(f"x{j}") - F.col(f"lo_x{j}")) / F.when(span(j) == 0, F.lit(1.0)).otherwise(span(j))).alias(f"u{j}") for j in range(len(values))))


def _score_topsis(df: DataFrame, values: list[Column], weights: list[float]) -> DataFrame:
    """TOPSIS on crisp scores from 0 to 1, all the more the better."""
    w = _shares(weights)
    units = _unit(df, values)
    s = _with_extremes(units.select("id", *((F.col(f"u{j}") * F.lit(w[j])).alias(f"v{j}") for j in range(len(values)))), [f"v{j}" for j in range(len(values))])
    gap = lambda end: _distance([(F.col(f"v{j}"), F.col(f"{end}_v{j}")) for j in range(len(values))], 1.0)
    s = s.withColumn("_b", gap("hi")).withColumn("_w", gap("lo"))
    return ranked(s, F.col("_w") / (F.col("_b") + F.col("_w") + 1e-12))


def rough_topsis(df: DataFrame, cols: list[str], weights: list[float]) -> DataFrame:
    return _score_topsis(df, [0.5 * (F.col(f"{c}.lo") + F.col(f"{c}.hi")) for c in cols], weights)


def picture_fuzzy_topsis(df: DataFrame, cols: list[str], weights: list[float]) -> DataFrame:
    return _score_topsis(df, [F.col(f"{c}.pos") - F.col(f"{c}.neg") for c in cols], weights)


def spherical_fuzzy_topsis(df: DataFrame, cols: list[str], weights: list[float]) -> DataFrame:
    return _score_topsis(df, [F.col(f"{c}.mu") * F.col(f"{c}.mu") - F.col(f"{c}.nu") * F.col(f"{c}.nu") for c in cols], weights)


def neutrosophic_waspas(df: DataFrame, cols: list[str], weights: list[float], mix: float = 0.5) -> DataFrame:
    """Truth x, indeterminacy 1 - x and falsity 1 - x^2 of the unit value x make one score, summed and multiplied up."""
    w, units = _shares(weights), _unit(df, [F.col(c) for c in cols])
    score = [(2 + F.col(f"u{j}") - (1 - F.col(f"u{j}")) - (1 - F.col(f"u{j}") * F.col(f"u{j}"))) / 3 for j in range(len(cols))]
    added = _total([x * F.lit(k) for x, k in zip(score, w)])
    multiplied = reduce(lambda a, b: a * b, [F.pow(x, F.lit(k)) for x, k in zip(score, w)])
    return ranked(units, F.lit(mix) * added + F.lit(1 - mix) * multiplied)


def intuitionistic_vikor(df: DataFrame, cols: list[str], weights: list[float], v: float = 0.5) -> DataFrame:
    """VIKOR on unit values, all the more the better (least score first)."""
    w = _shares(weights)
    s = _with_extremes(_unit(df, [F.col(c) for c in cols]), [f"u{j}" for j in range(len(cols))])
    terms = [F.lit(w[j]) * (F.col(f"hi_u{j}") - F.col(f"u{j}")) / (F.col(f"hi_u{j}") - F.col(f"lo_u{j}") + 1e-12) for j in range(len(cols))]
    s = _with_extremes(s.select("id", _total(terms).alias("s"), (F.greatest(*terms) if len(terms) > 1 else terms[0]).alias("r")), ["s", "r"])
    part = lambda c: (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}") + 1e-12)
    return ranked(s, F.lit(v) * part("s") + F.lit(1 - v) * part("r"), descending=False)


def fuzzy_copras(df: DataFrame, cols: list[str], weights: list[float], benefit: list[bool]) -> DataFrame:
    """COPRAS on (l + 4m + u) / 6, utility in percent of the best."""
    w = _shares(weights)
    raw = df.select("id", *(((F.col(f"{c}.l") + 4 * F.col(f"{c}.m") + F.col(f"{c}.u")) / 6).alias(f"x{j}") for j, c in enumerate(cols)))
    s = _with_extremes(raw, [f"x{j}" for j in range(len(cols))])
    share = lambda j: F.lit(w[j]) * F.col(f"x{j}") / F.when(F.col(f"sum_x{j}") == 0, F.lit(1.0)).otherwise(F.col(f"sum_x{j}"))
    side = lambda want: _total([F.lit(0.0)] + [share(j) for j, g in enumerate(benefit) if g == want])
    s = s.select("id", side(True).alias("p"), side(False).alias("m"))
    s = _with_extremes(s, ["m"]).withColumn("_least", F.when(F.col("lo_m") > 0, F.col("lo_m")).otherwise(F.lit(1e-6)))
    s = s.crossJoin(F.broadcast(s.agg(F.sum(F.col("_least") / (F.col("m") + 1e-12)).alias("_r"))))
    s = s.withColumn("q", F.col("p") + F.col("sum_m") * F.col("_least") / (F.col("m") * F.col("_r") + 1e-12))
    return ranked(_with_extremes(s.select("id", "q"), ["q"]), F.coalesce(F.try_divide("q", "hi_q"), F.lit(0.0)) * 100)


def normalize_criterion(x: Column, method: str, low: float = 0.0, high: float = 100.0, mid: float = 50.0, spread: float = 10.0, nodata: float | None = None) -> Column:
    """0 to 100 by min-max, sigmoid or gaussian, as benefit or cost; missing values become ``nodata`` or null."""
    if high <= low or spread <= 0:
        raise ValueError("high must be above low and spread above 0")
    key = method.lower().replace(" ", "_").replace("-", "_")
    z = F.least(F.greatest((x - mid) / spread, F.lit(-60.0)), F.lit(60.0))
    shapes = {
        "benefit_minmax": (x - low) / (high - low),
        "cost_minmax": (high - x) / (high - low),
        "benefit_sigmoid": 1 / (1 + F.exp(-z)),
        "cost_sigmoid": 1 - 1 / (1 + F.exp(-z)),
        "benefit_gaussian": F.exp(-0.5 * ((x - mid) / spread) * ((x - mid) / spread)),
    }
    shapes |= {"minmax_benefit": shapes["benefit_minmax"], "fuzzy_linear_benefit": shapes["benefit_minmax"], "minmax_cost": shapes["cost_minmax"], "fuzzy_linear_cost": shapes["cost_minmax"], "sigmoid_benefit": shapes["benefit_sigmoid"], "sigmoid_cost": shapes["cost_sigmoid"], "gaussian_benefit": shapes["benefit_gaussian"]}
    if key not in shapes:
        raise ValueError(f"no normalisation {method!r}")
    valid = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    if nodata is not None:
        valid = valid & (x != nodata)
    return F.when(valid, 100 * F.least(F.greatest(shapes[key], F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(nodata).cast("double"))
