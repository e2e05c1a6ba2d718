"""Multi-criteria ranking of alternatives: (id, one column a criterion) -> (id, score, rank). Ties rank by id.

``weights`` and ``benefit`` follow the order of ``cols``. Column extremes and sums are one small aggregate that is
broadcast back; no alternative is compared with another unless the method does so itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanloom.core.ordered import numbered

TINY = 1e-9


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _stats(df: DataFrame, cols: list[str], *names: str) -> DataFrame:
    """``df`` with lo_, hi_, sum_, avg_, norm_ and rec_ of each column, as asked for."""
    makers = {"lo": F.min, "hi": F.max, "sum": F.sum, "avg": F.avg, "norm": lambda c: F.sqrt(F.sum(F.col(c) * F.col(c))), "rec": lambda c: F.sum(1 / F.greatest(F.col(c), F.lit(TINY)))}
    return df.crossJoin(F.broadcast(df.agg(*(makers[n](c).alias(f"{n}_{c}") for n in names for c in cols))))


def _shares(weights: list[float]) -> list[float]:
    s = sum(weights)
    return [w / s for w in weights] if s > 0 else list(weights)


def ranked(df: DataFrame, score: Column, descending: bool = True, id_col: str = "id") -> DataFrame:
    out = df.select(id_col, score.alias("score"))
    order = F.col("score").desc() if descending else F.col("score").asc()
    return numbered(out, [order, F.col(id_col).asc()])


def _ideal(c: str, good: bool, best: bool, pre: str = "") -> Column:
    return F.col(f"{'hi' if good == best else 'lo'}_{pre}{c}")


def topsis(df: DataFrame, cols: list[str], weights: list[float], benefit: list[bool]) -> DataFrame:
    """Closeness to the ideal after vector normalisation; .5 where ideal and anti-ideal coincide."""
    w = _shares(weights)
    s = _stats(df, cols, "lo", "hi", "norm")
    scale = [F.lit(k) / F.when(F.col(f"norm_{c}") > 0, F.col(f"norm_{c}")).otherwise(TINY) for c, k in zip(cols, w)]
    gap = lambda best: F.sqrt(_total([F.pow((F.col(c) - _ideal(c, g, best)) * k, F.lit(2.0)) for c, g, k in zip(cols, benefit, scale)]))
    s = s.withColumn("_b", gap(True)).withColumn("_w", gap(False))
    return ranked(s, F.when(F.col("_b") + F.col("_w") > 0, F.col("_w") / (F.col("_b") + F.col("_w"))).otherwise(F.lit(0.5)))


def vikor(df: DataFrame, cols: list[str], weights: list[float], benefit: list[bool], v: float = 0.5, fixed: bool = False) -> DataFrame:
    """Compromise ranking (least first). As in the model described by the survey the range of a cost criterion is
    floored at 1e-9; ``fixed`` takes its absolute value instead."""
    s = _stats(df, cols, "lo", "hi")
    terms = []
    for c, g, w in zip(cols, benefit, _shares(weights)):
        span = _ideal(c, g, True) - _ideal(c, g, False)
        floored = F.when(F.abs(span) > 0, F.abs(span)).otherwise(TINY) if fixed else F.when(span > 0, span).otherwise(TINY)
        top = (_ideal(c, g, True) - F.col(c)) * (1 if g or not fixed else -1)
        terms.append(F.lit(w) * top / floored)
    s = s.withColumn("_s", _total(terms)).withColumn("_r", F.greatest(*terms))
    m = s.agg(*(f(c).alias(f"{n}{c}") for c in ("_s", "_r") for f, n in ((F.min, "lo"), (F.max, "hi"))))
    part = lambda c: F.when(F.col(f"hi{c}") > F.col(f"lo{c}"), (F.col(c) - F.col(f"lo{c}")) / (F.col(f"hi{c}") - F.col(f"lo{c}"))).otherwise(F.lit(0.0))
    return ranked(s.crossJoin(F.broadcast(m)), F.lit(v) * part("_s") + F.lit(1 - v) * part("_r"), descending=False)


def promethee_ii(df: DataFrame, cols: list[str], weights: list[float], benefit: list[bool]) -> DataFrame:
    """Net flow with the linear preference up to the criterion's range.

    For that preference the flows need no pairs: with x as a share of its range, the preferences of one over all others
    minus those of the others add up to n * x - sum(x) for each criterion.
    """
    s = _stats(df, cols, "lo", "hi", "sum").crossJoin(F.broadcast(df.agg(F.count("*").cast("double").alias("_n"))))
    flows = []
    for c, g, w in zip(cols, benefit, _shares(weights)):
        span = F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")).otherwise(F.lit(1.0))
        flows.append((1 if g else -1) * w * (F.col("_n") * F.col(c) - F.col(f"sum_{c}")) / span)
    return ranked(s, F.coalesce(F.try_divide(_total(flows), F.col("_n") - 1), F.lit(0.0)))


def marcos(df: DataFrame, cols: list[str], weights: list[float], benefit: list[bool]) -> DataFrame:
    """Utility between the anti-ideal and the ideal alternative."""
    s = _stats(df, cols, "lo", "hi")
    ratio = lambda c, g, x: x / F.greatest(F.col(f"hi_{c}"), F.lit(TINY)) if g else F.col(f"lo_{c}") / F.greatest(x, F.lit(TINY))
    sums = {n: _total([F.lit(float(w)) * ratio(c, g, x(c, g)) for c, g, w in zip(cols, benefit, weights)]) for n, x in {"own": lambda c, g: F.col(c), "anti": lambda c, g: _ideal(c, g, False), "ideal": lambda c, g: _ideal(c, g, True)}.items()}
    s = s.withColumn("_m", sums["own"] / F.greatest(sums["anti"], F.lit(TINY))).withColumn("_p", sums["own"] / F.greatest(sums["ideal"], F.lit(TINY)))
    both = F.greatest(F.col("_p") + F.col("_m"), F.lit(TINY))
    s = s.withColumn("_fm", F.col("_p") / both).withColumn("_fp", F.col("_m") / both)
    odds = lambda c: (1 - F.col(c)) / F.greatest(F.col(c), F.lit(TINY))
    return ranked(s, (F.col("_p") + F.col("_m")) / (1 + odds("_fp") + odds("_fm")))


def _linear(c: str, g: bool) -> Column:
    return F.col(c) / F.greatest(F.col(f"hi_{c}"), F.lit(TINY)) if g else F.col(f"lo_{c}") / F.greatest(F.col(c), F.lit(TINY))


def waspas(df: DataFrame, cols: list[str], weights: list[float], benefit: list[bool], mix: float = 0.5) -> DataFrame:
    s = _stats(df, cols, "lo", "hi")
    added = _total([F.lit(float(w)) * _linear(c, g) for c, g, w in zip(cols, benefit, weights)])
    multiplied = reduce(lambda a, b: a * b, [F.pow(_linear(c, g), F.lit(float(w))) for c, g, w in zip(cols, benefit, weights)])
    return ranked(s, F.lit(mix) * added + F.lit(1 - mix) * multiplied)


def aras(df: DataFrame, cols: list[str], weights: list[float], benefit: list[bool]) -> DataFrame:
    """Ratio to the optimal alternative, which takes part in the sums."""
    s = _stats(df, cols, "lo", "hi", "sum", "rec")
    inv = lambda x: 1 / F.greatest(x, F.lit(TINY))

    def score(pick) -> Column:
        return _total([F.lit(float(w)) * (pick(c) / F.greatest(F.col(f"sum_{c}") + F.col(f"hi_{c}"), F.lit(TINY)) if g else inv(pick(c)) / F.greatest(F.col(f"rec_{c}") + inv(F.col(f"lo_{c}")), F.lit(TINY))) for c, g, w in zip(cols, benefit, weights)])

    best = dict(zip(cols, benefit))
    return ranked(s, score(F.col) / F.greatest(score(lambda c: F.col(f"hi_{c}" if best[c] else f"lo_{c}")), F.lit(TINY)))


def copras(df: DataFrame, cols: list[str], weights: list[float], benefit: list[bool]) -> DataFrame:
    """Utility in percent of the best."""
    s = _stats(df, cols, "sum")
    part = lambda want: _total([F.lit(0.0)] + [F.lit(float(w)) * F.col(c) / F.greatest(F.col(f"sum_{c}"), F.lit(TINY)) for c, g, w in zip(cols, benefit, weights) if g == want])
    s = s.withColumn("_p", part(True)).withColumn("_m", part(False))
    if not all(benefit):
        t = s.agg(F.sum("_m").alias("_sm"), F.sum(1 / F.greatest(F.col("_m"), F.lit(TINY))).alias("_sr"))
        s = s.crossJoin(F.broadcast(t)).withColumn("_q", F.col("_p") + F.col("_sm") / (F.col("_m") * F.col("_sr") + 1e-12))
    else:
        s = s.withColumn("_q", F.col("_p"))
    return ranked(s.crossJoin(F.broadcast(s.agg(F.max("_q").alias("_top")))), F.col("_q") / F.greatest(F.col("_top"), F.lit(TINY)) * 100)


def edas(df: DataFrame, cols: list[str], weights: list[float], benefit: list[bool]) -> DataFrame:
    """Distances above and below the mean, each as a share of the largest."""
    s = _stats(df, cols, "avg")
    away = lambda c, up: F.greatest((F.col(c) - F.col(f"avg_{c}")) * (1 if up else -1), F.lit(0.0)) / F.greatest(F.col(f"avg_{c}"), F.lit(1e-12))
    s = s.withColumn("_p", _total([F.lit(float(w)) * away(c, g) for c, g, w in zip(cols, benefit, weights)])).withColumn("_n", _total([F.lit(float(w)) * away(c, not g) for c, g, w in zip(cols, benefit, weights)]))
    s = s.crossJoin(F.broadcast(s.agg(F.greatest(F.max("_p"), F.lit(1e-12)).alias("_tp"), F.greatest(F.max("_n"), F.lit(1e-12)).alias("_tn"))))
    return ranked(s, 0.5 * (F.col("_p") / F.col("_tp") + 1 - F.col("_n") / F.col("_tn")))


def spotis(df: DataFrame, cols: list[str], weights: list[float], benefit: list[bool]) -> DataFrame:
    """Normalised distance to the ideal within the columns' bounds (least first)."""
    s = _stats(df, cols, "lo", "hi")
    parts = []
    for c, g, w in zip(cols, benefit, _shares(weights)):
        top = F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), F.col(f"hi_{c}")).otherwise(F.col(f"lo_{c}") + 1)
        parts.append(F.lit(w) * F.abs(F.col(c) - (top if g else F.col(f"lo_{c}"))) / (top - F.col(f"lo_{c}")))
    return ranked(s, _total(parts), descending=False)


def weighted_linear_combination(df: DataFrame, cols: list[str], weights: list[float], constraint: str | None = None) -> DataFrame:
    """Adds ``score``: the weighted mean of criteria clipped to 0..100, 0 where the constraint is at most .5."""
    parts = [F.lit(w) * F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(100.0)) for c, w in zip(cols, _shares(weights))]
    score = _total(parts)
    return df.withColumn("score", F.when(F.col(constraint) > 0.5, score).otherwise(F.lit(0.0)) if constraint else score)


def entropy_weights(df: DataFrame, cols: list[str]) -> DataFrame:
    """(criterion, weight): Shannon entropy of the min-max shares; equal weights if none differs."""
    n = df.agg(F.count("*").cast("double").alias("_rows"))
    s = _stats(df, cols, "lo", "hi")
    z = [((F.col(c) - F.col(f"lo_{c}")) / F.when(F.col(f"hi_{c}") - F.col(f"lo_{c}") > 1e-12, F.col(f"hi_{c}") - F.col(f"lo_{c}")).otherwise(F.lit(1.0)) + 1e-12).alias(c) for c in cols]
    long = s.select(*z).unpivot([], cols, "criterion", "p").groupBy("criterion").agg(F.sum("p").alias("s"), F.sum(F.col("p") * F.ln("p")).alias("pl"))
    d = long.crossJoin(F.broadcast(n)).select("criterion", (1 + (F.col("pl") / F.col("s") - F.ln("s")) / F.ln(F.greatest(F.col("_rows"), F.lit(2.0)))).alias("d"))
    t = F.sum("d").over(Window.partitionBy())
    return d.select("criterion", F.when(t > 1e-12, F.col("d") / t).otherwise(F.lit(1.0 / len(cols))).alias("weight"))


def critic_weights(df: DataFrame, cols: list[str], benefit: list[bool]) -> DataFrame:
    """(criterion, weight, sigma, conflict): spread times the sum of 1 - correlation, from one aggregate of all pairs of columns."""
    s = _stats(df, cols, "lo", "hi")
    span = lambda c: F.when(F.col(f"hi_{c}") - F.col(f"lo_{c}") > 1e-12, F.col(f"hi_{c}") - F.col(f"lo_{c}")).otherwise(F.lit(1.0))
    z = s.select(*(((F.col(c) - F.col(f"lo_{c}")) / span(c) if g else (F.col(f"hi_{c}") - F.col(c)) / span(c)).alias(c) for c, g in zip(cols, benefit)))
    one = z.agg(*(F.stddev_pop(c).alias(f"s_{c}") for c in cols), *(F.corr(a, b).alias(f"r_{a}_{b}") for i, a in enumerate(cols) for b in cols[i + 1 :]))
    r = lambda a, b: F.coalesce(F.nanvl(F.col(f"r_{a}_{b}" if cols.index(a) < cols.index(b) else f"r_{b}_{a}"), F.lit(0.0)), F.lit(0.0))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("criterion"), F.col(f"s_{c}").alias("sigma"), _total([1 - r(c, o) for o in cols if o != c]).alias("conflict")) for c in cols))).alias("x")).select("x.*")
    score = F.col("sigma") * F.col("conflict")
    total = F.sum(score).over(Window.partitionBy())
    return rows.select("criterion", F.when(total > 1e-12, score / total).otherwise(F.lit(1.0 / len(cols))).alias("weight"), "sigma", "conflict")
