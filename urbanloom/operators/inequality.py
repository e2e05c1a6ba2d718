"""Weighted distribution and inequality measures over (x, w[, g]) rows.

Rows with a missing value or a weight that isn't positive are left out. Cumulated shares run over distinct values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanloom.core.exprs import finite
from urbanloom.core.ordered import running


def cleaned(df: DataFrame, x: str, w: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keep, finite(x).alias("_x"), (finite(w) if w else F.lit(1.0)).alias("_w")).where("_x is not null and _w > 0")


def _by_value(df: DataFrame, x: str, w: str | None, by: list[str]) -> DataFrame:
    return cleaned(df, x, w, tuple(by)).groupBy(*by, "_x").agg(F.sum("_w").alias("_w"))


def weighted_mean(df: DataFrame, x: str, w: str | None = None) -> DataFrame:
    return cleaned(df, x, w).agg(F.coalesce(F.sum(F.col("_x") * F.col("_w")) / F.sum("_w"), F.lit(0.0)).alias("mean"))


def weighted_std(df: DataFrame, x: str, w: str | None = None) -> DataFrame:
    """Population standard deviation, in two passes over one scan's aggregate."""
    rows = cleaned(df, x, w)
    mean = rows.agg((F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")).alias("_m"))
    d = F.col("_x") - F.col("_m")
    return rows.crossJoin(F.broadcast(mean)).agg(F.coalesce(F.sqrt(F.sum(F.col("_w") * d * d) / F.sum("_w")), F.lit(0.0)).alias("std"))


def coefficient_of_variation(df: DataFrame, x: str, w: str | None = None) -> DataFrame:
    both = weighted_mean(df, x, w).crossJoin(weighted_std(df, x, w))
    return both.select(F.when(F.col("mean") != 0, F.col("std") / F.abs("mean")).otherwise(F.lit(0.0)).alias("cv"))


def weighted_quantile(df: DataFrame, x: str, qs: list[float], w: str | None = None, by: list[str] | None = None) -> DataFrame:
    """(q, value) at plotting positions (cumulated weight minus half the row's own) over the total, clamped at both ends.

    Rows of one value keep their own positions, so ties are interpolated over; rows are ordered within a group.
    """
    by = by or []
    # rows of one value and weight sit side by side at even steps, so each such run is one row with a count
    rows = cleaned(df, x, w, tuple(by)).groupBy(*by, "_x", "_w").agg(F.count("*").alias("_k"))
    own = F.col("_w") * F.col("_k")
    order = [F.col("_x"), F.col("_w")]
    rows = running(rows, order, {"_to": ("sum", own)}, by)
    rows = running(rows, order, {"_last": ("max", F.struct("_x", "_w", "_to"))}, by, inclusive=False)
    total = rows.groupBy(*(F.col(c).alias(f"_t{i}") for i, c in enumerate(by))).agg(F.sum(own).alias("_total"), F.max(F.struct("_x", "_w")).alias("_end"))
    same = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"_t{i}")) for i, c in enumerate(by)], F.lit(True))
    rows = rows.join(total if by else F.broadcast(total), same)
    # positions of the run's first and last row, and of the row before the run
    place = lambda upto, weight: (upto - weight / 2) / F.col("_total")
    rows = rows.withColumn("s", place(F.col("_to") - own + F.col("_w"), F.col("_w"))).withColumn("e", place(F.col("_to"), F.col("_w")))
    rows = rows.withColumn("s0", place(F.col("_last._to"), F.col("_last._w"))).withColumn("x0", F.col("_last._x"))
    rows = rows.select("*", F.explode(F.array(*(F.lit(float(q)) for q in qs))).alias("q"))
    lowest = F.col("s0").isNull() & (F.col("q") < F.col("s"))
    between = F.col("s0").isNotNull() & (F.col("q") >= F.col("s0")) & (F.col("q") < F.col("s"))
    inside = (F.col("q") >= F.col("s")) & (F.col("q") < F.col("e"))
    highest = (F.struct("_x", "_w") == F.col("_end")) & (F.col("q") >= F.col("e"))
    value = F.when(between, F.col("x0") + (F.col("_x") - F.col("x0")) * (F.col("q") - F.col("s0")) / (F.col("s") - F.col("s0"))).otherwise(F.col("_x"))
    return rows.where(lowest | between | inside | highest).select(*by, "q", value.alias("value")).groupBy(*by, "q").agg(F.max("value").alias("value"))


def percentile_ratio(df: DataFrame, x: str, w: str | None = None, hi: float = 0.9, lo: float = 0.1) -> DataFrame:
    q = weighted_quantile(df, x, [hi, lo], w)
    both = q.agg(F.max(F.when(F.col("q") == hi, F.col("value"))).alias("h"), F.max(F.when(F.col("q") == lo, F.col("value"))).alias("l"))
    return both.select(F.when(F.col("l") > 0, F.col("h") / F.col("l")).otherwise(F.lit(0.0)).alias("ratio"))


def percentile_rank(df: DataFrame, x: str, w: str | None = None, id_col: str = "id") -> DataFrame:
    """(id, pct): weight below plus half the weight of equal values, over the total."""
    rows = cleaned(df, x, w, (id_col,))
    values = rows.groupBy("_x").agg(F.sum("_w").alias("_e"))
    values = running(values, [F.col("_x")], {"_to": ("sum", F.col("_e"))}).crossJoin(F.broadcast(rows.agg(F.sum("_w").alias("_all"))))
    values = values.select(F.col("_x").alias("_v"), ((F.col("_to") - F.col("_e") / 2) / F.col("_all")).alias("pct"))
    return rows.join(values, F.col("_x") == F.col("_v")).select(id_col, "pct")


def gini(df: DataFrame, x: str, w: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Negative values count as 0."""
    by = by or []
    rows = _by_value(df.withColumn("_c", F.greatest(finite(x), F.lit(0.0))), "_c", w, by)
    rows = running(rows, [F.col("_x")], {"_wb": ("sum", F.col("_w")), "_sb": ("sum", F.col("_w") * F.col("_x"))}, by, inclusive=False).na.fill(0.0, ["_wb", "_sb"])
    out = rows.groupBy(*by).agg(F.sum(F.col("_w") * (F.col("_x") * F.col("_wb") - F.col("_sb"))).alias("a"), F.sum("_w").alias("t"), F.sum(F.col("_w") * F.col("_x")).alias("s"))
    return out.select(*by, F.when(F.col("s") > 0, F.col("a") / (F.col("t") * F.col("s"))).otherwise(F.lit(0.0)).alias("gini"))


def _theil(r: Column, w: Column) -> Column:
    return F.sum(w * F.when(r > 0, r * F.ln(r)).otherwise(F.lit(0.0)))


def theil_t(df: DataFrame, x: str, w: str | None = None, by: list[str] | None = None) -> DataFrame:
    by = by or []
    rows = cleaned(df, x, w, tuple(by)).where("_x >= 0")
    means = rows.groupBy(*by).agg((F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")).alias("_m"))
    joined = rows.join(F.broadcast(means), by) if by else rows.crossJoin(F.broadcast(means))
    return joined.groupBy(*by).agg(F.when(F.first("_m") > 0, _theil(F.col("_x") / F.col("_m"), F.col("_w")) / F.sum("_w")).otherwise(F.lit(0.0)).alias("theil"))


def theil_decomposition(df: DataFrame, x: str, w: str, g: str) -> DataFrame:
    """One row for each group: mean, value share, Theil index, and its terms within and between."""
    rows = cleaned(df, x, w, (g,)).where("_x >= 0")
    groups = rows.groupBy(g).agg(F.sum(F.col("_x") * F.col("_w")).alias("s"), F.sum("_w").alias("n")).withColumn("m", F.col("s") / F.col("n"))
    total = groups.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    within = theil_t(df, x, w, [g])
    out = groups.join(within, g).crossJoin(F.broadcast(total))
    share, mean = F.col("s") / F.col("ts"), F.col("ts") / F.col("tn")
    return out.select(g, F.col("m").alias("mean"), share.alias("share"), "theil", (share * F.col("theil")).alias("within"), F.when(F.col("m") > 0, share * F.ln(F.col("m") / mean)).otherwise(F.lit(0.0)).alias("between"))


def atkinson_index(df: DataFrame, x: str, w: str | None = None, epsilon: float = 1.0) -> DataFrame:
    rows = cleaned(df, x, w).where("_x >= 0")
    mean, n = F.sum(F.col("_x") * F.col("_w")) / F.sum("_w"), F.sum("_w")
    if epsilon == 1:
        equal = F.exp(F.sum(F.col("_w") * F.ln("_x")) / n)
    else:
        equal = F.pow(F.sum(F.col("_w") * F.pow("_x", F.lit(1 - epsilon))) / n, F.lit(1 / (1 - epsilon)))
    zero = F.lit(epsilon >= 1) & (F.min("_x") <= 0)
    return rows.agg(F.when(F.coalesce(mean, F.lit(0.0)) <= 0, F.lit(0.0)).when(zero, F.lit(1.0)).otherwise(F.least(F.greatest(1 - equal / mean, F.lit(0.0)), F.lit(1.0))).alias("atkinson"))


def lorenz_points(df: DataFrame, x: str, w: str | None = None, rank: str | None = None) -> DataFrame:
    """(pop_share, value_share) with the origin, in the order of ``rank`` (the values themselves by default)."""
    key = rank or x
    rows = df.select(finite(key).alias("_k"), F.greatest(finite(x), F.lit(0.0)).alias("_x"), (finite(w) if w else F.lit(1.0)).alias("_w")).where("_k is not null and _x is not null and _w > 0")
    rows = rows.groupBy("_k").agg(F.sum("_w").alias("_w"), F.sum(F.col("_x") * F.col("_w")).alias("_s"))
    rows = running(rows, [F.col("_k")], {"_wt": ("sum", F.col("_w")), "_st": ("sum", F.col("_s"))})
    rows = rows.crossJoin(F.broadcast(rows.agg(F.sum("_w").alias("_wa"), F.sum("_s").alias("_sa"))))
    shares = rows.select((F.col("_wt") / F.col("_wa")).alias("pop_share"), F.when(F.col("_sa") > 0, F.col("_st") / F.col("_sa")).otherwise(F.lit(0.0)).alias("value_share"))
    return shares.unionByName(shares.sparkSession.range(1).select(F.lit(0.0).alias("pop_share"), F.lit(0.0).alias("value_share")))


def gini_from_lorenz(points: DataFrame) -> DataFrame:
    order = [F.col("pop_share"), F.col("value_share")]
    rows = running(points.select("pop_share", "value_share"), order, {"_b": ("max", F.struct("pop_share", "value_share"))}, inclusive=False)
    return rows.agg((1 - F.sum((F.col("pop_share") - F.col("_b.pop_share")) * (F.col("value_share") + F.col("_b.value_share")))).alias("gini"))


def concentration_index(df: DataFrame, x: str, rank: str, w: str | None = None) -> DataFrame:
    return gini_from_lorenz(lorenz_points(df, x, w, rank)).select(F.col("gini").alias("concentration"))


def value_classes(df: DataFrame, x: str, breaks: list[float]) -> DataFrame:
    """Adds ``class``: the number of breaks below the value (a value on a break stays below it)."""
    v = finite(x)
    return df.withColumn("class", F.when(v.isNotNull(), F.size(F.filter(F.array(*map(F.lit, breaks)), lambda k: k < v))))


def crosstab(df: DataFrame, x: str, g: str, w: str, breaks: list[float]) -> DataFrame:
    """Group by class: weight, share of the group, and representation (share over the class's share of all)."""
    rows = cleaned(df, x, w, (g,))
    cells = value_classes(rows, "_x", breaks).groupBy(g, "class").agg(F.sum("_w").alias("weight"))
    by_g, by_c, every = Window.partitionBy(g), Window.partitionBy("class"), Window.partitionBy()
    share = F.col("weight") / F.sum("weight").over(by_g)
    return cells.select(g, "class", "weight", share.alias("share"), (share / (F.sum("weight").over(by_c) / F.sum("weight").over(every))).alias("rep_ratio"))


def share_below(df: DataFrame, x: str, threshold: float, w: str | None = None, strict: bool = True) -> DataFrame:
    hit = F.col("_x") < threshold if strict else F.col("_x") <= threshold
    return cleaned(df, x, w).agg(F.coalesce(F.sum(F.when(hit, F.col("_w")).otherwise(0.0)) / F.sum("_w"), F.lit(0.0)).alias("share"))


def share_above(df: DataFrame, x: str, threshold: float, w: str | None = None, strict: bool = True) -> DataFrame:
    hit = F.col("_x") > threshold if strict else F.col("_x") >= threshold
    return cleaned(df, x, w).agg(F.coalesce(F.sum(F.when(hit, F.col("_w")).otherwise(0.0)) / F.sum("_w"), F.lit(0.0)).alias("share"))
