"""Data-quality statistics. Values that are null or not finite are missing; ids break ties."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.core.exprs import finite
from urbanloom.core.ordered import quantiles, running
from urbanloom.core.tables import stored
from urbanloom.session import ship

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def array_summary(df: DataFrame, x: str, w: str | None = None) -> DataFrame:
    """One row: counts, extremes, mean, interpolated quantiles, sum and, with ``w``, the weighted mean."""
    v = finite(x)
    cols = [F.count("*").alias("n"), F.count(v).alias("n_valid"), (F.count("*") - F.count(v)).alias("n_missing"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.sum(v).alias("sum")]
    q = quantiles(df, v, list(QUANTILES)).agg(*(F.max(F.when(F.col("q") == p, F.col("value"))).alias(n) for p, n in zip(QUANTILES, ("p05", "p25", "median", "p75", "p95"))))
    if w:
        ok = F.when(v.isNotNull(), finite(w))
        cols.append(F.try_divide(F.sum(v * ok), F.sum(ok)).alias("weighted_mean"))
    out = df.agg(*cols).crossJoin(F.broadcast(q))
    return out.select("n", "n_valid", "n_missing", "min", "max", "mean", "sum", "p05", "p25", "median", "p75", "p95", *(["weighted_mean"] if w else []))


def _cumulative(df: DataFrame, x: str, w: str, by: list[str]) -> DataFrame:
    """(x, w, cum, share, total): weights and weighted values cumulated over the distinct values."""
    rows = df.select(*by, finite(x).alias("x"), finite(w).alias("w")).where("x is not null and w > 0")
    rows = running(rows.groupBy(*by, "x").agg(F.sum("w").alias("w")), [F.col("x")], {"cum": ("sum", F.col("w")), "share": ("sum", F.col("x") * F.col("w")), "x_to": ("max", F.col("x"))}, by)
    total = rows.groupBy(*(F.col(c).alias(f"_t{i}") for i, c in enumerate(by))).agg(F.sum("w").alias("total"))
    if not by:
        return rows.crossJoin(F.broadcast(total))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_t{i}")) for i, c in enumerate(by)])
    return rows.join(total, same).drop(*(f"_t{i}" for i in range(len(by))))


def weighted_quantile(df: DataFrame, x: str, w: str, quantiles: list[float], by: list[str] | None = None) -> DataFrame:
    """(q, value): interpolated at the shares that cumulated weights reach, clamped at the left end."""
    by = by or []
    rows = _cumulative(df, x, w, by).withColumn("s", F.col("cum") / F.col("total"))
    # the share and the value before: what the row itself adds taken off, and the largest value so far
    rows = running(rows.select(*by, "x", "w", "s", "total"), [F.col("x")], {"x0": ("max", F.col("x"))}, by, inclusive=False)
    rows = rows.withColumn("s0", F.when(F.col("x0").isNotNull(), F.col("s") - F.col("w") / F.col("total")))
    q = F.explode(F.array(*map(F.lit, quantiles)))
    rows = rows.select(*by, "x", "s", "s0", "x0", q.alias("q"))
    hit = rows.where(((F.col("s0").isNull()) & (F.col("q") <= F.col("s"))) | ((F.col("q") > F.col("s0")) & (F.col("q") <= F.col("s"))))
    value = F.when(F.col("s0").isNull(), F.col("x")).otherwise(F.col("x0") + (F.col("x") - F.col("x0")) * (F.col("q") - F.col("s0")) / (F.col("s") - F.col("s0")))
    # rounding may let a share fall on both sides of a step, which are the same value
    return hit.select(*by, "q", value.alias("value")).groupBy(*by, "q").agg(F.min("value").alias("value"))


def gini_coefficient(df: DataFrame, x: str, w: str, by: list[str] | None = None) -> DataFrame:
    """Weighted Gini from the Lorenz curve's area; 0 where the total is 0. Values are taken as not negative."""
    by = by or []
    rows = _cumulative(df, x, w, by)
    area = F.sum(F.col("w") * (2 * F.col("share") - F.col("x") * F.col("w")))
    out = rows.groupBy(*by).agg(area.alias("a"), F.max("total").alias("t"), F.sum(F.col("x") * F.col("w")).alias("sx"))
    return out.select(*by, F.when(F.col("sx") > 0, 1 - F.col("a") / (F.col("t") * F.col("sx"))).otherwise(F.lit(0.0)).alias("gini"))


def normalize_weights(df: DataFrame, w: str) -> DataFrame:
    """Adds ``share``: the weight over the sum of all (one small aggregate, joined back)."""
    return df.crossJoin(F.broadcast(df.agg(F.sum(finite(w)).alias("_t")))).withColumn("share", finite(w) / F.col("_t")).drop("_t")


def quantile_breaks(df: DataFrame, x: str, n_classes: int = 5) -> DataFrame:
    """One row with the distinct inner quantiles as an array."""
    return quantiles(df, finite(x), [k / n_classes for k in range(1, n_classes)]).agg(F.array_sort(F.collect_set("value")).alias("breaks"))


def classify_values(df: DataFrame, x: str, breaks: list[float] | Column, nodata: int = -1) -> DataFrame:
    """Adds ``class``: 1 + the number of breaks at or below the value; ``nodata`` for missing values."""
    b = F.array(*map(F.lit, breaks)) if isinstance(breaks, list) else breaks
    v = finite(x)
    return df.withColumn("class", F.when(v.isNull(), F.lit(nodata)).otherwise(F.size(F.filter(b, lambda k: k <= v)) + 1))


def rank_values(df: DataFrame, x: str, descending: bool = True) -> DataFrame:
    """Adds ``rank``: average rank of ties, 0 for missing values.

    Distinct values are counted first, so the running sum orders distinct values, not rows.
    """
    counts = df.select(finite(x).alias("_v")).where("_v is not null").groupBy("_v").agg(F.count("*").alias("_n"))
    order = F.col("_v").desc() if descending else F.col("_v").asc()
    ranks = running(counts, [order], {"_to": ("sum", F.col("_n"))}).select("_v", (F.col("_to") - (F.col("_n") - 1) / 2).alias("_r"))
    return df.withColumn("_x", finite(x)).join(ranks, F.col("_x") == F.col("_v"), "left").withColumn("rank", F.coalesce(F.col("_r"), F.lit(0.0))).drop("_x", "_v", "_r")


def bootstrap_mean_ci(df: DataFrame, x: str, confidence: float = 0.95, n_boot: int = 2000, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean by the Poisson bootstrap: a row's weights for all replicates are drawn from a
    generator seeded by its value and its place among equal values, so that they don't depend on how rows are dealt;
    each batch sends two sums a replicate and no resample is ever gathered."""
    n = n_boot

    def run(batches):
        sums, counts = np.zeros(n), np.zeros(n)
        for pdf in batches:
            for v, c in zip(pdf["v"].to_numpy(float), pdf["c"].to_numpy()):
                # of c equal values a replicate draws a Poisson number with mean c
                k = np.random.Generator(np.random.PCG64([seed, int(np.float64(v).view(np.uint64))])).poisson(float(c), n)
                sums += k * v
                counts += k
        yield pd.DataFrame({"b": np.arange(n), "s": sums, "c": counts})

    values = df.select(finite(x).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("c"))
    reps = values.mapInPandas(run, "b int, s double, c double").groupBy("b").agg(F.try_divide(F.sum("s"), F.sum("c")).alias("m"))
    lo, hi = (1 - confidence) / 2, (1 + confidence) / 2
    # as many replicates as asked for, whatever the rows
    ends = reps.agg(F.percentile("m", F.lit(lo)).alias("ci_low"), F.percentile("m", F.lit(hi)).alias("ci_high"))
    return df.agg(F.avg(finite(x)).alias("mean")).crossJoin(ends)


def zscore(df: DataFrame, x: str, ddof: int = 0) -> DataFrame:
    """Adds ``z``: 0 where the spread is 0, null for missing values."""
    v = finite(x)
    stats = df.agg(F.avg(v).alias("_m"), (F.stddev_pop(v) if ddof == 0 else F.stddev_samp(v)).alias("_s"))
    z = F.when(v.isNull(), F.lit(None)).when(F.col("_s") > 0, (v - F.col("_m")) / F.col("_s")).otherwise(F.lit(0.0))
    return df.crossJoin(F.broadcast(stats)).withColumn("z", z).drop("_m", "_s")


def top_k(df: DataFrame, x: str, k: int, id_col: str = "id", largest: bool = True) -> DataFrame:
    """The k rows of largest (least) value, missing ones excluded; ids break ties."""
    v = finite(x)
    return df.where(v.isNotNull()).orderBy(v.desc() if largest else v.asc(), id_col).limit(k)


def pareto_front(df: DataFrame, a: str, b: str, maximize_a: bool = True, maximize_b: bool = True, id_col: str = "id") -> DataFrame:
    """Adds ``on_front``: no other row is at least as good in both and better in one. Missing values are never on it.

    Two objectives need no pairs: over the distinct values of the first, from the best on, a running best of the second.
    """
    x = finite(a) if maximize_a else -finite(a)
    y = finite(b) if maximize_b else -finite(b)
    rows = df.withColumn("_x", x).withColumn("_y", y)
    best = rows.where("_x is not null and _y is not null").groupBy("_x").agg(F.max("_y").alias("_top"))
    best = running(best, [F.col("_x").desc()], {"_above": ("max", F.col("_top"))}, inclusive=False).withColumnRenamed("_x", "_bx")
    on = (F.col("_y") == F.col("_top")) & (F.col("_above").isNull() | (F.col("_y") > F.col("_above")))
    return rows.join(best, F.col("_x") == F.col("_bx"), "left").withColumn("on_front", F.coalesce(on, F.lit(False))).drop("_x", "_y", "_bx", "_top", "_above")


def _skyline(values: np.ndarray) -> np.ndarray:
    """Which rows no other row of the block is as good as in everything and better than in something."""
    order = np.argsort(-values.sum(axis=1), kind="stable")
    kept: list[int] = []
    for i in order:  # whoever beats a row has a larger sum
        best = values[kept]
        if not len(kept) or not ((best >= values[i]).all(axis=1) & (best > values[i]).any(axis=1)).any():
            kept.append(int(i))
    return np.array(sorted(kept), int)


def pareto_front_of(df: DataFrame, columns: list[str], maximize: list[bool] | bool = True) -> DataFrame:
    """Adds ``on_front`` for any number of objectives; rows with a missing value are never on it, equal rows are alike.

    Parts of the rows keep their own fronts, which are joined by eights, so the last task holds a front and not the rows.
    """
    flags = [maximize] * len(columns) if isinstance(maximize, bool) else list(maximize)
    if not columns or len(flags) != len(columns):
        raise ValueError("one flag for each of one objective or more")
    ship(df.sparkSession)
    rows = stored(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    oriented = [(finite(c) if up else -finite(c)).alias(f"o{k}") for k, (c, up) in enumerate(zip(columns, flags))]
    names = [f"o{k}" for k in range(len(columns))]
    now = rows.select("_row", *oriented).na.drop()
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = "_row long, " + ", ".join(f"{n} double" for n in names)
    while True:
        now = now.groupBy(F.pmod(F.xxhash64("_row"), F.lit(parts)).alias("_part")).applyInPandas(lambda pdf: pdf.iloc[_skyline(pdf[names].to_numpy(float))][["_row", *names]], schema)
        if parts == 1:
            break
        parts = max(1, parts // 8)
    return rows.join(now.select("_row", F.lit(True).alias("_on")), "_row", "left").withColumn("on_front", F.coalesce("_on", F.lit(False))).drop("_row", "_on")
