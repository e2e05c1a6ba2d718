"""Spatial autocorrelation over values (id, v) and weights W(i, j, w): joins, aggregates and one row of moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.core.exprs import two_sided_p
from urbanloom.core.ordered import running
from urbanloom.core.tables import stored


def _lagged(values: DataFrame, w: DataFrame, v: str = "v") -> DataFrame:
    """(i, sw, sww, lag): sums of weights, their squares and weighted neighbour values; ids without values drop out."""
    y = values.select(F.col("id").alias("j"), F.col(v).alias("y"))
    known = w.join(values.select(F.col("id").alias("i")), "i", "left_semi")
    return known.join(y, "j").groupBy("i").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sww"), F.sum(F.col("w") * F.col("y")).alias("lag"))


def _with_moments(values: DataFrame, v: str = "v") -> DataFrame:
    m = values.agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.count(v).cast("double").alias("n"))
    return values.select("id", F.col(v).alias("y")).crossJoin(F.broadcast(m))


def _quadrant(z: Column, lag: Column) -> Column:
    return F.when((z >= 0) & (lag >= 0), "HH").when((z < 0) & (lag < 0), "LL").when((z >= 0) & (lag < 0), "HL").otherwise("LH")


def getis_ord(values: DataFrame, w: DataFrame, star: bool = True) -> DataFrame:
    """(id, z, p, bin): Gi or, with the unit itself at weight 1, Gi*; bin is +-1, 2, 3 at p below .10, .05, .01."""
    if star:
        own = values.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("w"))
        w = w.unionByName(own.join(w.where("i = j").select("i"), "i", "left_anti"))
    rows = _with_moments(values).join(_lagged(values, w).withColumnRenamed("i", "id"), "id", "left").na.fill(0.0, ["sw", "sww", "lag"])
    spread = F.col("sd") * F.sqrt(F.greatest(F.try_divide(F.col("n") * F.col("sww") - F.col("sw") * F.col("sw"), F.col("n") - 1), F.lit(0.0)))
    rows = rows.withColumn("z", F.when(spread > 1e-12, (F.col("lag") - F.col("mean") * F.col("sw")) / spread).otherwise(F.lit(0.0)))
    rows = rows.withColumn("p", two_sided_p(F.col("z")))
    level = F.when(F.abs("z") > 2.5758293035489, 3).when(F.abs("z") > 1.9599639845401, 2).when(F.abs("z") > 1.6448536269515, 1).otherwise(0)
    return rows.select("id", "z", "p", (F.signum("z") * level).cast("int").alias("bin"))


def bivariate_lee_l(values: DataFrame, w: DataFrame, x: str = "v", y: str = "v2") -> DataFrame:
    """(id, l, quadrant): standardised x times the weighted neighbours' standardised y."""
    zs = _standard(values, x, y)
    return _local_cross(zs, w).select("id", (F.col("zx") * F.col("lag")).alias("l"), _quadrant(F.col("zx"), F.col("lag")).alias("quadrant"))


def _standard(values: DataFrame, x: str, y: str) -> DataFrame:
    m = values.agg(*(f(c).alias(n) for c, a in ((x, "x"), (y, "y")) for f, n in ((F.avg, f"m{a}"), (F.stddev_pop, f"s{a}"))), F.count("*").cast("double").alias("n"))
    z = lambda c, a: F.when(F.col(f"s{a}") > 0, (F.col(c) - F.col(f"m{a}")) / F.col(f"s{a}")).otherwise(F.lit(0.0)).alias(f"z{a}")
    return values.crossJoin(F.broadcast(m)).select("id", z(x, "x"), z(y, "y"), "n")


def _local_cross(zs: DataFrame, w: DataFrame) -> DataFrame:
    lag = _lagged(zs, w, "zy").select(F.col("i").alias("id"), "lag", "sw", "sww")
    return zs.join(lag, "id", "left").na.fill(0.0, ["lag", "sw", "sww"])


def bivariate_moran(values: DataFrame, w: DataFrame, x: str = "v", y: str = "v2") -> DataFrame:
    """One row: mean of zx times the lag of zy, expectation -1/(n-1), variance 1/n - E^2, z, p."""
    out = _local_cross(_standard(values, x, y), w).agg(F.avg(F.col("zx") * F.col("lag")).alias("i"), F.max("n").alias("n"))
    out = out.withColumn("expected", F.try_divide(F.lit(-1.0), F.col("n") - 1)).withColumn("variance", F.try_divide(F.lit(1.0), F.col("n")) - F.col("expected") * F.col("expected"))
    out = out.withColumn("z", F.when(F.col("variance") > 0, (F.col("i") - F.col("expected")) / F.sqrt("variance")).otherwise(F.lit(0.0)))
    return out.select("i", "expected", "variance", "z", two_sided_p(F.col("z")).alias("p"))


def local_bivariate_moran(values: DataFrame, w: DataFrame, x: str = "v", y: str = "v2", alpha: float = 0.05) -> DataFrame:
    rows = _local_cross(_standard(values, x, y), w).withColumn("i", F.col("zx") * F.col("lag"))
    rows = rows.withColumn("z", F.coalesce(F.col("i") * F.sqrt(F.col("n") - 1), F.lit(0.0))).withColumn("p", two_sided_p(F.col("z")))
    return rows.select("id", "i", "z", "p", F.when(F.col("p") <= alpha, _quadrant(F.col("zx"), F.col("lag"))).otherwise("NS").alias("quadrant"))


def spatial_lag(values: DataFrame, w: DataFrame, standardize: bool = True) -> DataFrame:
    lag = _lagged(values, w).select(F.col("i").alias("id"), F.when(F.lit(standardize) & (F.col("sw") != 0), F.col("lag") / F.col("sw")).otherwise(F.col("lag")).alias("lag"))
    return values.select("id").join(lag, "id", "left").na.fill(0.0, ["lag"])


def weight_sums(values: DataFrame, w: DataFrame) -> DataFrame:
    """One row: S0, S1 (over the pairs that exist; the opposite weight is 0 if it doesn't) and S2."""
    ids = values.select("id")
    known = w.join(ids.select(F.col("id").alias("i")), "i", "left_semi").join(ids.select(F.col("id").alias("j")), "j", "left_semi").select("i", "j", "w")
    back = known.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("w").alias("w2"))
    s01 = known.join(back, ["i", "j"], "left").na.fill(0.0, ["w2"]).agg(F.sum("w").alias("s0"), (F.sum((F.col("w") + F.col("w2")) * (F.col("w") + F.col("w2"))) / 2).alias("s1"))
    ends = known.select(F.col("i").alias("k"), "w").unionByName(known.select(F.col("j").alias("k"), "w")).groupBy("k").agg(F.sum("w").alias("t"))
    return s01.crossJoin(ends.agg(F.sum(F.col("t") * F.col("t")).alias("s2")))


def _global_parts(values: DataFrame, w: DataFrame) -> DataFrame:
    w = stored(w.select("i", "j", "w"), "weights")
    z = _with_moments(values).withColumn("z", F.col("y") - F.col("mean"))
    sums = z.agg(F.sum(F.col("z") * F.col("z")).alias("m2"), F.sum(F.pow("z", F.lit(4.0))).alias("m4"), F.max("n").alias("n"))
    a, b = z.select(F.col("id").alias("i"), F.col("z").alias("zi")), z.select(F.col("id").alias("j"), F.col("z").alias("zj"))
    pairs = w.join(a, "i").join(b, "j").agg(F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("cross"), F.sum(F.col("w") * (F.col("zi") - F.col("zj")) * (F.col("zi") - F.col("zj"))).alias("diff"))
    return sums.crossJoin(pairs).crossJoin(weight_sums(values, w)).withColumn("k", F.try_divide(F.col("n") * F.col("m4"), F.col("m2") * F.col("m2")))


def global_moran(values: DataFrame, w: DataFrame) -> DataFrame:
    """One row: I, its expectation and variance under randomisation, z and p."""
    rows = _global_parts(values, w).withColumn("i", F.expr("coalesce(try_divide(n * cross, s0 * m2), 0D)")).withColumn("expected", F.expr("try_divide(-1D, n - 1)"))
    rows = rows.withColumn("variance", F.expr("try_divide(n * ((n*n - 3*n + 3) * s1 - n * s2 + 3 * s0*s0) - k * ((n*n - n) * s1 - 2 * n * s2 + 6 * s0*s0), (n-1) * (n-2) * (n-3) * s0*s0) - expected * expected"))
    rows = rows.withColumn("z", F.expr("case when variance > 0 then (i - expected) / sqrt(variance) else 0D end"))
    return rows.select("i", "expected", "variance", "z", two_sided_p(F.col("z")).alias("p"))


def global_geary(values: DataFrame, w: DataFrame) -> DataFrame:
    """One row: C, its expectation 1 and variance under normality, z and p."""
    rows = _global_parts(values, w).withColumn("c", F.expr("try_divide((n - 1) * diff, 2 * s0 * m2)"))
    rows = rows.withColumn("variance", F.expr("try_divide((2 * s1 + s2) * (n - 1) - 4 * s0*s0, 2 * (n + 1) * s0*s0)"))
    rows = rows.withColumn("z", F.expr("case when variance > 0 then (c - 1) / sqrt(variance) else 0D end"))
    return rows.select("c", F.lit(1.0).alias("expected"), "variance", "z", two_sided_p(F.col("z")).alias("p"))


def general_g(values: DataFrame, w: DataFrame) -> DataFrame:
    """One row: the share of products of values that neighbours make up, and its expectation."""
    y = values.select("id", F.col("v").alias("y"))
    near = w.join(y.select(F.col("id").alias("i"), F.col("y").alias("yi")), "i").join(y.select(F.col("id").alias("j"), F.col("y").alias("yj")), "j").where("i <> j")
    top = near.agg(F.sum(F.col("w") * F.col("yi") * F.col("yj")).alias("top"), F.sum("w").alias("s0"))
    tot = y.agg(F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("ss"), F.count("*").cast("double").alias("n"))
    return top.crossJoin(tot).select(F.expr("coalesce(try_divide(top, s * s - ss), 0D)").alias("g"), F.expr("try_divide(s0, n * (n - 1))").alias("expected"))


def local_moran(values: DataFrame, w: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(id, i, expected, variance, z, p, quadrant) with the kurtosis term in the variance; NS where p is above alpha."""
    z = _with_moments(values).withColumn("z", F.col("y") - F.col("mean"))
    m = z.agg((F.sum(F.col("z") * F.col("z")) / F.count("*")).alias("m2"), (F.sum(F.pow("z", F.lit(4.0))) / F.count("*")).alias("m4"))
    lag = _lagged(z.select("id", "z"), w, "z").withColumnRenamed("i", "id")
    rows = z.select("id", "z", "n").join(lag, "id", "left").na.fill(0.0, ["sw", "sww", "lag"]).crossJoin(F.broadcast(m))
    rows = rows.withColumn("i", F.expr("coalesce(try_divide(z * lag, m2), 0D)")).withColumn("expected", F.expr("try_divide(-sw, n - 1)")).withColumn("b2", F.expr("try_divide(m4, m2 * m2)"))
    rows = rows.withColumn("variance", F.expr("try_divide(sww * (n - b2), n - 1) + coalesce(try_divide((sw * sw - sww) * (2 * b2 - n), (n - 1) * (n - 2)), 0D) - expected * expected"))
    rows = rows.withColumn("zi", F.expr("case when variance > 0 then (i - expected) / sqrt(variance) else 0D end")).withColumn("p", two_sided_p(F.col("zi")))
    return rows.select("id", "i", "expected", "variance", F.col("zi").alias("z"), "p", F.when(F.col("p") < alpha, _quadrant(F.col("z"), F.col("lag"))).otherwise("NS").alias("quadrant"))


def fdr_adjust(df: DataFrame, p: str = "p", id_col: str = "id") -> DataFrame:
    """Adds ``p_adj``: Benjamini-Hochberg, from the largest p down. Equal p values share one rank (their last)."""
    counts = df.groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    counts = counts.where("_p is not null")
    up = running(counts, [F.col("_p")], {"_to": ("sum", F.col("_n"))}).crossJoin(F.broadcast(counts.agg(F.sum("_n").alias("_all"))))
    raw = up.select("_p", (F.col("_p") * F.col("_all") / F.col("_to")).alias("_q"))
    adj = running(raw, [F.col("_p").desc()], {"_least": ("min", F.col("_q"))}).select("_p", F.least("_least", F.lit(1.0)).alias("p_adj"))
    return df.join(adj, F.col(p) == F.col("_p"), "left").drop("_p")


def local_moran_fdr(values: DataFrame, w: DataFrame, alpha: float = 0.05) -> DataFrame:
    """``local_moran`` with ``p_adj`` by the false-discovery rate and whether that is ``significant``."""
    return fdr_adjust(local_moran(values, w, alpha)).withColumn("significant", F.col("p_adj") <= alpha)
