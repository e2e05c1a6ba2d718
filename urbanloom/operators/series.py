"""Time series (k, t, v): trend tests, anomalies, smoothing and forecast scores, one row or one key a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbanloom.core.exprs import two_sided_p


def mann_kendall(series: DataFrame) -> DataFrame:
    """(k, n, s, variance, z, p, slope, tau): tie-corrected; the slope is the upper median of the pairs that differ.

    The pairs of one key are those of its own times, which the test compares by definition.
    """
    a = series.select("k", F.col("t").alias("t0"), F.col("v").alias("v0"))
    pairs = a.join(series, "k").where("t > t0").select("k", F.signum(F.col("v") - F.col("v0")).alias("sg"), ((F.col("v") - F.col("v0")) / (F.col("t") - F.col("t0"))).alias("slope"))
    s = pairs.groupBy("k").agg(F.sum("sg").alias("s"))
    moved = pairs.where("sg <> 0")
    w = Window.partitionBy("k")
    at = moved.select("k", "slope", F.row_number().over(w.orderBy("slope")).alias("r"), F.count("*").over(w).alias("m")).where("r = floor(m / 2) + 1").select("k", "slope")
    ties = series.groupBy("k", "v").agg(F.count("*").alias("c")).groupBy("k").agg(F.sum("c").cast("double").alias("n"), F.sum(F.col("c") * (F.col("c") - 1) * (2 * F.col("c") + 5)).alias("ties"))
    out = ties.join(s, "k").join(at, "k", "left").withColumn("variance", F.expr("(n * (n - 1) * (2 * n + 5) - ties) / 18"))
    out = out.withColumn("z", F.expr("case when variance <= 0 then 0D when s > 0 then (s - 1) / sqrt(variance) when s < 0 then (s + 1) / sqrt(variance) else 0D end"))
    return out.select("k", F.col("n").cast("long").alias("n"), "s", "variance", "z", two_sided_p(F.col("z")).alias("p"), F.coalesce("slope", F.lit(0.0)).alias("slope"), F.expr("s / (n * (n - 1) / 2)").alias("tau"))


def classify_trend(tests: DataFrame, level: float = 0.05) -> DataFrame:
    """Adds ``trend``: 1 up, 2 down, 0 none."""
    return tests.withColumn("trend", F.when((F.col("p") < level) & (F.col("slope") > 0), 1).when((F.col("p") < level) & (F.col("slope") < 0), 2).otherwise(0))


def sen_intercept(series: DataFrame, slopes: DataFrame) -> DataFrame:
    """(k, intercept): median of v - slope * t."""
    return series.join(slopes.select("k", "slope"), "k").groupBy("k").agg(F.percentile(F.col("v") - F.col("slope") * F.col("t"), F.lit(0.5)).alias("intercept"))


def robust_zscores(series: DataFrame) -> DataFrame:
    """Adds ``z``: .6745 (v - median) / MAD; where the MAD is 0 the ordinary z-score."""
    m = series.groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("_m"), F.avg("v").alias("_a"), F.stddev_pop("v").alias("_s"))
    rows = series.join(m, "k")
    mad = rows.groupBy("k").agg(F.percentile(F.abs(F.col("v") - F.col("_m")), F.lit(0.5)).alias("_d"))
    z = F.when(F.col("_d") > 0, 0.6745 * (F.col("v") - F.col("_m")) / F.col("_d")).when(F.col("_s") > 0, (F.col("v") - F.col("_a")) / F.col("_s")).otherwise(F.lit(0.0))
    return rows.join(mad, "k").select("k", "t", "v", z.alias("z"))


def detect_anomalies(series: DataFrame, threshold: float = 3.0) -> DataFrame:
    return robust_zscores(series).withColumn("anomaly", F.abs("z") >= threshold)


def exponential_smoothing(series: DataFrame, alpha: float = 0.3, steps: int = 5) -> DataFrame:
    """(k, level, forecast): the last smoothed level, repeated over the steps ahead (a flat forecast)."""
    w = Window.partitionBy("k").orderBy(F.col("t").desc())
    rows = series.select("k", "v", (F.row_number().over(w) - 1).alias("age"), F.count("*").over(Window.partitionBy("k")).alias("n"))
    share = F.when(F.col("age") == F.col("n") - 1, F.lit(1.0)).otherwise(F.lit(alpha)) * F.pow(F.lit(1 - alpha), F.col("age").cast("double"))
    return rows.groupBy("k").agg(F.sum(share * F.col("v")).alias("level")).select("k", "level", F.array_repeat("level", steps).alias("forecast"))


def forecast_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    e = F.col(actual) - F.col(predicted)
    share = F.when(F.abs(actual) > 1e-9, F.abs(e / F.col(actual)))
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (100 * F.coalesce(F.avg(share), F.lit(0.0))).alias("mape"))


def forecast_cells(series: DataFrame, steps: int = 5, alpha: float = 0.3) -> DataFrame:
    """(k, method, ahead, value): a forecast of each series (k, t, v) over the steps ahead; nulls, NaN and infinities don't count.

    One value is repeated (constant), none gives 0 (none); others are smoothed exponentially. That is also what autoregressive
    and forest forecasts come to where their libraries are missing, as here.
    """
    v = F.col("v").cast("double")
    known = series.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).select("k", "t", v.alias("v"))
    levels = exponential_smoothing(known, alpha, steps).select("k", "level")
    n = known.groupBy("k").agg(F.count("*").alias("n"))
    every = series.select("k").distinct().join(n, "k", "left").join(levels, "k", "left")
    method = F.when(F.col("n").isNull(), "none").when(F.col("n") < 2, "constant").otherwise("exponential_smoothing")
    return every.select("k", method.alias("method"), F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("ahead"), F.coalesce("level", F.lit(0.0)).alias("value"))


def backtest(series: DataFrame, holdout: int = 3, alpha: float = 0.3) -> DataFrame:
    """(k, n_train, n_test, mae, rmse, mape): the last ``holdout`` values of each series (k, t, v) against a forecast from those before; series
    with fewer than two values more are left out."""
    v = F.col("v").cast("double")
    known = series.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    w = Window.partitionBy("k")
    rows = known.select("k", "t", v.alias("v"), F.row_number().over(w.orderBy(F.col("t").desc())).alias("back"), F.count("*").over(w).alias("n")).where((F.col("n") >= holdout + 2) & F.lit(holdout >= 1))
    levels = exponential_smoothing(rows.where(F.col("back") > holdout), alpha, 1).select("k", "level")
    e = F.col("v") - F.col("level")
    t = rows.where(F.col("back") <= holdout).join(levels, "k").groupBy("k").agg((F.max("n") - holdout).alias("n_train"), F.count("*").alias("n_test"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (100 * F.avg(F.when(F.abs("v") > 1e-9, F.abs(e / F.col("v"))))).alias("mape"))
    return t.select("k", "n_train", "n_test", "mae", "rmse", "mape")


def space_time_cube(points: DataFrame, cell: float, steps: int, how: str = "mean") -> DataFrame:
    """(bx, by, bt, value, n) from (x, y, t, v): bins from the minima; what lies on the last border falls in the last bin."""
    b = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    rows = points.crossJoin(F.broadcast(b))
    bins = lambda c: F.least(F.floor((F.col(c) - F.col(f"{c}0")) / cell), F.greatest(F.ceil((F.col(f"{c}1") - F.col(f"{c}0")) / cell) - 1, F.lit(0)))
    span = F.when(F.col("t1") > F.col("t0"), F.col("t1") - F.col("t0")).otherwise(F.lit(1.0))
    bt = F.least(F.floor((F.col("t") - F.col("t0")) / span * steps), F.lit(steps - 1))
    agg = {"mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "std": F.stddev_pop}[how]
    return rows.select(bins("x").alias("bx"), bins("y").alias("by"), bt.alias("bt"), "v").groupBy("bx", "by", "bt").agg(agg("v").cast("double").alias("value"), F.count("*").alias("n"))


def regression_quality(df: DataFrame, y: str, fitted: str, n_params: int) -> DataFrame:
    """One row: R2, adjusted R2, RMSE, MAE and AIC."""
    e = F.col(y) - F.col(fitted)
    t = df.agg(F.sum(e * e).alias("sse"), (F.var_pop(y) * F.count("*")).alias("sst"), F.count("*").cast("double").alias("n"), F.avg(F.abs(e)).alias("mae"))
    r2 = F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).otherwise(F.lit(0.0))
    return t.select(r2.alias("r2"), (1 - (1 - r2) * (F.col("n") - 1) / (F.col("n") - n_params - 1)).alias("adj_r2"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), "mae", (F.col("n") * F.ln(F.col("sse") / F.col("n")) + 2 * (n_params + 1)).alias("aic"))
