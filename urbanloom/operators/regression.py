"""Regression from sufficient statistics: one pass gathers the cross products, the driver solves a small system."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram(df: DataFrame, y: str, xs: list[str]) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'X and X'y with an intercept first, y'y and the number of complete rows."""
    ok = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [y, *xs]))
    cols = [F.lit(1.0), *(F.col(x).cast("double") for x in xs)]
    k = len(cols)
    sums = [F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(cols[i] * F.col(y)).alias(f"y{i}") for i in range(k)] + [F.sum(F.col(y) * F.col(y)).alias("yy")]
    row = ok.agg(*sums).first()
    a = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = row[f"g{i}_{j}"] or 0.0
    return a, np.array([row[f"y{i}"] or 0.0 for i in range(k)]), row["yy"] or 0.0, int(a[0, 0])


def ols(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """(term, beta, se, t, r2): least squares with an intercept; collinear terms share by the pseudo-inverse."""
    a, b, yy, n = gram(df, y, xs)
    inv = np.linalg.pinv(a)
    beta = inv @ b
    sse, mean = max(yy - beta @ b, 0.0), b[0] / max(n, 1)
    s2 = sse / max(n - len(beta), 1)
    se = np.sqrt(np.maximum(np.diag(inv) * s2, 0))
    sst = yy - n * mean * mean
    r2 = 1 - sse / sst if sst > 0 else 0.0
    rows = [(t, float(k), float(s), float(k / s) if s > 0 else 0.0, float(r2)) for t, k, s in zip(["intercept", *xs], beta, se)]
    return df.sparkSession.createDataFrame(rows, "term string, beta double, se double, t double, r2 double")


def difference_in_differences(df: DataFrame, before: str, after: str, treated: str) -> DataFrame:
    """One row: effect on the treated, in percent of their base and in all."""
    m = lambda c, t: F.coalesce(F.avg(F.when(F.col(treated) == t, F.col(c))), F.lit(0.0))
    out = df.agg(m(before, True).alias("tb"), m(after, True).alias("ta"), m(before, False).alias("cb"), m(after, False).alias("ca"), F.count_if(F.col(treated)).alias("n"))
    att = F.col("ta") - F.col("tb") - (F.col("ca") - F.col("cb"))
    return out.select(att.alias("att"), F.when(F.col("tb") > 0, att / F.col("tb") * 100).otherwise(F.lit(0.0)).alias("pct"), F.greatest(att * F.col("n"), F.lit(0.0)).alias("captured"))


def comparable_sales(target: dict[str, float], df: DataFrame, features: list[str], k: int = 5, w_space: float = 0.5, w_feature: float = 0.5) -> DataFrame:
    """(id, score): the k rows nearest to the target by scaled distance in space (x, y) and standardised features."""
    s = df.agg(*(F.stddev_pop(f).alias(f"s_{f}") for f in features))
    rows = df.crossJoin(F.broadcast(s))
    d2 = sum(((F.col(f) - target[f]) / F.when(F.col(f"s_{f}") > 0, F.col(f"s_{f}")).otherwise(F.lit(1.0))) ** 2 for f in features)
    rows = rows.select("id", F.sqrt((F.col("x") - target["x"]) ** 2 + (F.col("y") - target["y"]) ** 2).alias("ds"), F.sqrt(d2).alias("df"))
    m = rows.agg(F.max("ds").alias("ms"), F.max("df").alias("mf"))
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return rows.crossJoin(F.broadcast(m)).select("id", (w_space * part("ds", "ms") + w_feature * part("df", "mf")).alias("score")).orderBy("score", "id").limit(k)
