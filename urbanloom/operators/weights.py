"""Spatial weights as edge tables W(i, j, w) over points (id, x, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbanloom.core.spatial_join import nearest, range_join


def row_standardize(w: DataFrame) -> DataFrame:
    return w.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("i")))


def knn_weights(points: DataFrame, k: int = 4, row_standardized: bool = True) -> DataFrame:
    """The k nearest others of each point, ties by id; all others where there are fewer than k."""
    pairs = nearest(points, points, k, exclude_self=True).select("i", "j", F.lit(1.0).alias("w"))
    return row_standardize(pairs) if row_standardized else pairs


def _band(points: DataFrame, threshold: float) -> DataFrame:
    a, b = points.select(F.col("id").alias("i"), "x", "y"), points.select(F.col("id").alias("j"), "x", "y")
    return range_join(a, b, threshold, ["i"], ["j"]).where("i <> j")


def distance_band_weights(points: DataFrame, threshold: float, row_standardized: bool = True, binary: bool = True, power: float = 1.0) -> DataFrame:
    """All others within ``threshold``: weight 1, or the distance (at least 1e-12) to the power of -``power``."""
    w = F.lit(1.0) if binary else F.pow(F.greatest("d", F.lit(1e-12)), F.lit(-power))
    out = _band(points, threshold).select("i", "j", w.alias("w"))
    return row_standardize(out) if row_standardized else out


def auto_distance_band(points: DataFrame) -> DataFrame:
    """One row: the largest distance to a nearest neighbour."""
    return nearest(points, points, 1, exclude_self=True).agg(F.max("d").alias("band"))


def build_weights(points: DataFrame, mode: str = "knn", k: int = 8, distance: float = 0.0, include_self: bool = False, row_standardize_: bool = False, inverse_power: float = 1.0) -> DataFrame:
    """knn, distance_band, band (the same) or inverse weights; at distance 0 or less the largest distance to a nearest
    neighbour is the band. Rows are standardised before the self weights of 1 are added."""
    if mode == "knn":
        out = knn_weights(points, k, False)
    elif mode in ("inverse", "band", "distance_band"):
        if distance <= 0:
            distance = auto_distance_band(points).first()["band"] or 1.0
        near = _band(points, distance)
        w = F.when(F.col("d") > 0, F.pow("d", F.lit(-inverse_power))).otherwise(F.lit(0.0)) if mode == "inverse" else F.lit(1.0)
        out = near.select("i", "j", w.alias("w"))
    else:
        raise ValueError(f"no weights mode {mode!r}")
    if row_standardize_:
        out = out.withColumn("w", F.coalesce(F.try_divide("w", F.sum("w").over(Window.partitionBy("i"))), F.lit(0.0)))
    return out.unionByName(points.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("w"))) if include_self else out


def neighbour_counts(points: DataFrame, w: DataFrame) -> DataFrame:
    counts = w.groupBy("i").agg(F.count("*").alias("n"))
    return points.select("id").join(counts, F.col("id") == F.col("i"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
