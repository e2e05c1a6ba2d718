"""Interpolation from sources (id, x, y, v) to targets (id, x, y)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.core.spatial_join import nearest, range_join
from urbanloom.core.tables import stored
from urbanloom.session import ship

#: Share of a target's weights that sources out of reach may have together.
PRECISION = 1e-16


def idw(sources: DataFrame, targets: DataFrame, power: float = 2.0, max_points: int = 12, radius: float | None = None) -> DataFrame:
    """(id, value): inverse-distance mean of the nearest sources, within ``radius`` if given; a source at the target
    gives its own value (ties by id); null where no source counts."""
    if radius is None:
        near = nearest(targets, sources, max_points)
    else:
        from pyspark.sql import Window

        near = range_join(targets.select(F.col("id").alias("i"), "x", "y"), sources.select(F.col("id").alias("j"), "x", "y"), radius, ["i"], ["j"])
        near = near.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("rank") <= max_points)
    rows = near.join(sources.select(F.col("id").alias("j"), "v"), "j")
    w = F.pow(F.greatest("d", F.lit(1e-12)), F.lit(-power))
    hit = F.min(F.when(F.col("d") < 1e-12, F.struct("j", "v")))
    out = rows.groupBy("i").agg(hit.alias("hit"), (F.sum(w * F.col("v")) / F.sum(w)).alias("mean"))
    return targets.select("id").join(out, F.col("id") == F.col("i"), "left").select("id", F.coalesce("hit.v", "mean").alias("value"))


def grid(spark, xmin: float, ymin: float, xmax: float, ymax: float, cell: float) -> DataFrame:
    """(id, row, col, x, y): cell centres, rows from north to south."""
    cols, rows = max(1, round((xmax - xmin) / cell)), max(1, round((ymax - ymin) / cell))
    i = spark.range(cols * rows)
    out = i.select("id", F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    return out.withColumn("x", xmin + (F.col("col") + 0.5) * cell).withColumn("y", ymax - (F.col("row") + 0.5) * cell)


def space_time_weighting(sources: DataFrame, targets: DataFrame, space: float, time: float, nugget: float = 0.0, sill: float = 1.0) -> DataFrame:
    """(id, value, variance) for each target by weights exp(-d) of the scaled space-time distance to all sources (x, y, t, v).

    Sources are met within a radius beyond which all weights together are below the precision of a double for a target
    whose own weights sum to e^-10; targets that this doesn't settle get a pass over all sources. Where every weight is
    zero the value is the plain mean and the variance the sill. Sources with a null don't count; a target with a null,
    or without any source, gets nulls.
    """
    space, time = max(space, 1e-6), max(time, 1e-6)
    b = sources.select("x", "y", F.col("t").alias("tj"), "v").na.drop()
    n = b.count()
    radius = math.log(max(n, 1) / PRECISION) + 10
    at = targets.select("x", "y", F.col("t").alias("ti")).distinct()
    dt = (F.col("ti") - F.col("tj")) / time
    w = F.exp(-F.sqrt((F.col("d") / space) * (F.col("d") / space) + dt * dt))
    sums = [F.sum("w").alias("w"), F.sum(F.col("w") * F.col("v")).alias("wv"), F.max("w").alias("most"), F.avg("v").alias("mean")]
    near = range_join(at, b, radius * space, ["x", "y", "ti"], ["tj", "v"]).withColumn("w", w).groupBy("x", "y", "ti").agg(*sums)
    near = stored(near.where(F.col("w") * PRECISION >= n * math.exp(-radius)), "settled")
    same = lambda l, r: F.col(f"{l}.x").eqNullSafe(F.col(f"{r}.x")) & F.col(f"{l}.y").eqNullSafe(F.col(f"{r}.y")) & F.col(f"{l}.ti").eqNullSafe(F.col(f"{r}.ti"))
    rest = at.na.drop().alias("a").join(near.alias("n"), same("a", "n"), "left_anti")
    dx, dy = F.col("x") - F.col("_sx"), F.col("y") - F.col("_sy")
    far = rest.crossJoin(b.withColumnsRenamed({"x": "_sx", "y": "_sy"})).withColumn("d", F.sqrt(dx * dx + dy * dy)).withColumn("w", w).groupBy("x", "y", "ti").agg(*sums)
    value = F.when(F.col("w") > 0, F.col("wv") / F.col("w")).otherwise(F.col("mean"))
    variance = F.when(F.col("w") > 0, sill * (1 - F.col("most") / F.col("w")) + nugget).when(F.col("w") == 0, F.lit(float(sill)))
    out = near.unionByName(far).select("x", "y", "ti", value.alias("value"), variance.alias("variance"))
    return targets.select("id", "x", "y", F.col("t").alias("ti")).alias("a").join(out.alias("o"), same("a", "o"), "left").select("a.id", "o.value", "o.variance")


def cells_of(spark, bounds: tuple[float, float, float, float], cell: float) -> DataFrame:
    """(id, row, col, x, y): the centres that lie inside the bounds (xmin, ymin, xmax, ymax), counted from the lower left corner, rows
    from north to south."""
    xmin, ymin, xmax, ymax = bounds
    if xmin >= xmax or ymin >= ymax or cell <= 0:
        raise ValueError("bounds must be (xmin, ymin, xmax, ymax) and the cell above 0")
    cols, rows = (max(0, math.ceil((b - a - cell / 2) / cell)) for a, b in ((xmin, xmax), (ymin, ymax)))
    i = spark.range(cols * rows).select("id", F.floor(F.col("id") / max(cols, 1)).cast("int").alias("row"), (F.col("id") % max(cols, 1)).cast("int").alias("col"))
    return i.withColumn("x", F.lit(xmin + cell / 2) + F.col("col") * cell).withColumn("y", F.lit(ymin + cell / 2) + (rows - 1 - F.col("row")) * cell)


def idw_grid(sources: DataFrame, bounds: tuple[float, float, float, float], cell: float, power: float = 2.0, max_points: int = 12, radius: float | None = None) -> DataFrame:
    """(row, col, value): inverse-distance means at the cells' centres."""
    grid_ = cells_of(sources.sparkSession, bounds, cell)
    return grid_.select("id", "row", "col").join(idw(sources, grid_, power, max_points, radius), "id").select("row", "col", "value")


#: Sources of one kriging system; beyond them a target takes its nearest ones.
SYSTEM = 2000


def semivariance(h: np.ndarray, model: str, nugget: float, sill: float, range_: float) -> np.ndarray:
    part, u = sill - nugget, np.maximum(h, 0.0) / range_
    shapes = {"linear": lambda: np.maximum(h, 0.0), "spherical": lambda: np.where(u <= 1, 1.5 * u - 0.5 * u**3, 1.0), "exponential": lambda: 1 - np.exp(-3 * u), "gaussian": lambda: 1 - np.exp(-3 * u * u)}
    if model not in shapes:
        raise ValueError(f"no model {model!r}")
    return nugget + part * shapes[model]()


def kriging(sources: DataFrame, targets: DataFrame, model: str = "spherical", nugget: float = 0.0, sill: float = 1.0, range_: float = 10.0, neighbours: int = SYSTEM) -> DataFrame:
    """(id, value, variance) by ordinary kriging from sources (id, x, y, v); nulls where the system has no solution.

    Up to ``neighbours`` sources all of them make one system, which is sent to the tasks; of more, each target's
    nearest ones make its own.
    """
    if range_ <= 0 or sill < nugget:
        raise ValueError("the range must be above 0 and the sill at least the nugget")
    model = model.lower()
    semivariance(np.zeros(1), model, nugget, sill, range_)
    own = sources.where("x is not null and y is not null and v is not null")
    kind = targets.schema["id"].dataType.simpleString()
    schema = f"id {kind}, value double, variance double"

    def solve(xy: np.ndarray, v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(xy)
        k = np.ones((n + 1, n + 1))
        k[:n, :n] = semivariance(np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1)), model, nugget, sill, range_) + 1e-9 * np.eye(n)
        k[n, n] = 0.0
        f = np.ones((n + 1, len(at)))
        f[:n] = semivariance(np.hypot(*(xy[:, None] - at[None]).transpose(2, 0, 1)), model, nugget, sill, range_)
        try:
            w = np.linalg.solve(k, f)
        except np.linalg.LinAlgError:
            return np.full(len(at), np.nan), np.full(len(at), np.nan)
        return w[:n].T @ v, np.maximum((w * f).sum(axis=0), 0.0)

    if own.limit(neighbours + 1).count() <= neighbours:
        pdf = own.select(F.col("x").cast("double"), F.col("y").cast("double"), F.col("v").cast("double")).toPandas()
        xy, v = pdf[["x", "y"]].to_numpy(), pdf["v"].to_numpy()

        def run(batches):
            for b in batches:
                at = b[["x", "y"]].to_numpy(float)
                value, var = solve(xy, v, at) if len(xy) and len(b) else (np.full(len(b), np.nan),) * 2
                yield pd.DataFrame({"id": b["id"], "value": value, "variance": var})

        out = targets.select("id", "x", "y").mapInPandas(run, schema)
    else:
        near = nearest(targets, own, neighbours).select("i", "j").join(own.select(F.col("id").alias("j"), F.col("x").alias("sx"), F.col("y").alias("sy"), "v"), "j").join(targets.select(F.col("id").alias("i"), "x", "y"), "i")

        def one(b: pd.DataFrame) -> pd.DataFrame:
            value, var = solve(b[["sx", "sy"]].to_numpy(float), b["v"].to_numpy(float), b[["x", "y"]].to_numpy(float)[:1])
            return pd.DataFrame({"id": [b["i"].iloc[0]], "value": value, "variance": var})

        ship(near.sparkSession)
        out = near.groupBy("i").applyInPandas(one, schema)
    clean = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select("id", clean("value"), clean("variance"))


def kriging_grid(sources: DataFrame, bounds: tuple[float, float, float, float], cell: float, model: str = "spherical", nugget: float = 0.0, sill: float = 1.0, range_: float = 10.0) -> DataFrame:
    """(row, col, value, variance) at the cells' centres."""
    grid_ = cells_of(sources.sparkSession, bounds, cell)
    return grid_.select("id", "row", "col").join(kriging(sources, grid_, model, nugget, sill, range_), "id").select("row", "col", "value", "variance")
