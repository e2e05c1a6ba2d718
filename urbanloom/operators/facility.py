"""Facility location over candidates (id, x, y) and demand (id, x, y, pop): greedy rounds of joins and aggregates.

Pairs of candidates and demand are made once, within the radius, through grid cells, and written; each round is one
aggregate over them and one row to the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.core.blocks import blocks, over_pairs
from urbanloom.core.ordered import numbered
from urbanloom.core.spatial_join import by_place, nearest, range_join
from urbanloom.core.tables import stored


def _pairs(candidates: DataFrame, demand: DataFrame, radius: float) -> DataFrame:
    a, b = candidates.select(F.col("id").alias("f"), "x", "y"), demand.select(F.col("id").alias("i"), "pop", "x", "y")
    return stored(range_join(a, b, radius, ["f"], ["i", "pop"]), "cover")


def greedy_mclp(candidates: DataFrame, demand: DataFrame, radius: float, k: int) -> DataFrame:
    """(step, id, added, covered): the candidate that adds most people, k times or until none adds; ties by id."""
    pairs = _pairs(candidates, demand, radius)
    rows, covered = [], 0.0
    for step in range(1, k + 1):
        best = pairs.groupBy("f").agg(F.sum("pop").alias("gain")).orderBy(F.col("gain").desc(), "f").first()
        if best is None or best["gain"] <= 0:
            break
        covered += best["gain"]
        rows.append((step, best["f"], float(best["gain"]), float(covered)))
        pairs = stored(pairs.join(pairs.where(F.col("f") == best["f"]).select("i"), "i", "left_anti"), "cover")
    return candidates.sparkSession.createDataFrame(rows, "step int, id long, added double, covered double")


def greedy_lscp(candidates: DataFrame, demand: DataFrame, radius: float, share: float = 1.0) -> DataFrame:
    """The same until the share of all people is covered or no candidate adds any."""
    total = demand.agg(F.sum("pop").alias("t")).first()["t"] or 0.0
    out = greedy_mclp(candidates, demand, radius, candidates.count())
    return out.where(F.col("covered") - F.col("added") < share * total - 1e-9)


def greedy_p_median(candidates: DataFrame, demand: DataFrame, p: int) -> DataFrame:
    """(step, id, cost): p candidates, each time that which lowers the weighted distance most; ties by id.

    All pairs take part by definition; they are weighed in blocks, demand of one place together. Rows without a place are left out.
    """
    kind = candidates.schema["id"].dataType.simpleString()
    have = lambda df: df.na.drop(subset=["x", "y"])
    asked, _ = by_place(have(demand).selectExpr("id", "CAST(x AS DOUBLE) AS x", "CAST(y AS DOUBLE) AS y", "CAST(pop AS DOUBLE) AS pop"), "pop")
    c = blocks(have(candidates).selectExpr("id", "CAST(x AS DOUBLE) AS x", "CAST(y AS DOUBLE) AS y"), "id")
    d = blocks(asked.na.fill(0.0, ["pop"]), "id")
    rows: list[tuple] = []

    def weigh(a: dict, b: dict) -> pd.DataFrame:
        away = lambda x, y: np.sqrt((b["x"] - x) * (b["x"] - x) + (b["y"] - y) * (b["y"] - y))
        dist = away(a["x"][:, None], a["y"][:, None])
        for x, y in at:
            np.minimum(dist, away(x, y)[None], out=dist)
        return pd.DataFrame({"f": a["id"], "cost": (dist * b["pop"]).sum(axis=1)})

    at: list[tuple[float, float]] = []
    for step in range(1, p + 1):
        # added up in a fixed order, so that candidates of one place tie
        cost = over_pairs(c, d, weigh, f"f {kind}, cost double").groupBy("f").agg(F.aggregate(F.sort_array(F.collect_list("cost")), F.lit(0.0), lambda x, y: x + y).alias("cost"))
        top = cost.where(~F.col("f").isin([r[1] for r in rows]) if rows else F.lit(True)).orderBy("cost", "f").first()
        if top is None:
            break
        rows.append((step, top["f"], float(top["cost"])))
        one = candidates.where(F.col("id") == top["f"]).first()
        at.append((float(one["x"]), float(one["y"])))
    return candidates.sparkSession.createDataFrame(rows, f"step int, id {kind}, cost double")


def assign_to_nearest(candidates: DataFrame, demand: DataFrame) -> DataFrame:
    """(id, facility, d): nearest facility of each demand point, ties by id."""
    return nearest(demand, candidates, 1).select(F.col("i").alias("id"), F.col("j").alias("facility"), "d")


def rank_sites(cells: DataFrame, labels: DataFrame, cell_area: float, least_ha: float = 0.0) -> DataFrame:
    """(component, cells, area_ha, mean, max, rank) of labelled cells (r, c, component), best mean first, then area."""
    s = labels.join(cells, ["r", "c"]).groupBy("component").agg(F.count("*").alias("cells"), F.avg("z").alias("mean"), F.max("z").alias("max"))
    s = s.withColumn("area_ha", F.col("cells") * cell_area / 10000).where(F.col("area_ha") >= least_ha)
    return numbered(s.select("component", "cells", "area_ha", "mean", "max"), [F.col("mean").desc(), F.col("area_ha").desc(), F.col("component").asc()])


def label_components(cells: DataFrame, mask: str, connectivity: int = 8) -> DataFrame:
    """(r, c, component): connected cells of the mask; a component bears the key of its first cell by row and column."""
    from urbanloom.core.graph import components

    on = cells.where(F.col(mask)).select("r", "c", (F.col("r").cast("long") * 4294967296 + F.col("c")).alias("k"))
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    near = F.explode(F.array(*(((F.col("r") + i).cast("long") * 4294967296 + (F.col("c") + j)) for i, j in steps))).alias("v")
    links = on.select(F.col("k").alias("u"), near).join(on.select(F.col("k").alias("v")), "v", "left_semi")
    found = components(links.select("u", "v"))
    return on.join(found, F.col("k") == F.col("node"), "left").select("r", "c", F.coalesce("component", "k").alias("component"))
