"""Profiles of ways: grades and walking time; and which part of each edge a cost budget reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbanloom.functions import intervals as I


def grade_stats(points: DataFrame) -> DataFrame:
    """(id, mean, max, climb, descent) of profiles (id, seq, z, d): absolute grades over the way that goes forward, all heights
    gained and lost; 0 where a profile doesn't go forward."""
    w = Window.partitionBy("id").orderBy("seq")
    rows = points.select("id", (F.col("z") - F.lag("z").over(w)).alias("dz"), (F.col("d") - F.lag("d").over(w)).alias("dd"))
    on = F.col("dd") > 0
    t = rows.groupBy("id").agg(
        F.sum(F.when(on, F.abs("dz"))).alias("rise"),
        F.sum(F.when(on, F.col("dd"))).alias("way"),
        F.max(F.when(on, F.abs(F.col("dz") / F.col("dd")))).alias("max"),
        F.sum(F.greatest("dz", F.lit(0.0))).alias("climb"),
        F.sum(F.greatest(-F.col("dz"), F.lit(0.0))).alias("descent"),
    )
    moved = lambda c: F.when(F.col("way") > 0, F.coalesce(c, F.lit(0.0))).otherwise(F.lit(0.0))
    return t.select("id", moved(F.col("rise") / F.col("way")).alias("mean"), *(moved(F.col(c)).alias(c) for c in ("max", "climb", "descent")))


def walking_minutes(parts: DataFrame) -> DataFrame:
    """(id, minutes) of parts (id, grade, length in metres) by Tobler's speed for each grade."""
    speed = 6 * F.exp(-3.5 * F.abs(F.col("grade") + 0.05))
    return parts.groupBy("id").agg(F.sum(F.col("length") / 1000 / speed * 60).alias("minutes"))


def reach_intervals(edges: DataFrame, costs: DataFrame, cutoff: float, entries: DataFrame | None = None) -> DataFrame:
    """(edge, intervals) of the edges (edge, src, dst, cost) that the budget touches, from costs (node, dist); entries (edge, t, snap) within
    an edge add the stretch about them."""
    ends = [costs.select(F.col("node").alias(n), F.col("dist").alias(f"_{n}")) for n in ("src", "dst")]
    rows = edges.select("edge", "src", "dst", "cost").join(ends[0], "src", "left").join(ends[1], "dst", "left")
    rows = rows.select("edge", "cost", I.of_edge(I.reach(F.col("_src"), F.col("_dst"), F.col("cost"), cutoff)).alias("own"))
    if entries is not None:
        # an edge's entries are few; they are made one before they are joined
        near = entries.join(edges.select("edge", "cost"), "edge").select("edge", I.about(F.col("t"), F.col("snap"), F.col("cost"), cutoff).alias("x"))
        near = near.where("x is not null").groupBy("edge").agg(I.merged(F.collect_list("x")).alias("more"))
        rows = rows.join(near, "edge", "left").select("edge", F.when(F.col("more").isNull(), F.col("own")).otherwise(I.merged(F.concat("own", "more"))).alias("own"))
    return rows.where("size(own) > 0").select("edge", F.col("own").alias("intervals"))
