"""Distance joins through grid cells: no pair is made that isn't in neighbouring cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanloom.core.tables import stored


def distance(a: str = "l", b: str = "r") -> Column:
    dx, dy = F.col(f"{a}.x") - F.col(f"{b}.x"), F.col(f"{a}.y") - F.col(f"{b}.y")
    return F.sqrt(dx * dx + dy * dy)


def range_join(left: DataFrame, right: DataFrame, radius: float, left_cols: list[str], right_cols: list[str]) -> DataFrame:
    """Pairs within ``radius`` (inclusive) and their distance ``d``. Both sides have x and y.

    Each right row goes to the nine cells about its own, each left row to one, so a pair meets once. ``left_cols``
    and ``right_cols`` must not share names.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(float(radius)))
    l = left.where("x is not null and y is not null").select(*left_cols, F.col("x").alias("_lx"), F.col("y").alias("_ly"), cell("x").alias("_cx"), cell("y").alias("_cy"))
    around = F.array(*(F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    r = right.where("x is not null and y is not null").select(*right_cols, F.col("x").alias("_rx"), F.col("y").alias("_ry"), F.explode(around).alias("_c"))
    r = r.select(*right_cols, "_rx", "_ry", F.col("_c.cx").alias("_cx"), F.col("_c.cy").alias("_cy"))
    dx, dy = F.col("_lx") - F.col("_rx"), F.col("_ly") - F.col("_ry")
    pairs = l.join(r, ["_cx", "_cy"]).withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") <= radius)
    return pairs.select(*left_cols, *right_cols, "d")


def by_place(points: DataFrame, *sums: str) -> tuple[DataFrame, DataFrame]:
    """(id, x, y, sums ..) with one row for all points (id, x, y, sums ..) of a place, under their least id, and (id, place) of
    every point: what hangs on places alone is worked out once for all points of one, however many there are."""
    rows = points.select("id", *((F.col(c) + F.lit(0.0)).alias(c) for c in ("x", "y")), *sums)  # 0.0 and -0.0 are one place
    places = stored(rows.groupBy("x", "y").agg(F.min("id").alias("id"), *(F.sum(c).alias(c) for c in sums)).select("id", "x", "y", *sums), "places")
    at = places.select(F.col("id").alias("place"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    of = rows.select("id", "x", "y").join(at, F.col("x").eqNullSafe(F.col("_x")) & F.col("y").eqNullSafe(F.col("_y"))).groupBy("id").agg(F.min("place").alias("place"))
    return places, of


def nearest(left: DataFrame, right: DataFrame, k: int, left_key: str = "id", right_key: str = "id", exclude_self: bool = False, rounds: int = 40, within: float | None = None) -> DataFrame:
    """(i, j, d, rank): the k nearest right rows of each left row, ties by right key.

    The search begins with the radius at which a uniform pattern would have 2k neighbours and trebles for those left
    rows that don't have k within it, so far-off rows don't widen it for all. It ends when the radius spans everything
    or, where given, is ``within``, which bounds the distance.
    """
    box = right.agg(F.count("x").alias("n"), *(f(c).alias(f"{a}{c}") for c in "xy" for a, f in (("lo_", F.min), ("hi_", F.max)))).first()
    own = left.agg(*(f(c).alias(f"{a}{c}") for c in "xy" for a, f in (("lo_", F.min), ("hi_", F.max)))).first()
    todo, out = left.select(F.col(left_key).alias("i"), "x", "y"), None
    r = right.select(F.col(right_key).alias("j"), "x", "y")
    if box["lo_x"] is None or own["lo_x"] is None:
        span = radius = 1.0
    else:
        sides = [max(box[f"hi_{c}"], own[f"hi_{c}"]) - min(box[f"lo_{c}"], own[f"lo_{c}"]) for c in "xy"]
        span = sum(sides) + 1.0
        radius = min(span, max(math.sqrt(max(sides[0] * sides[1], 1e-9) * 2 * (k + 1) / (math.pi * max(box["n"], 1))), span * 1e-6))
    if within is not None:
        span = min(span, within)
        radius = min(radius, span)
    for _ in range(rounds):
        pairs = range_join(todo, r, radius, ["i"], ["j"])
        if exclude_self:
            pairs = pairs.where("i <> j")
        if k == 1:  # summed up before anything is moved
            ranked = pairs.groupBy("i").agg(F.min(F.struct("d", "j")).alias("n")).select("i", "n.j", "n.d", F.lit(1).alias("rank"))
        else:
            ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("rank") <= k)
        if radius >= span:
            return ranked if out is None else out.unionByName(ranked)
        ranked = stored(ranked, "near")  # k rows a left row; the pairs are made once
        done = ranked.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("i")
        settled = ranked.join(done, "i", "left_semi")
        out = settled if out is None else out.unionByName(settled)
        todo = stored(todo.join(done, "i", "left_anti"), "unsettled")
        if todo.isEmpty():
            return out
        radius = min(3 * radius, span)
    raise RuntimeError("the search radius never spanned the points")
