"""Rasters as cells (r, c, z, ...): neighbours are joined by offset, each cell once with its eight neighbours' values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.core.tables import stored

OFFSETS = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def neighbourhood(cells: DataFrame, value: str = "z") -> DataFrame:
    """(r, c, v_-1_-1 .. v_1_1): the 3 x 3 values about each cell, null where a neighbour is missing.

    Each cell sends its value to nine places and one aggregate gathers them: one shuffle, no self-join.
    """
    at = F.explode(F.array(*(F.struct((F.col("r") - i).alias("r"), (F.col("c") - j).alias("c"), F.lit(k).alias("k")) for k, (i, j) in enumerate(OFFSETS))))
    sent = cells.select(at.alias("p"), F.col(value).alias("v")).select("p.r", "p.c", "p.k", "v")
    names = [f"n{k}" for k in range(9)]
    out = sent.groupBy("r", "c").agg(*(F.max(F.when(F.col("k") == k, F.col("v"))).alias(n) for k, n in enumerate(names)), F.max(F.col("k") == 4).alias("own"))
    return out.where("own").drop("own")


def slope(cells: DataFrame, cell: float = 1.0, value: str = "z") -> DataFrame:
    """(r, c, slope, aspect) in degrees by Horn's weights; a missing neighbour takes the cell's own value."""
    n = neighbourhood(cells, value)
    v = [F.coalesce(f"n{k}", "n4") for k in range(9)]
    dx = ((v[2] + 2 * v[5] + v[8]) - (v[0] + 2 * v[3] + v[6])) / (8 * cell)
    dy = ((v[6] + 2 * v[7] + v[8]) - (v[0] + 2 * v[1] + v[2])) / (8 * cell)
    n = n.withColumn("dx", dx).withColumn("dy", dy)
    aspect = F.expr("case when dx = 0 and dy = 0 then -1D else pmod(degrees(atan2(-dx, dy)) + 360, 360D) end")
    return n.select("r", "c", F.degrees(F.atan(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))).alias("slope"), aspect.alias("aspect"))


#: Codes of the eight flow directions, from east clockwise, with their offsets.
D8 = ((1, 0, 1), (2, 1, 1), (4, 1, 0), (8, 1, -1), (16, 0, -1), (32, -1, -1), (64, -1, 0), (128, -1, 1))


def d8_flow(cells: DataFrame, value: str = "z") -> DataFrame:
    """(r, c, dir): code of the steepest way down, 0 in pits; the first code in order wins ties."""
    n = neighbourhood(cells, value)
    drops = [F.struct(((F.col("n4") - F.col(f"n{OFFSETS.index((i, j))}")) / (1.0 if i == 0 or j == 0 else 2**0.5)).alias("drop"), F.lit(-k).alias("k"), F.lit(code).alias("code")) for k, (code, i, j) in enumerate(D8)]
    best = F.array_max(F.filter(F.array(*drops), lambda x: x["drop"] > 0))
    return n.select("r", "c", F.coalesce(best["code"], F.lit(0)).alias("dir"))


def flow_accumulation(cells: DataFrame, value: str = "z", rounds: int = 64) -> DataFrame:
    """(r, c, n): cells that drain through each cell, itself included, by pointer doubling.

    After round k every cell has sent its count 2^k steps down, so rounds grow with the logarithm of the longest way.
    """
    code = F.create_map(*(x for c, i, j in D8 for x in (F.lit(c), F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")))))
    d = d8_flow(cells, value)
    step = code[F.col("dir")]
    to = F.when(F.col("dir") > 0, F.struct((F.col("r") + step["i"]).alias("r"), (F.col("c") + step["j"]).alias("c")))
    links = stored(d.select("r", "c", to.alias("to"), F.lit(1).cast("long").alias("n")), "flow")
    for _ in range(rounds):
        moving = links.where("to is not null")
        if moving.isEmpty():
            return links.select("r", "c", "n")
        got = moving.groupBy("to").agg(F.sum("n").alias("g")).select(F.col("to.r").alias("r"), F.col("to.c").alias("c"), "g")
        jump = links.select(F.struct("r", "c").alias("to"), F.col("to").alias("next"))
        links = stored(links.join(got, ["r", "c"], "left").join(jump, "to", "left").select("r", "c", F.col("next").alias("to"), (F.col("n") + F.coalesce("g", F.lit(0))).alias("n")), "flow")
    raise RuntimeError("the flow doesn't end")


def change_matrix(cells: DataFrame, before: str, after: str) -> DataFrame:
    """(before, after, cells): cross-tabulation of two classifications."""
    return cells.groupBy(F.col(before).alias("before"), F.col(after).alias("after")).agg(F.count("*").alias("cells"))


def transition_probabilities(cells: DataFrame, before: str, after: str) -> DataFrame:
    from pyspark.sql import Window

    return change_matrix(cells, before, after).withColumn("p", F.col("cells") / F.sum("cells").over(Window.partitionBy("before")))


def edge_length(cells: DataFrame, mask: str, pixel: float = 1.0) -> DataFrame:
    """One row: border between cells of the mask and others, over the four neighbours inside the raster."""
    n = neighbourhood(cells.select("r", "c", F.col(mask).cast("int").alias("m")), "m")
    sides = [OFFSETS.index(x) for x in ((0, 1), (1, 0))]
    return n.agg((pixel * F.sum(sum((F.coalesce((F.col("n4") != F.col(f"n{k}")).cast("long"), F.lit(0)) for k in sides), F.lit(0)))).alias("edge"))


def local_relief(cells: DataFrame, value: str = "z") -> DataFrame:
    n = neighbourhood(cells, value)
    all_of = [f"n{k}" for k in range(9)]
    return n.select("r", "c", (F.greatest(*all_of) - F.least(*all_of)).alias("relief"))


def landslide_susceptibility(cells: DataFrame, cell: float, soil: str, cover: str, w_slope: float = 0.5, w_soil: float = 0.25, w_cover: float = 0.25) -> DataFrame:
    """(r, c, score): slope from 5 to 35 degrees, soil and land cover (0..100), weighted."""
    s = slope(cells, cell).join(cells.select("r", "c", soil, cover), ["r", "c"])
    steep = F.least(F.greatest((F.col("slope") - 5) / 30 * 100, F.lit(0.0)), F.lit(100.0))
    return s.select("r", "c", ((w_slope * steep + w_soil * F.col(soil) + w_cover * F.col(cover)) / (w_slope + w_soil + w_cover)).alias("score"))
