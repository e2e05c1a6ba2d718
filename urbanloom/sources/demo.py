"""A made-up city of square blocks and a diagonal street: streets, blocks with uses, buildings, places, people, heights.

All of it follows from the seed; it is made by the executors, block by block, so it can be as large as wanted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Uses and their shares; the first four blocks have one each.
USES = (("residential", 0.6), ("commercial", 0.2), ("green", 0.15), ("school", 0.05))
#: Shares of a block's side: margin, building and gap; heights from and to; people for a cubic metre.
MARGIN, SIDE, GAP = 0.1, 0.35, 0.1
HEIGHTS, PEOPLE = (3.0, 40.0), 0.005


def _draw(seed: int, *key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 52)).cast("double") / float(1 << 52)


def demo_city(spark: SparkSession, seed: int, blocks_x: int, blocks_y: int, size: float, pixel: float = 2.0) -> dict[str, DataFrame]:
    """streets (x0, y0, x1, y1), blocks (bx, by, x, y, size, use), buildings (bx, by, k, x0, y0, x1, y1, height), places (bx, by, x, y, kind), facilities (name, x, y, capacity), demand
    (bx, by, k, x, y, pop) and heights (r, c, z), rows from the north."""
    w, h = blocks_x * size, blocks_y * size
    rise = h / w if w > 0 else 0.0

    def lines(n: int, along: int, far: float, cross) -> DataFrame:
        """(at, a, b): the stretches of n + 1 parallel streets between crossings, the diagonal's included."""
        at = F.col("id") * size
        nodes = F.array_sort(F.array_distinct(F.array_append(F.transform(F.sequence(F.lit(0), F.lit(along)), lambda k: k * size), cross(at))))
        nodes = F.filter(nodes, lambda v: (v >= 0) & (v <= far))
        rows = spark.range(n + 1).select(at.alias("at"), nodes.alias("v"))
        return rows.select("at", F.explode(F.arrays_zip(F.slice("v", 1, F.size("v") - 1).alias("a"), F.slice("v", 2, F.size("v")).alias("b"))).alias("s")).select("at", "s.a", "s.b").where("b - a > 1e-5")

    up = lines(blocks_x, blocks_y, h, lambda x: rise * x).select(F.col("at").alias("x0"), F.col("a").alias("y0"), F.col("at").alias("x1"), F.col("b").alias("y1"))
    level = lines(blocks_y, blocks_x, w, lambda y: y / rise if rise > 0 else F.lit(0.0)).select(F.col("a").alias("x0"), F.col("at").alias("y0"), F.col("b").alias("x1"), F.col("at").alias("y1"))
    # the diagonal between the crossings with streets of either way
    ways = F.array_sort(F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0), F.lit(blocks_x)), lambda k: F.round(k * size, 6)), F.transform(F.sequence(F.lit(0), F.lit(blocks_y)), lambda k: F.round(k * size / rise, 6) if rise > 0 else F.lit(0.0)))))
    diagonal = spark.range(1).select(ways.alias("v")).select(F.explode(F.arrays_zip(F.slice("v", 1, F.size("v") - 1).alias("a"), F.slice("v", 2, F.size("v")).alias("b"))).alias("s"))
    diagonal = diagonal.select(F.col("s.a").alias("x0"), (F.col("s.a") * rise).alias("y0"), F.col("s.b").alias("x1"), (F.col("s.b") * rise).alias("y1")).where("x1 - x0 > 1e-5")
    streets = up.unionByName(level).unionByName(diagonal)

    key = spark.range(blocks_x * blocks_y).select((F.col("id") / blocks_y).cast("int").alias("bx"), F.pmod("id", F.lit(blocks_y)).cast("int").alias("by"))
    use, upto = F.lit(USES[-1][0]), 1.0
    for name, share in reversed(USES[:-1]):
        upto = sum(s for n, s in USES[: [n for n, _ in USES].index(name) + 1])
        use = F.when(_draw(seed, F.col("bx"), F.col("by")) < upto, name).otherwise(use)
    first = F.when(F.col("bx") + F.col("by") == 0, "residential").when((F.col("bx") == 0) & (F.col("by") == 1), "commercial").when((F.col("bx") == 1) & (F.col("by") == 0), "green").when((F.col("bx") == 1) & (F.col("by") == 1), "school")
    blocks = key.select("bx", "by", (F.col("bx") * size).alias("x"), (F.col("by") * size).alias("y"), F.lit(float(size)).alias("size"), F.coalesce(first, use).alias("use"))

    side, step = SIDE * size, (SIDE + GAP) * size
    corner = lambda c, n: F.col(c) + MARGIN * size + F.col(n) * step
    made = blocks.where("use <> 'green'").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("i", (F.col("k") / 2).cast("int")).withColumn("j", F.col("k") % 2)
    made = made.select("bx", "by", "use", "k", corner("x", "i").alias("x0"), corner("y", "j").alias("y0")).withColumn("x1", F.col("x0") + side).withColumn("y1", F.col("y0") + side)
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    if rise > 0:  # none stands in the diagonal's way
        made = made.where(F.abs(rise * cx - cy) / math.hypot(rise, 1) >= 0.7 * side)
    made = made.withColumn("height", HEIGHTS[0] + (HEIGHTS[1] - HEIGHTS[0]) * _draw(seed + 1, F.col("bx"), F.col("by"), F.col("k")))
    people = F.greatest((side * side * F.col("height") * PEOPLE).cast("int"), F.lit(1))
    demand = made.where("use = 'residential'").select("bx", "by", "k", cx.alias("x"), cy.alias("y"), people.alias("pop"))
    spot = lambda c, n: F.col(c) + 15 + (size - 30) * _draw(seed + 2, F.col("bx"), F.col("by"), F.col("kind"), F.lit(n))
    places = blocks.where("use = 'commercial'").withColumn("kind", F.explode(F.array(F.lit("Shop"), F.lit("Cafe")))).select("bx", "by", spot("x", 0).alias("x"), spot("y", 1).alias("y"), "kind")
    park = F.col("use") == "green"
    facilities = blocks.where("use in ('green', 'school')").select(F.concat_ws("_", F.when(park, "Park").otherwise("School"), "bx", "by").alias("name"), (F.col("x") + size / 2).alias("x"), (F.col("y") + size / 2).alias("y"), F.when(park, 1000).otherwise(500).alias("capacity"))

    rows, cols = math.ceil(h / pixel), math.ceil(w / pixel)
    span = lambda lo, hi, n: F.sequence(F.greatest(F.floor(lo / pixel), F.lit(0)), F.least(F.ceil(hi / pixel), F.lit(n)) - 1)
    tall = made.withColumn("r", F.explode(span(h - F.col("y1"), h - F.col("y0"), rows))).withColumn("c", F.explode(span(F.col("x0"), F.col("x1"), cols)))
    tall = tall.groupBy("r", "c").agg(F.max_by("height", F.struct("bx", "by", "k")).alias("z"))
    every = spark.range(rows * cols).select((F.col("id") / cols).cast("long").alias("r"), F.pmod("id", F.lit(cols)).alias("c"))
    heights = every.join(tall, ["r", "c"], "left").na.fill(0.0, ["z"])
    return {"streets": streets, "blocks": blocks, "buildings": made.select("bx", "by", "k", "x0", "y0", "x1", "y1", "height"), "places": places, "facilities": facilities, "demand": demand, "heights": heights}
