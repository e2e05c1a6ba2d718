"""Point patterns over points (id, x, y[, w]): centres, spread, spacing and clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.core.ordered import quantiles
from urbanloom.core.spatial_join import nearest, range_join
from urbanloom.core.tables import stored


def mean_center(points: DataFrame, w: str | None = None) -> DataFrame:
    c = F.col(w) if w else F.lit(1.0)
    return points.agg((F.sum(F.col("x") * c) / F.sum(c)).alias("x"), (F.sum(F.col("y") * c) / F.sum(c)).alias("y"))


def standard_distance(points: DataFrame, w: str | None = None) -> DataFrame:
    c = F.col(w) if w else F.lit(1.0)
    m = mean_center(points, w).select(F.col("x").alias("mx"), F.col("y").alias("my"))
    d2 = (F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")) + (F.col("y") - F.col("my")) * (F.col("y") - F.col("my"))
    return points.crossJoin(F.broadcast(m)).agg(F.sqrt(F.sum(c * d2) / F.sum(c)).alias("standard_distance"))


def standard_deviational_ellipse(points: DataFrame) -> DataFrame:
    """One row: centre, rotation (radians) and the standard deviations along both rotated axes."""
    m = mean_center(points).select(F.col("x").alias("mx"), F.col("y").alias("my"))
    s = points.crossJoin(F.broadcast(m)).select("mx", "my", (F.col("x") - F.col("mx")).alias("dx"), (F.col("y") - F.col("my")).alias("dy"))
    t = s.agg(F.first("mx").alias("x"), F.first("my").alias("y"), F.expr("avg(dx * dx)").alias("xx"), F.expr("avg(dy * dy)").alias("yy"), F.expr("avg(dx * dy)").alias("xy"))
    t = t.withColumn("theta", F.expr("0.5D * atan2(2 * xy, xx - yy)"))
    return t.select("x", "y", "theta", F.expr("sqrt(greatest(xx * cos(theta) * cos(theta) + 2 * xy * sin(theta) * cos(theta) + yy * sin(theta) * sin(theta), 0D))").alias("along"), F.expr("sqrt(greatest(xx * sin(theta) * sin(theta) - 2 * xy * sin(theta) * cos(theta) + yy * cos(theta) * cos(theta), 0D))").alias("across"))


def median_center(points: DataFrame, iterations: int = 30) -> DataFrame:
    """Weiszfeld's iteration: each round one aggregate of one row."""
    points = points.where("x is not null and y is not null")
    c = mean_center(points)
    at = c.first()
    if at["x"] is None:
        return c.where("x is not null")
    x, y = at["x"], at["y"]
    for _ in range(iterations):
        d = F.greatest(F.sqrt((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)), F.lit(1e-12))
        nxt = points.agg((F.sum(F.col("x") / d) / F.sum(1 / d)).alias("x"), (F.sum(F.col("y") / d) / F.sum(1 / d)).alias("y")).first()
        moved = abs(nxt["x"] - x) + abs(nxt["y"] - y)
        x, y = nxt["x"], nxt["y"]
        if moved < 1e-9:
            break
    return points.sparkSession.range(1).select(F.lit(x).alias("x"), F.lit(y).alias("y"))


def average_nearest_neighbor(points: DataFrame, area: float | None = None) -> DataFrame:
    """One row: observed and expected mean distance, ratio and z; the area is the bounding box unless given."""
    near = nearest(points, points, 1, exclude_self=True).agg(F.avg("d").alias("observed"), F.count("*").cast("double").alias("n"))
    box = points.agg(F.expr("(max(x) - min(x)) * (max(y) - min(y))").alias("a"))
    a = F.lit(float(area)) if area else F.col("a")
    out = near.crossJoin(box).withColumn("expected", F.when(F.col("n") > 0, 0.5 * F.sqrt(a / F.col("n")))).withColumn("se", F.when(F.col("n") > 0, 0.26136 * F.sqrt(a) / F.col("n")))
    return out.select("observed", "expected", F.try_divide("observed", "expected").alias("ratio"), F.try_divide(F.col("observed") - F.col("expected"), F.col("se")).alias("z"))


def distance_band_stats(points: DataFrame, k: int = 1) -> DataFrame:
    d = nearest(points, points, k, exclude_self=True).where(F.col("rank") == k)
    d = stored(d.select("d"), "near")
    q = quantiles(d, F.col("d"), [0.25, 0.5, 0.75]).agg(*(F.max(F.when(F.col("q") == p, F.col("value"))).alias(n) for p, n in ((0.5, "median"), (0.25, "p25"), (0.75, "p75"))))
    return d.agg(F.min("d").alias("min"), F.max("d").alias("max"), F.avg("d").alias("mean")).crossJoin(F.broadcast(q))


def ripleys_k(points: DataFrame, radii: list[float], area: float | None = None) -> DataFrame:
    """(d, k, l, l_minus_d): ordered pairs within each radius, counted in one join at the largest radius."""
    a, b = points.select(F.col("id").alias("i"), "x", "y"), points.select(F.col("id").alias("j"), "x", "y")
    pairs = range_join(a, b, max(radii), ["i"], ["j"]).where("i <> j")
    counts = pairs.agg(*(F.count_if(F.col("d") <= r).alias(f"c{k}") for k, r in enumerate(radii)))
    base = points.agg(F.count("*").cast("double").alias("n"), F.expr("(max(x) - min(x)) * (max(y) - min(y))").alias("a"))
    size = F.lit(float(area)) if area else F.col("a")
    rows = counts.crossJoin(base).select("n", size.alias("a"), F.explode(F.array(*(F.struct(F.lit(float(r)).alias("d"), F.col(f"c{k}").alias("c")) for k, r in enumerate(radii)))).alias("x"))
    rows = rows.select(F.col("x.d").alias("d"), (F.col("a") / (F.col("n") * (F.col("n") - 1)) * F.col("x.c")).alias("k")).withColumn("l", F.sqrt(F.col("k") / F.pi()))
    return rows.select("d", "k", "l", (F.col("l") - F.col("d")).alias("l_minus_d"))


def cross_k(a: DataFrame, b: DataFrame, radii: list[float], area: float) -> DataFrame:
    pairs = range_join(a.select(F.col("id").alias("i"), "x", "y"), b.select(F.col("id").alias("j"), "x", "y"), max(radii), ["i"], ["j"])
    counts = pairs.agg(*(F.count_if(F.col("d") <= r).alias(f"c{k}") for k, r in enumerate(radii)))
    n = a.agg(F.count("*").alias("na")).crossJoin(b.agg(F.count("*").alias("nb")))
    rows = counts.crossJoin(n).select("na", "nb", F.explode(F.array(*(F.struct(F.lit(float(r)).alias("d"), F.col(f"c{k}").alias("c")) for k, r in enumerate(radii)))).alias("x"))
    return rows.select(F.col("x.d").alias("d"), (F.lit(float(area)) * F.col("x.c") / (F.col("na") * F.col("nb"))).alias("k"))


def linear_directional_mean(lines: DataFrame) -> DataFrame:
    """One row from (x0, y0, x1, y1): length-weighted mean compass direction in degrees and circular variance."""
    l = lines.select(F.expr("x1 - x0").alias("dx"), F.expr("y1 - y0").alias("dy"))
    t = l.agg(F.sum("dx").alias("sx"), F.sum("dy").alias("sy"), F.expr("sum(sqrt(dx * dx + dy * dy))").alias("len"))
    return t.select(F.expr("pmod(degrees(atan2(sx, sy)) + 360, 360D)").alias("direction"), F.expr("1 - sqrt(sx * sx + sy * sy) / len").alias("variance"))


def weighted_kde(events: DataFrame, grid: DataFrame, bandwidth: float, w: str | None = None) -> DataFrame:
    """(id, density) at the grid's points: quartic kernel 15/16 (1 - u^2)^2 over the squared bandwidth, 0 if none is near."""
    e = events.select(F.col("id").alias("e"), "x", "y", (F.col(w) if w else F.lit(1.0)).alias("ew"))
    pairs = range_join(grid.select(F.col("id").alias("g"), "x", "y"), e, bandwidth, ["g"], ["e", "ew"])
    u = F.col("d") / bandwidth
    sums = pairs.groupBy("g").agg((F.sum(F.col("ew") * 15 / 16 * (1 - u * u) * (1 - u * u)) / (bandwidth * bandwidth)).alias("density"))
    return grid.select("id").join(sums, F.col("id") == F.col("g"), "left").select("id", F.coalesce("density", F.lit(0.0)).alias("density"))


def similarity_search(df: DataFrame, features: list[str], targets: list[int], id_col: str = "id") -> DataFrame:
    """(id, distance): euclidean distance of the standardised features to the targets' mean profile."""
    m = df.agg(*(f(c).alias(f"{n}{i}") for i, c in enumerate(features) for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))))
    z = df.crossJoin(F.broadcast(m)).select(id_col, *(F.when(F.col(f"s{i}") > 0, (F.col(c) - F.col(f"m{i}")) / F.col(f"s{i}")).otherwise(F.lit(0.0)).alias(f"z{i}") for i, c in enumerate(features)))
    goal = z.where(F.col(id_col).isin(targets)).agg(*(F.avg(f"z{i}").alias(f"g{i}") for i in range(len(features))))
    total = sum(((F.col(f"z{i}") - F.col(f"g{i}")) * (F.col(f"z{i}") - F.col(f"g{i}")) for i in range(len(features))), F.lit(0.0))
    return z.crossJoin(F.broadcast(goal)).select(id_col, F.sqrt(total).alias("distance"))


def central_feature(points: DataFrame) -> DataFrame:
    """The point of least summed distance to all others, ties by id. All pairs are compared by definition, block by
    block of a broadcast half, and never kept: each left row carries one running sum."""
    b = points.select(F.col("x").alias("bx"), F.col("y").alias("by"))
    sums = points.select("id", "x", "y").crossJoin(b).groupBy("id", "x", "y").agg(F.expr("sum(sqrt((x - bx) * (x - bx) + (y - by) * (y - by)))").alias("total"))
    return sums.orderBy("total", "id").limit(1)
