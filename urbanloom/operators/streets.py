"""Networks from polylines: nodes where ends meet, edges, the dual graph of segments, directions of streets.

Ends are snapped to a grid of the tolerance (halves to even), so equal keys are one node; a node is numbered by the
order in which its first end comes along (by line, start before end).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.core.graph import components
from urbanloom.core.ordered import running
from urbanloom.core.spatial_join import nearest, range_join
from urbanloom.core.tables import stored
from urbanloom.functions import geometry as G


def _key(p: Column, tolerance: float) -> Column:
    return F.struct(F.rint(p["x"] / tolerance).cast("long").alias("kx"), F.rint(p["y"] / tolerance).cast("long").alias("ky"))


def build_graph(lines: DataFrame, tolerance: float = 0.01, cost: str | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes (node, x, y) and edges (edge, src, dst, cost, len) from lines (id, coords[, cost]) of two points or more.

    A cost that is missing, not finite or not above 0 is the length.
    """
    if not math.isfinite(tolerance) or tolerance <= 0:
        raise ValueError("the tolerance must be above 0")
    c = F.col("coords")
    ends = lines.where("size(coords) >= 2").select(F.col("id").alias("edge"), F.explode(F.array(*(F.struct(F.lit(k).alias("end"), p.alias("p")) for k, p in enumerate((c[0], F.element_at(c, -1)))))).alias("e"))
    ends = ends.select("edge", "e.end", F.col("e.p").alias("p"), _key(F.col("e.p"), tolerance).alias("key"))
    firsts = ends.groupBy("key").agg(F.min(F.struct("edge", "end", "p")).alias("f"))
    nodes = stored(running(firsts.select("key", "f.edge", "f.end", "f.p"), [F.col("edge"), F.col("end")], {"_n": ("sum", F.lit(1))}).select("key", (F.col("_n") - 1).alias("node"), F.col("p.x").alias("x"), F.col("p.y").alias("y")), "nodes")
    at = ends.join(nodes.select("key", "node"), "key").groupBy("edge").agg(F.max(F.when(F.col("end") == 0, F.col("node"))).alias("src"), F.max(F.when(F.col("end") == 1, F.col("node"))).alias("dst"))
    length = G.polyline_length(c)
    value = length if cost is None else F.when((F.col(cost) > 0) & (F.col(cost) < float("inf")) & ~F.isnan(F.col(cost)), F.col(cost).cast("double")).otherwise(length)
    edges = lines.where("size(coords) >= 2").select(F.col("id").alias("edge"), value.alias("cost"), length.alias("len")).join(at, "edge")
    return nodes.select("node", "x", "y"), edges.select("edge", "src", "dst", "cost", "len")


def graph_size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the numbers of nodes and edges."""
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, degree): ends of edges at the node; a loop counts twice."""
    d = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    return nodes.select("node").join(d, "node", "left").na.fill(0, ["degree"])


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, dst, edge, cost): each edge in both directions."""
    return edges.select("src", "dst", "edge", "cost").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge", "cost"))


def nearest_nodes(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """(id, node, d): the nearest node of each point, ties by node."""
    return nearest(points, nodes, 1, right_key="node").select(F.col("i").alias("id"), F.col("j").alias("node"), "d")


def segment_graph(lines: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(src, dst, cost, metric) in both directions between lines that share an end: the turn over 90 degrees plus half
    of both lines' inner curvature, and half of both lengths. Lines that share both ends have an arc for each."""
    c = F.col("coords")
    facts = lines.where("size(coords) >= 2").select(F.col("id").alias("s"), G.polyline_length(c).alias("len"), (G.internal_curvature(c) / 90).alias("curve"), c.alias("c"))
    n = F.size("c")
    ways = F.array(F.struct(F.col("c")[0].alias("p"), F.col("c")[1].alias("q")), F.struct(F.element_at("c", -1).alias("p"), F.element_at(F.col("c"), n - 1).alias("q")))
    ends = facts.select("s", "len", "curve", F.posexplode(ways).alias("end", "w"))
    ends = stored(ends.select("s", "len", "curve", "end", _key(F.col("w.p"), tolerance).alias("key"), F.degrees(F.atan2(F.col("w.q.y") - F.col("w.p.y"), F.col("w.q.x") - F.col("w.p.x"))).alias("b")), "ends")
    other = ends.select("key", *(F.col(x).alias(f"{x}2") for x in ("s", "len", "curve", "end", "b")))
    pairs = ends.join(other, "key").where("s <> s2")
    # the turn depends on which of two lines is taken first, so both directions take the lesser first
    turn = F.when(F.col("s") < F.col("s2"), G.angle_between(F.col("b") + 180, F.col("b2"))).otherwise(G.angle_between(F.col("b2") + 180, F.col("b")))
    return pairs.select(F.col("s").alias("src"), F.col("s2").alias("dst"), (turn / 90 + (F.col("curve") + F.col("curve2")) / 2).alias("cost"), ((F.col("len") + F.col("len2")) / 2).alias("metric"))


def segment_connectivity(lines: DataFrame, arcs: DataFrame) -> DataFrame:
    """(id, connectivity): how many different lines a line meets."""
    d = arcs.groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("connectivity"))
    return lines.select("id").join(d, "id", "left").na.fill(0, ["connectivity"])


def split_axial(lines: DataFrame, tol: float = 1e-6, cell: float | None = None) -> DataFrame:
    """(id, part, x0, y0, x1, y1): straight lines (id, x0, y0, x1, y1) cut where they cross or touch others.

    Only lines whose boxes share a grid cell are compared; the cell is the mean length unless given.
    """
    rows = lines.select("id", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    if cell is None:
        cell = rows.agg(F.avg(F.sqrt((F.col("x1") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0")) * (F.col("y1") - F.col("y0")))).alias("m")).first()["m"] or 1.0
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell))
    placed = rows.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))
    other = placed.select("cx", "cy", F.col("id").alias("id2"), *(F.col(c).alias(f"{c}b") for c in ("x0", "y0", "x1", "y1")))
    pairs = placed.join(other, ["cx", "cy"]).where("id <> id2").drop("cx", "cy").distinct()
    det = F.expr("(y1b - y0b) * (x1 - x0) - (x1b - x0b) * (y1 - y0)")
    ua = F.expr("(x1b - x0b) * (y0 - y0b) - (y1b - y0b) * (x0 - x0b)")
    ub = F.expr("(x1 - x0) * (y0 - y0b) - (y1 - y0) * (x0 - x0b)")
    hits = pairs.withColumn("d", det).where(F.abs("d") >= tol).withColumn("a", ua / F.col("d")).withColumn("b", ub / F.col("d")).where("a between 0 and 1 and b between 0 and 1")
    cuts = hits.select("id", F.round(F.expr("x0 + a * (x1 - x0)"), 6).alias("x"), F.round(F.expr("y0 + a * (y1 - y0)"), 6).alias("y"))
    ends = rows.select("id", F.col("x0").alias("x"), F.col("y0").alias("y")).unionByName(rows.select("id", F.col("x1").alias("x"), F.col("y1").alias("y")))
    along = F.expr("(x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)")
    stops = ends.unionByName(cuts).distinct().join(rows, "id").select("id", F.struct(along.alias("s"), "x", "y").alias("p"))
    chain = stops.groupBy("id").agg(F.sort_array(F.collect_list("p")).alias("c"))
    parts = chain.select("id", F.explode(F.transform(F.slice("c", 2, F.size("c")), lambda q, i: F.struct(F.col("c")[i].alias("p"), q.alias("q")))).alias("e"))
    out = parts.select("id", F.col("e.p.x").alias("x0"), F.col("e.p.y").alias("y0"), F.col("e.q.x").alias("x1"), F.col("e.q.y").alias("y1"), F.col("e.p.s").alias("s"))
    out = out.where(F.expr("(x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)") > tol)
    from pyspark.sql import Window

    return out.select("id", F.row_number().over(Window.partitionBy("id").orderBy("s", "x0", "y0")).alias("part"), "x0", "y0", "x1", "y1")


def _entropy(counts: DataFrame, weight: str) -> DataFrame:
    """One row: total, and entropy of the positive weights' shares."""
    t = counts.where(F.col(weight) > 0).agg(F.sum(weight).alias("total"), F.sum(F.col(weight) * F.ln(weight)).alias("l"))
    return t.select("total", F.when(F.col("total") > 0, F.ln("total") - F.col("l") / F.col("total")).otherwise(F.lit(0.0)).alias("entropy"))


def compass_entropy(nodes: DataFrame, edges: DataFrame, bins: int = 36) -> DataFrame:
    """One row: entropy of the compass bearings of all arcs (both ways) over ln(bins); arcs without length don't count."""
    at = lambda e: nodes.select(F.col("node").alias(e), F.col("x").alias(f"x_{e}"), F.col("y").alias(f"y_{e}"))
    arcs = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    rows = arcs.join(at("src"), "src").join(at("dst"), "dst").select(F.expr("x_dst - x_src").alias("dx"), F.expr("y_dst - y_src").alias("dy")).where("dx <> 0 or dy <> 0")
    b = F.pmod(F.degrees(F.atan2("dx", "dy")) + 360, F.lit(360.0))
    counts = rows.groupBy(F.least(F.floor(b / (360 / bins)), F.lit(bins - 1)).alias("bin")).agg(F.count("*").cast("double").alias("w"))
    return _entropy(counts, "w").select((F.col("entropy") / (math.log(bins) or 1.0)).alias("entropy"))


def rose(lines: DataFrame, bins: int = 36) -> DataFrame:
    """(bin, n, length, anisotropy, heading): directions of straight lines (x0, y0, x1, y1) both ways by length; anisotropy is 1 less
    the entropy's share of ln(bins), the heading the middle of the longest bin."""
    d = lines.select(F.expr("x1 - x0").alias("dx"), F.expr("y1 - y0").alias("dy")).withColumn("len", F.expr("sqrt(dx * dx + dy * dy)")).where("len > 1e-9")
    one = F.pmod(F.degrees(F.atan2("dy", "dx")), F.lit(180.0))
    both = d.select("len", F.explode(F.array(one, F.pmod(one + 180, F.lit(360.0)))).alias("a"))
    counts = both.groupBy(F.least(F.floor(F.col("a") / (360 / bins)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum("len").alias("length"))
    total = _entropy(counts, "length").crossJoin(counts.agg(F.max_by("bin", F.struct("length", (-F.col("bin")).alias("b"))).alias("top")))
    aniso = F.least(F.greatest(1 - F.col("entropy") / max(1e-9, math.log(bins)), F.lit(0.0)), F.lit(1.0))
    return counts.crossJoin(F.broadcast(total)).select("bin", "n", "length", aniso.alias("anisotropy"), ((F.col("top") + 0.5) * (360 / bins)).alias("heading"))


def orientation_order(bearings: DataFrame, bins: int = 36) -> DataFrame:
    """One row of bearings (b, len): entropy of both directions in bins centred on 0, and how close to a grid (1) it is."""
    half = 180 / bins
    both = bearings.select("len", F.explode(F.array(F.pmod(F.col("b"), F.lit(360.0)), F.pmod(F.col("b") + 180, F.lit(360.0)))).alias("a"))
    place = F.least(F.floor(F.pmod(F.col("a") + half, F.lit(360.0)) / (360 / bins)), F.lit(bins - 1))
    t = _entropy(both.groupBy(place.alias("bin")).agg(F.sum("len").alias("w")), "w")
    if bins <= 4:
        return t.select("entropy", F.lit(0.0).alias("order"))
    r = (F.col("entropy") - math.log(4)) / (math.log(bins) - math.log(4))
    return t.select("entropy", F.when(F.col("total") > 0, F.least(F.greatest(1 - r * r, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0)).alias("order"))


def dead_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes with one neighbouring end, and their share."""
    return degrees(nodes, edges).agg(F.count_if(F.col("degree") == 1).alias("dead_ends"), F.avg((F.col("degree") == 1).cast("double")).alias("share"))


def permeability(nodes: DataFrame, edges: DataFrame, low: str) -> DataFrame:
    """(node, permeability): of the nodes that can be reached, the percentage that still can over edges where ``low`` holds; 100
    for lone nodes. What can be reached is the rest of the component, so only component sizes are needed."""

    def sizes(e: DataFrame, name: str) -> DataFrame:
        found = nodes.select("node").join(components(e, "src", "dst").withColumnRenamed("node", "k"), F.col("node") == F.col("k"), "left").select("node", F.coalesce("component", "node").alias("c"))
        return found.join(found.groupBy("c").agg(F.count("*").alias(name)), "c").select("node", name)

    both = sizes(edges, "full").join(sizes(edges.where(F.col(low)), "few"), "node")
    return both.select("node", F.when(F.col("full") > 1, 100 * (F.col("few") - 1) / (F.col("full") - 1)).otherwise(F.lit(100.0)).alias("permeability"))


def barriers(nodes: DataFrame, edges: DataFrame, threshold: int = 2) -> DataFrame:
    """(src, dst, score): edges (.., lts) above the threshold between islands of the others, scored by both islands' sizes."""
    found = nodes.select("node").join(components(edges.where(F.col("lts") <= threshold), "src", "dst").withColumnRenamed("node", "k"), F.col("node") == F.col("k"), "left").select("node", F.coalesce("component", "node").alias("c"))
    sized = stored(found.join(found.groupBy("c").agg(F.count("*").alias("n")), "c"), "islands")
    end = lambda e: sized.select(F.col("node").alias(e), F.col("c").alias(f"c_{e}"), F.col("n").alias(f"n_{e}"))
    hard = edges.where(F.col("lts") > threshold).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return hard.join(end("src"), "src").join(end("dst"), "dst").where("c_src <> c_dst").select("src", "dst", (F.col("n_src") + F.col("n_dst")).alias("score"))


def low_stress_summary(edges: DataFrame, threshold: int = 2) -> DataFrame:
    """One row: share of the length (cost) with lts at most the threshold, islands, the largest one's length, nodes and share."""
    low = edges.where(F.col("lts") <= threshold)
    comp = components(low, "src", "dst")
    by = low.join(comp, F.col("src") == F.col("node")).groupBy("component").agg(F.sum("cost").alias("len")).join(comp.groupBy("component").agg(F.count("*").alias("nodes")), "component")
    top = by.agg(F.count_if(F.col("len") > 0).alias("islands"), F.max("len").alias("largest"), F.max_by("nodes", F.struct("len", (-F.col("component")).alias("c"))).alias("nodes"))
    t = edges.agg(F.sum("cost").alias("all"), F.sum(F.when(F.col("lts") <= threshold, F.col("cost")).otherwise(F.lit(0.0))).alias("low")).crossJoin(top)
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return t.select(share("low", "all").alias("low_share"), "islands", F.coalesce("largest", F.lit(0.0)).alias("largest"), F.coalesce("nodes", F.lit(0)).alias("nodes"), share("largest", "low").alias("largest_share"))


def straightness(edges: DataFrame, nodes: DataFrame, radius: float | None = None) -> DataFrame:
    """(node, straightness): mean of straight over network distance to all reachable nodes (node, x, y)."""
    from urbanloom.core.graph import shortest

    at = lambda k: nodes.select(F.col("node").alias(k), F.col("x").alias(f"x_{k}"), F.col("y").alias(f"y_{k}"))
    d = shortest(edges, nodes.select("node"), radius).where("source <> node and dist > 0").withColumnRenamed("node", "target")
    rows = d.join(at("source"), "source").join(at("target"), "target")
    flat = F.expr("sqrt((x_source - x_target) * (x_source - x_target) + (y_source - y_target) * (y_source - y_target))")
    s = rows.groupBy(F.col("source").alias("node")).agg(F.avg(flat / F.col("dist")).alias("straightness"))
    return nodes.select("node").join(s, "node", "left").na.fill(0.0, ["straightness"])


def circuity(edges: DataFrame, nodes: DataFrame, samples: int = 100, seed: int = 0) -> DataFrame:
    """One row: mean network over straight distance of pairs of nodes (node, x, y) drawn by hash; pairs that aren't
    connected or lie at one place don't count, 1 if none does."""
    from urbanloom.core.graph import shortest

    n = nodes.count()
    if n < 2:
        return nodes.sparkSession.range(1).select(F.lit(1.0).alias("circuity"))
    placed = stored(running(nodes.select("node", "x", "y"), [F.col("node")], {"_n": ("sum", F.lit(1))}).withColumn("_n", F.col("_n") - 1), "placed")
    draws = nodes.sparkSession.range(samples).select("id", F.pmod(F.xxhash64("id", F.lit(seed), F.lit(0)), F.lit(n)).alias("a"), F.pmod(F.xxhash64("id", F.lit(seed), F.lit(1)), F.lit(n - 1)).alias("b"))
    draws = draws.select("a", (F.col("b") + (F.col("b") >= F.col("a")).cast("long")).alias("b"))
    end = lambda k: placed.select(F.col("_n").alias(k), F.col("node").alias(f"n_{k}"), F.col("x").alias(f"x_{k}"), F.col("y").alias(f"y_{k}"))
    pairs = stored(draws.join(end("a"), "a").join(end("b"), "b"), "pairs")
    d = shortest(edges, pairs.select(F.col("n_a").alias("node")).distinct())
    rows = pairs.join(d, (F.col("n_a") == F.col("source")) & (F.col("n_b") == F.col("node"))).withColumn("flat", F.expr("sqrt((x_a - x_b) * (x_a - x_b) + (y_a - y_b) * (y_a - y_b))"))
    return rows.where("flat > 0").agg(F.coalesce(F.avg(F.col("dist") / F.col("flat")), F.lit(1.0)).alias("circuity"))


def intersection_profile(edges: DataFrame, nodes: DataFrame, radius: float = 800.0) -> DataFrame:
    """(node, reached, mean, score): other nodes within the radius, their mean distance, and reached over mean, in percent of
    the best."""
    from urbanloom.core.graph import shortest

    d = shortest(edges, nodes.select("node"), radius).where("source <> node")
    s = d.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("reached"), F.avg("dist").alias("mean"))
    s = nodes.select("node").join(s, "node", "left").na.fill(0, ["reached"]).na.fill(0.0, ["mean"]).withColumn("raw", F.when(F.col("mean") > 0, F.col("reached") / F.col("mean")).otherwise(F.lit(0.0)))
    s = stored(s, "profile")
    return s.crossJoin(F.broadcast(s.agg(F.max("raw").alias("_top")))).select("node", "reached", "mean", F.when(F.col("_top") > 0, F.col("raw") / F.col("_top") * 100).otherwise(F.col("raw")).alias("score"))


def hop_integration(edges: DataFrame, nodes: DataFrame, steps: int = 3) -> DataFrame:
    """(node, integration, local, depth) by numbers of steps: mean depth over all nodes, itself and unreachable ones
    counted with 0, against the diamond value; local integration within so many steps."""
    from urbanloom.core.graph import shortest

    n = nodes.count()
    d = shortest(edges.select("src", "dst", F.lit(1.0).alias("cost")), nodes.select("node"))
    s = d.groupBy(F.col("source").alias("node")).agg((F.sum("dist") / n).alias("m"), (F.sum(F.when(F.col("dist") <= steps, F.col("dist")).otherwise(F.lit(0.0))) / n).alias("l"))
    diamond = 2 * (n * (math.log2((n + 2) / 3) - 1) + 1) / max(1.0, float((n - 1) * (n - 2))) if n else 0.0
    s = nodes.select("node").join(s, "node", "left").na.fill(0.0, ["m", "l"]).withColumn("depth", F.when(F.col("m") == 0, F.lit(1.0)).otherwise(F.col("m")))
    ra = 2 * (F.col("depth") - 1) / max(1.0, float(n - 2))
    return s.select("node", (F.lit(diamond) / F.when(ra == 0, F.lit(1e-6)).otherwise(ra)).alias("integration"), (1 / F.when(F.col("l") == 0, F.lit(1.0)).otherwise(F.col("l"))).alias("local"), "depth")


def segment_density(samples: DataFrame, points: DataFrame, bandwidth: float, kind: str = "gaussian") -> DataFrame:
    """(segment, density): mean over a segment's samples (segment, sample, x, y) of the kernel sum of points (id, x, y, w)."""
    if bandwidth <= 0:
        raise ValueError("the bandwidth must be above 0")
    shapes = {"uniform": lambda u: F.lit(1.0), "triangular": lambda u: 1 - u, "epanechnikov": lambda u: 1 - u * u, "gaussian": lambda u: F.exp(-4.5 * u * u)}
    if kind.lower() not in shapes:
        raise ValueError(f"no kernel {kind!r}")
    pairs = range_join(samples.select("segment", "sample", "x", "y"), points.select(F.col("id").alias("p"), "x", "y", "w"), bandwidth, ["segment", "sample"], ["p", "w"])
    k = F.greatest(shapes[kind.lower()](F.col("d") / bandwidth), F.lit(0.0))
    s = pairs.groupBy("segment").agg(F.sum(F.col("w") * k).alias("s"))
    return samples.groupBy("segment").agg(F.count("*").alias("n")).join(s, "segment", "left").select("segment", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("density"))
