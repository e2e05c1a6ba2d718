"""Connected components and least costs over tables of links.

Components go by alternating large-star and small-star rounds. Each round is two joins and two aggregates over the
links; nothing is gathered on the driver but one checksum. Rounds are written to scratch tables, so their lineage is
short and a lost executor repeats one round at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.core.paths import dijkstra, each, network
from urbanloom.core.tables import drop, stored


def components(links: DataFrame, u: str = "u", v: str = "v", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of a link; component is the least node reachable. Nodes are integers.

    Loops and repeated links don't matter; links with a null end are left out; no links give no rows.
    """
    pairs = links.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    last = before = None
    for _ in range(rounds):
        # large star: every larger neighbour of a node is linked with the least of the node and its neighbours
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: smaller neighbours and the node itself are linked with the least of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(least, "a")
        pairs = stored(joined.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct(), "links")
        sums = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        drop(before)
        before = pairs
        state = (sums["n"], sums["h"])
        # a round that changes nothing leaves stars: every node is linked with its component's least alone
        if state == last or not sums["n"]:
            break
        last = state
    else:
        raise RuntimeError(f"links did not settle within {rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, cost) with every edge in either direction."""
    return edges.select("src", "dst", "cost").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost"))


def shortest(edges: DataFrame, sources: DataFrame, cutoff: float | None = None, directed: bool = False, apart: bool = True) -> DataFrame:
    """Least costs from ``sources`` (node[, offset]) over edges (src, dst, cost): (source, node, dist) for each source,
    or with ``apart=False`` the nearest source of each node, ties by source.

    Networks of up to ``paths.ARCS`` arcs are sent to the tasks, each of which takes some sources; larger ones go by
    rounds of joins, which are written, so a lost executor repeats one of them.
    """
    whole = {"tinyint", "smallint", "int", "bigint"}
    ids = {edges.schema[c].dataType.simpleString() for c in ("src", "dst")} | {sources.schema["node"].dataType.simpleString()}
    net = network(edges, directed=directed, nodes=sources.select("node")) if ids <= whole else None
    if net is None:
        return by_rounds(edges, sources, cutoff, directed, apart)
    kind = sources.schema["node"].dataType.simpleString()
    starts = sources.select(F.col("node").cast("long").alias("node"), (F.col("offset") if "offset" in sources.columns else F.lit(0.0)).cast("double").alias("offset"))
    starts = starts.where("node is not null and offset is not null").groupBy("node").agg(F.min("offset").alias("offset"))
    if cutoff is not None and apart:
        starts = starts.where(F.col("offset") <= cutoff)

    def found(net, starts):
        dist, label, _, _ = dijkstra(net.arcs("cost"), starts, cutoff)
        return [(int(net.nodes[label[v]]), int(net.nodes[v]), d) for v, d in dist.items()]

    def begin(net, nodes, offsets):
        return [(o, i, i) for o, i in zip(offsets, net.index(nodes).tolist())]

    if apart:
        out = each(starts, net, lambda net, pdf: [r for x in begin(net, pdf["node"], pdf["offset"]) for r in found(net, [x])], "source long, node long, dist double")
    else:
        # one search over a network of bounded size from all sources, which are nodes of it
        together = starts.groupBy(F.lit(1).alias("g")).agg(F.collect_list(F.struct("node", "offset")).alias("s")).select("s.node", "s.offset")
        out = each(together, net, lambda net, pdf: [r for n, o in zip(pdf["node"], pdf["offset"]) for r in found(net, begin(net, n, o))], "source long, node long, dist double")
    return out.select(F.col("source").cast(kind).alias("source"), F.col("node").cast(kind).alias("node"), "dist")


#: Rounds between two merges of what has been found into one table.
MERGED = 8


def by_rounds(edges: DataFrame, sources: DataFrame, cutoff: float | None = None, directed: bool = False, apart: bool = True) -> DataFrame:
    """The same by rounds of joins, whatever the size; only nodes whose cost fell in a round are expanded in the next.

    Costs beyond the cutoff are dropped on the way. Each round writes what fell; every few rounds these tables are
    merged into one and deleted. The rounds are as many as the most edges of a shortest path.
    """
    key = ["source", "node"] if apart else ["node"]
    arcs = edges if directed else both_ways(edges)
    arcs = stored(arcs.groupBy("src", "dst").agg(F.min("cost").alias("cost")), "arcs")
    offset = F.col("offset") if "offset" in sources.columns else F.lit(0.0)

    def least(df: DataFrame) -> DataFrame:
        if apart:
            return df.groupBy("source", "node").agg(F.min("dist").alias("dist"))
        return df.groupBy("node").agg(F.min(F.struct("dist", "source")).alias("x")).select("x.source", "node", "x.dist")

    first = least(sources.select(F.col("node").alias("source"), "node", offset.cast("double").alias("dist")))
    base, steps = stored(first if cutoff is None or not apart else first.where(F.col("dist") <= cutoff), "dist"), []
    front = base
    while not front.isEmpty():
        step = front.join(arcs, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node"), (F.col("dist") + F.col("cost")).alias("dist"))
        if cutoff is not None:
            step = step.where(F.col("dist") <= cutoff)
        known = least(reduce(DataFrame.unionByName, steps, base))
        old = known.select(*key, F.col("dist").alias("_d"), *([] if apart else [F.col("source").alias("_s")]))
        joined = least(step).join(old, key, "left")
        better = joined["_d"].isNull() | (joined["dist"] < joined["_d"])
        if not apart:
            better = better | ((joined["dist"] == joined["_d"]) & (joined["source"] < joined["_s"]))
        front = stored(joined.where(better).select("source", "node", "dist"), "front")
        steps.append(front)
        if len(steps) == MERGED:
            merged = stored(least(reduce(DataFrame.unionByName, steps, base)), "dist")
            for t in [base, *steps[:-1]]:
                drop(t)
            base, steps = merged, []
    return least(reduce(DataFrame.unionByName, steps, base))
