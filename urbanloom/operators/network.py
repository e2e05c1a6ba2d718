"""Networks as edges (src, dst, cost): shortest paths, centrality, service areas and form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.core.graph import both_ways, components, shortest
from urbanloom.core.ordered import numbered
from urbanloom.core.tables import stored


def many_to_many(edges: DataFrame, sources: DataFrame, cutoff: float | None = None) -> DataFrame:
    return shortest(edges, sources, cutoff)


def multi_source(edges: DataFrame, sources: DataFrame, cutoff: float | None = None) -> DataFrame:
    """(source, node, dist): the nearest source; ``sources`` may have an offset."""
    return shortest(edges, sources, cutoff, apart=False)


def closeness(edges: DataFrame, nodes: DataFrame, radius: float | None = None) -> DataFrame:
    """(node, reach, farness, closeness, harmonic) over all nodes within the radius."""
    n = nodes.agg(F.count("*").cast("double").alias("n"))
    d = shortest(edges, nodes, radius).where("source <> node")
    out = d.groupBy("source").agg(F.count("*").alias("reach"), F.sum("dist").alias("farness"), F.sum(1 / F.col("dist")).alias("harmonic"))
    out = nodes.join(out, F.col("node") == F.col("source"), "left").crossJoin(F.broadcast(n)).na.fill(0, ["reach"]).na.fill(0.0, ["farness", "harmonic"])
    value = F.when((F.col("farness") > 0) & (F.col("n") > 1), F.col("reach") / F.col("farness") * F.col("reach") / (F.col("n") - 1)).otherwise(F.lit(0.0))
    return out.select("node", "reach", "farness", value.alias("closeness"), "harmonic")


def gravity_centrality(edges: DataFrame, nodes: DataFrame, weights: DataFrame, cutoff: float, beta: float = 0.002) -> DataFrame:
    """(node, gravity): weights (node, w) of what lies within the cutoff, discounted exponentially, itself included."""
    d = shortest(edges, nodes, cutoff).join(weights.withColumnRenamed("node", "t"), F.col("node") == F.col("t"))
    return d.groupBy("source").agg(F.sum(F.col("w") * F.exp(-beta * F.col("dist"))).alias("gravity")).select(F.col("source").alias("node"), "gravity")


def service_area(edges: DataFrame, facilities: DataFrame, population: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, nodes, pop, share) reached from the nearest facility."""
    d = multi_source(edges, facilities, max(thresholds)).join(population, "node")
    total = population.agg(F.sum("pop").alias("all_pop"))
    t = F.explode(F.array(*(F.lit(float(x)) for x in thresholds))).alias("threshold")
    rows = d.select("node", "dist", "pop", t).where("dist <= threshold").groupBy("threshold").agg(F.count("*").alias("nodes"), F.sum("pop").alias("pop"))
    return rows.crossJoin(F.broadcast(total)).select("threshold", "nodes", "pop", (F.col("pop") / F.col("all_pop")).alias("share"))


def voronoi(edges: DataFrame, facilities: DataFrame, demand: DataFrame) -> DataFrame:
    """(source, nodes, demand, mean, farthest) of what each facility is nearest to."""
    return multi_source(edges, facilities).join(demand, "node").groupBy("source").agg(F.count("*").alias("nodes"), F.sum("pop").alias("demand"), (F.sum(F.col("pop") * F.col("dist")) / F.sum("pop")).alias("mean"), F.max("dist").alias("farthest"))


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): least node reachable; lone nodes are their own."""
    found = components(edges, "src", "dst").withColumnRenamed("node", "k")
    return nodes.join(found, F.col("node") == F.col("k"), "left").select("node", F.coalesce("component", "node").alias("component"))


def low_stress_islands(edges: DataFrame, nodes: DataFrame, threshold: int = 2) -> DataFrame:
    """(component, nodes, length) of the network whose edges (.., lts) are at most the threshold."""
    low = edges.where(F.col("lts") <= threshold)
    own = connected_components(low, nodes)
    length = low.join(own, F.col("src") == F.col("node")).groupBy("component").agg(F.sum("cost").alias("length"))
    return own.groupBy("component").agg(F.count("*").alias("nodes")).join(length, "component", "left").select("component", "nodes", F.coalesce("length", F.lit(0.0)).alias("length"))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def morphometry(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean degree and length, meshedness, share of dead ends and of crossings."""
    d = nodes.join(degrees(edges), "node", "left").select(F.coalesce("degree", F.lit(0)).alias("k"))
    n = d.agg(F.count("*").cast("double").alias("n"), F.avg("k").alias("mean_degree"), F.avg((F.col("k") == 1).cast("double")).alias("dead_ends"), F.avg((F.col("k") >= 3).cast("double")).alias("crossings"))
    e = edges.agg(F.count("*").cast("double").alias("e"), F.avg("cost").alias("mean_length"))
    return n.crossJoin(e).select("n", "e", "mean_degree", "mean_length", ((F.col("e") - F.col("n") + 1) / (2 * F.col("n") - 5)).alias("meshedness"), "dead_ends", "crossings")


def pagerank(edges: DataFrame, nodes: DataFrame, alpha: float = 0.85, iterations: int = 100, tol: float = 1e-6) -> DataFrame:
    """(node, rank): steps go to neighbours by inverse cost; what dead ends hold is spread over all.

    Ends when the changes of a step sum to less than ``tol``, or after ``iterations`` steps.
    """
    arcs = both_ways(edges).select("src", "dst", (1 / F.col("cost")).alias("w"))
    total = arcs.groupBy("src").agg(F.sum("w").alias("t"))
    arcs = stored(arcs.join(total, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("p")), "arcs")
    n = nodes.count()
    ends = total.select("src")
    nodes = stored(nodes.join(ends, F.col("node") == F.col("src"), "left").select("node", F.col("src").isNull().alias("dead")), "ends")
    ranks = nodes.select("node", "dead", F.lit(1.0 / max(n, 1)).alias("rank"))
    lost = nodes.where("dead").count() / max(n, 1)
    for _ in range(iterations if n else 0):
        got = ranks.join(arcs, F.col("node") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("p")).alias("g"))
        new = (1 - alpha) / n + alpha * (F.coalesce("g", F.lit(0.0)) + lost / n)
        ranks = stored(ranks.join(got, F.col("node") == F.col("dst"), "left").select("node", "dead", new.alias("rank"), F.abs(new - F.col("rank")).alias("change")), "ranks")
        step = ranks.agg(F.sum("change").alias("change"), F.coalesce(F.sum(F.when(F.col("dead"), F.col("rank"))), F.lit(0.0)).alias("lost")).first()
        lost = step["lost"]
        if step["change"] < tol:
            break
    return ranks.select("node", "rank")


#: Steps of the eigenvector iteration between two written rounds.
STEPS = 8


def eigenvector(edges: DataFrame, nodes: DataFrame, iterations: int = 200, tol: float = 1e-10) -> DataFrame:
    """(node, value): power iteration on the adjacency plus the identity, scaled to a largest value of 1.

    Ends when a step changes no value of the vector of length 1 by ``tol``, which is looked at every STEPS steps, or
    after ``iterations`` steps.
    """
    known = nodes.select("node").distinct()
    arcs = both_ways(edges).select("src", "dst", F.lit(False).alias("own"))
    for end in ("src", "dst"):
        arcs = arcs.join(known, F.col(end) == F.col("node"), "left_semi")
    arcs = stored(arcs.unionByName(known.where("node is not null").select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(True).alias("own"))), "arcs")
    x, done = known.where("node is not null").select("node", F.lit(1.0).alias("value")), 0
    while done < iterations:
        steps = min(STEPS, iterations - done)
        for _ in range(steps):
            # a node's own arc keeps its value, so that no step reads its predecessor twice
            x = x.select("node", "value").join(arcs, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node"))
            x = x.agg(F.sum("value").alias("value"), F.sum(F.when(F.col("own"), F.col("value"))).alias("last"))
        done += steps
        x = stored(x, "eigen")
        size = x.agg(*(F.sqrt(F.sum(F.col(c) * F.col(c))).alias(c) for c in ("value", "last")), F.max("value").alias("most")).first()
        if size["value"] is None:
            break
        moved = x.agg(F.max(F.abs(F.col("value") / size["value"] - F.col("last") / size["last"])).alias("m")).first()["m"]
        x = x.select("node", (F.col("value") / size["most"]).alias("value"))
        if moved < tol:
            break
    return nodes.select("node").join(x.select("node", "value"), "node").select("node", "value")


def probability_of_connectivity(edges: DataFrame, patches: DataFrame) -> DataFrame:
    """One row from patches (node, area): squared areas of components over the squared total."""
    c = connected_components(edges, patches.select("node")).join(patches, "node").groupBy("component").agg(F.sum("area").alias("a"))
    return c.agg((F.sum(F.col("a") * F.col("a")) / (F.sum("a") * F.sum("a"))).alias("pc"), F.count("*").alias("components"))


def bottlenecks(usage: DataFrame, k: int = 10) -> DataFrame:
    """The k edges (edge, pre, post) whose use grew most, ties by edge."""
    return usage.select("edge", F.greatest(F.col("post") - F.col("pre"), F.lit(0.0)).alias("growth")).orderBy(F.col("growth").desc(), "edge").limit(k)


def debris_priority(blocked: DataFrame, cost_factor: float = 1.0) -> DataFrame:
    """(edge, priority, rank) from (edge, volume, criticality)."""
    p = F.col("criticality") / (F.pow("volume", F.lit(cost_factor)) + 1e-6)
    return numbered(blocked.select("edge", p.alias("priority")), [F.col("priority").desc(), F.col("edge").asc()])
