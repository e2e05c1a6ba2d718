"""Paths and what runs over them: trees, betweenness, removal of edges, evacuation, choice of route.

These follow single paths, so a network of up to ``paths.ARCS`` arcs goes whole to each task, and tasks take origins, removed
edges or requests. Larger ones are cut into regions of whole components (``core.regions``). A component beyond that size, or a
large network for the methods that follow it on the driver, is ``NetworkTooLarge``; costs alone have no bound (``core.graph``).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.core.graph import components
from urbanloom.core.paths import ARCS, Network, dependencies, dijkstra, each, network, pruned
from urbanloom.core.regions import Regions, regions
from urbanloom.core.tables import stored
from urbanloom.session import ship


class NetworkTooLarge(ValueError):
    """The network has more arcs than a task is given."""


def _net(edges: DataFrame, values: tuple[str, ...] = ("cost",), directed: bool = False, nodes: DataFrame | None = None, whole: bool = False, limit: int | None = None) -> Network | Regions:
    limit = limit or ARCS
    net = network(edges, values, directed, nodes, limit)
    if net is None and not whole:
        net = regions(edges, values, directed, limit)
    if net is None:
        raise NetworkTooLarge(f"paths need a {'network' if whole else 'component'} of at most {limit} arcs in each task")
    return net


def _with_goals(own: DataFrame, goals: DataFrame) -> DataFrame:
    """Origins and, flagged, the destinations that their regions need."""
    return own.withColumn("goal", F.lit(False)).unionByName(goals.withColumn("goal", F.lit(True)), allowMissingColumns=True)


def _ids(df: DataFrame, name: str = "node") -> DataFrame:
    return df.select(F.col(df.columns[0]).cast("long").alias(name)).na.drop().distinct()


def path_tree(edges: DataFrame, sources: DataFrame, cutoff: float | None = None, together: bool = False) -> DataFrame:
    """(source, node, dist, pred, edge): the tree of least costs of each source, or with ``together`` one forest of all
    sources (node[, offset]); sources have no pred."""
    net = _net(edges, nodes=sources.select("node"))

    def rows(net, starts):
        dist, label, before, _ = dijkstra(net.arcs("cost"), starts, cutoff)
        name = net.nodes
        return [(int(name[label[v]]), int(name[v]), d, int(name[before[v][0]]) if v in before else None, before[v][1] if v in before else None) for v, d in dist.items()]

    schema = "source long, node long, dist double, pred long, edge long"
    if not together:
        return each(_ids(sources), net, lambda net, pdf: [r for s in net.index(pdf["node"]).tolist() for r in rows(net, [(0.0, s, s)])], schema)
    offset = F.col("offset").cast("double") if "offset" in sources.columns else F.lit(0.0)
    own = sources.select(F.col("node").cast("long").alias("node"), offset.alias("offset")).na.drop().groupBy("node").agg(F.min("offset").alias("offset"))
    if isinstance(net, Regions):
        return net.each(own, lambda net, pdf: rows(net, [(d, s, s) for s, d in zip(net.index(pdf["node"]).tolist(), pdf["offset"])]), schema, together=True)
    own = own.groupBy(F.lit(1)).agg(F.collect_list(F.struct("node", "offset")).alias("s")).select("s.node", "s.offset")
    return each(own, net, lambda net, pdf: [r for n, o in zip(pdf["node"], pdf["offset"]) for r in rows(net, [(d, s, s) for s, d in zip(net.index(n).tolist(), o)])], schema)


def reconstruct(tree: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target, nodes, edges): the way from the root of a target (node) to it; without ways to unreached targets.

    All targets step back together, a join a round, so a round is as long as the targets that haven't arrived.
    """
    steps = tree.select("source", F.col("node").alias("at"), "pred", "edge")
    way = targets.select(F.col("node").alias("target")).distinct().join(tree.select("source", F.col("node").alias("target")), "target")
    way = way.select("source", "target", F.col("target").alias("at"), F.array("target").alias("nodes"), F.expr("cast(array() as array<bigint>)").alias("edges"))
    done = None
    while True:
        moved = stored(way.join(steps, ["source", "at"]), "ways")
        home = moved.where("pred is null").select("source", "target", F.reverse("nodes").alias("nodes"), F.reverse("edges").alias("edges"))
        done = home if done is None else done.unionByName(home)
        way = moved.where("pred is not null").select("source", "target", F.col("pred").alias("at"), F.concat("nodes", F.array("pred")).alias("nodes"), F.concat("edges", F.array("edge")).alias("edges"))
        if way.isEmpty():
            return done


def route(edges: DataFrame, pairs: DataFrame, cost: str = "cost", directed: bool = False) -> DataFrame:
    """(o, d, dist, nodes, edges) for the pairs (o, d) that are connected."""
    net = _net(edges.withColumn("cost", F.col(cost)), directed=directed, nodes=pairs.select(F.col("o").alias("node")))

    def run(net, pdf):
        out, arcs = [], net.arcs("cost")
        for o, group in pdf.groupby("o"):
            goals = [(int(d), int(i)) for d, i in zip(group["d"], net.index(group["d"])) if i >= 0]
            s = int(net.index([o])[0])
            dist, _, before, _ = dijkstra(arcs, [(0.0, s, s)])
            for d, i in goals:
                if i in dist:
                    nodes, used, at = [i], [], i
                    while at in before:
                        at, e = before[at]
                        nodes.append(at)
                        used.append(e)
                    out.append((int(o), d, dist[i], [int(net.nodes[v]) for v in reversed(nodes)], used[::-1]))
        return out

    own = pairs.select(F.col("o").cast("long").alias("o"), F.col("d").cast("long").alias("d")).na.drop().distinct()
    return each(own, net, run, "o long, d long, dist double, nodes array<long>, edges array<long>")


def pruned_costs(edges: DataFrame, sources: DataFrame, radius: float | None = None) -> DataFrame:
    """(source, node, cost, metric): least costs, and the second value (``metric``) along them, cut beyond the radius."""
    net = _net(edges, ("cost", "metric"), nodes=sources.select("node"))

    def run(net, pdf):
        out = []
        for s in net.index(pdf["node"]).tolist():
            cost, second = pruned(net.arcs("cost", "metric"), s, radius)
            out += [(int(net.nodes[s]), int(net.nodes[v]), c, second[v]) for v, c in cost.items()]
        return out

    return each(_ids(sources), net, run, "source long, node long, cost double, metric double")


def betweenness(edges: DataFrame, nodes: DataFrame, radius: float | None = None, sources: DataFrame | None = None, directed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, value), (edge, value) and (node, reached, depth): what the shortest paths between all pairs put on nodes
    between them and on edges, both directions counted; and how many nodes a source reaches (itself counted) and their
    summed cost. ``radius`` bounds the edges' ``metric``; with ``sources`` values are scaled up to all nodes."""
    values = ("cost", "metric") if radius is not None else ("cost",)
    net = _net(edges, values, directed, nodes.select("node"))

    def run(net, pdf):
        on_node: dict[int, float] = {}
        on_edge: dict[int, float] = {}
        out = []
        for s in net.index(pdf["node"]).tolist():
            delta, used, dist, order = dependencies(net.arcs(*values), s, radius)
            for v, x in delta.items():
                on_node[v] = on_node.get(v, 0.0) + x
            for e, x in used.items():
                on_edge[e] = on_edge.get(e, 0.0) + x
            out.append(("source", int(net.nodes[s]), float(len(order)), float(sum(dist[v] for v in order[1:]))))
        out += [("node", int(net.nodes[v]), x, 0.0) for v, x in on_node.items() if x]
        return out + [("edge", int(e), x, 0.0) for e, x in on_edge.items()]

    start = _ids(nodes if sources is None else sources)
    parts = stored(each(start, net, run, "kind string, key long, a double, b double"), "dependencies")
    scale = 1.0
    if sources is not None:
        n, k = nodes.count(), start.count()
        scale = n / k if 0 < k < n else 1.0
    total = lambda kind, name: parts.where(F.col("kind") == kind).groupBy(F.col("key").alias(name)).agg((F.sum("a") * scale).alias("value"))
    by_node = nodes.select("node").join(total("node", "node"), "node", "left").na.fill(0.0, ["value"])
    return by_node, total("edge", "edge"), parts.where("kind = 'source'").select(F.col("key").alias("node"), F.col("a").cast("long").alias("reached"), F.col("b").alias("depth"))


def choice(edges: DataFrame, nodes: DataFrame, origins: DataFrame, destinations: DataFrame, cutoff: float, method: str = "none", beta: float = 0.0) -> DataFrame:
    """(node, choice): origins (node, w) times destinations (node, w) within the cutoff, discounted by cost, on the nodes that
    their shortest paths pass; an origin's own node isn't passed."""
    if method not in ("none", "exponential", "power", "linear") or method == "linear" and cutoff <= 0:
        raise ValueError(f"no decay {method!r} with cutoff {cutoff}")
    net = _net(edges, nodes=nodes.select("node"))
    ends = destinations.groupBy(F.col("node").cast("long").alias("node")).agg(F.max(F.col("w").cast("double")).alias("w"))
    decay = {"none": lambda d: 1.0, "exponential": lambda d: math.exp(-beta * d), "power": lambda d: max(d, 1e-9) ** -beta, "linear": lambda d: max(0.0, 1 - d / cutoff)}[method]

    def run(net, pdf, goals):
        total: dict[int, float] = {}
        worth = lambda v, d: goals.get(int(net.nodes[v]), 0.0) * decay(d)
        for s, w in zip(net.index(pdf["node"]).tolist(), pdf["w"]):
            for v, x in dependencies(net.arcs("cost"), s, cutoff=cutoff, worth=worth)[0].items():
                total[v] = total.get(v, 0.0) + w * x
        return [(int(net.nodes[v]), x) for v, x in total.items()]

    own = origins.select(F.col("node").cast("long").alias("node"), F.col("w").cast("double").alias("w")).na.drop()
    schema = "node long, x double"
    if isinstance(net, Regions):
        split = lambda net, pdf: run(net, pdf[~pdf["goal"]], dict(zip(pdf["node"][pdf["goal"]], pdf["w"][pdf["goal"]])))
        out = net.each(_with_goals(own, ends.na.drop()), split, schema, everywhere="goal")
    else:
        goals = {r[0]: r[1] for r in ends.limit(len(net.nodes) + 1).collect()}
        out = each(own, net, lambda net, pdf: run(net, pdf, goals), schema)
    s = out.groupBy("node").agg(F.sum("x").alias("choice"))
    return nodes.select("node").join(s, "node", "left").na.fill(0.0, ["choice"])


def segment_analysis(arcs: DataFrame, segments: DataFrame, radius: float | None = None) -> DataFrame:
    """(id, nc, td, md, nain, choice, nach) of segments over the dual graph's arcs (src, dst, cost, metric): angular depth
    and choice within a metric radius."""
    nodes = segments.select(F.col("id").alias("node"))
    bet, _, depth = betweenness(arcs, nodes, radius, directed=True)
    rows = bet.join(depth, "node", "left").na.fill(0, ["reached"]).na.fill(0.0, ["depth"])
    nc, td, c = F.col("reached").cast("double"), F.col("depth"), F.col("value") / 2
    return rows.select(F.col("node").alias("id"), F.col("reached").alias("nc"), td.alias("td"), F.when(nc > 1, td / F.greatest(nc - 1, F.lit(1.0))).otherwise(F.lit(0.0)).alias("md"), (F.pow(nc + 2, F.lit(1.2)) / (td + 2)).alias("nain"), c.alias("choice"), (F.log10(c + 1) / F.log10(td + 3)).alias("nach"))


def angular_centrality(lines: DataFrame, radius: float = 800.0, metric: bool = False) -> DataFrame:
    """(id, integration, choice, nain, nach) of straight segments (id, x0, y0, x1, y1) that meet at ends equal to six places.

    A turn costs its angle (of the lines, without direction) over 90 degrees. Choice counts the pairs of others whose
    least cost a segment lies on; within the radius of cost, or of straight distance between the middles (``metric``).

    Connected parts of up to TOGETHER segments are worked out whole in a task, larger ones by tables of all pairs.
    """
    v = lines.select("id", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1"))).withColumn("len", F.expr("sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))"))
    v = v.select("id", F.expr("(x0 + x1) / 2").alias("x"), F.expr("(y0 + y1) / 2").alias("y"), F.expr("case when len > 0 then (x1 - x0) / len else 1D end").alias("ux"), F.expr("case when len > 0 then (y1 - y0) / len else 0D end").alias("uy"), F.explode(F.array(F.struct(F.round("x0", 6).alias("px"), F.round("y0", 6).alias("py")), F.struct(F.round("x1", 6).alias("px"), F.round("y1", 6).alias("py")))).alias("p"))
    v = stored(v, "ends")
    other = v.select("p", F.col("id").alias("dst"), F.col("ux").alias("wx"), F.col("uy").alias("wy"))
    dot = F.least(F.abs(F.expr("ux * wx + uy * wy")), F.lit(1.0))
    arcs = v.withColumnRenamed("id", "src").join(other, "p").where("src <> dst").groupBy("src", "dst").agg(F.min(F.degrees(F.acos(dot)) / 90).alias("cost")).where("cost is not null")
    middles = v.select(F.col("id").alias("node"), "x", "y").distinct()
    if v.schema["id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        return _angular_by_joins(arcs, middles, radius, metric)
    arcs, middles = stored(arcs, "turns"), stored(middles, "middles")
    parts = stored(middles.join(components(arcs, "src", "dst"), "node", "left").select("node", "x", "y", F.coalesce("component", F.col("node").cast("long")).alias("part")), "parts")
    sizes = stored(parts.groupBy("part").agg(F.count("*").alias("n")), "sizes")
    small, large = sizes.where(F.col("n") <= TOGETHER), sizes.where(F.col("n") > TOGETHER)
    own = parts.join(small, "part")
    links = stored(arcs.join(own.select(F.col("node").alias("src"), "part"), "src"), "links")
    kind = v.schema["id"].dataType.simpleString()
    # small parts go together, so that a group isn't a few segments
    group = F.pmod(F.xxhash64("part"), F.lit(max(1, (sizes.agg(F.sum("n")).first()[0] or 0) // TOGETHER)))

    def run(pdf, links):
        rows = [_angular_part(own.reset_index(drop=True), links_of.get(part, links.iloc[:0]), radius, metric) for links_of in [dict(tuple(links.groupby("part")))] for part, own in pdf.groupby("part")]
        return pd.concat(rows, ignore_index=True) if rows else pd.DataFrame(columns=["id", "nc", "td", "far", "choice"])

    ship(v.sparkSession)
    found = own.withColumn("g", group).groupBy("g").cogroup(links.withColumn("g", group).groupBy("g")).applyInPandas(run, f"id {kind}, nc double, td double, far double, choice long")
    out = _angular_rows(found)
    if large.isEmpty():
        return out
    rest = parts.join(large, "part", "left_semi")
    return out.unionByName(_angular_by_joins(arcs.join(rest.select(F.col("node").alias("src")), "src", "left_semi"), rest.select("node", "x", "y"), radius, metric))


#: Segments of a connected part whose costs of all pairs a task holds at once; larger parts go by joins.
TOGETHER = 1000


def _angular_part(own: pd.DataFrame, links: pd.DataFrame, radius: float, metric: bool) -> pd.DataFrame:
    """(id, nc, td, far, choice) of one connected part of segments (node, x, y) and its turns (src, dst, cost)."""
    ids = own["node"].to_numpy()
    order = np.argsort(ids)
    at = lambda c: order[np.searchsorted(ids, links[c].to_numpy(), sorter=order)]
    n, src, dst, cost = len(ids), at("src"), at("dst"), links["cost"].to_numpy(float)
    by = np.lexsort((src, dst))
    src, dst, cost = src[by], dst[by], cost[by]
    begin = np.flatnonzero(np.append(True, dst[1:] != dst[:-1])[: len(dst)])
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0.0)
    while len(dst):
        # every cost from a source, one turn on
        least = d.copy()
        for i in range(0, n, step := max(1, 2_000_000 // len(dst))):
            least[i : i + step, dst[begin]] = np.minimum(least[i : i + step, dst[begin]], np.minimum.reduceat(d[i : i + step, src] + cost, begin, axis=1))
        if (least == d).all():
            break
        d = least
    reached = np.isfinite(d)
    if metric:
        x, y = own["x"].to_numpy(float), own["y"].to_numpy(float)
        near = reached & (np.sqrt((x[:, None] - x) * (x[:, None] - x) + (y[:, None] - y) * (y[:, None] - y)) <= radius)
    else:
        near = d <= radius
    known = np.where(reached, d, 0.0)
    pairs = reached & (d > 0) & (ids[:, None] < ids[None, :])
    tol = 1e-8 + 1e-5 * np.abs(known)
    choice = np.zeros(n, int)
    for a in range(0, n, step := max(1, 2_000_000 // (n * n))):
        # pairs that have segment k on a least way, but not as an end
        k = np.arange(a, min(a + step, n))
        on = pairs & (np.abs(d[:, k].T[:, :, None] + d[k][:, None, :] - known) <= tol)
        on[k - a, k] = False
        on[k - a, :, k] = False
        choice[k] = on.sum(axis=(1, 2))
    return pd.DataFrame({"id": ids, "nc": near.sum(axis=1).astype(float), "td": np.where(near, known, 0.0).sum(axis=1), "far": known.sum(axis=1), "choice": choice})


def _angular_rows(found: DataFrame) -> DataFrame:
    some = F.col("nc") > 1
    return found.select("id", F.when(some, 1 / F.greatest(F.col("td") / (F.col("nc") - 1), F.lit(1e-9))).otherwise(F.lit(0.0)).alias("integration"), "choice", F.when(some, F.pow("nc", F.lit(1.2)) / (F.col("td") + 2)).otherwise(F.lit(0.0)).alias("nain"), (F.ln(F.col("choice") + 1.0) / F.ln(F.col("far") + 3)).alias("nach"))


def _angular_by_joins(arcs: DataFrame, middles: DataFrame, radius: float, metric: bool) -> DataFrame:
    """The same by tables of all pairs, whatever the size of a part."""
    from urbanloom.core.graph import shortest

    d = stored(shortest(arcs, middles.select("node"), directed=True), "turns")
    near = d.where(F.col("dist") <= radius)
    if metric:
        at = lambda k: middles.select(F.col("node").alias(k), F.col("x").alias(f"x_{k}"), F.col("y").alias(f"y_{k}"))
        near = d.withColumnRenamed("node", "target").join(at("source"), "source").join(at("target"), "target").where(F.expr("sqrt((x_source - x_target) * (x_source - x_target) + (y_source - y_target) * (y_source - y_target))") <= radius)
    s = near.groupBy(F.col("source").alias("id")).agg(F.count("*").cast("double").alias("nc"), F.sum("dist").alias("td"))
    whole = d.groupBy(F.col("source").alias("id")).agg(F.sum("dist").alias("far"))
    # s before t, and v on a least way between them
    st = d.where("source < node and dist > 0").select(F.col("source").alias("s"), F.col("node").alias("t"), F.col("dist").alias("st"))
    sv, vt = d.select(F.col("source").alias("s"), F.col("node").alias("v"), F.col("dist").alias("sv")), d.select(F.col("source").alias("v"), F.col("node").alias("t"), F.col("dist").alias("vt"))
    on = sv.join(vt, "v").join(st, ["s", "t"]).where("v <> s and v <> t").where(F.abs(F.col("sv") + F.col("vt") - F.col("st")) <= 1e-8 + 1e-5 * F.abs("st"))
    c = on.groupBy(F.col("v").alias("id")).agg(F.count("*").alias("choice"))
    out = middles.select(F.col("node").alias("id")).join(s, "id", "left").join(whole, "id", "left").join(c, "id", "left").na.fill(0, ["choice"])
    return _angular_rows(out)


def nearest_usage(edges: DataFrame, origins: DataFrame, destinations: DataFrame) -> DataFrame:
    """(src, dst, usage, criticality): how many origins' ways to their nearest destination go from src to dst, and in percent
    of the most used."""
    net = _net(edges, nodes=origins.select("node"))

    def run(net, pdf, goals):
        stop = {i for i in net.index(sorted(goals)).tolist() if i >= 0}
        used: dict[tuple[int, int], int] = {}
        for s in net.index(pdf["node"]).tolist():
            _, _, before, order = dijkstra(net.arcs("cost"), [(0.0, s, s)], stop=stop)
            at = order[-1]
            if at not in stop:
                continue
            while at != s:
                prev, _ = before[at]
                used[prev, at] = used.get((prev, at), 0) + 1
                at = prev
        return [(int(net.nodes[a]), int(net.nodes[b]), n) for (a, b), n in used.items()]

    own = origins.select(F.col("node").cast("long").alias("node")).na.drop()
    schema = "src long, dst long, n long"
    if isinstance(net, Regions):
        out = net.each(_with_goals(own, _ids(destinations)), lambda net, pdf: run(net, pdf[~pdf["goal"]], set(pdf["node"][pdf["goal"]].tolist())), schema, everywhere="goal")
    else:
        goals = {r[0] for r in _ids(destinations).limit(len(net.nodes) + 1).collect()}
        out = each(own, net, lambda net, pdf: run(net, pdf, goals), schema)
    s = out.groupBy("src", "dst").agg(F.sum("n").alias("usage"))
    s = stored(s, "usage")
    return s.crossJoin(F.broadcast(s.agg(F.max("usage").alias("_m")))).select("src", "dst", "usage", (100 * F.col("usage") / F.col("_m")).alias("criticality"))


def _totals(net: Network, origins: list[int], goals: list[int], same: bool) -> dict[tuple[int, int], float]:
    arcs = net.arcs("cost")
    out = {}
    for k, s in enumerate(origins):
        dist = dijkstra(arcs, [(0.0, s, s)])[0]
        out |= {(k, m): dist[g] for m, g in enumerate(goals) if g in dist and not (same and k == m)}
    return out


def edge_criticality(edges: DataFrame, origins: DataFrame, destinations: DataFrame, same: bool = False, directed: bool = True) -> DataFrame:
    """(edge, criticality, extra, disconnected, used_by): what leaving each edge out adds to the summed costs between
    origins and destinations (node), over that sum; pairs that it cuts; arcs of the edge. ``same`` leaves out pairs of
    equal places in both lists. Tasks take edges to leave out."""
    net = _net(edges, directed=directed, nodes=origins.select("node").unionByName(destinations.select("node")), whole=True)
    o, d = (net.index([r[0] for r in _ids(x).orderBy("node").limit(len(net.nodes) + 1).collect()]).tolist() for x in (origins, destinations))
    base = _totals(net, o, d, same)
    total = sum(base.values())

    def run(net, pdf):
        out = []
        for e in pdf["edge"].tolist():
            gone = net.edge == e
            new = _totals(net.without(gone), o, d, same)
            extra = sum(max(0.0, new[k] - c) for k, c in base.items() if k in new)
            out.append((int(e), extra / max(total, 1e-12), extra, sum(k not in new for k in base), int(gone.sum())))
        return out

    own = edges.sparkSession.createDataFrame(pd.DataFrame({"edge": np.unique(net.edge)})) if len(net.edge) else edges.sparkSession.createDataFrame([], "edge long")
    return each(own, net, run, "edge long, criticality double, extra double, disconnected long, used_by long")


def efficiency_loss(edges: DataFrame, nodes: DataFrame, of: str = "edge") -> DataFrame:
    """(key, loss): the share of the summed inverse distances between all nodes that goes with an edge (both directions) or
    with all arcs of a node. Tasks take what to leave out."""
    net = _net(edges, nodes=nodes.select("node"), whole=True)

    def efficiency(net):
        arcs = net.arcs("cost")
        return sum(1 / d for s in range(len(net.nodes)) for v, d in dijkstra(arcs, [(0.0, s, s)])[0].items() if v != s and d > 0)

    base = efficiency(net)

    def run(net, pdf):
        out = []
        origin = np.repeat(np.arange(len(net.nodes)), np.diff(net.begin))
        for k in pdf["key"].tolist():
            if of == "edge":
                gone = net.edge == k
            else:
                i = int(net.index([k])[0])
                gone = (origin == i) | (net.adj == i)
            out.append((int(k), (base - efficiency(net.without(gone))) / base if base > 0 else 0.0))
        return out

    keys = np.unique(net.edge) if of == "edge" else net.nodes
    return each(edges.sparkSession.createDataFrame(pd.DataFrame({"key": keys.astype(np.int64)})), net, run, "key long, loss double")


def disrupted(edges: DataFrame, blocked_edges: DataFrame | None = None, blocked_nodes: DataFrame | None = None) -> DataFrame:
    """The edges that stay when some (edge) and all at some nodes (node) are blocked; null costs stay null."""
    out = edges
    if blocked_edges is not None:
        out = out.join(blocked_edges.select("edge").distinct(), "edge", "left_anti")
    if blocked_nodes is not None:
        for end in ("src", "dst"):
            out = out.join(blocked_nodes.select(F.col("node").alias(end)).distinct(), end, "left_anti")
    return out.select(*edges.columns)


def service_loss(before: DataFrame, after: DataFrame, demand: DataFrame, cutoff: float | None = None) -> DataFrame:
    """One row from costs (o, d, cost) before and after and demand (o, pop): share and number of people cut off, mean delay
    of the others, and 100 (.7 share + .3 mean relative delay, 1 at most)."""
    within = lambda df, n: (df if cutoff is None else df.where(F.col("cost") <= cutoff)).groupBy("o").agg(F.min("cost").alias(n))
    rows = demand.join(within(before, "pre"), "o", "left").join(within(after, "post"), "o", "left")
    cut = F.col("pre").isNotNull() & F.col("post").isNull()
    both = F.col("pre").isNotNull() & F.col("post").isNotNull()
    delay = F.greatest(F.col("post") - F.col("pre"), F.lit(0.0))
    part = delay / F.greatest("pre", F.lit(1.0))
    s = rows.agg(F.sum("pop").alias("all"), F.sum(F.when(cut, F.col("pop")).otherwise(F.lit(0.0))).alias("isolated"), F.sum(F.when(both, F.col("pop"))).alias("w"), F.sum(F.when(both, F.col("pop") * delay)).alias("d"), F.sum(F.when(both, F.col("pop") * part)).alias("p"), F.avg(F.when(both, delay)).alias("d0"), F.avg(F.when(both, part)).alias("p0"))
    share = F.col("isolated") / F.when(F.col("all") > 0, F.col("all")).otherwise(F.lit(1.0))
    mean = lambda a, b: F.coalesce(F.when(F.col("w") > 0, F.col(a) / F.col("w")).otherwise(F.col(b)), F.lit(0.0))
    return s.select(share.alias("isolation_rate"), "isolated", mean("d", "d0").alias("mean_delay"), (100 * (0.7 * share + 0.3 * F.least(mean("p", "p0"), F.lit(1.0)))).alias("index"))


def comfort_routes(edges: DataFrame, pairs: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(o, d, nodes, length, shade, shortest, shortest_length): the way of least cost (1 + alpha (1 - shade) + (1 - alpha) heat) over
    edges (src, dst, cost, edge, shade[, heat]), its mean shade, and the shortest way."""
    heat = F.col("heat") if "heat" in edges.columns else F.lit(0.0)
    felt = edges.withColumn("felt", F.col("cost") * (1 + alpha * (1 - F.col("shade")) + (1 - alpha) * heat))
    best, short = route(felt, pairs, "felt"), route(edges, pairs)
    used = best.select("o", "d", F.explode("edges").alias("edge")).join(edges.select("edge", "cost", "shade"), "edge").groupBy("o", "d").agg(F.sum("cost").alias("length"), F.avg("shade").alias("shade"))
    return best.select("o", "d", "nodes").join(used, ["o", "d"], "left").join(short.select("o", "d", F.col("nodes").alias("shortest"), F.col("dist").alias("shortest_length")), ["o", "d"]).select("o", "d", "nodes", F.coalesce("length", F.lit(0.0)).alias("length"), F.coalesce("shade", F.lit(1.0)).alias("shade"), "shortest", "shortest_length")


def cool_routes(edges: DataFrame, pairs: DataFrame, heat_weight: float = 0.5) -> DataFrame:
    """(o, d, nodes, length, shade, lst, impedance, shortest_length, extra_pct) over directed edges (src, dst, cost, edge, shade, lst):
    the way of least cost ((1 - h) + h (1 - shade / 2) lst / 30)."""
    felt = edges.withColumn("felt", F.col("cost") * (1 - heat_weight + heat_weight * (1 - 0.5 * F.col("shade")) * (F.col("lst") / 30)))
    best, short = route(felt, pairs, "felt", True), route(edges, pairs, directed=True)
    used = best.select("o", "d", F.explode("edges").alias("edge")).join(edges.select("edge", "cost", "shade", "lst"), "edge").groupBy("o", "d").agg(F.sum("cost").alias("length"), F.avg("shade").alias("shade"), F.avg("lst").alias("lst"))
    out = best.select("o", "d", "nodes", F.col("dist").alias("impedance")).join(used, ["o", "d"], "left").join(short.select("o", "d", F.col("dist").alias("shortest_length")), ["o", "d"]).na.fill(0.0, ["length", "shade", "lst"])
    extra = F.when(F.col("shortest_length") > 0, 100 * (F.col("length") - F.col("shortest_length")) / F.col("shortest_length")).otherwise(F.lit(0.0))
    return out.select("o", "d", "nodes", "length", "shade", "lst", "impedance", "shortest_length", extra.alias("extra_pct"))


def evacuation(edges: DataFrame, demand: DataFrame, depots: DataFrame, speed: float = 40.0) -> tuple[DataFrame, DataFrame]:
    """(src, dst, flow, capacity, ratio, bottleneck) and one row (clearance, unassigned): each origin's people (node, pop) go by
    the way to their nearest depot over directed edges (src, dst, cost, capacity)."""
    net = _net(edges, directed=True, nodes=demand.select("node"))

    def run(net, pdf, goals):
        stop = {i for i in net.index(sorted(goals)).tolist() if i >= 0}
        out = []
        for s, pop in zip(net.index(pdf["node"]).tolist(), pdf["pop"]):
            dist, _, before, order = dijkstra(net.arcs("cost"), [(0.0, s, s)], stop=stop)
            at = order[-1]
            if at not in stop:
                out.append((None, None, pop, None))
                continue
            out.append((-1, -1, 0.0, dist[at]))
            while at != s:
                prev, _ = before[at]
                out.append((int(net.nodes[prev]), int(net.nodes[at]), pop, None))
                at = prev
        return out

    own = demand.select(F.col("node").cast("long").alias("node"), F.col("pop").cast("double").alias("pop")).where("pop > 0").join(_ids(depots), "node", "left_anti")
    schema = "src long, dst long, pop double, dist double"
    if isinstance(net, Regions):
        out = net.each(_with_goals(own, _ids(depots)), lambda net, pdf: run(net, pdf[~pdf["goal"]], set(pdf["node"][pdf["goal"]].tolist())), schema, everywhere="goal")
    else:
        goals = {r[0] for r in _ids(depots).limit(len(net.nodes) + 1).collect()}
        out = each(own, net, lambda net, pdf: run(net, pdf, goals), schema)
    moves = stored(out, "moves")
    flows = moves.where("src >= 0").groupBy("src", "dst").agg(F.sum("pop").alias("flow"))
    cap = edges.groupBy("src", "dst").agg(F.max("capacity").cast("double").alias("capacity"))
    out = stored(flows.join(cap, ["src", "dst"], "left").select("src", "dst", "flow", "capacity", F.when(F.col("capacity") > 0, F.col("flow") / F.col("capacity")).otherwise(F.lit(0.0)).alias("ratio"), ((F.col("capacity") > 0) & (F.col("flow") > F.col("capacity"))).alias("bottleneck")), "flows")
    t = moves.agg(F.coalesce(F.max("dist"), F.lit(0.0)).alias("far"), F.coalesce(F.sum(F.when(F.col("src").isNull(), F.col("pop"))), F.lit(0.0)).alias("unassigned"))
    queue = out.agg(F.coalesce(F.max(F.when(F.col("bottleneck"), F.col("ratio") - 1)), F.lit(0.0)).alias("q"))
    return out, t.crossJoin(queue).select((F.col("far") / max(1e-9, speed) + F.col("q")).alias("clearance"), "unassigned")


def evacuation_steps(edges: DataFrame, nodes: DataFrame, steps: int = 24) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edge, max_ratio, queue), (step, evacuated) and one row (evacuated, clearance_step) of a simulation: nodes (node, demand,
    capacity) admit people, the others move one edge towards the nearest node with room, capacity by capacity, and edges
    (edge, src, dst, capacity, cost) slow down with the fourth power of their load.

    The state of a step depends on the step before, so one task runs all of them, on a network within ``paths.ARCS``.
    """
    spark = edges.sparkSession
    net = _net(edges, ("cost", "capacity"), True, nodes.select("node"), whole=True)
    if nodes.count() > len(net.nodes):
        raise ValueError("each node once")
    pdf = nodes.select(F.col("node").cast("long"), F.col("demand").cast("double"), F.col("capacity").cast("double")).toPandas()
    people, room = np.zeros(len(net.nodes)), np.zeros(len(net.nodes))
    at = net.index(pdf["node"])
    people[at], room[at] = pdf["demand"], pdf["capacity"]
    origin = np.repeat(np.arange(len(net.nodes)), np.diff(net.begin))
    free, cap = net.values["cost"], net.values["capacity"]
    # ways lead to the open nodes, so the search runs against the arcs
    order = np.lexsort((np.arange(len(origin)), net.adj))
    times, ratio, queue = free.copy(), np.zeros(len(free)), np.zeros(len(free))
    total, start, cleared, series = 0.0, float(people.sum()), -1, []
    cleared = 0 if start == 0 else -1
    for t in range(steps):
        admitted = np.minimum(people, np.maximum(room, 0.0))
        people, room, total = people - admitted, room - admitted, total + float(admitted.sum())
        back: list[list[tuple]] = [[] for _ in net.nodes]
        for k in order.tolist():
            back[int(net.adj[k])].append((int(origin[k]), k, float(times[k])))
        _, _, before, _ = dijkstra(back, [(0.0, i, i) for i in np.flatnonzero(room > 0).tolist()])
        load = np.zeros(len(free))
        for u in np.flatnonzero(people > 0).tolist():
            if u in before:
                load[before[u][1]] += people[u]
        for k in np.flatnonzero(load > 0).tolist():
            moved = min(load[k], cap[k])
            people[origin[k]] -= moved
            people[net.adj[k]] += moved
        safe = np.where(cap > 0, cap, 1e-9)
        queue += np.maximum(0.0, load - safe)
        ratio = np.maximum(ratio, load / safe)
        times = free * (1 + 0.15 * (load / safe) ** 4)
        series.append((t, total))
        if cleared == -1 and total >= 0.95 * start:
            cleared = t
    by_edge = spark.createDataFrame(pd.DataFrame({"edge": net.edge.astype(np.int64), "max_ratio": ratio, "queue": queue})) if len(free) else spark.createDataFrame([], "edge long, max_ratio double, queue double")
    return by_edge, spark.createDataFrame(series, "step int, evacuated double"), spark.createDataFrame([(total, cleared)], "evacuated double, clearance_step int")


def clearance_order(edges: DataFrame, blocked: DataFrame, depot: int, cost_factor: float = 1.0) -> DataFrame:
    """(place, edge, distance): blocked edges (edge, volume, criticality) in the order in which a crew from the depot clears them: each
    time the highest criticality over volume^factor times the way there plus the edge; cleared edges open again.

    Unreachable ones count as 1e6 away. The order is sequential, so the driver follows it on a network within ``paths.ARCS``.
    """
    spark = edges.sparkSession
    net = _net(edges, whole=True)
    rows = blocked.select("edge", "volume", "criticality").orderBy("edge").limit(len(net.edge) + 1).collect()
    gone = {int(r["edge"]) for r in rows}
    ends = {}
    origin = np.repeat(np.arange(len(net.nodes)), np.diff(net.begin))
    for k, e in enumerate(net.edge.tolist()):
        if e in gone and e not in ends:
            ends[e] = (int(origin[k]), int(net.adj[k]), float(net.values["cost"][k]))
    at, total, out = int(net.index([depot])[0]), 0.0, []
    left = [r for r in rows if int(r["edge"]) in ends]
    while left:
        open_ = net.without(np.isin(net.edge, [int(r["edge"]) for r in left]))
        dist = dijkstra(open_.arcs("cost"), [(0.0, at, at)])[0]

        def score(r):
            u, _, c = ends[int(r["edge"])]
            return r["criticality"] / (r["volume"] ** cost_factor * (dist.get(u, 1e6) + c) + 1e-6)

        best = max(left, key=lambda r: (score(r), -int(r["edge"])))
        u, v, c = ends[int(best["edge"])]
        total += c + (dist[u] if u in dist else 0.0)
        out.append((len(out) + 1, int(best["edge"]), total))
        at = v
        left = [r for r in left if r["edge"] != best["edge"]]
    return spark.createDataFrame(out, "place int, edge long, distance double")


def cascade(power: DataFrame, water: DataFrame, depends: DataFrame, failed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kind, node) that have failed in the end and one row (rounds, power_share, water_share still working).

    Links (a, b) join power and water nodes; ``depends`` (power, water) fails water with power; a node whose neighbours
    have all failed fails too. Rounds of joins until nothing changes.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    nets = {"power": stored(both(power), "links"), "water": stored(both(water), "links")}
    every = {"power": nets["power"].select(F.col("a").alias("node")).unionByName(depends.select(F.col("power").alias("node"))).unionByName(failed.select("node")).distinct(), "water": nets["water"].select(F.col("a").alias("node")).unionByName(depends.select(F.col("water").alias("node"))).distinct()}
    down = stored(failed.select(F.lit("power").alias("kind"), "node").distinct(), "failed")
    rounds, n = 0, down.count()
    while True:
        rounds += 1
        lost = {k: down.where(F.col("kind") == k).select("node") for k in nets}
        new = depends.join(lost["power"], F.col("power") == F.col("node")).select(F.lit("water").alias("kind"), F.col("water").alias("node"))
        for k, links in nets.items():
            alive = links.join(lost[k].withColumnRenamed("node", "b"), "b", "left_anti").select("a").distinct()
            cut = links.select("a").distinct().join(alive, "a", "left_anti").select(F.lit(k).alias("kind"), F.col("a").alias("node"))
            new = new.unionByName(cut)
        down = stored(down.unionByName(new).distinct(), "failed")
        now = down.count()
        if now == n:
            break
        n = now
    share = [every[k].count() for k in ("power", "water")]
    gone = {r["kind"]: r["count"] for r in down.groupBy("kind").count().collect()}
    row = [(rounds, *((s - gone.get(k, 0)) / max(1, s) for s, k in zip(share, ("power", "water"))))]
    return down, down.sparkSession.createDataFrame(row, "rounds int, power_share double, water_share double")


def patch_importance(edges: DataFrame, patches: DataFrame) -> DataFrame:
    """(node, component, component_area, dpc): the percentage of the probability of connectivity that goes with a patch (node, area).

    Leaving a patch out changes its own component alone, so tasks take components; each holds one of them.
    """
    from urbanloom.operators.network import connected_components

    own = stored(connected_components(edges, patches.select("node")).join(patches.select("node", "area"), "node"), "patches")
    total = own.groupBy("component").agg(F.sum("area").alias("a")).agg(F.sum(F.col("a") * F.col("a")).alias("pc")).first()["pc"] or 0.0
    links = edges.join(own.select(F.col("node").alias("src"), "component"), "src").join(own.select(F.col("node").alias("dst")), "dst", "left_semi").groupBy("component").agg(F.collect_list(F.struct("src", "dst")).alias("links"))
    groups = own.groupBy("component").agg(F.collect_list(F.struct("node", "area")).alias("nodes")).join(links, "component", "left")

    def run(batches):
        for pdf in batches:
            out = []
            for comp, nodes, pairs in zip(pdf["component"], pdf["nodes"], pdf["links"]):
                area = {int(p["node"]): float(p["area"]) for p in nodes}
                near: dict[int, list[int]] = {v: [] for v in area}
                for p in pairs if pairs is not None else ():
                    near[int(p["src"])].append(int(p["dst"]))
                    near[int(p["dst"])].append(int(p["src"]))
                whole = sum(area.values())
                for v in area:
                    seen, rest = {v}, 0.0
                    for s in near[v]:
                        if s in seen:
                            continue
                        stack, mass = [s], 0.0
                        seen.add(s)
                        while stack:
                            u = stack.pop()
                            mass += area[u]
                            for x in near[u]:
                                if x not in seen:
                                    seen.add(x)
                                    stack.append(x)
                        rest += mass * mass
                    out.append((v, int(comp), whole, 100 * (whole * whole - rest) / total if total > 0 else 0.0))
            yield pd.DataFrame(out, columns=["node", "component", "component_area", "dpc"])

    return groups.mapInPandas(run, "node long, component long, component_area double, dpc double")
