"""Networks small enough to be sent whole to every task: paths from many sources at once, one source after another.

``network`` returns None beyond ARCS arcs; callers then go by regions of whole components (``core.regions``) or by rounds of
joins (``core.graph``), which have no bound.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.session import ship

#: Arcs (two for an undirected edge) that are broadcast at most; about 40 bytes each.
ARCS = 2_000_000
INF = float("inf")


class Network:
    """Arcs sorted by origin: ``adj`` to which node, ``edge`` of which edge, and their values by name."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, edge: np.ndarray, values: dict[str, np.ndarray], nodes: np.ndarray | None = None):
        self.nodes = np.unique(np.concatenate([src, dst] if nodes is None else [src, dst, nodes]))
        a, b = np.searchsorted(self.nodes, src), np.searchsorted(self.nodes, dst)
        order = np.lexsort((edge, b, a))
        self.adj, self.edge = b[order], edge[order]
        self.values = {k: v[order] for k, v in values.items()}
        self.begin = np.searchsorted(a[order], np.arange(len(self.nodes) + 1))
        self._arcs: dict[tuple, list] = {}

    def index(self, ids) -> np.ndarray:
        """Places of node ids; -1 for unknown ones."""
        ids = np.asarray(ids, np.int64)
        at = np.minimum(np.searchsorted(self.nodes, ids), max(len(self.nodes) - 1, 0))
        return np.where(self.nodes[at] == ids, at, -1) if len(self.nodes) else np.full(len(ids), -1)

    def arcs(self, *names: str) -> list[list[tuple]]:
        """For each node its (neighbour, edge, values ..)."""
        if names not in self._arcs:
            rows = list(zip(self.adj.tolist(), self.edge.tolist(), *(self.values[n].tolist() for n in names)))
            self._arcs[names] = [rows[a:b] for a, b in zip(self.begin[:-1].tolist(), self.begin[1:].tolist())]
        return self._arcs[names]

    def without(self, gone: np.ndarray) -> Network:
        """The same nodes without the arcs where ``gone`` is true."""
        out = object.__new__(Network)
        keep = ~gone
        origin = np.repeat(np.arange(len(self.nodes)), np.diff(self.begin))[keep]
        out.nodes, out.adj, out.edge = self.nodes, self.adj[keep], self.edge[keep]
        out.values, out._arcs = {k: v[keep] for k, v in self.values.items()}, {}
        out.begin = np.searchsorted(origin, np.arange(len(self.nodes) + 1))
        return out


def network(edges: DataFrame, values: tuple[str, ...] = ("cost",), directed: bool = False, nodes: DataFrame | None = None, limit: int = ARCS) -> Network | None:
    """The network of edges (src, dst, values ..[, edge]) with integer nodes, or None if it has more than ``limit`` arcs.

    Edges without an id are numbered by their ends and values; rows with a null end or value are left out.
    """
    has_id = "edge" in edges.columns
    cols = ["src", "dst", *values, *(["edge"] if has_id else [])]
    rows = edges.select(*(F.col(c).cast("long").alias(c) if c in ("src", "dst", "edge") else F.col(c).cast("double").alias(c) for c in cols)).na.drop()
    if rows.count() > (limit if directed else limit // 2):
        return None
    pdf = rows.toPandas().sort_values(cols, kind="stable").reset_index(drop=True)
    own = None if nodes is None else np.array([r[0] for r in nodes.select(F.col(nodes.columns[0]).cast("long")).na.drop().distinct().limit(limit + 1).collect()], np.int64)
    if own is not None and len(own) > limit:
        return None
    src, dst = pdf["src"].to_numpy(np.int64), pdf["dst"].to_numpy(np.int64)
    edge = pdf["edge"].to_numpy(np.int64) if has_id else np.arange(len(pdf))
    vals = {v: pdf[v].to_numpy(float) for v in values}
    if directed:
        return Network(src, dst, edge, vals, own)
    both = lambda x, y: np.concatenate([x, y])
    return Network(both(src, dst), both(dst, src), both(edge, edge), {k: both(v, v) for k, v in vals.items()}, own)


def dijkstra(arcs: list[list[tuple]], starts: list[tuple[float, int, int]], cutoff: float | None = None, stop: set[int] | None = None) -> tuple[dict, dict, dict, list]:
    """Costs, labels, (node, edge) before each node, and nodes in the order settled, from (cost, node, label) starts.

    Ties go to the least (cost, label, node); with ``stop`` the search ends at the first of those nodes.
    """
    dist: dict[int, float] = {}
    label: dict[int, int] = {}
    before: dict[int, tuple[int, int]] = {}
    heap = []
    for d, s, who in starts:
        if (d, who) < (dist.get(s, INF), label.get(s, who + 1)):
            dist[s], label[s] = d, who
            heap.append((d, who, s))
    heapq.heapify(heap)
    settled, order = set(), []
    while heap:
        d, who, u = heapq.heappop(heap)
        if u in settled or d > dist[u] or who != label[u]:
            continue
        settled.add(u)
        order.append(u)
        if stop is not None and u in stop:
            break
        for v, e, c, *_ in arcs[u]:
            nd = d + c
            if v in settled or cutoff is not None and nd > cutoff:
                continue
            if nd < dist.get(v, INF) or nd == dist[v] and who < label[v]:
                dist[v], label[v], before[v] = nd, who, (u, e)
                heapq.heappush(heap, (nd, who, v))
    return dist, label, before, order


def pruned(arcs: list[list[tuple]], source: int, radius: float | None) -> tuple[dict, dict]:
    """Least costs and the second value along those paths, that is cut beyond the radius; arcs have (.., cost, second)."""
    cost, second, heap = {source: 0.0}, {source: 0.0}, [(0.0, 0.0, source)]
    while heap:
        c, p, u = heapq.heappop(heap)
        if c > cost[u]:
            continue
        for v, _, w, q in arcs[u]:
            if radius is not None and p + q > radius:
                continue
            if c + w < cost.get(v, INF):
                cost[v], second[v] = c + w, p + q
                heapq.heappush(heap, (c + w, p + q, v))
    return cost, second


def dependencies(arcs: list[list[tuple]], source: int, radius: float | None = None, cutoff: float | None = None, worth: Callable[[int, float], float] | None = None) -> tuple[dict, dict, dict, list]:
    """What the source's shortest paths put on nodes and edges (Brandes), costs, and nodes in the order settled.

    Costs that differ by a billionth are equal. ``radius`` bounds the arcs' second value, ``cutoff`` the cost. Each
    target counts 1, or ``worth(node, cost)``.
    """
    dist, second, sigma, preds = {source: 0.0}, {source: 0.0}, {source: 1.0}, {source: []}
    heap, seen, order = [(0.0, 0.0, source)], set(), []
    while heap:
        d, p, u = heapq.heappop(heap)
        if u in seen:
            continue
        seen.add(u)
        order.append(u)
        for v, e, c, *rest in arcs[u]:
            if v in seen:
                continue
            q = p + rest[0] if rest else p
            nd = d + c
            if radius is not None and q > radius or cutoff is not None and nd > cutoff:
                continue
            tol, old = 1e-9 * max(1.0, abs(nd)), dist.get(v, INF)
            if nd < old - tol:
                dist[v], second[v], sigma[v], preds[v] = nd, q, sigma[u], [(u, e)]
                heapq.heappush(heap, (nd, q, v))
            elif abs(nd - old) <= tol:
                sigma[v] += sigma[u]
                preds[v].append((u, e))
    delta: dict[int, float] = dict.fromkeys(order, 0.0)
    on_edge: dict[int, float] = {}
    for v in reversed(order):
        own = 1.0 if worth is None else (worth(v, dist[v]) if v != source else 0.0)
        share = (own + delta[v]) / sigma[v]
        for u, e in preds[v]:
            c = sigma[u] * share
            delta[u] += c
            on_edge[e] = on_edge.get(e, 0.0) + c
    delta.pop(source)
    return delta, on_edge, dist, order


def each(rows: DataFrame, net: Network, kernel: Callable[[Network, pd.DataFrame], Iterator[dict] | dict], schema: str) -> DataFrame:
    """``kernel`` over batches of ``rows`` with the network (or ``core.regions.Regions``) at hand; rows are dealt out evenly."""
    spark = rows.sparkSession
    ship(spark)
    if not isinstance(net, Network):
        return net.each(rows, kernel, schema)
    sent = spark.sparkContext.broadcast(net)
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches):
        for pdf in batches:
            out = kernel(sent.value, pdf)
            yield pd.DataFrame(out, columns=names) if isinstance(out, (list, dict)) else out

    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 200))
    return rows.repartition(parts).mapInPandas(run, schema)
