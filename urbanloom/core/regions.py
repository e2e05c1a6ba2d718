"""Networks with more arcs than a task is given, cut where no path leads: a region is one large connected component or
many small ones, and a task searches a region from the rows that start in it."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.core.graph import components
from urbanloom.core.ordered import running
from urbanloom.core.paths import ARCS, Network
from urbanloom.core.tables import stored

#: Arcs of a region of small components, about, as a share of what a task is given.
SHARE = 20
#: Tasks that share the rows of a component too large to be put together with others.
SLICES = 16


class Regions:
    """``arcs`` (src, dst, edge, values .., _region) and ``home`` (_node, _region) of the nodes that have arcs."""

    def __init__(self, arcs: DataFrame, home: DataFrame, values: tuple[str, ...], directed: bool, buckets: int):
        self.arcs, self.home, self.values, self.directed, self.buckets = arcs, home, values, directed, buckets

    def each(self, rows: DataFrame, kernel: Callable, schema: str, together: bool = False, everywhere: str | None = None) -> DataFrame:
        """``kernel`` once a region, with the rows whose first column is a node of it. The rows of a large component are
        dealt to some tasks unless they go ``together``; those with the flag ``everywhere`` go to all of them."""
        k, values, directed = rows.columns[0], self.values, self.directed
        names = [x.strip().split()[0] for x in schema.split(",")]
        alone = F.pmod(F.xxhash64(F.col(k)), F.lit(self.buckets))
        own = rows.join(self.home, F.col(k) == F.col("_node"), "left").withColumn("_region", F.coalesce("_region", F.concat(F.lit("h"), alone.cast("string")))).drop("_node")
        large, all_ = F.col("_region").startswith("c"), F.sequence(F.lit(0), F.lit(SLICES - 1))
        first = F.array(F.lit(0))
        if together:
            own, arcs = own.withColumn("_slice", F.lit(0)), self.arcs.withColumn("_slice", F.lit(0))
        else:
            one = F.when(large, F.array(F.pmod(F.xxhash64(F.col(k)), F.lit(SLICES)).cast("int"))).otherwise(first)
            own = own.withColumn("_slice", F.explode(one if everywhere is None else F.when(large & F.col(everywhere), all_).otherwise(one)))
            arcs = self.arcs.withColumn("_slice", F.explode(F.when(large, all_).otherwise(first)))

        def run(pdf, a):
            if pdf.empty:
                return pd.DataFrame(columns=names)
            src, dst, edge = (a[c].to_numpy(np.int64) for c in ("src", "dst", "edge"))
            vals = {v: a[v].to_numpy(float) for v in values}
            if not directed:
                src, dst, edge, vals = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([edge, edge]), {v: np.concatenate([x, x]) for v, x in vals.items()}
            nodes = np.concatenate([src, dst, pdf[k].to_numpy(np.int64)])
            out = kernel(Network(src, dst, edge, vals, nodes), pdf)
            return pd.DataFrame(out, columns=names) if isinstance(out, (list, dict)) else out

        by = ["_region", "_slice"]
        return own.groupBy(*by).cogroup(arcs.groupBy(*by)).applyInPandas(run, schema)


def regions(edges: DataFrame, values: tuple[str, ...] = ("cost",), directed: bool = False, limit: int = ARCS) -> Regions | None:
    """The regions of edges as ``paths.network`` takes them, or None if a single component has more than ``limit`` arcs."""
    has_id = "edge" in edges.columns
    cols = ["src", "dst", *values, *(["edge"] if has_id else [])]
    rows = edges.select(*(F.col(c).cast("long" if c in ("src", "dst", "edge") else "double").alias(c) for c in cols)).na.drop()
    if not has_id:
        rows = running(rows, [F.col(c) for c in cols], {"edge": ("sum", F.lit(1))}, inclusive=False).withColumn("edge", F.coalesce("edge", F.lit(0)).cast("long"))
    labels = components(rows, "src", "dst").select(F.col("node").alias("_node"), F.col("component").alias("_c"))
    # a node whose only arcs are loops is a component of its own
    rows = stored(rows.join(labels, F.col("src") == F.col("_node"), "left").withColumn("_c", F.coalesce("_c", "src")).drop("_node"), "arcs")
    each = 1 if directed else 2
    sizes = rows.groupBy("_c").agg((F.count("*") * each).alias("_n"))
    t = sizes.agg(F.max("_n").alias("most"), F.sum("_n").alias("all")).first()
    if (t["most"] or 0) > limit:
        return None
    buckets = max(1, math.ceil((t["all"] or 0) * SHARE / limit))
    region = F.when(F.col("_n") * SHARE > limit, F.concat(F.lit("c"), F.col("_c").cast("string"))).otherwise(F.concat(F.lit("h"), F.pmod(F.xxhash64("_c"), F.lit(buckets)).cast("string")))
    of = stored(sizes.select("_c", region.alias("_region")), "regions")
    arcs = stored(rows.join(of, "_c").select("src", "dst", "edge", *values, "_region"), "arcs")
    ends = arcs.select(F.explode(F.array("src", "dst")).alias("_node"), "_region").distinct()
    return Regions(arcs, stored(ends, "home"), values, directed, buckets)
