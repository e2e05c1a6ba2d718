"""Rasters (r, c, values ..) in square tiles with a margin of their neighbours' cells: work on arrays, a tile a group.

A tile's task holds TILE + 2 * halo rows and columns, however large the raster is.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.core.tables import drop, stored
from urbanloom.session import ship

#: Rows and columns of a tile.
TILE = 256


def tiled(cells: DataFrame, values: list[str], halo: int, work: Callable[..., dict[str, np.ndarray]], out: str, extent: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(r, c, out ..) where ``work`` maps the arrays of a tile to arrays of its results.

    Missing cells are NaN. ``work`` gets the values' arrays with the margin, the row and column of their corner, and a
    mask of the cells that exist; ``extent`` (least and largest row and column) only matters to it. Results are kept
    for existing cells inside the tile.
    """
    ship(cells.sparkSession)
    # every cell goes to its own tile and to those whose margin it lies in
    span = lambda x: F.sequence(F.floor((F.col(x) - halo) / TILE), F.floor((F.col(x) + halo) / TILE))
    rows = cells.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), *(F.col(v).cast("double").alias(f"v{k}") for k, v in enumerate(values)))
    rows = rows.withColumn("tr", F.explode(span("r"))).withColumn("tc", F.explode(span("c")))
    size, names = TILE + 2 * halo, [x.strip().split()[0] for x in out.split(",")]

    def run(key, pdf):
        r0, c0 = int(key[0]) * TILE - halo, int(key[1]) * TILE - halo
        i, j = pdf["r"].to_numpy() - r0, pdf["c"].to_numpy() - c0
        inside = (i >= halo) & (i < halo + TILE) & (j >= halo) & (j < halo + TILE)
        if not inside.any():
            return pd.DataFrame({n: [] for n in ["r", "c", *names]})
        arrays = []
        for k in range(len(values)):
            a = np.full((size, size), np.nan)
            a[i, j] = pdf[f"v{k}"].to_numpy(float)
            arrays.append(a)
        known = np.zeros((size, size), bool)
        known[i, j] = True
        got = work(*arrays, r0, c0, known)
        i, j = i[inside], j[inside]
        return pd.DataFrame({"r": i + r0, "c": j + c0} | {n: got[n][i, j] for n in names})

    return rows.groupBy("tr", "tc").applyInPandas(run, f"r long, c long, {out}")


def extent_of(cells: DataFrame) -> tuple[int, int, int, int] | None:
    """Least and largest row and column; None without cells."""
    e = cells.agg(F.min("r"), F.max("r"), F.min("c"), F.max("c")).first()
    return None if e[0] is None else tuple(int(x) for x in e)


STEPS = [(i, j, math.sqrt(2) if i and j else 1.0) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def spread(cells: DataFrame, values: list[str], start: str, move: Callable, least: bool = True) -> DataFrame:
    """(r, c, state): the best state that can reach each cell from the starting states (column ``start``, null elsewhere).

    ``move(state, arrays, from_, to, length)`` is the state that a cell gives a neighbour (length 1 or the root of 2) or
    None; it must not be better than the one it comes from. Each tile settles its own cells given its neighbours' border;
    rounds go on until no border changes. Cells that nothing reaches get null.
    """
    sign = 1.0 if least else -1.0
    now = stored(cells.select("r", "c", *values, F.col(start).cast("double").alias("state")), "state")

    def work(*args):
        *arrays, state, _, _, known = args
        state = state.copy()
        heap = [(sign * state[i, j], int(i), int(j)) for i, j in zip(*np.nonzero(np.isfinite(state)))]
        heapq.heapify(heap)
        n, m = state.shape
        while heap:
            s, i, j = heapq.heappop(heap)
            if s > sign * state[i, j]:
                continue
            for di, dj, length in STEPS:
                a, b = i + di, j + dj
                if 0 <= a < n and 0 <= b < m and known[a, b]:
                    new = move(sign * s, arrays, (i, j), (a, b), length)
                    if new is not None and not sign * new >= sign * state[a, b]:
                        state[a, b] = new
                        heapq.heappush(heap, (sign * new, a, b))
        return {"state": state}

    while True:
        got = tiled(now, [*values, "state"], 1, work, "state double")
        new = stored(now.drop("state").join(got.withColumn("state", F.when(~F.isnan("state"), F.col("state"))), ["r", "c"]), "state")
        both = new.select("r", "c", F.col("state").alias("_n")).join(now.select("r", "c", F.col("state").alias("_o")), ["r", "c"])
        changed = not both.where("not (_n <=> _o)").isEmpty()
        drop(now)
        now = new
        if not changed:
            return now.select("r", "c", "state")
