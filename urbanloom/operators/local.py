"""Geographically weighted statistics: for each point a small weighted summary of its surroundings.

Pairs come from grid cells within the kernel's reach. A gaussian kernel is cut where all weights together no longer
change a sum of doubles (a point's own weight is 1). Each point's sums of products are one aggregate; the small solves
run in Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.core.spatial_join import nearest, range_join
from urbanloom.core.tables import stored
from urbanloom.session import ship

#: Points that are sent to all tasks at most, and pairs that a task weighs at once.
SENT, BLOCK = 1_000_000, 500_000
#: Pairs that are worked on at once, and the score below which the logistic curve isn't clipped.
CACHED, CLIPPED = 65_536, 20.0


def _reach(df: DataFrame, bandwidth: float) -> float:
    return bandwidth * math.sqrt(2 * (math.log(max(df.count(), 2)) + 37))


def kernel_pairs(df: DataFrame, kernel: str, bandwidth: float, columns: list[str]) -> DataFrame:
    """(i, j, k, columns of j): the weight k of each neighbour j of i, itself included, where it isn't 0.

    Kernels: fixed_gaussian, fixed_bisquare and adaptive_bisquare, whose bandwidth is a number of neighbours (itself
    counted) and which weighs points at the same place alone if that many are.
    """
    a, b = df.select(F.col("id").alias("i"), "x", "y"), df.select(F.col("id").alias("j"), "x", "y", *(F.col(c).alias(f"_{c}") for c in columns))
    extra = [f"_{c}" for c in columns]
    if kernel == "adaptive_bisquare":
        near = stored(nearest(df, df, max(1, int(bandwidth))).select("i", "j", "d", "rank"), "near")
        edge = near.groupBy("i").agg(F.max("d").alias("_e"))
        rows = near.join(edge, "i").where("d < _e").select("i", "j", F.pow(1 - (F.col("d") / F.col("_e")) * (F.col("d") / F.col("_e")), F.lit(2.0)).alias("k"))
        lone = edge.where("_e = 0").select("i").join(a, "i")
        same = lone.join(b.select("j", "x", "y"), ["x", "y"]).select("i", "j", F.lit(1.0).alias("k"))
        return rows.unionByName(same).join(b.drop("x", "y"), "j").select("i", "j", "k", *(F.col(f"_{c}").alias(c) for c in columns))
    if kernel not in ("fixed_gaussian", "fixed_bisquare"):
        raise ValueError(f"no kernel {kernel!r}")
    gauss = kernel == "fixed_gaussian"
    h = max(1e-9, bandwidth)
    pairs = range_join(a, b, _reach(df, h) if gauss else h, ["i"], ["j", *extra])
    u = F.col("d") / h
    k = F.exp(-0.5 * u * u) if gauss else F.pow(1 - u * u, F.lit(2.0))
    return pairs.select("i", "j", k.alias("k"), *(F.col(f"_{c}").alias(c) for c in columns)).where("k > 0")


def _sums(pairs: DataFrame, names: list[str]) -> DataFrame:
    """Weighted sums of products of the names and a constant for each i, as p<a>_<b>."""
    values = [F.lit(1.0), *map(F.col, names)]
    return pairs.groupBy("i").agg(*(F.sum(F.col("k") * values[a] * values[b]).alias(f"p{a}_{b}") for a in range(len(values)) for b in range(a, len(values))), F.count_if(F.col("k") > 1e-12).alias("support"))


def _matrix(pdf: pd.DataFrame, n: int) -> np.ndarray:
    out = np.zeros((len(pdf), n, n))
    for a in range(n):
        for b in range(a, n):
            out[:, a, b] = out[:, b, a] = pdf[f"p{a}_{b}"].to_numpy(float)
    return out


def gwr(df: DataFrame, y: str, xs: list[str], bandwidth: float, kernel: str = "adaptive_bisquare") -> DataFrame:
    """(id, support, fitted, residual, r2, hat, beta_<term>, se_<term>, t_<term>) of a local regression at each point (id, x, y, ..).

    ``hat`` is the point's own share in its fitted value; ``gwr_summary`` makes the model's figures of these rows.
    """
    names = [y, *xs]
    terms = ["intercept", *xs]
    p = len(xs)
    sums = _sums(kernel_pairs(df, kernel, bandwidth, names), names)
    own = df.select(F.col("id").alias("i"), *(F.col(c).cast("double").alias(f"own_{c}") for c in names))

    def solve(batches):
        for pdf in batches:
            g = _matrix(pdf, p + 2)
            keep = [0, *range(2, p + 2)]
            a, b, yy, w = g[:, keep][:, :, keep], g[:, keep, 1], g[:, 1, 1], g[:, 0, 0]
            inverse = np.linalg.pinv(a, hermitian=True)
            beta = np.einsum("nij,nj->ni", inverse, b)
            rss = np.maximum(yy - 2 * np.einsum("ni,ni->n", beta, b) + np.einsum("ni,nij,nj->n", beta, a, beta), 0)
            tss = np.maximum(yy - g[:, 0, 1] ** 2 / w, 0)
            free = w - p - 1
            se = np.where(free[:, None] > 0, np.sqrt(np.maximum(0, (rss / np.where(free > 0, free, 1))[:, None] * np.diagonal(inverse, axis1=1, axis2=2))), 0.0)
            x = np.column_stack([np.ones(len(pdf)), *(pdf[f"own_{c}"] for c in xs)])
            fitted = np.einsum("ni,ni->n", x, beta)
            out = {"id": pdf["i"], "support": pdf["support"], "fitted": fitted, "residual": pdf[f"own_{y}"] - fitted, "r2": np.where(tss > 0, 1 - rss / np.where(tss > 0, tss, 1), 1.0), "hat": np.einsum("ni,nij,nj->n", x, inverse, x)}
            for k, t in enumerate(terms):
                out |= {f"beta_{t}": beta[:, k], f"se_{t}": se[:, k], f"t_{t}": np.where(se[:, k] > 0, beta[:, k] / np.where(se[:, k] > 0, se[:, k], 1), 0.0)}
            yield pd.DataFrame(out)

    kind = df.schema["id"].dataType.simpleString()
    schema = f"id {kind}, support long, fitted double, residual double, r2 double, hat double" + "".join(f", `beta_{t}` double, `se_{t}` double, `t_{t}` double" for t in terms)
    return sums.join(own, "i").mapInPandas(solve, schema)


def gwr_summary(fitted: DataFrame, terms: int) -> DataFrame:
    """One row from the rows of ``gwr``: rss, tss, r2, effective parameters and AICc."""
    y = F.col("fitted") + F.col("residual")
    t = fitted.agg(F.sum(F.col("residual") * F.col("residual")).alias("rss"), (F.var_pop(y) * F.count("*")).alias("tss"), F.sum("hat").alias("s"), F.count("*").cast("double").alias("n"))
    s = F.when(F.col("s") > 0, F.col("s")).otherwise(F.lit(float(terms)))
    n, rss = F.col("n"), F.col("rss")
    aicc = F.when((n - s - 2 > 0) & (rss > 0), n * F.ln(rss / n) + n * math.log(2 * math.pi) + n * (n + s) / (n - 2 - s))
    return t.select("rss", "tss", F.when(F.col("tss") > 0, 1 - rss / F.col("tss")).otherwise(F.lit(0.0)).alias("r2"), s.alias("effective"), aicc.alias("aicc"))


def gwlr(df: DataFrame, y: str, xs: list[str], bandwidth: float, kernel: str = "fixed_gaussian", max_iter: int = 50, tol: float = 1e-5) -> DataFrame:
    """(id, probability, beta_<term>, se_<term>): a local logistic regression at each point; y is 0 or 1.

    With a fixed kernel up to SENT points are sent to all tasks, which weigh those of the nine cells about a point as they go;
    no pair is written. Beyond that, and with an adaptive kernel, a point's neighbours make one group, which its rounds of
    reweighting go over.
    """
    terms, spark = ["intercept", *xs], df.sparkSession
    kind = df.schema["id"].dataType.simpleString()
    schema = f"id {kind}, probability double" + "".join(f", `beta_{t}` double, `se_{t}` double" for t in terms)
    ship(spark)

    def fit(x, v, k, own):
        """A row for each row of weights ``k`` over the points (x, v), of the terms ``own`` at its own place."""
        q = x.shape[1]
        xx = (x[:, :, None] * x[:, None, :]).reshape(len(x), q * q)
        beta, todo = np.zeros((len(k), q)), np.arange(len(k))
        most, kv = np.abs(x).max(axis=0, initial=0.0), (k * v) @ x

        def at(b, k, kv):
            """The weighted squares of the terms, and what they are solved for."""
            if not (np.abs(b) @ most < CLIPPED).all():
                eta = np.clip(b @ x.T, -30, 30)
                p = np.clip(1 / (1 + np.exp(-eta)), 1e-9, 1 - 1e-9)
                weight = k * p * (1 - p)
                return (weight @ xx).reshape(-1, q, q), (weight * eta + k * (v - p)) @ x
            # nothing to clip: the same in fewer passes, over as many points as stay in the cache
            squares, given, step = np.zeros((len(b), q * q)), np.zeros((len(b), q)), max(1, CACHED // len(b))
            for n in range(0, len(x), step):
                own = slice(n, n + step)
                p = -b @ x[own].T
                np.exp(p, out=p)
                p += 1
                np.reciprocal(p, out=p)
                kp = k[:, own] * p
                given += kp @ x[own]
                p -= 1
                p *= kp
                squares -= p @ xx[own]
            squares = squares.reshape(-1, q, q)
            return squares, (squares @ b[:, :, None])[:, :, 0] + kv - given

        for _ in range(max_iter):
            squares, aim = at(beta[todo], *((k[todo], kv[todo]) if len(todo) < len(k) else (k, kv)))
            new = (np.linalg.pinv(squares) @ aim[:, :, None])[:, :, 0]
            moved = np.abs(new - beta[todo]).max(axis=1)
            beta[todo] = new
            todo = todo[moved >= tol]
            if not len(todo):
                break
        se = np.sqrt(np.maximum(0, np.diagonal(np.linalg.pinv(at(beta, k, kv)[0]), axis1=1, axis2=2)))
        out = {"probability": 1 / (1 + np.exp(-np.clip((own * beta).sum(axis=1), -30, 30)))}
        for n, t in enumerate(terms):
            out |= {f"beta_{t}": beta[:, n], f"se_{t}": se[:, n]}
        return out

    matrix = lambda pdf: np.column_stack([np.ones(len(pdf)), *(pdf[c].to_numpy(float) for c in xs)])
    if kernel in ("fixed_gaussian", "fixed_bisquare") and df.count() <= SENT:
        h, gauss = max(1e-9, bandwidth), kernel == "fixed_gaussian"
        reach = _reach(df, h) if gauss else h
        rows = stored(df.where("x is not null and y is not null").select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col(y).cast("double").alias("_v"), *(F.col(c).cast("double").alias(f"_x{n}") for n, c in enumerate(xs))), "points")
        names = ["x", "y", "_v", *(f"_x{n}" for n in range(len(xs)))]
        # in a fixed order, whatever the tasks do
        points = rows.select("id", *names).toArrow().sort_by([("id", "ascending")]).to_pandas()[names].to_numpy(float)
        cell = np.floor(points[:, :2] / reach).astype(np.int64)
        order = np.lexsort((cell[:, 1], cell[:, 0]))
        points, cell = points[order], cell[order]
        first = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]).any(axis=1))[: len(cell)]).tolist()
        where = {(int(cell[i, 0]), int(cell[i, 1])): (i, j) for i, j in zip(first, [*first[1:], len(cell)])}
        sent = spark.sparkContext.broadcast((points, where))

        def run(batches):
            points, where = sent.value
            for pdf in batches:
                at = np.floor(pdf[["x", "y"]].to_numpy(float) / reach).astype(np.int64)
                for (cx, cy), own in pdf.groupby([at[:, 0], at[:, 1]], sort=False):
                    near = np.concatenate([points[slice(*where[c])] for i in (-1, 0, 1) for j in (-1, 0, 1) if (c := (cx + i, cy + j)) in where])
                    x = np.column_stack([np.ones(len(near)), near[:, 3:]])
                    for k in range(0, len(own), step := max(1, BLOCK // len(near))):
                        part = own.iloc[k : k + step]
                        w, at_x, at_y = np.empty((len(part), len(near))), *(part[c].to_numpy(float)[:, None] for c in "xy")
                        for n in range(0, len(near), cut := max(1, CACHED // len(part))):
                            u, dy = at_x - near[n : n + cut, 0], at_y - near[n : n + cut, 1]
                            u *= u
                            dy *= dy
                            u += dy
                            far = u > reach * reach
                            u /= h * h
                            w[:, n : n + cut] = np.exp(np.multiply(u, -0.5, out=u), out=u) if gauss else (1 - u) ** 2
                            w[:, n : n + cut][far] = 0.0
                        yield pd.DataFrame({"id": part["id"].to_numpy()} | fit(x, near[:, 2], w, np.column_stack([np.ones(len(part)), part[names[3:]].to_numpy(float)])))

        tasks = max(1, min(200, 4 * spark.sparkContext.defaultParallelism))
        return rows.repartition(tasks, F.xxhash64("id")).mapInPandas(run, schema)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x = matrix(pdf)
        own = x[(pdf["j"] == pdf["i"]).to_numpy()][:1]
        return pd.DataFrame({"id": pdf["i"].iloc[:1].to_numpy()} | fit(x, pdf[y].to_numpy(float), pdf["k"].to_numpy(float)[None], own))

    return kernel_pairs(df, kernel, bandwidth, [y, *xs]).groupBy("i").applyInPandas(solve, schema)


def gwss(df: DataFrame, columns: list[str], bandwidth: float, kernel: str = "fixed_gaussian") -> DataFrame:
    """(id, mean_<c>, std_<c>, skew_<c>): local weighted moments, taken about the columns' overall means."""
    centre = df.agg(*(F.avg(c).alias(c) for c in columns)).first()
    pairs = kernel_pairs(df, kernel, bandwidth, columns)
    v = {c: F.col(c) - F.lit(centre[c] or 0.0) for c in columns}
    sums = pairs.groupBy("i").agg(F.sum("k").alias("_w"), *(F.sum(F.col("k") * F.pow(v[c], F.lit(float(m)))).alias(f"_{m}_{c}") for c in columns for m in (1, 2, 3)))
    out = []
    for c in columns:
        a, b, d = (F.col(f"_{m}_{c}") / F.col("_w") for m in (1, 2, 3))
        sd = F.sqrt(F.greatest(b - a * a, F.lit(0.0)))
        third = d - 3 * a * b + 2 * a * a * a
        out += [(a + F.lit(centre[c] or 0.0)).alias(f"mean_{c}"), sd.alias(f"std_{c}"), F.when(sd > 1e-9, third / (sd * sd * sd)).otherwise(F.lit(0.0)).alias(f"skew_{c}")]
    return sums.select(F.col("i").alias("id"), *out)


def gwpca(df: DataFrame, columns: list[str], bandwidth: float, components: int = 2, kernel: str = "fixed_gaussian") -> DataFrame:
    """(id, total, winner, value_<k>, share_<k>): eigenvalues of the local weighted covariance, largest first, their shares
    in percent, and the column of the largest loading on the first."""
    n, k = len(columns), min(components, len(columns))
    centre = df.agg(*(F.avg(c).alias(c) for c in columns)).first()
    moved = df.select("id", "x", "y", *((F.col(c) - F.lit(centre[c] or 0.0)).alias(c) for c in columns))
    sums = _sums(kernel_pairs(moved, kernel, bandwidth, columns), columns)

    def solve(batches):
        for pdf in batches:
            g = _matrix(pdf, n + 1) / pdf["p0_0"].to_numpy(float)[:, None, None]
            cov = g[:, 1:, 1:] - g[:, 1:, :1] * g[:, :1, 1:]
            value, vector = np.linalg.eigh(cov)
            value, first = value[:, ::-1], vector[:, :, -1]
            total = np.maximum(np.maximum(value, 0).sum(axis=1), 1e-12)
            out = {"id": pdf["i"], "total": total, "winner": [columns[i] for i in np.abs(first).argmax(axis=1)]}
            for m in range(k):
                out |= {f"value_{m + 1}": value[:, m], f"share_{m + 1}": 100 * np.maximum(value[:, m], 0) / total}
            yield pd.DataFrame(out)

    kind = df.schema["id"].dataType.simpleString()
    return sums.mapInPandas(solve, f"id {kind}, total double, winner string" + "".join(f", value_{m + 1} double, share_{m + 1} double" for m in range(k)))


def space_time_ridge(df: DataFrame, y: str, xs: list[str], bandwidth_space: float, bandwidth_time: float, ridge: float = 0.1) -> DataFrame:
    """(id, fitted, residual, beta_<x>): local ridge regression without intercept, gaussian in space and time (column t)."""
    names, p = [y, *xs], len(xs)
    times = df.select(F.col("id").alias("i"), F.col("t").cast("double").alias("_ti"))
    pairs = kernel_pairs(df, "fixed_gaussian", max(bandwidth_space, 1e-6), ["t", *names]).join(times, "i")
    u = (F.col("t") - F.col("_ti")) / max(bandwidth_time, 1e-6)
    sums = _sums(pairs.withColumn("k", F.col("k") * F.exp(-0.5 * u * u)), names)
    own = df.select(F.col("id").alias("i"), *(F.col(c).cast("double").alias(f"own_{c}") for c in names))

    def solve(batches):
        for pdf in batches:
            g = _matrix(pdf, p + 2)
            beta = np.linalg.solve(g[:, 2:, 2:] + ridge * np.eye(p), g[:, 2:, 1:2])[:, :, 0]
            fitted = sum(beta[:, k] * pdf[f"own_{c}"].to_numpy(float) for k, c in enumerate(xs))
            yield pd.DataFrame({"id": pdf["i"], "fitted": fitted, "residual": pdf[f"own_{y}"] - fitted} | {f"beta_{c}": beta[:, k] for k, c in enumerate(xs)})

    kind = df.schema["id"].dataType.simpleString()
    return sums.join(own, "i").mapInPandas(solve, f"id {kind}, fitted double, residual double" + "".join(f", `beta_{c}` double" for c in xs))
