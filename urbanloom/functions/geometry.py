"""Polylines and rings as arrays of struct<x, y>: measures as column expressions; hulls in Arrow batches.

Rings may be closed or open. Null geometries give null.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

EPS = 1e-9


def _total(n: Column, term) -> Column:
    """Sum of term(i) for i from 1 to n (none if n < 1)."""
    steps = F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0)).cast("int")), lambda i: i > 0)
    return F.aggregate(steps, F.lit(0.0), lambda a, i: a + term(i))


def _hop(c: Column, i: Column) -> Column:
    dx, dy = c[i]["x"] - c[i - 1]["x"], c[i]["y"] - c[i - 1]["y"]
    return F.sqrt(dx * dx + dy * dy)


def points_of(df, key: str, order: str = "seq", into: str = "coords"):
    """(key, coords) from vertices (key, order, x, y)."""
    rows = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, "x", "y"))).alias("_p"))
    return rows.select(key, F.transform("_p", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))).alias(into))


def polyline_length(c: Column) -> Column:
    return F.when(c.isNotNull(), _total(F.size(c) - 1, lambda i: _hop(c, i)))


def closed(ring: Column) -> Column:
    first, last = ring[0], F.element_at(ring, -1)
    return F.when((first["x"] == last["x"]) & (first["y"] == last["y"]), ring).otherwise(F.concat(ring, F.array(first)))


def ring_area(ring: Column) -> Column:
    r = closed(ring)
    return F.abs(_total(F.size(r) - 1, lambda i: r[i - 1]["x"] * r[i]["y"] - r[i]["x"] * r[i - 1]["y"])) / 2


def ring_perimeter(ring: Column) -> Column:
    return polyline_length(closed(ring))


def _bearing(a: Column, b: Column) -> Column:
    return F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"]))


def angle_between(a: Column, b: Column) -> Column:
    """Difference of two bearings, 0 to 180 degrees."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.when(d > 180, 360 - d).otherwise(d)


def internal_curvature(c: Column) -> Column:
    """Sum of the turns at the inner vertices in degrees."""
    return F.when(c.isNotNull(), _total(F.size(c) - 2, lambda i: angle_between(_bearing(c[i - 1], c[i]), _bearing(c[i], c[i + 1]))))


def corner_count(ring: Column, least: float = 10.0) -> Column:
    """Vertices at which the ring turns by at least so many degrees."""
    r = closed(ring)
    n = F.size(r) - 1

    def turn(i: Column) -> Column:
        a, b, c = r[F.when(i == 1, n - 1).otherwise(i - 2)], r[i - 1], r[i]
        x1, y1, x2, y2 = b["x"] - a["x"], b["y"] - a["y"], c["x"] - b["x"], c["y"] - b["y"]
        moving = ((x1 != 0) | (y1 != 0)) & ((x2 != 0) | (y2 != 0))
        return F.when(moving & (F.degrees(F.abs(F.atan2(x1 * y2 - y1 * x2, x1 * x2 + y1 * y2))) >= least), 1.0).otherwise(0.0)

    return F.when(n < 3, F.lit(0)).otherwise(_total(n, turn).cast("int"))


def projected_width(ring: Column, azimuth: float) -> Column:
    """Extent across the wind that comes from ``azimuth`` degrees."""
    a = math.radians(azimuth)
    on = F.transform(ring, lambda p: p["x"] * math.cos(a) - p["y"] * math.sin(a))
    return F.array_max(on) - F.array_min(on)


def cumulated(c: Column) -> Column:
    """Lengths from the first vertex to each one."""
    return F.aggregate(F.sequence(F.lit(0), F.size(c) - 1), F.expr("cast(array() as array<double>)"), lambda a, i: F.concat(a, F.array(F.when(i == 0, F.lit(0.0)).otherwise(F.element_at(a, -1) + _hop(c, i)))))


def point_at(c: Column, t: Column) -> Column:
    """The point at the share t of the length; the first vertex of a line without length."""
    cum = cumulated(c)
    s = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * F.element_at(cum, -1)
    # the last vertex that isn't beyond, but never the very last
    i = F.least(F.greatest(F.size(F.filter(cum, lambda v: v <= s)) - 1, F.lit(0)), F.size(c) - 2)
    span = F.element_at(cum, i + 2) - F.element_at(cum, i + 1)
    u = F.when(span <= EPS, F.lit(0.0)).otherwise((s - F.element_at(cum, i + 1)) / span)
    a, b = F.element_at(c, i + 1), F.element_at(c, i + 2)
    at = F.struct((a["x"] + u * (b["x"] - a["x"])).alias("x"), (a["y"] + u * (b["y"] - a["y"])).alias("y"))
    return F.when(F.element_at(cum, -1) <= EPS, F.struct(c[0]["x"].alias("x"), c[0]["y"].alias("y"))).otherwise(at)


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull counter-clockwise from the leftmost point, without points on its sides."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts
    half = []
    for side in (pts, pts[::-1]):
        chain: list[np.ndarray] = []
        for p in side:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(p)
        half.append(chain[:-1])
    return np.array(half[0] + half[1])


def least_rectangle(points: np.ndarray) -> tuple[float, float, float]:
    """Length, width and direction (degrees, mod 180) of the smallest rectangle about the points, along a side of the hull."""
    h = hull(points)
    if len(h) == 1:
        return 0.0, 0.0, 0.0
    if len(h) == 2:
        dx, dy = h[1] - h[0]
        return float(np.hypot(dx, dy)), 0.0, math.degrees(math.atan2(dy, dx)) % 180
    best = None
    for dx, dy in np.roll(h, -1, axis=0) - h:
        n = math.hypot(dx, dy)
        along, across = h @ np.array([dx, dy]) / n, h @ np.array([-dy, dx]) / n
        w, t = float(np.ptp(along)), float(np.ptp(across))
        if best is None or w * t < best[0]:
            angle = math.degrees(math.atan2(dy, dx))
            best = (w * t, w, t, angle % 180) if w >= t else (w * t, t, w, (angle + 90) % 180)
    return best[1:]


def _xy(points) -> np.ndarray:
    return np.array([(p["x"], p["y"]) if isinstance(p, dict) else (p[0], p[1]) for p in points], float).reshape(-1, 2)


_POINTS = ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))


@pandas_udf(_POINTS)
def cut_polyline(lines: pd.Series, t0: pd.Series, t1: pd.Series) -> pd.Series:
    """The part of a line between two shares of its length; null if nothing is left."""

    def cut(line, a, b):
        if line is None:
            return None
        p, a, b = _xy(line), max(0.0, a), min(1.0, b)
        cum = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))])
        if cum[-1] <= EPS or b - a <= EPS:
            return None
        ends = [[np.interp(t * cum[-1], cum, p[:, k]) for k in (0, 1)] for t in (a, b)]
        inner = p[(cum > a * cum[-1] + EPS) & (cum < b * cum[-1] - EPS)].tolist()
        out = [ends[0]]
        for q in [*inner, ends[1]]:
            if math.dist(q, out[-1]) > EPS:
                out.append(q)
        return [{"x": float(x), "y": float(y)} for x, y in out] if len(out) > 1 else None

    return pd.Series([cut(*row) for row in zip(lines, t0, t1)], dtype=object)


@pandas_udf(_POINTS)
def convex_hull(rings: pd.Series) -> pd.Series:
    return rings.map(lambda r: None if r is None else [{"x": float(x), "y": float(y)} for x, y in hull(_xy(r))])


@pandas_udf(StructType([StructField(n, DoubleType()) for n in ("length", "width", "direction", "hull_area")]))
def envelope(rings: pd.Series) -> pd.DataFrame:
    """The smallest rectangle and the hull's area."""
    out = []
    for r in rings:
        p = _xy(r)
        h = hull(p)
        x, y = h[:, 0], h[:, 1]
        area = abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2 if len(h) > 2 else 0.0
        out.append((*least_rectangle(p), area))
    return pd.DataFrame(out, columns=["length", "width", "direction", "hull_area"])


def shape_metrics(ring: Column, courtyard: Column | float = 0.0) -> list[Column]:
    """Columns area, perimeter, ipq, convexity, rectangularity, elongation, direction, length, width and fractal of a ring
    whose courtyards have the given area."""
    outer, per, env = ring_area(ring), ring_perimeter(ring), envelope(ring)
    court = F.lit(courtyard) if isinstance(courtyard, float) else courtyard
    area = F.greatest(outer - court, F.lit(0.0))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return [
        area.alias("area"),
        per.alias("perimeter"),
        ratio(4 * math.pi * area, per * per).alias("ipq"),
        ratio(outer, env["hull_area"]).alias("convexity"),
        ratio(outer, env["length"] * env["width"]).alias("rectangularity"),
        F.when(env["length"] > 0, 1 - env["width"] / env["length"]).otherwise(F.lit(0.0)).alias("elongation"),
        env["direction"].alias("direction"),
        env["length"].alias("length"),
        env["width"].alias("width"),
        F.when((per > 4) & (outer > 1), 2 * F.ln(per / 4) / F.ln(outer)).otherwise(F.lit(0.0)).alias("fractal"),
    ]
