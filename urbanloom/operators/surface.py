"""Surfaces as cells (r, c, z, ..), rows from north to south: water, sun, sky, sight, growth and texture.

What looks far about a cell works on tiles with a margin of that reach (``core.tiles``); what travels over the surface
settles tile by tile until nothing changes. Cells that are missing or null are no data.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from urbanloom.core.ordered import running
from urbanloom.core.tables import stored
from urbanloom.core.tiles import TILE, extent_of, spread, tiled
from urbanloom.operators.facility import label_components
from urbanloom.operators.raster import D8, OFFSETS, neighbourhood, slope
from urbanloom.session import ship

#: Cells that a margin may reach at most, which bounds a tile's task; farther sight needs larger cells.
REACH = 2048


def _valid(cells: DataFrame, value: str = "z") -> DataFrame:
    v = F.col(value).cast("double")
    return cells.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def _reach(cells_: int) -> int:
    if cells_ > REACH:
        raise ValueError(f"a reach of {cells_} cells, {REACH} at most: use larger cells")
    return max(1, cells_)


# water


def fill_depressions(cells: DataFrame, value: str = "z") -> DataFrame:
    """(r, c, z): each cell raised to the lowest level at which water gets to the raster's border."""
    cells = _valid(cells, value)
    e = extent_of(cells)
    if e is None:
        return cells.select("r", "c", F.col(value).cast("double").alias("z"))
    border = (F.col("r").isin(e[0], e[1])) | (F.col("c").isin(e[2], e[3]))
    start = cells.select("r", "c", F.col(value).cast("double").alias("z")).withColumn("s", F.when(border, F.col("z")))
    got = spread(start, ["z"], "s", lambda s, a, f, t, d: max(s, a[0][t]))
    return got.join(cells.select("r", "c", F.col(value).cast("double").alias("_z")), ["r", "c"]).select("r", "c", F.coalesce("state", "_z").alias("z"))


def hand(cells: DataFrame, flow: DataFrame, drainage: DataFrame, value: str = "z", rounds: int = 64) -> DataFrame:
    """(r, c, hand): height above the first drainage cell (r, c) downstream along the directions (r, c, dir); a cell whose way ends
    before one, in a pit or at the border, is measured from there. Pointer doubling: rounds grow with the logarithm."""
    code = F.create_map(*(x for c, i, j in D8 for x in (F.lit(c), F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")))))
    own = _valid(cells, value).select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col(value).cast("double").alias("z"))
    stops = drainage.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).distinct().withColumn("stop", F.lit(True))
    step = code[F.col("dir")]
    links = own.join(flow.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "dir"), ["r", "c"], "left").join(stops, ["r", "c"], "left")
    to = F.when(F.col("stop").isNull() & (F.coalesce("dir", F.lit(0)) > 0), F.struct((F.col("r") + step["i"]).alias("r"), (F.col("c") + step["j"]).alias("c")))
    links = links.select(F.struct("r", "c").alias("at"), "z", to.alias("to"))
    # a way out of the raster ends where it is
    there = own.select(F.struct("r", "c").alias("to"), F.lit(True).alias("_in"))
    links = stored(links.join(there, "to", "left").select("at", "z", F.when(F.col("_in"), F.col("to")).alias("to")), "flow")
    ends = stored(links.select("at", "z", F.coalesce("to", "at").alias("to")), "flow")
    for _ in range(rounds):
        jump = ends.select(F.col("at").alias("to"), F.col("to").alias("next"))
        new = stored(ends.join(jump, "to").select("at", "z", F.col("next").alias("to")), "flow")
        moved = new.join(ends.select("at", F.col("to").alias("old")), "at").where("to <> old").limit(1).count()
        ends = new
        if not moved:
            break
    else:
        raise RuntimeError("the flow doesn't end")
    low = own.select(F.struct("r", "c").alias("to"), F.col("z").alias("low"))
    return ends.join(low, "to").select("at.r", "at.c", (F.col("z") - F.col("low")).alias("hand"))


def inundation(hand_cells: DataFrame, depth: float) -> DataFrame:
    """Adds ``wet``: 1 where 0 <= hand <= depth, else 0."""
    return hand_cells.withColumn("wet", F.when((F.col("hand") >= 0) & (F.col("hand") <= depth), 1.0).otherwise(0.0))


def flood_exposure(wet: DataFrame, buildings: DataFrame, people: DataFrame, origin: tuple[float, float], size: tuple[float, float]) -> DataFrame:
    """One row: buildings (x, y) and people (x, y, pop) on wet cells, all of them, and the percentages.

    ``origin`` is the raster's corner and ``size`` a cell's width and (negative) height; coordinates are cut towards 0.
    """
    on = wet.where("wet > 0.5").select("r", "c").distinct()

    def placed(df: DataFrame, weight: Column, name: str) -> DataFrame:
        at = df.select(((F.col("y") - origin[1]) / size[1]).cast("int").alias("r"), ((F.col("x") - origin[0]) / size[0]).cast("int").alias("c"), weight.cast("double").alias("w"))
        hit = at.join(on.withColumn("_hit", F.lit(True)), ["r", "c"], "left")
        return hit.agg(F.coalesce(F.sum(F.when(F.col("_hit"), F.col("w"))), F.lit(0.0)).alias(f"exposed_{name}"), F.coalesce(F.sum("w"), F.lit(0.0)).alias(f"total_{name}"))

    both = placed(buildings, F.lit(1.0), "buildings").crossJoin(placed(people, F.col("pop"), "people"))
    pct = lambda n: F.coalesce(100 * F.try_divide(f"exposed_{n}", f"total_{n}"), F.lit(0.0)).alias(f"pct_{n}")
    return both.select("*", pct("buildings"), pct("people"))


def bathtub(cells: DataFrame, level: float, sea: str | None = None) -> DataFrame:
    """(r, c, flooded, depth): cells at or below the level that hang together (eight ways) with the sea: cells of the mask, or
    border cells at or below 0."""
    cells = _valid(cells)
    e = extent_of(cells)
    low = cells.withColumn("low", F.col("z") <= level)
    seed = F.col(sea) if sea else (F.col("z") <= 0) & (F.col("r").isin(*(e or (0,) * 4)[:2]) | F.col("c").isin(*(e or (0,) * 4)[2:]))
    labels = stored(label_components(low, "low"), "labels")
    wet = low.where("low").join(labels, ["r", "c"]).groupBy("component").agg(F.max(seed.cast("int")).alias("s")).where("s = 1").select("component")
    flooded = labels.join(wet, "component", "left_semi").select("r", "c", F.lit(True).alias("flooded"))
    out = cells.select("r", "c", "z").join(flooded, ["r", "c"], "left")
    return out.select("r", "c", F.coalesce("flooded", F.lit(False)).alias("flooded"), F.when(F.col("flooded"), level - F.col("z")).otherwise(F.lit(0.0)).alias("depth"))


def surge(cells: DataFrame, height: float, sea: str, cell: float = 10.0, runup: float = 0.0, decay: float = 0.0) -> DataFrame:
    """(r, c, flooded, depth): a surge from the sea's cells that falls by ``decay`` for each kilometre of its shortest way over
    flooded cells."""
    cells, top = _valid(cells), height + runup
    start = cells.withColumn("s", F.when(F.col(sea), F.lit(0.0)))
    km = cell / 1000

    def move(s, a, f, t, d):
        far = s + d * km
        return far if a[0][t] <= max(0.0, top - far * decay) else None

    got = spread(start, ["z"], "s", move)
    rows = cells.select("r", "c", "z", F.col(sea).alias("_sea")).join(got, ["r", "c"])
    depth = F.greatest(F.lit(top) - F.col("state") * decay, F.lit(0.0)) - F.col("z")
    return rows.select("r", "c", F.col("state").isNotNull().alias("flooded"), F.when(F.col("state").isNull(), F.lit(0.0)).when(F.col("_sea"), F.greatest(F.lit(top) - F.col("z"), F.lit(0.0))).otherwise(depth).alias("depth"))


def storm_surge(cells: DataFrame, coast: str, level: float, cell: float = 10.0, manning: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(r, c, depth) and one row of area, depths, volume and cells by hazard (low, medium, high): water from the coast's cells
    below the level, which loses head by roughness on its way (the best way counts)."""
    cells = _valid(cells)
    values = ["z", *([manning] if manning else [])]
    start = cells.withColumn("s", F.when(F.col(coast) & (F.col("z") < level), F.lit(float(level))))

    def move(s, a, f, t, d):
        new = s - (max(0.0, a[1][t] * 0.01 * cell * (1.41421356 if d > 1 else 1.0)) if len(a) > 1 else 0.0)
        return new if new > a[0][t] else None

    got = spread(start, values, "s", move, least=False)
    depth = stored(cells.select("r", "c", "z").join(got, ["r", "c"]).select("r", "c", F.coalesce(F.col("state") - F.col("z"), F.lit(0.0)).alias("depth")), "depth")
    wet, area = F.when(F.col("depth") > 0, F.col("depth")), cell * cell
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    t = depth.agg((F.count(wet) * area).alias("area"), zero(F.max(wet)).alias("max_depth"), zero(F.avg(wet)).alias("mean_depth"), zero(F.sum(wet) * area).alias("volume"), F.count_if(wet < 0.5).alias("low"), F.count_if((wet >= 0.5) & (wet <= 1.5)).alias("medium"), F.count_if(wet > 1.5).alias("high"))
    return depth, t


def pluvial_susceptibility(cells: DataFrame, cell: float, radius: float = 150.0, drainage: str | None = None, w_low: float = 0.45, w_flat: float = 0.3, w_drain: float = 0.25) -> DataFrame:
    """(r, c, score, class): how low a cell lies, how little relief its square neighbourhood has, and how near drains are."""
    cells = _valid(cells)
    k = _reach(max(1, round(radius / cell)))

    def relief(z, r0, c0, known):
        hi, lo = np.where(np.isnan(z), -np.inf, z), np.where(np.isnan(z), np.inf, z)
        for axis in (0, 1):
            for best, a in ((np.maximum, "hi"), (np.minimum, "lo")):
                src = hi if a == "hi" else lo
                out = src.copy()
                for s in range(1, k + 1):
                    for way in (1, -1):
                        moved = np.roll(src, way * s, axis)
                        edge = [slice(None)] * 2
                        edge[axis] = slice(0, s) if way > 0 else slice(-s, None)
                        moved[tuple(edge)] = -np.inf if a == "hi" else np.inf
                        out = best(out, moved)
                hi, lo = (out, lo) if a == "hi" else (hi, out)
        return {"relief": hi - lo}

    near = tiled(cells, ["z"], k, relief, "relief double")
    box = cells.agg(F.min("z").alias("_lo"), F.max("z").alias("_hi"))
    rows = cells.select("r", "c", "z", *([F.col(drainage).alias("_d")] if drainage else [])).join(near, ["r", "c"]).crossJoin(F.broadcast(box))
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0))
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(F.lit(1.0))
    low, flat = clip((1 - (F.col("z") - F.col("_lo")) / span) * 100), clip(100 - F.col("relief") / radius * 100)
    drain, w_drain = (clip(100 - F.col("_d") / (4 * radius) * 100), w_drain) if drainage else (F.lit(50.0), 0.0)
    score = clip((low * w_low + flat * w_flat + drain * w_drain) / ((w_low + w_flat + w_drain) or 1.0))
    return rows.select("r", "c", score.alias("score")).withColumn("class", risk_class(F.col("score")))


def risk_class(score: Column) -> Column:
    return F.when(score >= 75, "Very High").when(score >= 55, "High").when(score >= 35, "Moderate").otherwise("Low")


# fire


def wildfire_risk(cells: DataFrame, cell: float, vegetation: str, northern: bool = True, w_slope: float = 0.35, w_aspect: float = 0.2, w_veg: float = 0.45) -> DataFrame:
    """(r, c, score, class) from slope (30 degrees is full), aspect towards the sun (0 on slopes below 1 degree) and vegetation 0..1."""
    s = slope(_valid(cells), cell).join(cells.select("r", "c", F.col(vegetation).alias("_v")), ["r", "c"])
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0))
    cosine = F.cos(F.radians(F.col("aspect")))
    warm = F.when((F.col("slope") < 1) | (F.col("aspect") < 0), F.lit(0.0)).otherwise((1 - cosine if northern else 1 + cosine) * 50)
    total = (w_slope + w_aspect + w_veg) or 1.0
    score = (clip(F.col("slope") / 30 * 100) * w_slope + warm * w_aspect + clip(F.col("_v") * 100) * w_veg) / total
    return s.select("r", "c", score.alias("score")).withColumn("class", risk_class(F.col("score")))


def fire_arrival(cells: DataFrame, origin: tuple[int, int], wind: tuple[float, float], slope_col: str = "slope", fuel: str = "fuel", cell: float = 30.0) -> DataFrame:
    """(r, c, hours): when a fire from the origin arrives, by the rate of spread of the cell that it leaves; null where it doesn't."""
    speed = math.hypot(*wind)
    start = cells.withColumn("s", F.when((F.col("r") == origin[0]) & (F.col("c") == origin[1]), F.lit(0.0)))

    def move(s, a, f, t, d):
        fuel_ = a[1][f]
        if not fuel_ > 0:
            return None
        rate = 2.0 * (0.5 + fuel_) * (1 + 0.05 * speed + 0.02 * math.tan(math.radians(a[0][f])))
        return s + d * cell / max(0.1, rate) / 60

    return spread(start, [slope_col, fuel], "s", move).select("r", "c", F.col("state").alias("hours"))


def fire_buffers(arrival: DataFrame, steps: int = 10, cell: float = 30.0) -> DataFrame:
    """(step, burned, buffer): cells burned by each hour and the radius of their area plus 100 m."""
    every = arrival.sparkSession.range(1, steps + 1).select(F.col("id").cast("int").alias("step"))
    counts = arrival.where(F.col("hours") <= steps).groupBy(F.greatest(F.ceil("hours"), F.lit(1)).cast("int").alias("step")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    # one row an hour
    rows = every.join(counts, "step", "left").withColumn("burned", F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("step")))
    return rows.select("step", "burned", (F.sqrt(F.col("burned") * (cell * cell) / math.pi) + 100).alias("buffer"))


# sun and sky


def sun_position(year: Column | int, month: Column | int, day: Column | int, hour: Column | float, lat: Column | float, lon: Column | float) -> Column:
    """struct<altitude, azimuth> in degrees of the sun at an hour of UTC, by the low-precision solar equations."""
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    early = c(month) <= 2
    y, m = F.when(early, c(year) - 1).otherwise(c(year)), F.when(early, c(month) + 12).otherwise(c(month))
    a = F.floor(y / 100)
    jd = F.floor(365.25 * (y + 4716)) + F.floor(30.6001 * (m + 1)) + c(day) + (2 - a + F.floor(a / 4)) - 1524.5 + c(hour) / 24
    t = (jd - 2451545.0) / 36525.0
    rad, sin, cos = F.radians, F.sin, F.cos
    long = F.pmod(280.46646 + t * (36000.76983 + 0.0003032 * t), F.lit(360.0))
    anomaly = rad(357.52911 + t * (35999.05029 - 0.0001537 * t))
    ecc = 0.016708634 - t * (4.2037e-05 + 1.267e-07 * t)
    centre = sin(anomaly) * (1.914602 - t * (0.004817 + 1.4e-05 * t)) + sin(2 * anomaly) * (0.019993 - 0.000101 * t) + sin(3 * anomaly) * 0.000289
    omega = rad(125.04 - 1934.136 * t)
    apparent = rad(long + centre - 0.00569 - 0.00478 * sin(omega))
    oblique = rad(23 + (26 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60) / 60 + 0.00256 * cos(omega))
    decl = F.asin(sin(oblique) * sin(apparent))
    v = F.pow(F.tan(oblique / 2), F.lit(2.0))
    ml = rad(long)
    equation = 4 * F.degrees(v * sin(2 * ml) - 2 * ecc * sin(anomaly) + 4 * ecc * v * sin(anomaly) * cos(2 * ml) - 0.5 * v * v * sin(4 * ml) - 1.25 * ecc * ecc * sin(2 * anomaly))
    ha = F.pmod(c(hour) * 60 + equation + 4 * c(lon), F.lit(1440.0)) / 4 - 180
    ha = F.when(ha < -180, ha + 360).otherwise(ha)
    la = rad(c(lat))
    cos_z = F.least(F.greatest(sin(la) * sin(decl) + cos(la) * cos(decl) * cos(rad(ha)), F.lit(-1.0)), F.lit(1.0))
    zenith = F.acos(cos_z)
    denominator = cos(la) * sin(zenith)
    cos_az = F.least(F.greatest(F.try_divide(sin(la) * cos_z - sin(decl), denominator), F.lit(-1.0)), F.lit(1.0))
    az = F.degrees(F.acos(cos_az))
    azimuth = F.when(F.abs(denominator) < 1e-12, F.lit(180.0)).when(ha > 0, F.pmod(az + 180, F.lit(360.0))).otherwise(F.pmod(180 - az, F.lit(360.0)))
    return F.struct((90 - F.degrees(zenith)).alias("altitude"), azimuth.alias("azimuth"))


def _shifted(a: np.ndarray, dr: int, dc: int, fill: float) -> np.ndarray:
    """The values dr rows down and dc columns right of each cell."""
    out = np.full_like(a, fill)
    h, w = a.shape
    if abs(dr) < h and abs(dc) < w:
        out[max(0, -dr) : h - max(0, dr), max(0, -dc) : w - max(0, dc)] = a[max(0, dr) : h - max(0, -dr), max(0, dc) : w - max(0, -dc)]
    return out


def _ray(azimuth: float, steps: int) -> list[tuple[int, int]]:
    """Different (row, column) offsets of the cells towards the azimuth, halves to even."""
    out: list[tuple[int, int]] = []
    for i in range(1, steps + 1):
        at = (-round(i * math.cos(azimuth)), round(i * math.sin(azimuth)))
        if at != (0, 0) and at not in out[-2:]:
            out.append(at)
    return out


def _shadow(z: np.ndarray, altitude: float, azimuth: float, pixel: float, reach: float) -> np.ndarray:
    base, tan = np.where(np.isnan(z), -np.inf, z), math.tan(math.radians(altitude))
    top = np.full(z.shape, -np.inf)
    for dr, dc in _ray(math.radians(azimuth), max(1, math.ceil(reach / pixel))):
        np.maximum(top, _shifted(base, dr, dc, -np.inf) - math.hypot(dr, dc) * pixel * tan, out=top)
    return top > base + 0.01


def _shadow_reach(relief: float, altitude: float, pixel: float, extent, most: float | None) -> float:
    reach = relief / math.tan(math.radians(altitude))
    if most is not None:
        reach = min(reach, most)
    return min(reach, math.hypot(extent[1] - extent[0] + 1, extent[3] - extent[2] + 1) * pixel)


def _facts(cells: DataFrame) -> tuple[float, tuple[int, int, int, int]] | None:
    e = extent_of(cells)
    if e is None:
        return None
    b = cells.agg((F.max("z") - F.min("z")).alias("d")).first()
    return float(b["d"] or 0.0), e


def shadow_mask(cells: DataFrame, altitude: float, azimuth: float, pixel: float, most: float | None = None) -> DataFrame:
    """(r, c, shadow): whether something towards the sun rises above the sunbeam; all is dark when the sun is down."""
    own = _valid(cells)
    facts = _facts(own)
    if facts is None or altitude <= 0 or facts[0] <= 0:
        return own.select("r", "c", F.lit(altitude <= 0).alias("shadow"))
    reach = _shadow_reach(facts[0], altitude, pixel, facts[1], most)
    halo = _reach(math.ceil(reach / pixel))
    return tiled(own, ["z"], halo, lambda z, r0, c0, known: {"shadow": _shadow(z, altitude, azimuth, pixel, reach)}, "shadow boolean")


def day_of_year(year: int, month: int, day: int) -> int:
    import datetime

    return datetime.date(year, month, day).timetuple().tm_yday


def _moments(spark, year: int, month: int, day: int, offset: float, lat: float, lon: float, interval: float) -> list[tuple[float, float, float]]:
    """(hours, altitude, azimuth) of the steps of a day at which the sun is up."""
    n = max(1, round(24 * 60 / interval))
    local = (F.col("id") + 0.5) * (24 / n)
    rows = spark.range(n).select("id", sun_position(year, month, day, local - offset, lat, lon).alias("s")).where("s.altitude > 0").orderBy("id").collect()
    return [(interval / 60, r["s"]["altitude"], r["s"]["azimuth"]) for r in rows]


def _swept(cells: DataFrame, moments: list[tuple], pixel: float, most: float | None, gain) -> DataFrame | None:
    """(r, c, v): sums over the moments of ``gain(moment, shadow)``; None where no moment counts."""
    facts = _facts(cells)
    if facts is None or not moments:
        return None
    relief, e = facts
    far = [0.0 if relief <= 0 else _shadow_reach(relief, m[1], pixel, e, most) for m in moments]
    halo = _reach(math.ceil(max(far) / pixel))

    def work(z, r0, c0, known):
        total = np.zeros(z.shape)
        for m, reach in zip(moments, far):
            total += gain(m, _shadow(z, m[1], m[2], pixel, reach) if relief > 0 else np.zeros(z.shape, bool))
        return {"v": total}

    return tiled(cells, ["z"], halo, work, "v double")


def sun_hours(cells: DataFrame, pixel: float, year: int, month: int, day: int, offset: float, lat: float, lon: float, interval: float = 30.0, most: float | None = None) -> DataFrame:
    """(r, c, hours, daylight): hours of sun on a day, and how long the sun is up."""
    own = _valid(cells)
    moments = _moments(cells.sparkSession, year, month, day, offset, lat, lon, interval)
    got = _swept(own, moments, pixel, most, lambda m, dark: np.where(dark, 0.0, m[0]))
    got = own.select("r", "c", F.lit(0.0).alias("v")) if got is None else got
    return got.select("r", "c", F.col("v").alias("hours"), F.lit(sum(m[0] for m in moments)).cast("double").alias("daylight"))


def clear_sky(altitude: float, day: int) -> tuple[float, float]:
    """Beam on the ground and diffuse light of a clear sky."""
    if altitude <= 0:
        return 0.0, 0.0
    turn = lambda k: math.sin(2 * math.pi * (day - k) / 365)
    up = math.sin(math.radians(altitude))
    direct = (1160 + 75 * turn(275)) * math.exp(-(0.174 + 0.035 * turn(100)) / up)
    return direct * up, (0.095 + 0.04 * turn(100)) * direct


def daily_irradiation(cells: DataFrame, pixel: float, year: int, month: int, day: int, offset: float, lat: float, lon: float, interval: float = 30.0, svf: str | None = None, most: float | None = None) -> DataFrame:
    """(r, c, kwh, flat): a day's irradiation with shadows, diffuse light by the sky view factor (1 if none), and that of open ground."""
    own, n = _valid(cells), day_of_year(year, month, day)
    moments = [(*m, *clear_sky(m[1], n)) for m in _moments(cells.sparkSession, year, month, day, offset, lat, lon, interval)]
    beam = _swept(own, moments, pixel, most, lambda m, dark: np.where(dark, 0.0, m[3] * m[0]))
    beam = own.select("r", "c", F.lit(0.0).alias("v")) if beam is None else beam
    diffuse = sum(m[4] * m[0] for m in moments)
    sky = own.select("r", "c", (F.col(svf) if svf else F.lit(1.0)).alias("_s"))
    return beam.join(sky, ["r", "c"]).select("r", "c", ((F.col("v") + F.lit(diffuse) * F.col("_s")) / 1000).alias("kwh"), F.lit(sum((m[3] + m[4]) * m[0] for m in moments) / 1000).cast("double").alias("flat"))


#: The day of each month that stands for its mean declination.
MEAN_DAY = (17, 16, 16, 15, 15, 11, 17, 16, 15, 15, 14, 10)


def annual_irradiation(cells: DataFrame, pixel: float, year: int, offset: float, lat: float, lon: float, interval: float = 60.0, svf: str | None = None, months: list[int] | None = None, most: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(r, c, kwh) and (month, mean, flat): a year from a mean day of each month times its days."""
    import calendar

    parts = []
    for m in months or range(1, 13):
        days = calendar.monthrange(year, m)[1]
        day = daily_irradiation(cells, pixel, year, m, MEAN_DAY[m - 1], offset, lat, lon, interval, svf, most)
        parts.append(day.select("r", "c", F.lit(m).alias("month"), (F.col("kwh") * days).alias("kwh"), (F.col("flat") * days).alias("flat")))
    rows = stored(reduce(DataFrame.unionByName, parts), "months")
    return rows.groupBy("r", "c").agg(F.sum("kwh").alias("kwh")), rows.groupBy("month").agg(F.avg("kwh").alias("mean"), F.max("flat").alias("flat"))


def sky_view_factor(cells: DataFrame, pixel: float, directions: int = 16, radius: float = 100.0) -> DataFrame:
    """(r, c, svf): 1 less the mean of the horizon's squared sine over the directions."""
    steps = _reach(math.ceil(radius / pixel))

    def work(z, r0, c0, known):
        base, total = np.where(np.isnan(z), -np.inf, z), np.zeros(z.shape)
        for d in range(directions):
            top = np.zeros(z.shape)
            for dr, dc in _ray(2 * math.pi * d / directions, steps):
                with np.errstate(invalid="ignore"):
                    np.fmax(top, (_shifted(base, dr, dc, -np.inf) - base) / (math.hypot(dr, dc) * pixel), out=top)
            with np.errstate(invalid="ignore"):  # cells without data look up endlessly
                total += top * top / (1 + top * top)
        return {"svf": np.clip(1 - total / directions, 0, 1)}

    return tiled(_valid(cells), ["z"], steps, work, "svf double")


def grid_sky_view(cells: DataFrame, pixel: float = 1.0, radius: float = 100.0, directions: int = 8) -> DataFrame:
    """(r, c, svf): mean squared cosine of the horizon; what lies outside has height 0."""
    steps = _reach(round(radius / pixel))

    def work(z, r0, c0, known):
        base, total = np.where(np.isnan(z), 0.0, z), np.zeros(z.shape)
        for k in range(directions):
            a = 2 * math.pi * k / directions
            top = np.zeros(z.shape)
            for p in range(1, steps + 1):
                # rows and columns grow with the angle's cosine and sine, looking back
                dr, dc = -round(p * math.cos(a)), -round(p * math.sin(a))
                if dr or dc:
                    np.maximum(top, np.maximum(0.0, _shifted(base, dr, dc, 0.0) - base) / (math.hypot(dr, dc) * pixel), out=top)
            total += 1 / (1 + top * top)
        return {"svf": np.clip(total / directions, 0, 1)}

    return tiled(_valid(cells), ["z"], steps, work, "svf double")


def solar_access(cells: DataFrame, pixel: float, suns: list[tuple[float, float]], most: float = 150.0) -> DataFrame:
    """(r, c, access): percentage of the suns (altitude, azimuth) above the horizon that a cell sees."""
    own, up = _valid(cells), [s for s in suns if s[0] > 0]
    if not suns or not up:
        return own.select("r", "c", F.lit(0.0 if suns else 100.0).alias("access"))
    top = own.agg(F.max("z").alias("m")).first()["m"] or 0.0
    plan = []
    for alt, azi in up:
        tan = math.tan(math.radians(alt))
        plan.append((tan, math.radians(azi), max(1, round(min(most, top / tan if tan > 0 else most) / pixel))))
    halo = _reach(max(p[2] for p in plan))

    def work(z, r0, c0, known):
        base, seen = np.where(np.isnan(z), 0.0, z), np.zeros(z.shape)
        for tan, az, n in plan:
            roof = base.copy()
            for p in range(1, n + 1):
                dr, dc = -round(p * math.cos(az)), round(p * math.sin(az))
                if dr or dc:
                    np.maximum(roof, _shifted(base, dr, dc, 0.0) - math.hypot(dr, dc) * pixel * tan, out=roof)
            seen += base >= roof - 1e-5
        return {"access": 100 * seen / len(plan)}

    return tiled(own, ["z"], halo, work, "access double")


# sight


def _steps(pixel: float, reach: float) -> np.ndarray:
    return np.arange(pixel / 2, reach + pixel / 2, pixel / 2)


def _looks(cells: DataFrame, value: str, points: DataFrame, pixel: float, reach: float, work, out: str) -> DataFrame:
    """``work`` for each point (id, r, c) on the array of what lies within reach; points of one tile share a group."""
    ship_cells = cells.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col(value).cast("double").alias("v"))
    halo = _reach(math.ceil(reach / pixel) + 1)
    span = lambda x: F.sequence(F.floor((F.col(x) - halo) / TILE), F.floor((F.col(x) + halo) / TILE))
    rows = ship_cells.withColumn("tr", F.explode(span("r"))).withColumn("tc", F.explode(span("c"))).select("tr", "tc", "r", "c", "v")
    kind = points.schema["id"].dataType.simpleString()
    asked = points.select("id", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).withColumn("tr", F.floor(F.col("r") / TILE)).withColumn("tc", F.floor(F.col("c") / TILE))
    names = ["id", *(x.strip().split()[0] for x in out.split(","))]

    def run(key, own, cells_):
        if not len(own) or not len(cells_):
            return pd.DataFrame({n: [] for n in names})
        r0, c0, size = int(key[0]) * TILE - halo, int(key[1]) * TILE - halo, TILE + 2 * halo
        a = np.full((size, size), np.nan)
        a[cells_["r"].to_numpy() - r0, cells_["c"].to_numpy() - c0] = cells_["v"].to_numpy(float)
        known = np.zeros((size, size), bool)
        known[cells_["r"].to_numpy() - r0, cells_["c"].to_numpy() - c0] = True
        return pd.DataFrame([(i, *row) for i, r, c in zip(own["id"], own["r"] - r0, own["c"] - c0) for row in work(a, known, int(r), int(c), r0, c0)], columns=names)

    ship(cells.sparkSession)
    return asked.groupBy("tr", "tc").cogroup(rows.groupBy("tr", "tc")).applyInPandas(run, f"id {kind}, {out}")


def _diagonal(cells: DataFrame, pixel: float, radius: float | None) -> float:
    e = extent_of(cells)
    diag = 0.0 if e is None else math.hypot(e[1] - e[0] + 1, e[3] - e[2] + 1) * pixel
    return diag if radius is None or radius <= 0 else min(radius, diag)


def viewshed(cells: DataFrame, observers: DataFrame, pixel: float, eye: float = 1.6, target: float = 0.0, radius: float | None = None, rays: int = 720) -> DataFrame:
    """(id, r, c): cells that each observer (id, r, c) sees along the rays, half a cell a step; the own cell is seen."""
    reach = _diagonal(cells, pixel, radius)
    t = _steps(pixel, reach)

    def look(z, known, r, c, r0, c0):
        own = z[r, c] if np.isfinite(z[r, c]) else 0.0
        seen = {(r, c)}
        for k in range(rays):
            a = 2 * math.pi * k / rays
            rr, cc = np.rint(r - t * (math.cos(a) / pixel)).astype(int), np.rint(c + t * (math.sin(a) / pixel)).astype(int)
            ok = (rr >= 0) & (rr < z.shape[0]) & (cc >= 0) & (cc < z.shape[1])
            ok[ok] = known[rr[ok], cc[ok]]
            rr, cc, d = rr[ok], cc[ok], t[ok]
            v = z[rr, cc]
            finite = np.isfinite(v)
            surface = np.where(finite, (np.where(finite, v, 0) - own - eye) / d, -np.inf)
            horizon = np.concatenate([[-np.inf], np.maximum.accumulate(surface)[:-1]]) if len(d) else surface
            hit = finite & (np.where(finite, v, 0) + target - own - eye >= (horizon - 1e-12) * d)
            seen |= set(zip(rr[hit].tolist(), cc[hit].tolist()))
        return [(i + r0, j + c0) for i, j in seen]

    return _looks(cells, "z", observers, pixel, reach, look, "r long, c long")


def isovists(cells: DataFrame, mask: str, points: DataFrame, pixel: float = 1.0, rays: int = 360, most: float | None = None) -> DataFrame:
    """(id, area, perimeter, min_rad, max_rad, mean_rad, circularity, occlusivity): what each point (id, r, c) sees in the plane
    up to blocked cells (mask) or the raster's end, half a cell a step; nothing from a blocked cell."""
    blocked = cells.select("r", "c", F.col(mask).cast("double").alias("_m"))
    reach = _diagonal(cells, pixel, most)
    t = _steps(pixel, reach)
    angle = 2 * np.pi * np.arange(rays) / rays

    def look(m, known, r, c, r0, c0):
        if m[r, c] > 0.5:
            return [(0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)]
        radii, hits = np.zeros(rays), 0
        for k in range(rays):
            # the same steps as a ray's own sine and cosine give
            rr, cc = np.rint(r + t * (-math.cos(angle[k]) / pixel)).astype(int), np.rint(c + t * (math.sin(angle[k]) / pixel)).astype(int)
            inside = (rr >= 0) & (rr < m.shape[0]) & (cc >= 0) & (cc < m.shape[1])
            inside[inside] = known[rr[inside], cc[inside]]
            stop = len(t) if inside.all() else int(np.argmin(inside))
            wall = m[rr[:stop], cc[:stop]] > 0.5
            hit = bool(wall.any())
            stop = int(np.argmax(wall)) if hit else stop
            radii[k] = t[stop - 1] if stop else 0.0
            if not hit and most is not None and most > 0:
                radii[k] = min(radii[k], most)
            hits += hit
        x, y = radii * np.sin(angle), radii * np.cos(angle)
        x2, y2 = np.roll(x, -1), np.roll(y, -1)
        area, around = 0.5 * abs(float(np.sum(x * y2 - x2 * y))), float(np.sum(np.hypot(x2 - x, y2 - y)))
        return [(area, around, float(radii.min()), float(radii.max()), float(radii.mean()), min(1.0, 4 * math.pi * area / around**2) if around > 0 else 0.0, hits / rays)]

    return _looks(blocked, "_m", points, pixel, reach, look, "area double, perimeter double, min_rad double, max_rad double, mean_rad double, circularity double, occlusivity double")


# growth and texture


def _sum8(cells: DataFrame, value: str) -> DataFrame:
    """(r, c, near): sum of the eight neighbours, missing ones 0."""
    n = neighbourhood(cells.select("r", "c", F.col(value).cast("double").alias("_v")), "_v")
    return n.select("r", "c", reduce(lambda a, b: a + b, [F.coalesce(f"n{k}", F.lit(0.0)) for k, (i, j) in enumerate(OFFSETS) if i or j]).alias("near"))


def urban_growth(cells: DataFrame, urban: str, suitability: str, demand: int, iterations: int = 5, blocked: str | None = None, neighbour_weight: float = 1.0, base: float = 0.1) -> DataFrame:
    """(r, c, year): the step in which a cell becomes urban (0 if it was, null if never): each step turns the cells of highest
    suitability (min-max) times base + share of urban neighbours, ties by row and column; the last step takes the remainder."""
    ok = _valid(cells, suitability)
    box = ok.agg(F.min(suitability).alias("lo"), F.max(suitability).alias("hi")).first()
    lo, span = (box["lo"] or 0.0), ((box["hi"] - box["lo"]) if box["lo"] is not None else 0.0) or 1.0
    stop = F.coalesce(F.col(blocked).cast("boolean"), F.lit(False)) if blocked else F.lit(False)
    finite = ok.select("r", "c", ((F.col(suitability) - lo) / span).alias("s"))
    now = cells.select("r", "c", F.when(F.col(urban), F.lit(0)).alias("year"), stop.alias("stop")).join(finite, ["r", "c"], "left")
    now = stored(now, "growth")
    iterations, demand = max(1, iterations), max(0, demand)
    for step in range(1, iterations + 1):
        want = demand // iterations + (demand % iterations if step == iterations else 0)
        near = _sum8(now.withColumn("u", F.col("year").isNotNull()), "u")
        score = F.col("s") * (base + neighbour_weight * F.col("near") / 8)
        open_ = now.where("year is null and not stop and s is not null").join(near, ["r", "c"]).select("r", "c", score.alias("score"))
        placed = running(open_, [F.col("score").desc(), F.col("r"), F.col("c")], {"_n": ("sum", F.lit(1))}).where(F.col("_n") <= want).select("r", "c", F.lit(step).alias("_new"))
        now = stored(now.join(placed, ["r", "c"], "left").select("r", "c", F.coalesce("year", "_new").alias("year"), "stop", "s"), "growth")
    return now.select("r", "c", "year")


def sleuth_growth(cells: DataFrame, urban: str, slope_col: str, road: str, excluded: str, diffusion: float = 50.0, breed: float = 50.0, spread_: float = 50.0, slope_coef: float = 50.0, road_coef: float = 50.0, steps: int = 10) -> DataFrame:
    """(r, c, year): deterministic growth of inner cells: slope resistance times road gravity times diffusion, breeding by one urban
    neighbour and spreading by two or more; above 0.35 a cell becomes urban."""
    e = extent_of(cells)
    p = F.exp(-F.col(slope_col) * (slope_coef / 100)) * F.exp(-F.col(road) / max(100.0, 1000 * (1 - road_coef / 100)))
    inner = F.lit(False) if e is None else (F.col("r") > e[0]) & (F.col("r") < e[1]) & (F.col("c") > e[2]) & (F.col("c") < e[3])
    now = stored(cells.select("r", "c", F.when(F.col(urban), F.lit(0)).alias("year"), F.when(inner & ~F.coalesce(F.col(excluded), F.lit(False)), p).alias("p")), "growth")
    for step in range(1, steps + 1):
        near = _sum8(now.withColumn("u", F.col("year").isNotNull()), "u")
        rows = now.join(near, ["r", "c"])
        chance = F.col("p") * (0.2 * diffusion / 100 + 0.3 * F.when(F.col("near") == 1, breed / 100).otherwise(0.0) + 0.5 * F.when(F.col("near") >= 2, spread_ / 100).otherwise(0.0))
        now = stored(rows.select("r", "c", F.when(F.col("year").isNull() & (chance > 0.35), F.lit(step)).otherwise(F.col("year")).alias("year"), "p"), "growth")
    return now.select("r", "c", "year")


def fractal_dimension(cells: DataFrame, mask: str, least: int = 2, most: int = 32) -> DataFrame:
    """(box, boxes, dimension): boxes of doubling size that hold a cell of the mask (whole boxes from the first row and column),
    and the slope of their logarithms."""
    e = extent_of(cells)
    sizes, b = [], least
    while e is not None and b <= min(most, e[1] - e[0] + 1, e[3] - e[2] + 1):
        sizes.append(b)
        b *= 2
    spark = cells.sparkSession
    if not sizes:
        return spark.createDataFrame([], "box int, boxes long, dimension double")
    h, w = e[1] - e[0] + 1, e[3] - e[2] + 1
    at = lambda c, k, n: F.floor((F.col(c) - k) / F.col("box")).alias(n)
    on = cells.where(F.col(mask)).select("r", "c", F.explode(F.array(*map(F.lit, sizes))).alias("box"))
    on = on.select("box", at("r", e[0], "i"), at("c", e[2], "j")).where((F.col("i") < F.floor(F.lit(h) / F.col("box"))) & (F.col("j") < F.floor(F.lit(w) / F.col("box"))))
    counts = spark.createDataFrame([(s,) for s in sizes], "box int").join(on.distinct().groupBy("box").agg(F.count("*").alias("boxes")), "box", "left").na.fill(0, ["boxes"])
    x, y = F.ln(1 / F.col("box")), F.ln(F.col("boxes") + 1e-12)
    fit = counts.agg(F.abs(F.regr_slope(y, x)).alias("d"))
    return counts.crossJoin(F.broadcast(fit)).select("box", "boxes", F.coalesce("d", F.lit(1.0)).alias("dimension"))


def sprawl(cells: DataFrame, before: str, after: str, pop_before: float, pop_after: float, pixel: float = 1.0) -> DataFrame:
    """One row: areas, land consumption and population growth rates and their ratio, patches (four neighbours), share of the
    largest, border length (the raster's edge counts) and its density."""
    t = cells.agg(F.count_if(before).alias("n1"), F.count_if(after).alias("n2"))
    patches = label_components(cells, after, 4).groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("patches"), F.max("n").alias("top"), F.sum("n").alias("all"))
    n = neighbourhood(cells.select("r", "c", F.col(after).cast("int").alias("m")), "m")
    sides = [OFFSETS.index(x) for x in ((0, 1), (1, 0), (0, -1), (-1, 0))]
    border = n.where("n4 = 1").agg(F.coalesce(F.sum(reduce(lambda a, b: a + b, [(F.coalesce(f"n{k}", F.lit(0)) == 0).cast("long") for k in sides])), F.lit(0)).alias("e"))
    px = float(pixel)
    pgr = math.log(pop_after / pop_before) if pop_before > 0 and pop_after > 0 else None
    lcr = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.ln(F.col("n2") / F.col("n1")))
    edge, area = F.col("e") * px, F.col("n2") * (px * px)
    out = t.crossJoin(patches).crossJoin(border)
    return out.select((F.col("n1") * (px * px)).alias("area_before"), area.alias("area_after"), lcr.alias("lcr"), F.lit(pgr).cast("double").alias("pgr"), (lcr / F.lit(pgr) if pgr else F.lit(None).cast("double")).alias("ratio"), "patches", F.coalesce(F.col("top") / F.col("all"), F.lit(0.0)).alias("largest_share"), edge.alias("edge"), F.when(area > 0, edge / area).otherwise(F.lit(0.0)).alias("edge_density"))
