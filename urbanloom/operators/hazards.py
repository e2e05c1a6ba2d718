"""Hazards, climate and form: what sums, neighbourhoods and small fixed tables make of columns."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.core.ordered import numbered
from urbanloom.core.spatial_join import by_place, nearest, range_join
from urbanloom.core.tables import stored
from urbanloom.functions.geometry import hull, ring_area
from urbanloom.operators.services import gini_of
from urbanloom.session import ship


def _clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def _unit(df: DataFrame, columns: list[str], scale: float = 1.0) -> DataFrame:
    """``df`` with u_<c>: min-max of each column; 0 where it doesn't vary."""
    box = df.agg(*(f(c).alias(f"_{a}_{c}") for c in columns for a, f in (("lo", F.min), ("hi", F.max))))
    u = {f"u_{c}": F.when(F.col(f"_hi_{c}") > F.col(f"_lo_{c}"), scale * (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))).otherwise(F.lit(0.0)) for c in columns}
    return df.crossJoin(F.broadcast(box)).withColumns(u).drop(*(f"_{a}_{c}" for c in columns for a in ("lo", "hi")))


# water

#: Runoff coefficients by land use; other uses take 0.5.
RUNOFF = {"roofs": 0.90, "pavement": 0.85, "commercial": 0.80, "residential": 0.50, "lawns": 0.20, "forest": 0.10, "parks": 0.15}


def peak_runoff(shares: DataFrame, area_ha: float, intensity: float) -> DataFrame:
    """One row of land uses (kind, share): mean runoff coefficient, peak discharge by the rational method, volume of an hour."""
    if area_ha <= 0 or intensity <= 0:
        raise ValueError("area and intensity must be above 0")
    c = F.coalesce(F.create_map(*(x for k, v in RUNOFF.items() for x in (F.lit(k), F.lit(v))))[F.lower("kind")], F.lit(0.5))
    t = shares.agg(F.sum(c * F.col("share")).alias("c"), F.sum("share").alias("s")).select(F.when(F.col("s") > 0, F.col("c") / F.col("s")).otherwise(F.lit(0.5)).alias("coefficient"))
    q = 0.00278 * F.col("coefficient") * float(intensity) * float(area_ha)
    return t.select("coefficient", q.alias("peak"), (q * 3600).alias("volume"))


#: The dimensionless unit hydrograph, time over time to peak and discharge over peak.
HYDROGRAPH = (
    (0.0, 0.0), (0.1, 0.03), (0.2, 0.1), (0.3, 0.19), (0.4, 0.31), (0.5, 0.47), (0.6, 0.66), (0.7, 0.82), (0.8, 0.93), (0.9, 0.99), (1.0, 1.0),
    (1.1, 0.99), (1.2, 0.93), (1.3, 0.86), (1.4, 0.78), (1.5, 0.68), (1.6, 0.56), (1.7, 0.46), (1.8, 0.39), (1.9, 0.33), (2.0, 0.28), (2.2, 0.207),
    (2.4, 0.147), (2.6, 0.107), (2.8, 0.077), (3.0, 0.055), (3.2, 0.04), (3.4, 0.029), (3.6, 0.021), (3.8, 0.015), (4.0, 0.011), (4.5, 0.005), (5.0, 0.0),
)


def unit_hydrograph(basins: DataFrame, dt: float = 5.0, factor: float = 484.0) -> DataFrame:
    """(id, minute, discharge, peak, to_peak_h, runoff_mm, volume) of basins (id, area_km2, cn, rain_mm, concentration_h): a row a time step up to
    five times the time to peak."""
    s = 25400 / F.col("cn") - 254
    rain = F.col("rain_mm") - 0.2 * s
    b = basins.select("id", "area_km2", F.when(rain > 0, rain * rain / (rain + s)).otherwise(F.lit(0.0)).alias("runoff_mm"), (dt / 120 + 0.6 * F.col("concentration_h")).alias("to_peak_h"))
    b = b.withColumn("peak", factor / 484 * 0.208 * F.col("area_km2") * F.col("runoff_mm") / F.col("to_peak_h")).withColumn("volume", F.col("runoff_mm") * F.col("area_km2") * 1000)
    rows = b.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.col("to_peak_h") * 300 / dt + 0.5).cast("int")))).withColumn("minute", F.col("k") * dt)
    u = F.col("minute") / 60 / F.col("to_peak_h")
    q = F.lit(0.0)
    for (t0, q0), (t1, q1) in reversed(list(zip(HYDROGRAPH, HYDROGRAPH[1:]))):
        q = F.when((u >= t0) & (u <= t1), F.lit(q0) + (u - t0) * ((q1 - q0) / (t1 - t0))).otherwise(q)
    return rows.select("id", "minute", (q * F.col("peak")).alias("discharge"), "peak", "to_peak_h", "runoff_mm", "volume")


def flash_flood(cells: DataFrame, rain: float, pipes: float = 25.0) -> tuple[DataFrame, DataFrame]:
    """(id, runoff, ponding) and one row (max, mean, inundated share, hazard) by curve numbers (id, cn) and pipe capacity."""
    cn = _clip(F.col("cn"), 1, 100)
    s = 25400 / cn - 254
    ia = 0.2 * s
    runoff = F.when(F.lit(rain) > ia, (rain - ia) * (rain - ia) / (rain + 0.8 * s + 1e-12)).otherwise(F.lit(0.0))
    rows = cells.select("id", runoff.alias("runoff")).withColumn("ponding", F.greatest(F.col("runoff") - pipes, F.lit(0.0)))
    t = rows.agg(F.max("ponding").alias("max_ponding"), F.avg("ponding").alias("mean_ponding"), F.avg((F.col("ponding") > 10).cast("double")).alias("inundated"))
    return rows, t.withColumn("hazard", F.when(F.col("inundated") > 0.3, "High").otherwise("Moderate"))


def tsunami_shelter(people: DataFrame, coast: DataFrame, refuges: DataFrame, wave: float = 10.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, refuge, depth), (refuge, assigned, deficit) and one row (saved, rate): people (id, x, y, pop) to the nearest refuge (id, x, y, capacity);
    the wave falls with the distance to the coast (id, x, y)."""
    places, of = by_place(people)
    shore = nearest(places, by_place(coast)[0], 1).select(F.col("i").alias("place"), (F.lit(wave) * F.exp(-F.col("d") / 1000)).alias("depth"))
    to = nearest(places, by_place(refuges)[0], 1).select(F.col("i").alias("place"), F.col("j").alias("refuge"))
    rows = stored(of.join(to.join(shore, "place"), "place").select("id", "refuge", "depth").join(people.select("id", "pop"), "id"), "people")
    load = refuges.select(F.col("id").alias("refuge"), "capacity").join(rows.groupBy("refuge").agg(F.sum("pop").alias("assigned")), "refuge", "left").na.fill(0.0, ["assigned"])
    load = stored(load.select("refuge", "assigned", F.greatest(F.col("assigned") - F.col("capacity"), F.lit(0.0)).alias("deficit")), "load")
    t = people.agg(F.sum("pop").alias("p")).crossJoin(load.agg(F.sum("deficit").alias("d")))
    return rows.select("id", "refuge", "depth"), load, t.select((F.col("p") - F.col("d")).alias("saved"), ((F.col("p") - F.col("d")) / F.greatest("p", F.lit(1.0))).alias("rate"))


def slope_failures(cells: DataFrame, weight: float = 60.0) -> DataFrame:
    """One row: cells whose factor of safety (slope, cohesion, friction, pga) is below 1, their share, and its mean."""
    a, f = F.radians(_clip(F.col("slope"), 0.1, 89.0)), F.radians("friction")
    cos2 = F.cos(a) * F.cos(a)
    fs = (F.col("cohesion") + weight * cos2 * F.tan(f)) / (weight * F.sin(a) * F.cos(a) + F.col("pga") * weight * cos2 + 1e-12)
    return cells.select(fs.alias("fs")).agg(F.count_if(F.col("fs") < 1).alias("unstable"), F.avg((F.col("fs") < 1).cast("double")).alias("share"), F.avg("fs").alias("mean"))


# heat


def canopy_priority(edges: DataFrame, n: int) -> DataFrame:
    """(edge, priority) of the n edges (edge, flow, canopy, heat) with the highest flow times heat (min-max) times missing canopy; ties by
    the larger edge."""
    u = _unit(edges, ["heat"])
    return u.select("edge", (F.col("flow") * F.col("u_heat") * (1 - F.col("canopy"))).alias("priority")).orderBy(F.col("priority").desc(), F.col("edge").desc()).limit(max(0, n))


def tree_cooling(grid: DataFrame, trees: DataFrame, reach: float = 50.0) -> DataFrame:
    """(id, cooling): the most that a tree (id, x, y, radius, lai) cools: .6 LAI under it, falling exponentially beyond."""
    top = trees.agg(F.max("radius").alias("r")).first()["r"] or 0.0
    near = range_join(grid.select(F.col("id").alias("g"), "x", "y"), trees.select(F.col("id").alias("t"), "x", "y", "radius", "lai"), top + reach, ["g"], ["t", "radius", "lai"])
    out = F.col("d") - F.col("radius")
    cool = F.when(out <= 0, 0.6 * F.col("lai")).when(out <= reach, 0.6 * F.col("lai") * F.exp(-3 * out / reach)).otherwise(F.lit(0.0))
    return grid.select("id").join(near.groupBy("g").agg(F.max(cool).alias("c")), F.col("id") == F.col("g"), "left").select("id", F.greatest(F.coalesce("c", F.lit(0.0)), F.lit(0.0)).alias("cooling"))


def heat_vulnerability(zones: DataFrame) -> DataFrame:
    """(id, score, class) from uhi, sensitivity and canopy: .4 and .4 less .2 of their min-max, scaled 0..100 again."""
    u = _unit(zones, ["uhi", "sensitivity", "canopy"]).select("id", (0.4 * F.col("u_uhi") + 0.4 * F.col("u_sensitivity") - 0.2 * F.col("u_canopy")).alias("raw"))
    s = _unit(stored(u, "raw"), ["raw"], 100.0)
    return s.select("id", F.col("u_raw").alias("score"), F.when(F.col("u_raw") >= 75, "Very High").when(F.col("u_raw") >= 50, "High").when(F.col("u_raw") >= 25, "Moderate").otherwise("Low").alias("class"))


def greening_plan(sites: DataFrame, trees: int, radius: float = 100.0) -> tuple[DataFrame, float]:
    """(step, id, priority) and the summed effect: each time the site (id, x, y, lst, aqi, people, canopy) of highest priority gets a tree, which
    lowers the priority about it; ties by id. A round is one aggregate and one small join."""
    u = _unit(sites, ["lst", "aqi", "people"])
    now = stored(u.select("id", "x", "y", ((0.4 * F.col("u_lst") + 0.3 * F.col("u_aqi") + 0.3 * F.col("u_people")) * (1 - F.col("canopy"))).alias("p")), "sites")
    rows, total = [], 0.0
    for step in range(1, trees + 1):
        top = now.orderBy(F.col("p").desc(), "id").first()
        if top is None or top["p"] <= 0:
            break
        d2 = (F.col("x") - top["x"]) * (F.col("x") - top["x"]) + (F.col("y") - top["y"]) * (F.col("y") - top["y"])
        effect = F.when(d2 <= radius * radius, F.exp(-d2 / (2 * (radius / 3) * (radius / 3)))).otherwise(F.lit(0.0))
        total += 1.5 * now.agg(F.sum(effect).alias("s")).first()["s"]
        rows.append((step, top["id"], float(top["p"])))
        now = stored(now.select("id", "x", "y", F.when(F.col("id") == top["id"], F.lit(0.0)).otherwise(F.greatest(F.col("p") - 0.2 * effect, F.lit(0.0))).alias("p")), "sites")
    kind = sites.schema["id"].dataType.simpleString()
    return sites.sparkSession.createDataFrame(rows, f"step int, id {kind}, priority double"), total


def ember_density(grid: DataFrame, fire: DataFrame, wind: float, canopy: float = 15.0) -> DataFrame:
    """(id, density): embers from fire points (id, x, y) within the spotting distance, falling exponentially."""
    if wind <= 0:
        raise ValueError("wind must be above 0")
    far = 0.05 * wind**1.2 * canopy**0.8 * 10
    near = range_join(grid.select(F.col("id").alias("g"), "x", "y"), fire.select(F.col("id").alias("f"), "x", "y"), far, ["g"], ["f"])
    return grid.select("id").join(near.groupBy("g").agg(F.sum(F.exp(-3 * F.col("d") / max(far, 1.0))).alias("s")), F.col("id") == F.col("g"), "left").select("id", F.coalesce("s", F.lit(0.0)).alias("density"))


def park_cooling(grid: DataFrame, parks: DataFrame, reach: float = 500.0) -> DataFrame:
    """(id, cooling): the most that a park (id, x, y, ha) cools: 1.2 ln(ha + 1), falling exponentially."""
    near = range_join(grid.select(F.col("id").alias("g"), "x", "y"), parks.select(F.col("id").alias("p"), "x", "y", "ha"), reach, ["g"], ["p", "ha"])
    cool = 1.2 * F.ln(F.col("ha") + 1) * F.exp(-3 * F.col("d") / reach)
    return grid.select("id").join(near.groupBy("g").agg(F.max(cool).alias("c")), F.col("id") == F.col("g"), "left").select("id", F.greatest(F.coalesce("c", F.lit(0.0)), F.lit(0.0)).alias("cooling"))


def daily_radiation(places: DataFrame, cloud: float = 0.2) -> DataFrame:
    """(id, peak, kwh, declination, daylight) by latitude and day of the year (id, lat, day)."""
    la = F.radians("lat")
    d = F.radians(23.45 * F.sin(F.radians(360 / 365 * (F.col("day") - 81))))
    ws = F.acos(_clip(-F.tan(la) * F.tan(d), -1, 1))
    dr = 1 + 0.033 * F.cos(F.radians(360 * F.col("day") / 365))
    share = 0.75 - 0.5 * cloud
    h = 24 * 60 / math.pi * 1367 * dr * (ws * F.sin(la) * F.sin(d) + F.cos(la) * F.cos(d) * F.sin(ws))
    return places.select("id", (1367 * dr * share).alias("peak"), (h * share / 3600 / 1000).alias("kwh"), F.degrees(d).alias("declination"), F.degrees(2 * ws / 15).alias("daylight"))


def fire_front(fronts: DataFrame, slopes: DataFrame, safety: float = 1.5) -> DataFrame:
    """(id, rate, forward, flank, buffer, semi_major, semi_minor) of fronts (id, wind in km/h, hours) on the steepest of their slopes (id, slope in
    degrees), in metres: the flank is four tenths and the back one tenth of the way forward."""
    rows = fronts.join(slopes.groupBy("id").agg(F.max("slope").alias("_s")), "id")
    rate = (0.5 + 0.1 * F.col("wind")) * (1 + 0.05 * F.tan(F.radians("_s"))) * (1 + 0.02 * F.col("wind"))
    far = rate * 60 * F.col("hours")
    return rows.select("id", rate.alias("rate"), far.alias("forward"), (0.4 * far).alias("flank"), (far * safety).alias("buffer"), (0.55 * far).alias("semi_major"), (0.4 * far).alias("semi_minor"))


def shadow_access(buildings: DataFrame, altitude: float, azimuth: float, cell: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(id, shadow, access) and one row (shadow_area, footprint_area) of convex footprints (id, coords, height): the length of each one's shadow, the percentage of
    its ground cells that no other building shades, and the area in shadow or under a building.

    A building marks the cells under it and its shadow; a cell of its own ground is shaded where another one marks it too.
    """
    if not 0 < altitude <= 90 or not 0 <= azimuth < 360 or cell <= 0:
        raise ValueError("altitude above 0 to 90, azimuth 0 to 360, cells above 0")
    ship(buildings.sparkSession)
    long = 0.0 if altitude == 90 else 1 / math.tan(math.radians(altitude))
    step = (-math.sin(math.radians(azimuth)) * long, -math.cos(math.radians(azimuth)) * long)
    low = lambda c, k: F.array_min(F.transform("coords", lambda p: F.least(p[c], p[c] + step[k] * F.col("height"))))
    box = buildings.agg(F.min(low("x", 0)).alias("x"), F.min(low("y", 1)).alias("y")).first()
    x0, y0 = (box["x"] or 0.0) - cell, (box["y"] or 0.0) - cell
    kind = buildings.schema["id"].dataType.simpleString()

    def marks(batches):
        for batch in batches:
            out = []
            for i, coords, height in zip(batch["id"], batch["coords"], batch["height"]):
                p = np.array([(c["x"], c["y"]) for c in coords], float)
                whole = np.concatenate([p, p + np.array(step) * height])
                own = _covered(hull(p), x0, y0, cell)
                out += [(i, c, r, (c, r) in own) for c, r in _covered(hull(whole), x0, y0, cell)]
            yield pd.DataFrame(out, columns=["id", "c", "r", "own"])

    cells = stored(buildings.select("id", "coords", "height").mapInPandas(marks, f"id {kind}, c long, r long, own boolean"), "shadows")
    counts = stored(cells.groupBy("c", "r").agg(F.count("*").alias("n")), "cells")
    free = cells.where("own").join(counts, ["c", "r"]).groupBy("id").agg((100 * F.avg((F.col("n") < 2).cast("double"))).alias("access"))
    rows = buildings.select("id", (F.col("height") * long).alias("shadow")).join(free, "id", "left").select("id", "shadow", F.coalesce("access", F.lit(100.0)).alias("access"))
    area = buildings.agg(F.coalesce(F.sum(ring_area(F.col("coords"))), F.lit(0.0)).alias("footprint_area"))
    return rows, counts.agg((F.count("*") * (cell * cell)).alias("shadow_area")).crossJoin(area)


def _covered(outline: np.ndarray, x0: float, y0: float, cell: float) -> set[tuple[int, int]]:
    """(column, row) of the cells whose middle lies in a convex outline (counter-clockwise) or on its border."""
    if len(outline) < 3:
        return set()
    lo, hi = outline.min(axis=0), outline.max(axis=0)
    c = np.arange(int((lo[0] - x0) / cell), int((hi[0] - x0) / cell) + 1)
    r = np.arange(int((lo[1] - y0) / cell), int((hi[1] - y0) / cell) + 1)
    x, y = np.meshgrid(x0 + (c + 0.5) * cell, y0 + (r + 0.5) * cell)
    inside = np.ones(x.shape, bool)
    for a, b in zip(outline, np.roll(outline, -1, axis=0)):
        inside &= (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= -1e-9
    rr, cc = np.nonzero(inside)
    return set(zip(c[cc].tolist(), r[rr].tolist()))


def mean_cap_rate(yields: DataFrame) -> DataFrame:
    """One row: the mean capitalisation rate of (yield) in percent."""
    return yields.agg((100 * F.avg("yield")).alias("mean_cap_rate_pct"))


# ground


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) for a key, the same in every run."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)).cast("double") / float(1 << 52)


def base_probability(year: Column) -> Column:
    return F.when(year <= 1985, 0.85).when(year <= 2000, 0.60).when(year <= 2018, 0.25).otherwise(0.05)


def simulate_collapse(buildings: DataFrame, p: str = "p", seed: int = 0) -> DataFrame:
    """Adds ``collapsed``: a draw for each building (id) falls below its probability."""
    return buildings.withColumn("collapsed", uniform(F.col("id"), seed) < F.col(p))


def seismic_debris(buildings: DataFrame, magnitude: float, storey: float = 3.0, factor: float = 0.4, solid: float = 0.3, seed: int = 0) -> DataFrame:
    """(id, p, collapsed, reach, volume) of buildings (id, area, floors, year): collapse drawn by year and magnitude, debris of those."""
    p = _clip(base_probability(F.col("year")) * math.exp(0.8 * (magnitude - 7)), 0, 1)
    rows = simulate_collapse(buildings.withColumn("p", p), "p", seed)
    h = F.col("floors") * storey
    when = lambda x: F.when(F.col("collapsed"), x).otherwise(F.lit(0.0))
    return rows.select("id", "p", "collapsed", when(h * factor).alias("reach"), when(F.col("area") * h * solid).alias("volume"))


#: Median acceleration and spread of collapse by construction; others take the last pair.
FRAGILITY = {"RC": (0.50, 0.40), "Masonry": (0.30, 0.45), "Timber": (0.65, 0.35), "Steel": (0.75, 0.35), "": (0.45, 0.40)}


def collapse_casualties(buildings: DataFrame, pga: float) -> tuple[DataFrame, DataFrame]:
    """(id, p) and one row (collapsed, fatalities, injuries) of buildings (id, kind, storeys, people): lognormal fragility."""
    from urbanloom.operators.panel import normal_cdf

    pick = lambda n: F.coalesce(F.create_map(*(x for k, v in FRAGILITY.items() if k for x in (F.lit(k), F.lit(v[n]))))[F.col("kind")], F.lit(FRAGILITY[""][n]))
    felt = pga * (1 + 0.05 * F.greatest(F.col("storeys") - 1, F.lit(0.0)))
    rows = stored(buildings.select("id", "people", normal_cdf((F.ln(F.greatest(felt, F.lit(1e-4))) - F.ln(pick(0))) / pick(1)).alias("p")), "collapse")
    return rows.select("id", "p"), rows.agg(F.count_if(F.col("p") >= 0.5).alias("collapsed"), F.sum(F.col("p") * F.col("people") * 0.15).alias("fatalities"), F.sum(F.col("p") * F.col("people") * 0.35).alias("injuries"))


#: Median accelerations of the damage states slight to complete and their spread, and the loss in each state.
DAMAGE = {
    "w1": ((0.15, 0.25, 0.40, 0.70), 0.60),
    "c2_medium": ((0.20, 0.35, 0.60, 0.90), 0.64),
    "s1": ((0.22, 0.38, 0.65, 0.95), 0.62),
    "rm1": ((0.18, 0.30, 0.50, 0.80), 0.65),
    "urm": ((0.10, 0.18, 0.32, 0.55), 0.70),
}
LOSS = (0.0, 0.02, 0.10, 0.50, 1.00)


def damage_loss(shaking: DataFrame, stock: DataFrame, kind: str = "c2_medium") -> DataFrame:
    """(pga, p0..p4, loss_ratio, loss, collapsed) for accelerations (pga) over a stock (count, value)."""
    from urbanloom.operators.panel import normal_cdf

    if kind not in DAMAGE:
        raise ValueError(f"kinds are {sorted(DAMAGE)}")
    medians, beta = DAMAGE[kind]
    x = F.ln(F.greatest(F.col("pga"), F.lit(1e-10)))
    rows = shaking.select("pga", *(normal_cdf((x - math.log(m)) / beta).alias(f"e{k}") for k, m in enumerate(medians)))
    e = [F.when(F.col("pga") > 0, F.col(f"e{k}")).otherwise(F.lit(0.0)) for k in range(4)]
    p = [1 - e[0], e[0] - e[1], e[1] - e[2], e[2] - e[3], e[3]]
    t = stock.agg(F.sum("count").alias("_n"), F.sum(F.col("count") * F.col("value")).alias("_v"))
    out = rows.crossJoin(F.broadcast(t)).select("pga", "_n", "_v", *(c.alias(f"p{k}") for k, c in enumerate(p)))
    ratio = reduce(lambda a, b: a + b, [F.col(f"p{k}") * loss for k, loss in enumerate(LOSS)])
    return out.select("pga", *(f"p{k}" for k in range(5)), ratio.alias("loss_ratio"), (ratio * F.col("_v")).alias("loss"), (F.col("p4") * F.col("_n")).alias("collapsed"))


def blockage_summary(streets: DataFrame, factor: float = 0.5) -> DataFrame:
    """One row: streets (width, height, collapse) that debris blocks, restricts or leaves open, and the blocked share."""
    ratio = F.col("height") * factor / F.greatest("width", F.lit(1.0))
    p = F.col("collapse") * F.least(ratio, F.lit(1.0))
    state = F.when((p >= 0.7) | (ratio >= 1), "b").when(p >= 0.3, "r").otherwise("o")
    s = streets.select(state.alias("s"), p.alias("p"))
    return s.agg(F.count_if(F.col("s") == "b").alias("blocked"), F.count_if(F.col("s") == "r").alias("restricted"), F.count_if(F.col("s") == "o").alias("open"), F.avg((F.col("s") == "b").cast("double")).alias("blocked_share"))


def liquefaction(layers: DataFrame, pga: float, water: float) -> DataFrame:
    """(id, lpi, class) of soil layers (id, depth, spt) between the water table and 20 m."""
    part = F.when((F.col("depth") <= 20) & (F.col("depth") >= water), (10 - 0.5 * F.col("depth")) * F.greatest(1 - F.col("spt") / max(1.0, 100 * pga), F.lit(0.0))).otherwise(F.lit(0.0))
    s = layers.groupBy("id").agg(F.sum(part).alias("lpi"))
    return s.select("id", "lpi", F.when(F.col("lpi") >= 15, "Very High").when(F.col("lpi") >= 5, "High").when(F.col("lpi") > 0, "Low").otherwise("Very Low").alias("class"))


# together


def hazard_composite(df: DataFrame, hazards: dict[str, float]) -> DataFrame:
    """(id, score, class, dominant, diversity, drivers): weighted mean of the hazards that are given and finite, the largest part, the
    entropy of the parts in percent and the three largest; ties keep the order of ``hazards``."""
    if len(hazards) < 2:
        raise ValueError("two hazards at least")
    parts = []
    for k, (c, w) in enumerate(hazards.items()):
        v = F.col(c).cast("double")
        ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
        parts.append(F.when(ok, F.struct((v * max(0.0, w)).alias("p"), F.lit(-k).alias("k"), F.lit(c).alias("name"), F.lit(max(0.0, float(w))).alias("w"))))
    rows = df.select("id", F.reverse(F.array_sort(F.array_compact(F.array(*parts)))).alias("a"))
    total = lambda f: F.aggregate("a", F.lit(0.0), lambda acc, x: acc + f(x))
    up = F.filter("a", lambda x: x["p"] > 0)
    rows = rows.select("id", "a", total(lambda x: x["p"]).alias("p"), total(lambda x: x["w"]).alias("w"), up.alias("up"))
    s = F.aggregate("up", F.lit(0.0), lambda acc, x: acc + x["p"])
    h = F.aggregate("up", F.lit(0.0), lambda acc, x: acc - x["p"] / F.col("t") * F.ln(x["p"] / F.col("t")))
    rows = rows.withColumn("t", s)
    none = F.size("a") == 0
    score = F.when(none, F.lit(None)).when(F.col("w") > 0, F.col("p") / F.col("w")).otherwise(F.lit(0.0))
    out = rows.select("id", score.cast("double").alias("score"), F.when(F.size("up") > 0, F.col("up")[0]["name"]).otherwise("").alias("dominant"), F.when(none, F.lit(None)).when(F.size("up") > 1, 100 * h / F.ln(F.size("up").cast("double"))).otherwise(F.lit(0.0)).cast("double").alias("diversity"), F.array_join(F.transform(F.slice("up", 1, 3), lambda x: x["name"]), ",").alias("drivers"))
    return out.withColumn("class", F.when(F.col("score") >= 75, "Very High").when(F.col("score") >= 55, "High").when(F.col("score") >= 35, "Moderate").otherwise("Low")).select("id", "score", "class", "dominant", "diversity", "drivers")


def hazard_cascade(df: DataFrame, hazards: list[str], thresholds: list[float], amplify: list[list[float]], vulnerability: str, rounds: int = 50) -> DataFrame:
    """(id, <hazards>, total, damage, peak): each round hazards above their threshold add to others by the amplification matrix, until
    nothing changes by a millionth or the rounds are over; damage is vulnerability times 1 - exp(-total).

    A unit's rounds are one fold over an array, so they need no job of their own.
    """
    n = len(hazards)
    if n < 2 or any(t <= 0 for t in thresholds) or any(a < 0 for row in amplify for a in row) or any(amplify[k][k] for k in range(n)):
        raise ValueError("two hazards, thresholds above 0, no negative or own amplification")
    start = F.struct(F.array(*(F.col(h).cast("double") for h in hazards)).alias("x"), F.lit(False).alias("done"))

    def step(acc: Column, _: Column) -> Column:
        x = acc["x"]
        gain = [reduce(lambda a, b: a + b, [F.when(x[i] > thresholds[i], x[i] * float(amplify[i][j])).otherwise(F.lit(0.0)) for i in range(n) if i != j and amplify[i][j]], F.lit(0.0)) for j in range(n)]
        new = F.array(*(x[j] + gain[j] for j in range(n)))
        still = reduce(lambda a, b: a & b, [gain[j] <= 1e-8 + 1e-6 * F.abs(x[j]) for j in range(n)])
        return F.struct(F.when(acc["done"], x).otherwise(new).alias("x"), (acc["done"] | still).alias("done"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)["x"]
    rows = df.select("id", F.col(vulnerability).alias("_v"), end.alias("_x"))
    total = reduce(lambda a, b: a + b, [F.col("_x")[k] for k in range(n)])
    peak = F.element_at(F.array(*map(F.lit, hazards)), F.array_position("_x", F.array_max("_x")).cast("int"))
    return rows.select("id", *(F.col("_x")[k].alias(h) for k, h in enumerate(hazards)), total.alias("total"), (F.col("_v") * (1 - F.exp(-total))).alias("damage"), peak.alias("peak"))


def energy_vulnerability_summary(zones: DataFrame) -> DataFrame:
    """One row: zones (income, efficiency, exposure, vulnerable) at high, moderate and low risk (65, 40) and the Gini of their index."""
    top = zones.agg(F.max("income").alias("_m"))
    e = zones.crossJoin(F.broadcast(top)).select((100 * ((1 - F.col("income") / F.col("_m")) * 0.35 + (1 - F.col("efficiency") / 100) * 0.30 + F.col("exposure") / 100 * 0.20 + F.col("vulnerable") * 0.15)).alias("e"))
    e = stored(e, "index")
    return e.agg(F.count_if(F.col("e") >= 65).alias("high"), F.count_if((F.col("e") >= 40) & (F.col("e") < 65)).alias("moderate"), F.count_if(F.col("e") < 40).alias("low")).crossJoin(gini_of(e, "e"))


# form


def subdivide(sites: DataFrame, least: float = 300.0, aspect: float = 3.0, depth: int = 4) -> DataFrame:
    """(id, x, y, w, h): rectangles (id, w, h) halved across their longer side until one is below twice the least area, too long, or deep."""
    now = sites.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("w").cast("double").alias("w"), F.col("h").cast("double").alias("h"))
    done = None
    for level in range(depth + 1):
        stop = (F.col("w") * F.col("h") < 2 * least) | (F.greatest(F.col("w") / F.greatest("h", F.lit(1e-6)), F.col("h") / F.greatest("w", F.lit(1e-6))) > aspect) | F.lit(level >= depth)
        end = now.where(stop)
        done = end if done is None else done.unionByName(end)
        wide = F.col("w") >= F.col("h")
        half = lambda k: F.struct(F.when(wide & F.lit(k == 1), F.col("x") + F.col("w") / 2).otherwise(F.col("x")).alias("x"), F.when(~wide & F.lit(k == 1), F.col("y") + F.col("h") / 2).otherwise(F.col("y")).alias("y"), F.when(wide, F.col("w") / 2).otherwise(F.col("w")).alias("w"), F.when(wide, F.col("h")).otherwise(F.col("h") / 2).alias("h"))
        now = now.where(~stop).select("id", F.explode(F.array(half(0), half(1))).alias("p")).select("id", "p.x", "p.y", "p.w", "p.h")
    return done


def block_grain(buildings: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block, porosity, grain, buildings, mean_area) of buildings (block, area) in blocks (block, area)."""
    b = buildings.groupBy("block").agg(F.sum("area").alias("s"), F.avg("area").alias("m"), F.count("*").alias("n"))
    rows = blocks.select("block", F.greatest("area", F.lit(1e-6)).alias("a")).join(b, "block", "left").na.fill(0.0, ["s", "m"]).na.fill(0, ["n"])
    return rows.select("block", F.greatest(1 - F.col("s") / F.col("a"), F.lit(0.0)).alias("porosity"), (F.col("m") / F.col("a") * 100).alias("grain"), F.col("n").alias("buildings"), F.col("m").alias("mean_area"))


def frontal_area(buildings: DataFrame, lots: DataFrame, direction: float = 0.0) -> DataFrame:
    """(lot, lambda_f, z0, d0, mean_height) of buildings (lot, height, width) on lots (lot, area): frontal area, roughness and displacement."""
    a = math.radians(direction)
    b = buildings.groupBy("lot").agg(F.sum(F.col("height") * F.col("width") * (abs(math.cos(a)) + abs(math.sin(a)))).alias("f"), F.avg("height").alias("h"))
    rows = lots.join(b, "lot", "left").na.fill(0.0, ["f", "h"]).withColumn("lambda_f", F.col("f") / F.greatest("area", F.lit(1e-6)))
    return rows.select("lot", "lambda_f", (0.5 * F.col("h") * F.col("lambda_f")).alias("z0"), (0.7 * F.col("h") * F.pow("lambda_f", F.lit(0.6))).alias("d0"), F.col("h").alias("mean_height"))


def link_equilibrium(links: DataFrame, demand: float, alpha: float = 0.15, beta: float = 4.0, rounds: int = 15) -> tuple[DataFrame, DataFrame]:
    """(link, flow, time) and one row (total_time, max_vc, mean_vc) of links (link, capacity, free): the demand spread evenly, then each round twice that
    on links no slower than the median, mixed in with falling weight."""
    from urbanloom.core.ordered import quantiles

    n = links.count()
    time = lambda f: F.col("free") * (1 + alpha * F.pow(F.greatest(f / F.greatest("capacity", F.lit(1e-6)), F.lit(0.0)), F.lit(beta)))
    now = stored(links.select("link", "capacity", "free", F.lit(demand / n if n else 0.0).alias("flow")), "links")
    for k in range(rounds if n and demand else 0):
        timed = stored(now.withColumn("t", time(F.col("flow"))), "links")
        mid = quantiles(timed, F.col("t"), [0.5]).select(F.col("value").alias("_m"))
        g = 2 / (k + 3)
        target = F.when(F.col("t") <= F.col("_m"), 2 * demand / n).otherwise(F.lit(0.0))
        now = stored(timed.crossJoin(F.broadcast(mid)).select("link", "capacity", "free", ((1 - g) * F.col("flow") + g * target).alias("flow")), "links")
    rows = now.withColumn("time", time(F.col("flow")))
    vc = F.col("flow") / F.greatest("capacity", F.lit(1e-6))
    return rows.select("link", "flow", "time"), rows.agg(F.sum(F.col("flow") * F.col("time")).alias("total_time"), F.max(vc).alias("max_vc"), F.avg(vc).alias("mean_vc"))


def leslie(rates: DataFrame) -> DataFrame:
    """(i, j, value) from ages (age, survival, fertility) from 0 without gaps: fertility in the first row, survival below the diagonal, the last
    age's survival on it; zero cells are left out."""
    top = rates.agg(F.max("age").alias("_k"))
    rows = rates.crossJoin(F.broadcast(top))
    cells = F.array(F.struct(F.lit(0).alias("i"), F.col("age").cast("int").alias("j"), F.col("fertility").cast("double").alias("value")), F.struct(F.least(F.col("age") + 1, F.col("_k")).cast("int").alias("i"), F.col("age").cast("int").alias("j"), F.col("survival").cast("double").alias("value")))
    return rows.select(F.explode(cells).alias("x")).select("x.*").groupBy("i", "j").agg(F.sum("value").alias("value")).where("value <> 0")


def cohorts(people: DataFrame, rates: DataFrame, steps: int = 1, migration: DataFrame | None = None) -> DataFrame:
    """(region, step, age, pop) of people (region, age, pop): survivors move up an age, births follow fertility, migration (region, age, n) is
    added, negative numbers become 0. All regions go together, a join and an aggregate a step."""
    m = stored(leslie(rates), "leslie")
    now = people.select("region", F.col("age").cast("int").alias("age"), F.col("pop").cast("double").alias("pop"))
    out = [now.select("region", F.lit(0).alias("step"), "age", "pop")]
    ages = now.select("region", "age")
    for step in range(1, steps + 1):
        new = now.join(m, F.col("age") == F.col("j")).groupBy("region", F.col("i").alias("age")).agg(F.sum(F.col("value") * F.col("pop")).alias("pop"))
        new = ages.join(new, ["region", "age"], "left").na.fill(0.0, ["pop"])
        if migration is not None:
            new = new.join(migration.select("region", F.col("age").cast("int").alias("age"), F.col("n").cast("double").alias("_n")), ["region", "age"], "left").select("region", "age", (F.col("pop") + F.coalesce("_n", F.lit(0.0))).alias("pop"))
        now = stored(new.select("region", "age", F.greatest("pop", F.lit(0.0)).alias("pop")), "cohorts")
        out.append(now.select("region", F.lit(step).alias("step"), "age", "pop"))
    return reduce(DataFrame.unionByName, out)


def balanced_trips(costs: DataFrame, zones: DataFrame, beta: float, power: bool = False, rounds: int = 100, tol: float = 1e-4) -> tuple[DataFrame, int, float]:
    """(o, d, trips), rounds and the largest gap: doubly constrained gravity over costs (o, d, cost) and zones (zone, p, a); attractions are scaled
    to the productions. The factors alone are written each round."""
    total = zones.agg(F.sum("p").alias("p"), F.sum("a").alias("a")).first()
    scale = total["p"] / total["a"] if total["a"] else 0.0
    f = F.pow(F.greatest("cost", F.lit(1e-6)), F.lit(-beta)) if power else F.exp(-beta * F.col("cost"))
    p, a = zones.select(F.col("zone").alias("o"), F.col("p").cast("double").alias("p")), zones.select(F.col("zone").alias("d"), (F.col("a") * scale).cast("double").alias("a"))
    t = stored(costs.select("o", "d", f.alias("f")).join(p, "o").join(a, "d").select("o", "d", (F.col("f") * F.col("p") * F.col("a")).alias("t")), "trips")
    s = stored(a.select("d", F.lit(1.0).alias("s")), "factors")
    gap = math.inf
    for done in range(1, rounds + 1):
        r = t.join(s, "d").groupBy("o").agg(F.sum(F.col("t") * F.col("s")).alias("x")).join(p, "o")
        r = stored(r.select("o", F.coalesce(F.try_divide("p", "x"), F.lit(0.0)).alias("r")), "factors")
        col = t.join(r, "o").groupBy("d").agg(F.sum(F.col("t") * F.col("r")).alias("x")).join(a, "d")
        s = stored(col.select("d", F.coalesce(F.try_divide("a", "x"), F.lit(0.0)).alias("s")), "factors")
        row = t.join(r, "o").join(s, "d").groupBy("o").agg(F.sum(F.col("t") * F.col("r") * F.col("s")).alias("x")).join(p, "o").agg(F.max(F.abs(F.col("x") - F.col("p"))).alias("m")).first()["m"]
        gap = row or 0.0
        if gap < tol:
            break
    return t.join(r, "o").join(s, "d").select("o", "d", (F.col("t") * F.col("r") * F.col("s")).alias("trips")), done, gap


def route_rank(df: DataFrame, score: str, id_col: str = "id") -> DataFrame:
    """Adds ``rank`` by score, highest first, ties by id."""
    return numbered(df, [F.col(score).desc(), F.col(id_col).asc()])
