"""Access to services and what it means for groups: health care, chargers, modes, stops, domains; dispatch and schedules.

Distances come from points through grid cells where a catchment bounds them; nothing else is paired.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.core.ordered import quantiles, running
from urbanloom.core.spatial_join import by_place, nearest, range_join
from urbanloom.core.tables import stored
from urbanloom.operators.access import spatial_equity_gini

#: Rows of a table that is read whole by one task or by the driver, where a method is sequential by nature.
WHOLE = 1_000_000


def bounded(df: DataFrame, order: list[str], limit: int = WHOLE) -> pd.DataFrame:
    """A table of bounded size in a fixed order, for methods that go row by row; more rows are an error, never cut."""
    rows = df.limit(limit + 1).toPandas()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: the method takes them one after another")
    return rows.sort_values(order, kind="stable").reset_index(drop=True)


def gini_of(df: DataFrame, value: str) -> DataFrame:
    """One row: Gini of the values by their places in order, between 0 and 1; 0 where they sum to 0."""
    counts = df.groupBy(F.col(value).alias("x")).agg(F.count("*").alias("k"))
    rows = running(counts, [F.col("x")], {"upto": ("sum", F.col("k"))})
    # the places of k equal values that end at n sum to k n - k (k - 1) / 2
    t = rows.agg(F.sum(F.col("x") * (F.col("k") * F.col("upto") - F.col("k") * (F.col("k") - 1) / 2)).alias("ix"), F.sum(F.col("k") * F.col("x")).alias("s"), F.sum("k").cast("double").alias("n"))
    g = (2 * F.col("ix") - (F.col("n") + 1) * F.col("s")) / (F.col("n") * F.col("s"))
    return t.select(F.when(F.col("s") > 0, F.least(F.greatest(g, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0)).alias("gini"))


def health_equity(demand: DataFrame, facilities: DataFrame, groups: dict[str, float], catchment: float = 5000.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, access, weighted), one row (gini, equity) and (group, mean, deficit): floating catchments in three zones (1, .6, .2 at a
    third, two thirds, all of the distance) of facilities (id, x, y, capacity) for demand (id, x, y, one column a group)."""
    total = sum((F.col(g) for g in groups), F.lit(0.0))
    need = sum((F.col(g) * float(w) for g, w in groups.items()), F.lit(0.0))
    people = stored(demand.select("id", "x", "y", *groups, total.alias("pop"), need.alias("need")), "demand")
    # the facilities of a place have the same people in reach, so they share its sum
    (places, of), (at, _) = by_place(people, "pop"), by_place(facilities, "capacity")
    near = range_join(places.select(F.col("id").alias("o"), "x", "y", "pop"), at.select(F.col("id").alias("f"), "x", "y", "capacity"), catchment, ["o", "pop"], ["f", "capacity"])
    w = F.when(F.col("d") <= 0.33 * catchment, 1.0).when(F.col("d") <= 0.66 * catchment, 0.6).otherwise(0.2)
    near = stored(near.withColumn("w", w), "near")
    ratio = near.groupBy("f").agg((F.max("capacity") / F.when(F.sum(F.col("w") * F.col("pop")) > 0, F.sum(F.col("w") * F.col("pop")))).alias("ratio"))
    a = near.join(ratio, "f").groupBy("o").agg(F.sum(F.col("w") * F.coalesce("ratio", F.lit(0.0))).alias("access"))
    a = of.join(a, F.col("place") == F.col("o")).select(F.col("id").alias("o"), "access")
    rows = stored(people.join(a, F.col("id") == F.col("o"), "left").withColumn("access", F.coalesce("access", F.lit(0.0))), "access")
    g = spatial_equity_gini(rows.select(F.col("id").alias("o"), "access"), rows.select(F.col("id").alias("o"), "pop"))
    mean = lambda c: F.try_divide(F.sum(F.col("access") * F.col(c)), F.sum(c))
    means = rows.agg(F.coalesce(mean("pop"), F.lit(0.0)).alias("all"), *(F.coalesce(mean(c), F.lit(0.0)).alias(c) for c in groups), *(F.sum(c).alias(f"n_{c}") for c in groups))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("group"), F.col(c).alias("mean"), F.when((F.col(f"n_{c}") > 0) & (F.col("all") > 0), (F.col("all") - F.col(c)) / F.col("all")).otherwise(F.lit(0.0)).alias("deficit")) for c in groups)))
    weighted = F.when(F.col("need") > 0, F.col("access") / F.col("need")).otherwise(F.lit(0.0))
    return rows.select("id", "access", weighted.alias("weighted")), g.select("gini", (1 - F.col("gini")).alias("equity")), means.select(each.alias("x")).select("x.*")


def multimodal_score(demand: DataFrame, amenities: DataFrame, speeds: dict[str, float] | None = None, weights: dict[str, float] | None = None, minutes: float = 15.0) -> tuple[DataFrame, DataFrame]:
    """(id, score) and one row (gini, compliance): for each category the nearest amenity (id, x, y, category) in metres, timed by each
    mode's speed (km/h) and scored 100 to 0 over the minutes; the mean of the categories."""
    speeds = speeds or {"walk": 4.5, "bike": 15.0, "transit": 20.0}
    weights = weights or {"walk": 0.6, "bike": 0.3, "transit": 0.1}
    if any(s <= 0 for s in speeds.values()) or abs(sum(weights.values()) - 1) > 1e-8 or not set(speeds) & set(weights):
        raise ValueError("speeds must be above 0 and weights sum to 1, with a mode in common")
    kinds = [r[0] for r in amenities.select("category").distinct().orderBy("category").limit(1001).collect()]
    if not kinds or len(kinds) > 1000:
        raise ValueError("between 1 and 1,000 categories")
    km = F.col("d") / 1000
    score = sum((F.lit(100 * weights[m]) * F.least(F.greatest(1 - km / speeds[m] * 60 / minutes, F.lit(0.0)), F.lit(1.0)) for m in sorted(set(speeds) & set(weights))), F.lit(0.0))
    total = None
    for k in kinds:
        part = nearest(demand, amenities.where(F.col("category") == k), 1).select(F.col("i").alias("id"), score.alias("s"))
        total = part if total is None else total.unionByName(part)
    rows = stored(total.groupBy("id").agg((F.sum("s") / len(kinds)).alias("score")), "scores")
    g = spatial_equity_gini(rows.select(F.col("id").alias("o"), F.col("score").alias("access")), rows.select(F.col("id").alias("o"), F.lit(1.0).alias("pop")))
    return rows, g.crossJoin(rows.agg((100 * F.avg((F.col("score") >= 75).cast("double"))).alias("compliance")))


def charging_access(zones: DataFrame, stations: DataFrame, beta: float = 0.1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, access, slow, fast), (id, demand, stress, ratio) of stations and one row (gini, equity) from zones (id, x, y, demand) and stations
    (id, x, y, kw[, transformer, fast]): capacity over the demand that reaches a station, both discounted exponentially.

    Every station counts for every zone by definition; pairs are made within the distance at which a weight is below a
    double's precision of the nearest one's, which the reach makes sure of.
    """
    n = max(zones.count(), stations.count(), 2)
    cap = F.least("kw", "transformer") if "transformer" in stations.columns else F.col("kw")
    fast = F.col("fast").cast("int") if "fast" in stations.columns else F.lit(None).cast("int")
    far = nearest(zones, stations, 1).agg(F.max("d").alias("m")).unionByName(nearest(stations, zones, 1).agg(F.max("d").alias("m"))).agg(F.max("m")).first()[0] or 0.0
    reach = far + (math.log(n) + 37) / beta
    s = stations.select(F.col("id").alias("s"), "x", "y", cap.cast("double").alias("cap"), fast.alias("fast"))
    near = stored(range_join(zones.select(F.col("id").alias("z"), "x", "y", "demand"), s, reach, ["z", "demand"], ["s", "cap", "fast"]).withColumn("w", F.exp(-beta * F.col("d"))), "near")
    load = near.groupBy("s").agg(F.sum(F.col("demand") * F.col("w")).alias("load"), F.max("cap").alias("c"))
    load = stored(load.withColumn("ratio", F.col("c") / F.greatest("load", F.lit(1e-6))), "load")
    own = near.join(load.select("s", "ratio"), "s").groupBy("z").agg(F.sum(F.col("w") * F.col("ratio")).alias("access"), *(F.sum(F.when(F.col("fast") == k, F.col("w") * F.col("ratio")).otherwise(F.lit(0.0))).alias(c) for k, c in ((0, "slow"), (1, "fast_"))))
    rows = stored(zones.select(F.col("id").alias("z"), "demand").join(own, "z", "left").na.fill(0.0, ["access", "slow", "fast_"]), "access")
    g = spatial_equity_gini(rows.select(F.col("z").alias("o"), "access"), rows.select(F.col("z").alias("o"), F.col("demand").alias("pop")))
    return rows.select(F.col("z").alias("id"), "access", "slow", F.col("fast_").alias("fast")), load.select(F.col("s").alias("id"), F.col("load").alias("demand"), (F.col("load") / F.greatest("c", F.lit(1e-6))).alias("stress"), "ratio"), g.select("gini", (1 - F.col("gini")).alias("equity"))


def isochrone_profile(origin: tuple[float, float], places: DataFrame, stops: DataFrame, rides: DataFrame, walk_kmh: float = 4.8, penalty: float = 5.0, budget: float = 45.0) -> DataFrame:
    """(id, minutes, reachable, band, mode) of places (id, x, y) from one origin, on foot or by walking to a stop (stop, x, y, headway), half
    its headway, rides (a, b, minutes) with a penalty for each change, and walking on; bands of 15 minutes, 0 beyond 60."""
    speed = walk_kmh * 1000 / 60
    at = bounded(stops.select("stop", "x", "y", "headway"), ["stop"], 2000)
    index = {s: k for k, s in enumerate(at["stop"])}
    n = len(at)
    t = np.zeros((n, n))
    for r in rides.select("a", "b", "minutes").limit(n * n + 1).collect():
        t[index[r["a"]], index[r["b"]]] = r["minutes"]
    np.fill_diagonal(t, 0)
    for k in range(n):  # a ride of 0 minutes is none
        via = np.where((t[:, k : k + 1] > 0) & (t[k : k + 1] > 0), t[:, k : k + 1] + t[k : k + 1] + penalty, np.inf)
        t = np.where(via < np.where(t == 0, np.inf, t), via, t)
    start = np.hypot(at["x"] - origin[0], at["y"] - origin[1]).to_numpy() / speed + 0.5 * at["headway"].to_numpy()
    reach = (start[:, None] + t).min(axis=0) if n else np.zeros(0)
    spark = places.sparkSession
    known = spark.createDataFrame(pd.DataFrame({"x": at["x"].astype(float), "y": at["y"].astype(float), "t": reach.astype(float)}), "x double, y double, t double")
    foot = F.sqrt((F.col("x") - origin[0]) * (F.col("x") - origin[0]) + (F.col("y") - origin[1]) * (F.col("y") - origin[1])) / speed
    rows = places.select("id", "x", "y", foot.alias("foot"))
    ride = rows.join(F.broadcast(known.select(F.col("x").alias("sx"), F.col("y").alias("sy"), "t")), F.lit(True), "left").groupBy("id", "foot").agg(F.min(F.col("t") + F.sqrt((F.col("x") - F.col("sx")) * (F.col("x") - F.col("sx")) + (F.col("y") - F.col("sy")) * (F.col("y") - F.col("sy"))) / speed).alias("ride"))
    out = ride.withColumn("minutes", F.least("foot", "ride"))
    band = F.when(F.col("minutes") <= 15, 1).when(F.col("minutes") <= 30, 2).when(F.col("minutes") <= 45, 3).when(F.col("minutes") <= 60, 4).otherwise(0)
    return out.select("id", "minutes", (F.col("minutes") <= budget).alias("reachable"), band.alias("band"), F.when(F.col("ride").isNull() | (F.col("foot") <= F.col("ride")), "direct_walk").otherwise("multimodal_transit").alias("mode"))


def electric_routes(depots: DataFrame, customers: DataFrame, chargers: DataFrame | None = None, capacity: float = 100.0, battery: float = 60.0, consumption: float = 0.25) -> DataFrame:
    """(route, depot, stops, load, km, kwh, recharges): each vehicle leaves the depot (id, x, y) nearest to any customer (id, x, y, demand) left,
    goes on to the nearest one while the load fits, by the nearest charger when the battery wouldn't bring it back.

    One vehicle after another, so it runs on tables of bounded size.
    """
    dep, cus = bounded(depots, ["id"]), bounded(customers, ["id"])
    spots = np.zeros((0, 2)) if chargers is None else bounded(chargers, ["id"])[["x", "y"]].to_numpy(float)
    d_xy, c_xy, need = dep[["x", "y"]].to_numpy(float), cus[["x", "y"]].to_numpy(float), cus["demand"].to_numpy(float)
    left, routes = list(range(len(cus))), []
    while left:
        gaps = np.hypot(d_xy[:, None, 0] - c_xy[None, left, 0], d_xy[:, None, 1] - c_xy[None, left, 1])
        home, first = np.unravel_index(int(gaps.argmin()), gaps.shape)
        at, now, load, charge, km, stops, refills = left[first], d_xy[home], 0.0, battery, 0.0, [], 0
        while at is not None:
            if load + need[at] > capacity:
                break
            hop, back = math.dist(now, c_xy[at]), math.dist(c_xy[at], d_xy[home])
            if charge < (hop + back) * consumption and len(spots) and charge < battery:
                away = np.hypot(*(spots - now).T)
                k = int(away.argmin())
                if charge >= away[k] * consumption:
                    km, now, charge, refills = km + float(away[k]), spots[k], battery, refills + 1
                    hop = math.dist(now, c_xy[at])
            if charge < hop * consumption:
                break
            left.remove(at)
            stops.append(cus["id"][at])
            load, charge, km, now = load + need[at], charge - hop * consumption, km + hop, c_xy[at]
            if not left:
                break
            near = left[int(np.hypot(*(c_xy[left] - now).T).argmin())]
            at = near if load + need[near] <= capacity else None
        km += math.dist(now, d_xy[home])
        routes.append((len(routes) + 1, int(dep["id"][home]), [int(s) for s in stops], float(load), km, km * consumption, refills))
        if not stops:  # nobody can be served from the best depot: the first one left is given up
            left.pop(0)
    return depots.sparkSession.createDataFrame(routes, "route int, depot long, stops array<long>, load double, km double, kwh double, recharges int")


def micromobility_equity(zones: DataFrame) -> DataFrame:
    """One row: mean, Gini and number below half the median of vehicles exp(-distance / 500) over vulnerability."""
    s = stored(zones.select((F.col("vehicles") * F.exp(-F.col("distance") / 500) / (F.col("vulnerability") + 1e-6)).alias("s")), "scores")
    mid = quantiles(s, F.col("s"), [0.5]).select(F.col("value").alias("_m"))
    low = s.crossJoin(F.broadcast(mid)).agg(F.count_if(F.col("s") < 0.5 * F.col("_m")).alias("low_access"))
    return s.agg(F.avg("s").alias("mean")).crossJoin(gini_of(s, "s")).crossJoin(low)


def fleet_charging(buses: DataFrame, charger_kw: float = 150.0, grid_kw: float = 1000.0) -> DataFrame:
    """One row: peak power, energy, buses at once and hours to charge all of (energy)."""
    if charger_kw <= 0:
        raise ValueError("chargers need power")
    at_once = math.floor(grid_kw / charger_kw)
    t = buses.agg(F.count("*").alias("n"), F.coalesce(F.sum("energy"), F.lit(0.0)).alias("e"))
    return t.select(F.least(F.col("n") * charger_kw, F.lit(float(grid_kw))).alias("peak"), F.col("e").alias("energy"), F.lit(at_once).alias("at_once"), (F.col("e") / charger_kw / max(at_once, 1)).alias("hours"))


def street_sky_view(grid: DataFrame, buildings: DataFrame, radius: float = 100.0) -> DataFrame:
    """(id, svf): cosine of the steepest angle to a building (id, x, y, height) within the radius, at 1 m at least."""
    near = range_join(grid.select(F.col("id").alias("g"), "x", "y"), buildings.select(F.col("id").alias("b"), "x", "y", "height"), radius, ["g"], ["b", "height"])
    top = near.groupBy("g").agg(F.max(F.atan(F.col("height") / F.greatest("d", F.lit(1.0)))).alias("a"))
    return grid.select("id").join(top, F.col("id") == F.col("g"), "left").select("id", F.cos(F.greatest(F.coalesce("a", F.lit(0.0)), F.lit(0.0))).alias("svf"))


def ride_dispatch(requests: DataFrame, vehicles: DataFrame, capacity: float = 8.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, vehicle, d), (vehicle, load) and one row (km, utilization): each request (id, x, y, to_x, to_y) to its nearest vehicle."""
    got = stored(nearest(requests, vehicles, 1).select(F.col("i").alias("id"), F.col("j").alias("vehicle"), "d"), "assigned")
    loads = vehicles.select(F.col("id").alias("vehicle")).join(got.groupBy("vehicle").agg(F.count("*").alias("load")), "vehicle", "left").na.fill(0, ["load"])
    trip = requests.agg(F.sum(F.sqrt((F.col("to_x") - F.col("x")) * (F.col("to_x") - F.col("x")) + (F.col("to_y") - F.col("y")) * (F.col("to_y") - F.col("y")))).alias("t"))
    total = got.agg(F.sum("d").alias("d")).crossJoin(trip).crossJoin(loads.agg(F.avg(F.col("load") / capacity).alias("utilization")))
    return got, loads, total.select(((F.coalesce("d", F.lit(0.0)) + F.coalesce("t", F.lit(0.0))) / 1000).alias("km"), "utilization")


def domain_scores(times: DataFrame, zones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(zone, score) and one row (mean, compliant, gap): percentage of service domains (zone, domain, minutes, services) within 15 minutes; zones
    (zone, vulnerability) above one half against the others."""
    hit = ((F.col("minutes") <= 15) & (F.col("services") > 0)).cast("double")
    s = stored(times.groupBy("zone").agg((100 * F.avg(F.coalesce(hit, F.lit(0.0)))).alias("score")).join(zones, "zone"), "scores")
    high = F.col("vulnerability") > 0.5
    t = s.agg(F.avg("score").alias("mean"), F.avg((F.col("score") >= 80).cast("double")).alias("compliant"), F.avg(F.when(high, F.col("score"))).alias("h"), F.avg(F.when(~high, F.col("score"))).alias("l"))
    return s.select("zone", "score"), t.select("mean", "compliant", (F.coalesce("h", "mean") - F.coalesce("l", "mean")).alias("gap"))


def land_use_entropy(counts: DataFrame, kinds: int) -> DataFrame:
    """(zone, entropy) of (zone, kind, amount): entropy of the shares over the logarithm of the number of kinds, 0 to 1."""
    t = counts.groupBy("zone").agg(F.sum("amount").alias("s"), F.sum(F.when(F.col("amount") > 0, F.col("amount") * F.ln("amount")).otherwise(F.lit(0.0))).alias("l"))
    h = F.when((F.col("s") > 0) & F.lit(kinds > 1), (F.ln("s") - F.col("l") / F.col("s")) / math.log(max(kinds, 2))).otherwise(F.lit(0.0))
    return t.select("zone", F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0)).alias("entropy"))


def walk_score(amenities: DataFrame, places: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(id, score): amenities (id, kind, d) by weight and a decay in five steps to 2,400 m, less penalties for few crossings and long
    blocks of the place (id, crossings, block)."""
    total = sum(weights.values())
    share = F.create_map(*(x for k, w in weights.items() for x in (F.lit(k), F.lit(w / total if total > 0 else 1 / len(weights)))))
    d = F.col("d")
    steps = [(400, 1.0, 0.0, 1.0), (800, 1.0, 0.25, 400.0), (1200, 0.75, 0.15, 400.0), (1600, 0.6, 0.1, 400.0), (2400, 0.5, 0.375, 800.0)]
    decay, low = None, 0.0
    for edge, top, fall, width in steps:
        part = F.lit(top) - F.lit(fall) * ((d - low) / width)
        decay = F.when(d <= edge, part) if decay is None else decay.when(d <= edge, part)
        low = float(edge)
    raw = amenities.groupBy("id").agg((100 * F.sum(F.coalesce(share[F.col("kind")], F.lit(0.0)) * decay.otherwise(0.0))).alias("raw"))
    tier = lambda c, limits, above: sum((F.when(F.col(c) > x if above else F.col(c) < x, 0.01).otherwise(0.0) for x in limits), F.lit(0.0))
    penalty = tier("crossings", (200, 150, 120, 90, 60), False) + tier("block", (120, 150, 180, 200, 250), True)
    out = places.join(raw, "id", "left")
    return out.select("id", F.least(F.greatest(F.coalesce("raw", F.lit(0.0)) * (1 - penalty), F.lit(0.0)), F.lit(100.0)).alias("score"))


#: Weights of the sub-scores and the values at which they are full or nothing.
WALK_WEIGHTS = {"intersections": 0.30, "mix": 0.25, "destinations": 0.25, "blocklength": 0.10, "slope": 0.10}
WALK_BREAKS = {"intersections_full": 120.0, "destinations_full": 25.0, "block_best": 80.0, "block_worst": 400.0, "slope_worst": 10.0}


def segment_walkability(segments: DataFrame, columns: dict[str, str], weights: dict[str, float] | None = None, breaks: dict[str, float] | None = None) -> DataFrame:
    """Adds s_<part> (0..100) and ``total``, their weighted mean, for the parts that ``columns`` names a column for."""
    w = WALK_WEIGHTS | {k: max(0.0, float(v)) for k, v in (weights or {}).items()}
    b = WALK_BREAKS | (breaks or {})
    if set(columns) - set(WALK_WEIGHTS) or "intersections" not in columns or set(w) - set(WALK_WEIGHTS):
        raise ValueError(f"parts are {sorted(WALK_WEIGHTS)}, and intersections are needed")

    def line(c: Column, zero: float, full: float) -> Column:
        return F.lit(100.0) if full == zero else 100 * F.least(F.greatest((c - zero) / (full - zero), F.lit(0.0)), F.lit(1.0))

    ends = {"intersections": (0.0, b["intersections_full"]), "mix": (0.0, 1.0), "destinations": (0.0, b["destinations_full"]), "blocklength": (b["block_worst"], b["block_best"]), "slope": (b["slope_worst"], 0.0)}
    parts = {k: line(F.col(c), *ends[k]) for k, c in columns.items()}
    total = sum(w[k] for k in parts)
    mean = sum((F.lit(w[k]) * c for k, c in parts.items()), F.lit(0.0)) / total if total > 0 else F.lit(0.0)
    return segments.withColumns({f"s_{k}": c for k, c in parts.items()} | {"total": mean})


def jobs_housing_mismatch(od: DataFrame, origins: DataFrame, jobs: DataFrame, cutoff: float, method: str = "linear") -> DataFrame:
    """(o, mismatch): logarithm of discounted jobs (d, supply) over discounted people (o, pop) at the same places, within the cutoff."""
    if cutoff <= 0:
        raise ValueError("the cutoff must be above 0")
    c = F.col("cost")
    shapes = {"none": F.lit(1.0), "uniform": F.lit(1.0), "linear": F.least(F.greatest(1 - c / cutoff, F.lit(0.0)), F.lit(1.0)), "exponential": F.exp(-3 / cutoff * c)}
    if method not in shapes:
        raise ValueError(f"no decay {method!r}")
    w = F.when(c <= cutoff, shapes[method]).otherwise(F.lit(0.0))
    rows = od.join(jobs, "d").join(origins.select(F.col("o").alias("d"), F.col("pop").alias("_p")), "d").groupBy("o").agg(F.sum(w * F.col("supply")).alias("j"), F.sum(w * F.col("_p")).alias("p"))
    return rows.select("o", F.ln((F.col("j") + 1e-6) / (F.col("p") + 1e-6)).alias("mismatch"))


def travel_gini(scores: DataFrame) -> DataFrame:
    """One row: Gini of (score, pop) by trapezoids under the Lorenz curve, 0 without people or scores."""
    by = scores.groupBy("score").agg(F.sum("pop").alias("p"))
    rows = running(by, [F.col("score")], {"p_to": ("sum", F.col("p")), "s_to": ("sum", F.col("p") * F.col("score"))})
    t = rows.agg(F.sum(F.col("p") * (2 * F.col("s_to") - F.col("p") * F.col("score"))).alias("a"), F.sum("p").alias("n"), F.sum(F.col("p") * F.col("score")).alias("s"))
    g = 1 - F.col("a") / (F.col("n") * F.col("s"))
    return t.select(F.when((F.col("n") > 0) & (F.col("s") > 0), F.least(F.greatest(g, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0)).alias("gini"))


def transport_mismatch(rows: DataFrame) -> DataFrame:
    """One row: mean of 100 less access (min-max, 0..100, negative access 0) weighed by vulnerable people."""
    a = F.greatest("access", F.lit(0.0))
    t = rows.agg(F.min(a).alias("lo"), F.max(a).alias("hi"), F.sum("vulnerable").alias("v"), F.sum(F.col("vulnerable") * a).alias("va"))
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    return t.select(F.when(F.col("v") > 0, 100 - 100 * (F.col("va") / F.col("v") - F.col("lo")) / span).otherwise(F.lit(0.0)).alias("mismatch"))


def tod_index(zones: DataFrame, shares: list[str], density: str = "density", connectivity: str = "connectivity", weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """(id, index): density and connectivity from 0 to 100 and the entropy of land-use shares, weighted."""
    total = sum(weights)
    w = [x / total for x in weights] if total > 0 else [1 / 3] * 3
    box = zones.agg(*(f(c).alias(f"{a}_{n}") for n, c in (("d", density), ("c", connectivity)) for a, f in (("lo", F.min), ("hi", F.max))))
    unit = lambda n, c: F.when(F.col(f"hi_{n}") > F.col(f"lo_{n}"), 100 * (F.col(c) - F.col(f"lo_{n}")) / (F.col(f"hi_{n}") - F.col(f"lo_{n}"))).otherwise(F.lit(0.0))
    s = sum((F.col(c) for c in shares), F.lit(0.0))
    h = sum((F.when((s > 0) & (F.col(c) > 0), -(F.col(c) / s) * F.ln(F.col(c) / s)).otherwise(F.lit(0.0)) for c in shares), F.lit(0.0))
    mix = 100 * h / math.log(len(shares)) if len(shares) > 1 else F.lit(0.0)
    index = unit("d", density) * w[0] + mix * w[1] + unit("c", connectivity) * w[2]
    return zones.crossJoin(F.broadcast(box)).select("id", F.least(F.greatest(index, F.lit(0.0)), F.lit(100.0)).alias("index"))


def node_diversity(nodes: DataFrame, shares: list[str]) -> tuple[DataFrame, DataFrame]:
    """(id, entropy, score) and one row (mean, ready): land-use entropy .4, floor area over the largest .3, nearness to transit .3."""
    p = [F.least(F.greatest(F.col(c), F.lit(1e-12)), F.lit(1.0)) for c in shares]
    s = sum(p[1:], p[0])
    h = sum((-(x / s) * F.ln(x / s) for x in p), F.lit(0.0)) / math.log(max(len(shares), 2))
    top = nodes.agg(F.max("far").alias("_f"))
    rows = nodes.crossJoin(F.broadcast(top)).withColumn("entropy", h).withColumn("score", F.col("entropy") * 0.4 + F.col("far") / (F.col("_f") + 1e-6) * 0.3 + F.exp(-F.col("transit") / 400) * 0.3).select("id", "entropy", "score")
    return rows, rows.agg(F.avg("score").alias("mean"), F.count_if(F.col("score") > 0.7).alias("ready"))
