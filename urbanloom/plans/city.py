"""Queries of timetables, sites, land uses, footprints, snapshots, reports and texts that stand for numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from urbanloom.functions import geometry, intervals, shapes, text
from urbanloom.operators import allocation, autocorr, planning, profiles, report, routes, scenario, series, siting, transit
from urbanloom.plans.registry import query
from urbanloom.plans.services import D, at, places
from urbanloom.plans.streets import HUBS, E, N, edges_, hubs
from urbanloom.sources import settings
from urbanloom.sources.demo import demo_city

R = lambda x: f"round({x}, 6) + 0.0"
P = "plots"

# texts
query("width_m", lambda p: p.selectExpr("id", "CASE id % 7 WHEN 0 THEN '7.5' WHEN 1 THEN concat(id, ' m') WHEN 2 THEN '12,5 Metres' WHEN 3 THEN 'wide' WHEN 4 THEN '-3' WHEN 5 THEN '  4m ' END AS t").select("id", text.width_m(F.col("t")).alias("width")), P, sql="SELECT id, CASE id % 7 WHEN 0 THEN 7.5 WHEN 1 THEN CASE WHEN id > 0 THEN id END WHEN 2 THEN 12.5 WHEN 5 THEN 4 END::DOUBLE AS width FROM {plots}")
query("road_width", lambda p: p.selectExpr("id", "CASE id % 6 WHEN 0 THEN 'primary' WHEN 1 THEN ' Trunk_Link' WHEN 2 THEN 'steps' WHEN 3 THEN 'moon' WHEN 4 THEN 'FOOTWAY' END AS t").select("id", text.road_width_m(F.col("t"), 6.5).alias("width")), P, sql="SELECT id, CASE id % 6 WHEN 0 THEN 18 WHEN 1 THEN 25 WHEN 2 THEN 2 WHEN 4 THEN 3 ELSE 6.5 END::DOUBLE AS width FROM {plots}")
query("time_seconds", lambda p: p.selectExpr("id", "concat(id % 30, ':', lpad(id % 60, 2, '0'), ':', lpad(id % 59, 2, '0')) AS t").select("id", text.seconds(F.col("t")).alias("seconds")), P, sql="SELECT id, CAST(id % 30 * 3600 + id % 60 * 60 + id % 59 AS INT) AS seconds FROM {plots}")
STANDARDS = settings.standards("green=10; education=4, health=1.5")
query("matched_standard", lambda p: p.selectExpr("id", "CASE id % 4 WHEN 0 THEN 'Public Green' WHEN 1 THEN 'education (green roof)' WHEN 2 THEN 'HEALTH' ELSE 'other' END AS c").select("id", text.matched(F.col("c"), STANDARDS).alias("m")).select("id", "m.key", "m.per_capita"), P, sql="SELECT id, CASE id % 4 WHEN 0 THEN 'green' WHEN 1 THEN 'green' WHEN 2 THEN 'health' END AS key, CASE id % 4 WHEN 0 THEN 10 WHEN 1 THEN 10 WHEN 2 THEN 1.5 END::DOUBLE AS per_capita FROM {plots}")

# profiles and reach
query("grade_stats", lambda p: profiles.grade_stats(p.selectExpr("id % 100 AS id", "id AS seq", "u * 50 AS z", "floor(id / 100) * 20.0D + v AS d")), P, sql=f"""
WITH d AS (SELECT id % 100 AS id, u * 50 - lag(u * 50) OVER w AS dz, floor(id / 100) * 20 + v - lag(floor(id / 100) * 20 + v) OVER w AS dd FROM {{plots}} WINDOW w AS (PARTITION BY id % 100 ORDER BY id))
SELECT id, {R('sum(abs(dz)) / sum(dd)')} AS mean, {R('max(abs(dz / dd))')} AS max, {R('sum(greatest(dz, 0))')} AS climb, {R('sum(greatest(-dz, 0))')} AS descent FROM d WHERE dd > 0 GROUP BY id""")
query("walking_minutes", lambda p: profiles.walking_minutes(p.selectExpr("id % 50 AS id", "u - 0.5 AS grade", "s * 10 AS length")), P, sql=f"SELECT id % 50 AS id, {R('sum(s * 10 / 1000 / (6 * exp(-3.5 * abs(u - 0.45))) * 60)')} AS minutes FROM {{plots}} GROUP BY 1")
reached = lambda p: p.select("id", intervals.reach(F.col("u") * 10, F.col("v") * 10, 1 + F.col("w") * 5, 6.0).alias("r"))
REACH = "f AS (SELECT id, greatest(0, least(1, (6 - u * 10) / (1 + w * 5))) AS a, greatest(0, least(1, (6 - v * 10) / (1 + w * 5))) AS b FROM {plots}), r AS (SELECT id, a + b >= 1 - 1e-9 AS whole, a, b FROM f)"
query("reach_fractions", lambda p: reached(p).select("id", "r.whole", "r.a", "r.b"), P, sql=f"WITH {REACH} SELECT id, whole, {R('a')} AS a, {R('b')} AS b FROM r")
query("edge_intervals", lambda p: reached(p).select("id", intervals.of_edge(F.col("r")).alias("i")).select("id", F.size("i").alias("n"), intervals.length(F.col("i")).alias("length")), P, sql=f"WITH {REACH} SELECT id, CASE WHEN whole THEN 1 ELSE (a > 1e-9)::INT + (b > 1e-9)::INT END AS n, {R('CASE WHEN whole THEN 1 ELSE a + b END')} AS length FROM r")
fifth = lambda: F.array(intervals.piece(F.lit(0.2), F.lit(0.6)))
_over = "greatest(0, least(a, 0.6) - 0.2) + greatest(0, 0.6 - greatest(1 - b, 0.2))"
query("subtract_intervals", lambda p: reached(p).select("id", intervals.length(intervals.without(intervals.of_edge(F.col("r")), fifth())).alias("length")), P, sql=f"WITH {REACH} SELECT id, {R(f'CASE WHEN whole THEN 0.6 ELSE a + b - ({_over}) END')} AS length FROM r")
query("merged_intervals", lambda p: p.select("id", intervals.merged(F.array(intervals.piece(F.col("v"), F.col("v") + 0.3), intervals.piece(F.col("u"), F.col("u") + 0.2))).alias("m")).select("id", F.size("m").alias("n"), intervals.length(F.col("m")).alias("length")), P, sql=f"""
WITH i AS (SELECT id, v AS a0, least(v + 0.3, 1) AS a1, u AS b0, least(u + 0.2, 1) AS b1 FROM {{plots}}) SELECT id, CASE WHEN greatest(a0, b0) <= least(a1, b1) + 1e-9 THEN 1 ELSE 2 END AS n, {R('a1 - a0 + b1 - b0 - greatest(0, least(a1, b1) - greatest(a0, b0))')} AS length FROM i""")
query("entry_interval", lambda p: p.select("id", intervals.about(F.col("u"), F.col("v") * 2, 1 + F.col("w"), 1.0).alias("x")).select("id", "x.lo", "x.hi"), P, sql=f"WITH s AS (SELECT id, u, 1 - v * 2 AS b, (1 - v * 2) / (1 + w) AS s FROM {{plots}}) SELECT id, {R('CASE WHEN b > 1e-9 THEN greatest(u - s, 0) END')} AS lo, {R('CASE WHEN b > 1e-9 THEN least(u + s, 1) END')} AS hi FROM s")
query("reach_intervals", lambda e, n: profiles.reach_intervals(edges_(e), routes.path_tree(edges_(e), hubs(n), together=True), 4.5).select("edge", intervals.length(F.col("intervals")).alias("share")), E, N, sql=f"""
WITH {HUBS}, m AS (SELECT node, min(dist) AS dist FROM d GROUP BY node), f AS (SELECT edge, greatest(0, least(1, (4.5 - a.dist) / cost)) AS a, greatest(0, least(1, (4.5 - b.dist) / cost)) AS b FROM {{block_edges}} JOIN m a ON a.node = src JOIN m b ON b.node = dst) SELECT edge, {R('least(a + b, 1)')} AS share FROM f WHERE a + b > 0""")

# timetables
TRIP, STOP, WHEN = "concat('t', floor(id / 8))", "concat('s', (floor(id / 8) * 3 + id % 8 * (1 + floor(id / 8) % 3)) % 40)", "floor(id / 8) % 20 * 600 + id % 8 * 180"
times = lambda p: p.selectExpr(f"{TRIP} AS trip", "CAST(id % 8 AS INT) AS seq", f"{STOP} AS stop", f"CAST({WHEN} AS INT) AS arr", f"CAST({WHEN} + 30 AS INT) AS dep")
trips = lambda p: p.selectExpr(f"{TRIP} AS trip", "concat('r', floor(id / 8) % 5) AS route", "concat('x', floor(id / 8) % 3) AS service").distinct()
calendar = lambda a: a.selectExpr("concat('x', id) AS service", "transform(sequence(0, 6), k -> (id + k) % 3 <> 0) AS days", "concat('2024010', 1 + id % 9) AS start", "concat('202402', 10 + id % 15) AS end")
dates = lambda a: a.selectExpr("id AS n", "concat('x', id) AS service", "IF(id % 2 = 0, '20240110', '20240111') AS date", "CAST(1 + id % 4 % 3 % 2 AS INT) AS exception")
ACTIVE = "a AS (SELECT 'x' || id AS service FROM {areas} WHERE (id + 2) % 3 <> 0 AND '2024010' || (1 + id % 9) <= '20240110' AND '202402' || (10 + id % 15) >= '20240110' UNION SELECT 'x' || id FROM {areas} WHERE id % 2 = 0 AND id % 4 % 3 % 2 = 0), s AS (SELECT service FROM a WHERE service NOT IN (SELECT 'x' || id FROM {areas} WHERE id % 2 = 0 AND id % 4 % 3 % 2 = 1))"
query("active_services", lambda a: transit.active_services(calendar(a), dates(a), "20240110"), "areas", sql=f"WITH {ACTIVE} SELECT service FROM s")
query("first_service_day", lambda a: a.sparkSession.createDataFrame([(transit.first_service_day(calendar(a), dates(a)),)], "day string"), "areas", sql="""
WITH d AS (SELECT id, DATE '2024-01-01' + CAST(id % 9 AS INT) + CAST(k AS INT) AS d FROM {areas}, (SELECT unnest(range(7)) AS k)) SELECT min(strftime(d, '%Y%m%d')) AS day FROM d WHERE (id + isodow(d) - 1) % 3 <> 0 AND strftime(d, '%Y%m%d') <= '202402' || (10 + id % 15)""")
DAY = f"{ACTIVE}, t AS (SELECT 't' || CAST(floor(id / 8) AS BIGINT) AS trip, 'r' || CAST(floor(id / 8) % 5 AS BIGINT) AS route, 'x' || CAST(floor(id / 8) % 3 AS BIGINT) AS service, id % 8 AS seq, 's' || CAST((floor(id / 8) * 3 + id % 8 * (1 + floor(id / 8) % 3)) % 40 AS BIGINT) AS stop, {WHEN} AS arr, {WHEN} + 30 AS dep FROM {{plots}}), k AS (SELECT * FROM t WHERE service IN (SELECT service FROM s) AND trip IN (SELECT trip FROM t GROUP BY trip HAVING count(*) > 1))"
day = lambda p, a: transit.compile_day(trips(p), times(p), transit.active_services(calendar(a), dates(a), "20240110"))
query("trip_patterns", lambda p, a: day(p, a)[0].select("route", F.array_join("stops", ",").alias("stops"), "trips"), P, "areas", sql=f"WITH {DAY}, w AS (SELECT trip, route, string_agg(stop, ',' ORDER BY seq) AS stops FROM k GROUP BY trip, route) SELECT route, stops, count(*) AS trips FROM w GROUP BY route, stops")
query("trip_runs", lambda p, a: day(p, a)[1].groupBy("trip", "run").agg(F.min("arr").alias("first"), F.max("arr").alias("last")), P, "areas", sql=f"""
WITH {DAY}, w AS (SELECT trip, route, string_agg(stop, ',' ORDER BY seq) AS stops, min(dep) AS d, min(arr) AS f, max(arr) AS l FROM k GROUP BY trip, route) SELECT trip, CAST(row_number() OVER (PARTITION BY route, stops ORDER BY d, trip) - 1 AS INT) AS run, CAST(f AS INT) AS first, CAST(l AS INT) AS last FROM w""")
_rides = ["b0 AS (SELECT * FROM (VALUES ('s0', 0.0::DOUBLE), ('s7', 900.0)) v(stop, t))"]
for _k in range(3):
    _rides.append(f"o{_k} AS (SELECT trip, min(seq) AS o FROM k JOIN b{_k} USING (stop) WHERE t <= dep GROUP BY trip), b{_k + 1} AS MATERIALIZED (SELECT stop, min(t) AS t FROM (SELECT * FROM b{_k} UNION ALL SELECT stop, arr FROM k JOIN o{_k} USING (trip) WHERE seq > o) GROUP BY stop)")
query("earliest_arrival", lambda p, a: transit.earliest_arrival(day(p, a)[1], p.sparkSession.createDataFrame([("s0", 0.0), ("s7", 900.0)], "stop string, t double"), 2), P, "areas", sql=f"WITH {DAY}, {', '.join(_rides)} SELECT stop, t FROM b3")

# sites
sites = lambda p: places(p, 5000).where("id % 50 = 3")
asked = lambda p: p.selectExpr("id AS demand", "s AS w")
within = lambda p, r: siting.costs_between(sites(p), places(p, 5000), r)
COSTS = lambda r: f"p AS ({at(5000, 's AS w')}), c AS MATERIALIZED (SELECT f.id AS site, p.id AS demand, p.w, {D('p', 'f')} AS cost FROM p, (SELECT * FROM p WHERE id % 50 = 3) f WHERE {D('p', 'f')} <= {r})"
query("coverage_weights", lambda p: siting.coverage_of(sites(p), places(p, 5000, "s AS w"), 600.0), P, sql=f"WITH {COSTS(800)} SELECT site, {R('sum(w)')} AS weight FROM c WHERE cost <= 600 GROUP BY site")


def cover(f: str, k: int, start: str = "false") -> str:
    """CTEs of k greedy steps t1.. over covers ``f`` of c, from what the sites of ``start`` cover."""
    out = [f"f AS MATERIALIZED (SELECT site, demand, w, {f} AS f FROM c), b0 AS (SELECT demand, max(f) AS b FROM f WHERE {start} GROUP BY demand)"]
    for i in range(k):
        taken = " OR ".join([start, *(f"site = (SELECT site FROM t{j + 1})" for j in range(i))])
        out.append(f"t{i + 1} AS MATERIALIZED (SELECT site, sum(greatest(f - coalesce(b, 0), 0) * w) AS added FROM f LEFT JOIN b{i} USING (demand) WHERE NOT ({taken}) GROUP BY site ORDER BY added DESC, site LIMIT 1)")
        out.append(f"b{i + 1} AS MATERIALIZED (SELECT demand, max(b) AS b FROM (SELECT * FROM b{i} UNION ALL SELECT demand, f FROM f WHERE site = (SELECT site FROM t{i + 1})) GROUP BY demand)")
    return ", ".join(out)


def steps(k: int) -> str:
    return " UNION ALL ".join(f"SELECT {i + 1} AS step, site, {R('added')} AS added, {R(f'(SELECT sum(b * s) FROM b{i + 1} JOIN {{plots}} ON id = demand)')} AS covered FROM t{i + 1}" for i in range(k))


query("decayed_cover", lambda p: siting.decayed_cover_of(sites(p), places(p, 5000, "s AS w"), 4, 800.0), P, sql=f"WITH {COSTS(800)}, {cover('exp(-0.002 * cost)', 4)} {steps(4)}")
query("max_coverage", lambda p: siting.decayed_cover(within(p, 800.0), asked(p), 3, 800.0, "none", fixed=sites(p).where("id % 100 = 3 and id < 500").selectExpr("id AS site")), P, sql=f"WITH {COSTS(800)}, {cover('1', 3, '(site % 100 = 3 AND site < 500)')} {steps(3)}")
near = lambda a, f: a.selectExpr("id AS demand", "x", "y").crossJoin(f.selectExpr("id AS site", "x AS fx", "y AS fy")).selectExpr("demand", "site", "sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy)) + site / 100 AS cost")
NEAR = "c AS (SELECT a.id AS demand, f.id AS site, pop, sqrt(pow(a.x - f.x, 2) + pow(a.y - f.y, 2)) + f.id / 100 AS cost FROM {areas} a, {facilities} f)"
people = lambda a: a.selectExpr("id AS demand", "pop AS w")
query("p_median_interchange", lambda a, f: siting.p_median(near(a, f), people(a), 2)[0].agg(F.max("objective").alias("objective")), "areas", "facilities", sql=f"WITH {NEAR} SELECT {R('min(o)')} AS objective FROM (SELECT sum(a.pop * least(a.cost, b.cost)) AS o FROM c a JOIN c b USING (demand) WHERE a.site < b.site GROUP BY a.site, b.site)")
_hub = f"c AS (SELECT p.id AS demand, f.id AS site, p.s AS w, {D('p', 'f')} / 1000 AS cost FROM (SELECT *, u * 5000 AS x, v * 5000 AS y FROM {{plots}}) p, ({at(5000)} WHERE id % 50 = 3) f), h1 AS (SELECT site FROM c GROUP BY site ORDER BY sum(w * cost), site LIMIT 1), m AS (SELECT demand, cost AS b FROM c WHERE site = (SELECT site FROM h1)), h2 AS (SELECT site FROM c JOIN m USING (demand) WHERE site <> (SELECT site FROM h1) GROUP BY site ORDER BY sum(w * least(cost, b)), site LIMIT 1), n AS (SELECT demand, any_value(w) AS w, min(cost) AS cost, arg_min(site, (cost, site)) AS site FROM c WHERE site IN (SELECT site FROM h1 UNION ALL SELECT site FROM h2) GROUP BY demand)"
hub = lambda p: siting.micro_hubs(sites(p), places(p, 5000, "s AS w"), 2, 2.0)
query("micro_hubs", lambda p: hub(p)[0], P, sql=f"WITH {_hub} SELECT demand, site, {R('cost')} AS cost FROM n")
query("micro_hub_summary", lambda p: hub(p)[1], P, sql=f"WITH {_hub} SELECT {R('sum(cost * w)')} AS km, {R('avg((cost <= 2)::INT)')} AS in_reach FROM n")
stores = lambda f: f.selectExpr("id AS site", "supply * 100 AS capacity")
query("capacitated_assign", lambda a, f: siting.capacitated(near(a, f), stores(f), people(a), 4.0)[0], "areas", "facilities")
query("capacitated_loads", lambda p: siting.capacitated_within(sites(p).selectExpr("*", "500D AS capacity"), places(p, 5000, "s AS w"), 800.0)[1], P)
query("capacitated_siting", lambda a, f: siting.capacitated_siting(near(a, f), stores(f), people(a), 2)[1], "areas", "facilities")
pairs = lambda f: f.selectExpr("id AS a").crossJoin(f.selectExpr("id AS b")).where("a < b").selectExpr("a * 100 + b AS set", "explode(array(a, b)) AS site")
query("site_trade_off", lambda a, f: siting.site_trade_off(near(a, f).where("cost <= 2.5"), people(a), pairs(f)), "areas", "facilities", sql=f"""
WITH {NEAR}, s AS (SELECT a.id * 100 + b.id AS k, unnest([a.id, b.id]) AS site FROM {{facilities}} a, {{facilities}} b WHERE a.id < b.id), n AS (SELECT k, demand, any_value(pop) AS w, min(cost) AS d FROM s JOIN c USING (site) WHERE cost <= 2.5 GROUP BY k, demand),
o AS (SELECT *, sum(w) OVER (PARTITION BY k ORDER BY d, demand) / sum(w) OVER (PARTITION BY k) AS q FROM n), t AS (SELECT k, sum(w) AS c, sum(w * d) / sum(w) AS m, greatest(0, least(1, 1 - 2 * sum(d * (1 - q)) / greatest(sum(d), 1e-9))) AS g FROM o GROUP BY k)
SELECT k AS "set", {R('c')} AS covered, {R('m')} AS mean, {R('g')} AS gini FROM t WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.c >= t.c AND b.m <= t.m AND (b.c > t.c OR b.m < t.m))""")
query("fleet_depots", lambda p, a: siting.fleet_depots(p.selectExpr("id", "u * 20 AS x", "v * 20 AS y", "w * 20 AS to_x", "q * 20 AS to_y"), a.selectExpr("id", "x * 5 AS x", "y * 5 AS y", "5000D AS kw"), 5, True, 6.0)[2], P, "areas")
query("balanced_clusters", lambda p: siting.balanced_clusters(places(p, 1000, "s AS w"), 8)[1].agg(F.count("*").alias("clusters"), F.sum("weight").alias("weight")), P, sql=f"SELECT 8::BIGINT AS clusters, {R('sum(s)')} AS weight FROM {{plots}}")

# land uses
parcels = lambda a: a.selectExpr("id", "pop AS area", "1 + id % 4 AS homes", "1 + (id * 7) % 5 AS shops", "id % 3 AS parks", "IF(id = 12, 'parks', NULL) AS locked")
beside = lambda e: e.selectExpr("src", "dst", "cost AS length")
GOALS = dict(settings.targets("homes=700, shops=500, parks=300"))
query("allocate_land_use", lambda a: allocation.allocate(parcels(a), GOALS)[1], "areas")
query("allocate_with_neighbours", lambda a, e: allocation.allocate(parcels(a), GOALS, beside(e), np.eye(3) * 20)[1], "areas", "edges")
query("allocate_in_one_piece", lambda a, e: allocation.use_pieces(allocation.allocate(parcels(a), GOALS, beside(e), contiguous=True)[0], beside(e)).select("use", "whole"), "areas", "edges")
query("allocation_trade_off", lambda a, e: allocation.trade_off(parcels(a), GOALS, beside(e), [0.0, 5.0, 20.0, 80.0]), "areas", "edges")

# footprints
box = lambda p: p.selectExpr("id", "20 + s AS w", "25 + u * 40 AS h")
_m, _t = lambda share: f"greatest(7, w * {share})", lambda share: f"greatest(7, h * {share})"
AREAS = {
    "rectangle": "greatest(5, w * 0.9) * h",
    "L": f"w * {_t(0.4)} + {_m(0.45)} * (h - {_t(0.4)})",
    "U": f"w * {_t(0.3)} + 2 * {_m(0.3)} * (h - {_t(0.3)})",
    "T": f"w * {_t(0.35)} + {_m(0.4)} * (h - {_t(0.35)})",
    "H": f"2 * {_m(0.3)} * h + (w - 2 * {_m(0.3)}) * {_t(0.3)}",
    "courtyard": "w * h",
    "C": f"{_m(0.4)} * h + 2 * (w - {_m(0.4)}) * {_t(0.25)}",
    "E": f"{_m(0.25)} * h + 3 * (w - {_m(0.25)}) * {_t(0.2)}",
    "cross": f"{_m(0.35)} * h + (w - {_m(0.35)}) * {_t(0.35)}",
}
for _shape, _area in AREAS.items():
    query(f"footprint_{_shape.lower()}", lambda p, s=_shape: box(p).select("id", geometry.ring_area(shapes.footprint(s)).alias("area")), P, sql=f"WITH b AS (SELECT id, 20 + s AS w, 25 + u * 40 AS h FROM {{plots}}) SELECT id, {R(_area)} AS area FROM b")
query("open_court", lambda p: box(p).select("id", geometry.ring_area(shapes.courtyard()).alias("area")), P, sql=f"WITH b AS (SELECT id, 20 + s AS w, 25 + u * 40 AS h FROM {{plots}}), m AS (SELECT *, greatest(7, least(w, h) * 0.25) AS m FROM b) SELECT id, {R('(w - 2 * m) * (h - 2 * m)')} AS area FROM m")

# figures of plans
scores = lambda p: p.selectExpr("least(u * 110, 100) AS score")
balance = lambda v: planning.balance_rows(v.groupBy("g").agg({"x": "sum"}).selectExpr("g AS category", "`sum(x)` AS area"), 1000.0, {"auto": 1e6, "mach": 2000.0, "house": 10.0}).withColumnsRenamed({"area": "area_m2", "required": "required_m2", "balance": "balance_m2"})
shops = lambda f: f.selectExpr("id AS facility", "supply AS capacity", "bal / 1000 AS utilization", "CASE id % 3 WHEN 0 THEN 'Adequate' WHEN 1 THEN 'Overloaded' ELSE 'Unused' END AS status")
served = lambda p: p.selectExpr("s - 5 AS pop", "id % 3 AS covered")
dense = lambda p: p.selectExpr("price AS value")
ACCESS = "a AS (SELECT count(*) AS n, avg(least(u * 110, 100)) AS mean, quantile_cont(least(u * 110, 100), 0.5) AS median, 100 * avg((u * 110 >= 100 - 1e-9)::INT) AS full_, 100 * avg((u * 110 < 50)::INT) AS low_ FROM {plots})"
BALANCE = "c AS (SELECT lower(g) AS g, g AS category, sum(x) AS area FROM {values} GROUP BY g), k AS (SELECT *, CASE WHEN g LIKE '%auto%' THEN 1e6 WHEN g LIKE '%mach%' THEN 2000 WHEN g LIKE '%house%' THEN 10 END * 1000 AS need FROM c), b AS (SELECT count(*) AS n, count(need) AS s, count(*) FILTER (area < need) AS d, coalesce(arg_min(category, (area - need, category)) FILTER (area < need), '') AS w, coalesce(min(area - need) FILTER (area < need), 0) AS m FROM k)"
ADEQUACY = "f AS (SELECT count(*) AS n, count(*) FILTER (id % 3 = 1) AS o, count(*) FILTER (id % 3 = 2) AS u, coalesce(avg(bal / 1000) FILTER (id % 3 < 2), 0) AS m FROM {facilities}), d AS (SELECT sum(greatest(s - 5, 0)) FILTER (id % 3 <> 0) AS c, sum(greatest(s - 5, 0)) AS t FROM {plots})"
DENSITY = "y AS (SELECT count(*) AS n, avg(price) AS m, max(price) AS x FROM {plots})"
query("access_summary", lambda p: scenario.access_summary(scores(p)), P, sql=f"WITH {ACCESS} SELECT n, {R('mean')} AS mean, {R('median')} AS median, {R('full_')} AS share_full, {R('low_')} AS share_low FROM a")
query("balance_summary", lambda v: scenario.balance_summary(balance(v)), "values", sql=f"WITH {BALANCE} SELECT n AS n_categories, s AS n_with_standard, d AS n_deficit, {R('100.0 * (s - d) / s')} AS compliance_pct, w AS worst_category, {R('m')} AS worst_deficit_m2 FROM b")
query("adequacy_summary", lambda f, p: scenario.adequacy_summary(shops(f), served(p)), "facilities", P, sql=f"WITH {ADEQUACY} SELECT n AS n_facilities, o AS n_overloaded, u AS n_unused, {R('m')} AS mean_utilization, {R('c')} AS covered_pop, {R('t')} AS total_pop, {R('100 * c / t')} AS covered_share FROM f, d")
query("density_summary", lambda p: scenario.density_summary(dense(p)), P, sql=f"WITH {DENSITY} SELECT n AS n_cells, {R('m')} AS mean, {R('x')} AS max FROM y")
parts = lambda v, f, p: {"access": scenario.access_summary(scores(p)), "balance": scenario.balance_summary(balance(v)), "adequacy": scenario.adequacy_summary(shops(f), served(p))}
ALL = f"{ACCESS}, {BALANCE}, {ADEQUACY}, {DENSITY}, i AS (SELECT (mean + 100.0 * (b.s - b.d) / b.s + 100 * d.c / d.t) / 3 AS i FROM a, b, f, d)"
query("overall_score", lambda v, f, p: scenario.overall_score(**parts(v, f, p)), "values", "facilities", P, sql=f"WITH {ALL} SELECT {R('i')} AS overall FROM i")
_metrics = {"plan_performance_index": "i.i", "access_mean": "a.mean", "access_median": "a.median", "access_share_full": "a.full_", "access_share_low": "a.low_", "origins": "a.n", "standards_compliance_pct": "100.0 * (b.s - b.d) / b.s", "standards_deficits": "b.d", "standards_categories": "b.s", "covered_share": "100 * d.c / d.t", "covered_pop": "d.c", "total_pop": "d.t", "facilities": "f.n", "facilities_overloaded": "f.o", "facilities_unused": "f.u", "mean_utilization": "f.m", "density_mean": "y.m", "density_max": "y.x", "density_cells": "y.n"}
METRICS = " UNION ALL ".join(f"SELECT '{k}' AS metric, ({x})::DOUBLE AS value FROM a, b, f, d, y, i" for k, x in _metrics.items())
figures = lambda v, f, p: scenario.metrics_of(**parts(v, f, p), density=scenario.density_summary(dense(p)), overall=scenario.overall_score(**parts(v, f, p)))
query("metrics_of_summaries", figures, "values", "facilities", P, sql=f"WITH {ALL}, m AS ({METRICS}) SELECT metric, {R('value')} AS value FROM m")
query("snapshot_json", lambda v, f, p: scenario.from_json(scenario.to_json(scenario.snapshot(figures(v, f, p), "Plan", "2024-01-01 00:00"))), "values", "facilities", P, sql=f"WITH {ALL}, m AS ({METRICS}) SELECT 'Plan' AS name, 1 AS version, '2024-01-01 00:00' AS generated, metric, {R('value')} AS value FROM m")
query("metric_labels", lambda s: s.selectExpr("explode(array('access_gini', 'density_max', 'own_metric', k)) AS key").distinct().select("key", scenario.label_of(F.col("key")).alias("label"), scenario.direction_of(F.col("key")).alias("direction")), "series", sql="""
WITH k AS (SELECT DISTINCT k AS key FROM {series}) SELECT key, upper(key[1]) || key[2:] AS label, 0 AS direction FROM k UNION ALL SELECT 'access_gini', 'Access inequality (Gini)', -1 UNION ALL SELECT 'density_max', 'Density max (/ha)', 0 UNION ALL SELECT 'own_metric', 'Own Metric', 0""")
query("score_line", lambda p: scenario.score_line(p.where("id % 3 < 2").selectExpr("CASE WHEN u > 0.6 THEN 'A' WHEN u < 0.3 THEN 'B' WHEN v > 0.5 THEN 'tie' ELSE 'n/a' END AS better"), "Now", "Then"), P, sql="""
WITH t AS (SELECT CASE WHEN u > 0.6 THEN 'A' WHEN u < 0.3 THEN 'B' WHEN v > 0.5 THEN 'tie' ELSE 'n/a' END AS b FROM {plots} WHERE id % 3 < 2), n AS (SELECT count(*) FILTER (b = 'A') AS a, count(*) FILTER (b = 'B') AS b, count(*) FILTER (b = 'tie') AS t, count(*) AS n FROM t)
SELECT CASE WHEN a = b THEN 'Even result' WHEN b > a THEN '''Then'' leads' ELSE '''Now'' leads' END || ': Then wins ' || b || ', Now wins ' || a || ', ' || t || ' tied, over ' || n || ' compared metrics.' AS line FROM n""")
query("report_cards", lambda v, f, p: report.report_cards(**parts(v, f, p), density=scenario.density_summary(dense(p))), "values", "facilities", P, sql=f"""
WITH {ALL}, cards AS (SELECT 0 AS k, 'Plan Performance Index' AS label, printf('%.0f', i) AS value, 'mean of available components (0-100)' AS sub, CASE WHEN i >= 75 THEN 'good' WHEN i >= 50 THEN 'warn' ELSE 'bad' END AS tone FROM i
UNION ALL SELECT 1, 'Accessibility Score', printf('%.0f', mean), n || ' origins - ' || printf('%.0f', full_) || '% reach every category', CASE WHEN mean >= 75 THEN 'good' WHEN mean >= 50 THEN 'warn' ELSE 'bad' END FROM a
UNION ALL SELECT 2, 'Standards Compliance', printf('%.0f', 100.0 * (s - d) / s) || '%', CASE WHEN d > 0 THEN d || ' deficit(s) - worst: ' || w ELSE s || ' categories with a standard' END, CASE WHEN 100.0 * (s - d) / s >= 99.9 THEN 'good' WHEN 100.0 * (s - d) / s >= 66 THEN 'warn' ELSE 'bad' END FROM b
UNION ALL SELECT 3, 'Population Covered', printf('%.0f', 100 * c / t) || '%', n || ' facilities - ' || o || ' overloaded', CASE WHEN 100 * c / t >= 90 THEN 'good' WHEN 100 * c / t >= 70 THEN 'warn' ELSE 'bad' END FROM f, d
UNION ALL SELECT 4, 'Density (mean)', printf('%.1f', m) || '/ha', 'max ' || printf('%.1f', x) || '/ha over ' || n || ' cells', 'info' FROM y) SELECT * FROM cards""")
RAMP = lambda t: f"printf('#%02x%02x%02x', {', '.join(f'CAST(round_even(CASE WHEN {t} < 0.5 THEN {a} + ({b} - {a}) * 2 * {t} ELSE {b} + ({c} - {b}) * (2 * {t} - 1) END, 0) AS INT)' for a, b, c in zip(*report.RAMP))})"
query("ramp_color", lambda p: p.select("id", report.ramp_color(F.col("u")).alias("color")), P, sql=f"SELECT id, {RAMP('u')} AS color FROM {{plots}}")
query("histogram_bins", lambda p: report.histogram(scores(p), "score"), P, sql=f"WITH s AS (SELECT least(9, CAST(floor(least(u * 110, 100) / 10) AS INT)) AS b FROM {{plots}}), k AS (SELECT CAST(unnest(range(10)) AS INT) AS b) SELECT b AS bin, (SELECT count(*) FROM s WHERE s.b = k.b) AS n, {RAMP('((b + 0.5) / 10)')} AS color FROM k")
query("map_points", lambda p: report.map_points(p.where("id < 1500").selectExpr("u AS x", "v AS y", "w * 100 AS value")), P, sql=f"SELECT {R('u')} AS x, {R('v')} AS y, {RAMP('w')} AS color FROM {{plots}} WHERE id < 1500")

# series
query("forecast_cells", lambda s: series.forecast_cells(s, 3), "series", sql=f"""
WITH o AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY t DESC) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM {{series}}), l AS (SELECT k, sum(CASE WHEN i = n - 1 THEN 1 ELSE 0.3 END * pow(0.7, i) * v) AS l FROM o GROUP BY k) SELECT k, 'exponential_smoothing' AS method, CAST(a AS INT) AS ahead, {R('l')} AS value FROM l, (SELECT unnest([1, 2, 3]) AS a)""")
query("backtest", lambda s: series.backtest(s, 4), "series", sql=f"""
WITH o AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY t DESC) - 5 AS i, count(*) OVER (PARTITION BY k) - 4 AS n FROM {{series}}), l AS (SELECT k, sum(CASE WHEN i = n - 1 THEN 1 ELSE 0.3 END * pow(0.7, i) * v) AS l FROM o WHERE i >= 0 GROUP BY k)
SELECT k, any_value(n) AS n_train, count(*) AS n_test, {R('avg(abs(v - l))')} AS mae, {R('sqrt(avg(pow(v - l, 2)))')} AS rmse, {R('100 * avg(CASE WHEN abs(v) > 1e-9 THEN abs((v - l) / v) END)')} AS mape FROM o JOIN l USING (k) WHERE i < 0 GROUP BY k""")

# a made-up city: the diagonal cuts four streets of one way and two of the other between corners, and has eight parts
town = lambda p, name: demo_city(p.sparkSession, 7, 6, 4, 100.0, 5.0)[name]
query("demo_streets", lambda p: town(p, "streets").agg(F.count("*").alias("n"), F.sum(F.expr("sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))")).alias("length")), P, sql=f"SELECT (7 * 4 + 4 + 5 * 6 + 2 + 8)::BIGINT AS n, {R('7 * 400 + 5 * 600 + sqrt(600 * 600 + 400 * 400)')} AS length")
query("demo_blocks", lambda p: town(p, "blocks").groupBy().agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("size")).alias("area")), P, sql="SELECT 24::BIGINT AS n, 240000.0::DOUBLE AS area")
query("demo_heights", lambda p: town(p, "heights").agg(F.count("*").alias("n")), P, sql="SELECT 9600::BIGINT AS n")
query("demo_buildings", lambda p: town(p, "buildings"), P)
