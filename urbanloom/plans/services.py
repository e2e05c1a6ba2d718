"""Queries of access to services and of groups' shares in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from urbanloom.operators import services as S
from urbanloom.plans.registry import query
from urbanloom.plans.streets import paths

R = lambda x: f"round({x}, 6) + 0.0"
D = lambda a, b: f"sqrt(pow({a}.x - {b}.x, 2) + pow({a}.y - {b}.y, 2))"
P = "plots"


def gini(source: str) -> str:
    """Gini of x weighted by p, from all pairs."""
    return f"coalesce((SELECT sum(l.p * r.p * abs(l.x - r.x)) / 2 FROM {source} l, {source} r) / nullif((SELECT sum(p) * sum(p * x) FROM {source}), 0), 0)"


def plain_gini(source: str, x: str) -> str:
    return f"(SELECT CASE WHEN sum(x) > 0 THEN greatest(0, least(1, (2 * sum(i * x) - (count(*) + 1) * sum(x)) / (count(*) * sum(x)))) ELSE 0 END FROM (SELECT {x} AS x, row_number() OVER (ORDER BY {x}) AS i FROM {source}))"


places = lambda p, size=10000, *more: p.selectExpr("id", f"u * {size}D AS x", f"v * {size}D AS y", *more)
at = lambda size=10000, *more: "SELECT " + ", ".join(["id", f"u * {size} AS x", f"v * {size} AS y", *more]) + " FROM {plots}"
clinics = lambda p: places(p, 10000, "price AS capacity").where("id % 40 = 7")
HEALTH = f"""p AS ({at(10000, '1 + s AS a', '10 * w AS b')}), f AS ({at(10000, 'price AS capacity')} WHERE id % 40 = 7), n0 AS (SELECT p.id AS o, f.id AS f, capacity, a + b AS pop, {D('p', 'f')} AS d FROM p, f),
n AS (SELECT *, CASE WHEN d <= 660 THEN 1.0 WHEN d <= 1320 THEN 0.6 ELSE 0.2 END AS w FROM n0 WHERE d <= 2000), r AS (SELECT f, max(capacity) / sum(w * pop) AS ratio FROM n GROUP BY f), g AS (SELECT o, sum(w * ratio) AS access FROM n JOIN r USING (f) GROUP BY o),
a AS (SELECT id, a, b, coalesce(access, 0) AS access FROM p LEFT JOIN g ON o = id), e AS (SELECT access AS x, a + b AS p FROM a)"""
health = lambda p: S.health_equity(places(p, 10000, "1 + s AS a", "10 * w AS b"), clinics(p), {"a": 1.0, "b": 2.0}, 2000.0)
query("health_access", lambda p: health(p)[0], P, sql=f"WITH {HEALTH} SELECT id, {R('access')} AS access, {R('access / (a + 2 * b)')} AS weighted FROM a")
query("health_equity", lambda p: health(p)[1], P, sql=f"WITH {HEALTH} SELECT {R('g')} AS gini, {R('1 - g')} AS equity FROM (SELECT {gini('e')} AS g)")
query("health_groups", lambda p: health(p)[2], P, sql=f"""
WITH {HEALTH}, m AS (SELECT sum(access * (a + b)) / sum(a + b) AS t, sum(access * a) / sum(a) AS a, sum(access * b) / sum(b) AS b FROM a)
SELECT 'a' AS "group", {R('a')} AS mean, {R('(t - a) / t')} AS deficit FROM m UNION ALL SELECT 'b', {R('b')}, {R('(t - b) / t')} FROM m""")

shops = lambda p: places(p, 3000, "CAST(id % 50 AS STRING) AS category").where("id % 50 < 3")
_mode = lambda w, speed: f"{100 * w} * greatest(0, least(1, 1 - d / 1000 / {speed} * 60 / 15))"
MODES = f"""p AS ({at(3000)}), f AS ({at(3000, 'id % 50 AS category')} WHERE id % 50 < 3), n AS (SELECT p.id, category, min({D('p', 'f')}) AS d FROM p, f GROUP BY p.id, category),
s AS (SELECT id, sum({_mode(0.1, 20.0)} + {_mode(0.3, 15.0)} + {_mode(0.6, 4.5)}) / 3 AS x, 1.0::DOUBLE AS p FROM n GROUP BY id)"""
query("multimodal_score", lambda p: S.multimodal_score(places(p, 3000), shops(p))[0], P, sql=f"WITH {MODES} SELECT id, {R('x')} AS score FROM s")
query("multimodal_summary", lambda p: S.multimodal_score(places(p, 3000), shops(p))[1], P, sql=f"WITH {MODES} SELECT {R(gini('s'))} AS gini, {R('100 * avg((x >= 75)::INT)')} AS compliance FROM s")

zones = lambda a: a.selectExpr("id", "x", "y", "pop AS demand")
stations = lambda f: f.selectExpr("id", "x", "y", "supply * 10 AS kw", "abs(bal) AS transformer", "id % 2 = 0 AS fast")
CHARGE = f"""z AS (SELECT id, x, y, pop AS demand FROM {{areas}}), f AS (SELECT id, x, y, least(supply * 10, abs(bal)) AS cap, id % 2 = 0 AS fast FROM {{facilities}}), n AS (SELECT z.id AS z, f.id AS s, demand, cap, fast, exp(-0.1 * {D('z', 'f')}) AS w FROM z, f),
l AS (SELECT s, sum(demand * w) AS load, max(cap) AS cap FROM n GROUP BY s), a AS (SELECT z, max(demand) AS p, sum(w * l.cap / greatest(load, 1e-6)) AS x, coalesce(sum(w * l.cap / greatest(load, 1e-6)) FILTER (NOT fast), 0) AS slow, coalesce(sum(w * l.cap / greatest(load, 1e-6)) FILTER (fast), 0) AS fast FROM n JOIN l USING (s) GROUP BY z)"""
query("charging_access", lambda a, f: S.charging_access(zones(a), stations(f))[0], "areas", "facilities", sql=f"WITH {CHARGE} SELECT z AS id, {R('x')} AS access, {R('slow')} AS slow, {R('fast')} AS fast FROM a")
query("charging_stations", lambda a, f: S.charging_access(zones(a), stations(f))[1], "areas", "facilities", sql=f"WITH {CHARGE} SELECT s AS id, {R('load')} AS demand, {R('load / greatest(cap, 1e-6)')} AS stress, {R('cap / greatest(load, 1e-6)')} AS ratio FROM l")
query("charging_equity", lambda a, f: S.charging_access(zones(a), stations(f))[2], "areas", "facilities", sql=f"WITH {CHARGE} SELECT {R('g')} AS gini, {R('1 - g')} AS equity FROM (SELECT {gini('a')} AS g)")

# a ride and its change cost together what an arc of the unrolled search costs; the last change isn't made
stops = lambda a: a.selectExpr("id AS stop", "x * 900 AS x", "y * 900 AS y", "4D + id % 5 AS headway")
rides = lambda e: e.selectExpr("src AS a", "dst AS b", "2 * cost AS minutes").unionByName(e.selectExpr("dst AS a", "src AS b", "2 * cost AS minutes"))
query("isochrone_profile", lambda p, a, e: S.isochrone_profile((100.0, 200.0), places(p, 4000), stops(a), rides(e)), P, "areas", "edges", sql=f"""
WITH s AS (SELECT id AS stop, x * 900 AS x, y * 900 AS y, 4 + id % 5 AS headway FROM {{areas}}), arcs AS (SELECT src, dst, 2 * cost + 5 AS cost FROM {{edges}} UNION ALL SELECT dst, src, 2 * cost + 5 FROM {{edges}}), {paths('SELECT node AS source, node, 0.0::DOUBLE AS dist FROM {nodes}', 14)},
t AS (SELECT source AS i, node AS j, dist - 5 AS t FROM d WHERE source <> node UNION ALL SELECT a.source, a.source, min(a.dist + b.dist) - 5 FROM d a JOIN d b ON a.source = b.node AND a.node = b.source WHERE a.node <> a.source GROUP BY a.source),
w AS (SELECT stop, x, y, sqrt(pow(x - 100, 2) + pow(y - 200, 2)) / 80 + 0.5 * headway AS t FROM s), k AS (SELECT j AS stop, min(w.t + t.t) AS t FROM t JOIN w ON w.stop = i GROUP BY j), p AS ({at(4000)}),
m AS (SELECT p.id, min(sqrt(pow(p.x - 100, 2) + pow(p.y - 200, 2)) / 80) AS foot, min(k.t + {D('p', 's')} / 80) AS ride FROM p, k JOIN s USING (stop) GROUP BY p.id), o AS (SELECT *, least(foot, ride) AS minutes FROM m)
SELECT id, {R('minutes')} AS minutes, minutes <= 45 AS reachable, CASE WHEN minutes <= 15 THEN 1 WHEN minutes <= 30 THEN 2 WHEN minutes <= 45 THEN 3 WHEN minutes <= 60 THEN 4 ELSE 0 END AS band, CASE WHEN foot <= ride THEN 'direct_walk' ELSE 'multimodal_transit' END AS mode FROM o""")
query("electric_routes", lambda a, f: S.electric_routes(a.where("id % 12 = 0"), f.selectExpr("id", "x * 10 AS x", "y * 10 AS y", "supply * 5 AS demand"), a.where("id % 7 = 3").selectExpr("id", "x * 10 AS x", "y * 10 AS y")), "areas", "facilities")

query("micromobility_equity", lambda p: S.micromobility_equity(p.selectExpr("s AS vehicles", "u * 1000 AS distance", "v + 0.1D AS vulnerability")), P, sql=f"""
WITH s AS (SELECT s * exp(-u * 1000 / 500) / (v + 0.1 + 1e-6) AS s FROM {{plots}}) SELECT {R('avg(s)')} AS mean, {R(plain_gini('s', 's'))} AS gini, count(*) FILTER (s < 0.5 * (SELECT quantile_cont(s, 0.5) FROM s)) AS low_access FROM s""")
query("fleet_charging", lambda p: S.fleet_charging(p.selectExpr("price AS energy")), P, sql=f"SELECT {R('least(count(*) * 150.0, 1000)')} AS peak, {R('sum(price)')} AS energy, 6 AS at_once, {R('sum(price) / 150 / 6')} AS hours FROM {{plots}}")
query("street_sky_view", lambda p: S.street_sky_view(places(p, 1000), p.where("id % 3 = 0").selectExpr("id", "w * 1000 AS x", "q * 1000 AS y", "s AS height")), P, sql=f"""
WITH p AS ({at(1000)}), b AS (SELECT w * 1000 AS x, q * 1000 AS y, s AS height FROM {{plots}} WHERE id % 3 = 0), n AS (SELECT p.id, max(atan(height / greatest({D('p', 'b')}, 1))) AS a FROM p, b WHERE {D('p', 'b')} <= 100 GROUP BY p.id) SELECT id, {R('cos(coalesce(a, 0))')} AS svf FROM p LEFT JOIN n USING (id)""")

requests = lambda p: places(p, 5000, "w * 5000 AS to_x", "q * 5000 AS to_y").where("id % 20 <> 3")
vehicles = lambda p: places(p, 5000).where("id % 20 = 3")
RIDES = f"r AS ({at(5000, 'w * 5000 AS to_x', 'q * 5000 AS to_y')} WHERE id % 20 <> 3), v AS ({at(5000)} WHERE id % 20 = 3), n AS (SELECT r.id, arg_min(v.id, ({D('r', 'v')}, v.id)) AS vehicle, min({D('r', 'v')}) AS d FROM r, v GROUP BY r.id), l AS (SELECT v.id AS vehicle, (SELECT count(*) FROM n WHERE n.vehicle = v.id) AS load FROM v)"
query("ride_assignment", lambda p: S.ride_dispatch(requests(p), vehicles(p), 30.0)[0], P, sql=f"WITH {RIDES} SELECT id, vehicle, {R('d')} AS d FROM n")
query("ride_loads", lambda p: S.ride_dispatch(requests(p), vehicles(p), 30.0)[1], P, sql=f"WITH {RIDES} SELECT vehicle, load FROM l")
query("ride_summary", lambda p: S.ride_dispatch(requests(p), vehicles(p), 30.0)[2], P, sql=f"WITH {RIDES} SELECT {R('((SELECT sum(d) FROM n) + (SELECT sum(sqrt(pow(to_x - x, 2) + pow(to_y - y, 2))) FROM r)) / 1000')} AS km, {R('(SELECT avg(load / 30) FROM l)')} AS utilization")

times = lambda p: p.selectExpr("id % 50 AS zone", "floor(id / 50) AS domain", "s AS minutes", "id % 3 AS services")
groups = lambda p: p.groupBy((F.col("id") % 50).alias("zone")).agg((F.max(F.col("id") % 10) / 10 + 0.05).alias("vulnerability"))
DOMAINS = "s AS (SELECT id % 50 AS zone, 100 * avg((s <= 15 AND id % 3 > 0)::INT) AS score, max(id % 10) / 10 + 0.05 AS v FROM {plots} GROUP BY 1)"
query("domain_scores", lambda p: S.domain_scores(times(p), groups(p))[0], P, sql=f"WITH {DOMAINS} SELECT zone, {R('score')} AS score FROM s")
query("domain_summary", lambda p: S.domain_scores(times(p), groups(p))[1], P, sql=f"WITH {DOMAINS} SELECT {R('avg(score)')} AS mean, {R('avg((score >= 80)::INT)')} AS compliant, {R('avg(score) FILTER (v > 0.5) - avg(score) FILTER (v <= 0.5)')} AS gap FROM s")
query("land_use_entropy", lambda p: S.land_use_entropy(p.groupBy((F.col("id") % 50).alias("zone"), (F.col("id") % 7).alias("kind")).agg(F.sum("s").alias("amount")), 7), P, sql=f"""
WITH c AS (SELECT id % 50 AS zone, id % 7 AS kind, sum(s) AS a FROM {{plots}} GROUP BY ALL), s AS (SELECT zone, a / sum(a) OVER (PARTITION BY zone) AS p FROM c) SELECT zone, {R('greatest(0, least(1, -sum(p * ln(p)) / ln(7)))')} AS entropy FROM s GROUP BY zone""")
_decay = "CASE WHEN d <= 400 THEN 1 WHEN d <= 800 THEN 1 - 0.25 * (d - 400) / 400 WHEN d <= 1200 THEN 0.75 - 0.15 * (d - 800) / 400 WHEN d <= 1600 THEN 0.6 - 0.1 * (d - 1200) / 400 WHEN d <= 2400 THEN 0.5 - 0.375 * (d - 1600) / 800 ELSE 0 END"
query("walk_score", lambda p: S.walk_score(p.selectExpr("id % 300 AS id", "concat('k', id % 4) AS kind", "u * 2600 AS d"), p.where("id < 300").selectExpr("id", "40 + id AS crossings", "100 + id AS block"), {"k0": 3.0, "k1": 2.0, "k2": 1.0, "k3": 1.0}), P, sql=f"""
WITH a AS (SELECT id % 300 AS id, CASE id % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END / 7 AS w, u * 2600 AS d FROM {{plots}}), s AS (SELECT id, 100 * sum(w * ({_decay})) AS raw FROM a GROUP BY id),
p AS (SELECT id, 0.01 * ({' + '.join(f'(40 + id < {x})::INT' for x in (200, 150, 120, 90, 60))} + {' + '.join(f'(100 + id > {x})::INT' for x in (120, 150, 180, 200, 250))}) AS t FROM {{plots}} WHERE id < 300) SELECT id, {R('greatest(0, least(100, raw * (1 - t)))')} AS score FROM p JOIN s USING (id)""")
_line = lambda x, zero, full: f"100 * greatest(0, least(1, ({x} - {zero}) / ({full} - {zero})))"
query("segment_walkability", lambda p: S.segment_walkability(p.selectExpr("id", "s * 3 AS n", "u", "w * 30 AS d", "50 + v * 400 AS b", "q * 12 AS g"), {"intersections": "n", "mix": "u", "destinations": "d", "blocklength": "b", "slope": "g"}).select("id", "s_slope", "s_blocklength", "total"), P, sql=f"""
SELECT id, {R(_line('q * 12', 10, 0))} AS s_slope, {R(_line('50 + v * 400', 400, 80))} AS s_blocklength, {R(f"0.3 * {_line('s * 3', 0, 120)} + 0.25 * {_line('u', 0, 1)} + 0.25 * {_line('w * 30', 0, 25)} + 0.1 * {_line('50 + v * 400', 400, 80)} + 0.1 * {_line('q * 12', 10, 0)}")} AS total FROM {{plots}}""")
od = lambda a, f: a.selectExpr("id AS o", "x", "y").crossJoin(f.selectExpr("id AS d", "x AS fx", "y AS fy")).selectExpr("o", "d", "sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy)) AS cost")
query("jobs_housing_mismatch", lambda a, f: S.jobs_housing_mismatch(od(a, f), a.selectExpr("id AS o", "pop"), f.selectExpr("id AS d", "supply"), 3.0), "areas", "facilities", sql=f"""
WITH n AS (SELECT a.id AS o, f.supply, b.pop, greatest(0, 1 - {D('a', 'f')} / 3) AS w FROM {{areas}} a, {{facilities}} f JOIN {{areas}} b ON b.id = f.id) SELECT o, {R('ln((sum(w * supply) + 1e-6) / (sum(w * pop) + 1e-6))')} AS mismatch FROM n GROUP BY o""")
query("travel_gini", lambda p: S.travel_gini(p.selectExpr("s AS score", "price AS pop")), P, sql=f"WITH t AS (SELECT s AS x, sum(price) AS p FROM {{plots}} GROUP BY s) SELECT {R(gini('t'))} AS gini")
query("transport_mismatch", lambda p: S.transport_mismatch(p.selectExpr("u * 10 - 1 AS access", "s AS vulnerable")), P, sql=f"""
WITH a AS (SELECT greatest(u * 10 - 1, 0) AS a, s AS v FROM {{plots}}), b AS (SELECT min(a) AS lo, max(a) AS hi FROM a) SELECT {R('sum(v * (100 - 100 * (a - lo) / (hi - lo))) / sum(v)')} AS mismatch FROM a, b""")
_h = lambda *c: "(" + " + ".join(f"CASE WHEN {x} > 0 THEN -({x} / ({' + '.join(c)})) * ln({x} / ({' + '.join(c)})) ELSE 0 END" for x in c) + f") / ln({len(c)})"
query("tod_index", lambda p: S.tod_index(p.withColumnsRenamed({"price": "density", "s": "connectivity"}), ["u", "v", "w"], weights=(2.0, 1.0, 1.0)), P, sql=f"""
WITH b AS (SELECT min(price) AS p0, max(price) AS p1, min(s) AS s0, max(s) AS s1 FROM {{plots}}) SELECT id, {R(f"greatest(0, least(100, 50 * (price - p0) / (p1 - p0) + 25 * CASE WHEN u + v + w > 0 THEN {_h('u', 'v', 'w')} ELSE 0 END + 25 * (s - s0) / (s1 - s0)))")} AS "index" FROM {{plots}}, b""")
_c = lambda x: f"greatest(least({x}, 1), 1e-12)"
NODES = f"n AS (SELECT id, {_h(_c('u'), _c('v'), _c('w'))} AS h, price, q * 900 AS t FROM {{plots}}), s AS (SELECT id, h, 0.4 * h + 0.3 * price / ((SELECT max(price) FROM n) + 1e-6) + 0.3 * exp(-t / 400) AS score FROM n)"
nodes = lambda p: p.selectExpr("id", "u", "v", "w", "price AS far", "q * 900 AS transit")
query("node_diversity", lambda p: S.node_diversity(nodes(p), ["u", "v", "w"])[0], P, sql=f"WITH {NODES} SELECT id, {R('h')} AS entropy, {R('score')} AS score FROM s")
query("node_readiness", lambda p: S.node_diversity(nodes(p), ["u", "v", "w"])[1], P, sql=f"WITH {NODES} SELECT {R('avg(score)')} AS mean, count(*) FILTER (score > 0.7) AS ready FROM s")
