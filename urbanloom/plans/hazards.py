"""Queries of hazards, climate and form."""

from __future__ import annotations

from pyspark.sql import functions as F

from urbanloom.operators import hazards as H
from urbanloom.plans.registry import query
from urbanloom.plans.services import D, P, at, places, plain_gini

R = lambda x: f"round({x}, 6) + 0.0"


def cdf(z: str) -> str:
    """The normal distribution function by its series of odd powers over odd factorials, all terms of one sign."""
    a = f"greatest(abs({z}), 1e-200)"
    return f"(0.5 + sign({z}) * exp(-pow({z}, 2) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln({a}) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1)))))"


unit = lambda c: f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())"

# water
_kinds = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(["roofs", "Pavement", "commercial", "residential", "lawns", "forest", "parks"]))
_runoff = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate([0.90, 0.85, 0.80, 0.50, 0.20, 0.10, 0.15]))
query("peak_runoff", lambda p: H.peak_runoff(p.selectExpr(f"CASE id % 8 {_kinds} ELSE 'other' END AS kind", "s AS share"), 12.0, 30.0), P, sql=f"""
WITH t AS (SELECT sum(s * CASE id % 8 {_runoff} ELSE 0.5 END) / sum(s) AS c FROM {{plots}}) SELECT {R('c')} AS coefficient, {R('0.00278 * c * 30 * 12')} AS peak, {R('0.00278 * c * 30 * 12 * 3600')} AS volume FROM t""")
_curve = ", ".join(f"({k}, {t}, {q})" for k, (t, q) in enumerate(H.HYDROGRAPH))
query("unit_hydrograph", lambda a: H.unit_hydrograph(a.selectExpr("id", "1D + id AS area_km2", "60D + id AS cn", "20D + 5 * id AS rain_mm", "1D + id / 10 AS concentration_h"), 15.0), "areas", sql=f"""
WITH b AS (SELECT id, 1.0::DOUBLE + id AS area, 25400 / (60.0::DOUBLE + id) - 254 AS s, 20.0::DOUBLE + 5 * id AS rain, 15 / 120 + 0.6 * (1 + id / 10) AS tp FROM {{areas}}), r AS (SELECT *, CASE WHEN rain > 0.2 * s THEN pow(rain - 0.2 * s, 2) / (rain + 0.8 * s) ELSE 0 END AS q FROM b), k AS (SELECT *, unnest(range(0, CAST(floor(tp * 300 / 15 + 0.5) AS BIGINT) + 1)) * 15.0 AS m FROM r),
h AS (SELECT * FROM (VALUES {_curve}) v(k, t, q)), g AS (SELECT a.t AS t0, b.t AS t1, a.q AS q0, b.q AS q1 FROM h a JOIN h b ON b.k = a.k + 1), f AS (SELECT id, m, max(coalesce(q0 + (m / 60 / tp - t0) * (q1 - q0) / (t1 - t0), 0)) AS u FROM k LEFT JOIN g ON m / 60 / tp >= t0 AND m / 60 / tp <= t1 GROUP BY id, m)
SELECT id, {R('m')} AS minute, {R('u * 0.208 * area * q / tp')} AS discharge, {R('0.208 * area * q / tp')} AS peak, {R('tp')} AS to_peak_h, {R('q')} AS runoff_mm, {R('q * area * 1000')} AS volume FROM k JOIN f USING (id, m)""")
FLASH = "s AS (SELECT id, 25400 / least(40 + s * 1.5, 100) - 254 AS s FROM {plots}), f AS (SELECT id, CASE WHEN 60 > 0.2 * s THEN pow(60 - 0.2 * s, 2) / (60 + 0.8 * s + 1e-12) ELSE 0 END AS q FROM s), p AS (SELECT id, q, greatest(q - 25, 0) AS p FROM f)"
flood = lambda p: H.flash_flood(p.selectExpr("id", "40 + s * 1.5D AS cn"), 60.0)
query("flash_flood", lambda p: flood(p)[0], P, sql=f"WITH {FLASH} SELECT id, {R('q')} AS runoff, {R('p')} AS ponding FROM p")
query("flash_flood_summary", lambda p: flood(p)[1], P, sql=f"WITH {FLASH} SELECT {R('max(p)')} AS max_ponding, {R('avg(p)')} AS mean_ponding, {R('avg((p > 10)::INT)')} AS inundated, CASE WHEN avg((p > 10)::INT) > 0.3 THEN 'High' ELSE 'Moderate' END AS hazard FROM p")
shore = lambda p: p.where("id % 100 = 5").selectExpr("id", "q * 100 AS x", "v * 10000 AS y")
refuges = lambda p: places(p, 10000, "price / 2 AS capacity").where("id % 200 = 9")
tsunami = lambda p: H.tsunami_shelter(places(p, 10000, "s AS pop"), shore(p), refuges(p))
TSUNAMI = f"""p AS ({at(10000, 's AS pop')}), c AS (SELECT q * 100 AS x, v * 10000 AS y FROM {{plots}} WHERE id % 100 = 5), f AS ({at(10000, 'price / 2 AS capacity')} WHERE id % 200 = 9), s AS (SELECT p.id, 10 * exp(-min({D('p', 'c')}) / 1000) AS depth FROM p, c GROUP BY p.id),
n AS (SELECT p.id, max(pop) AS pop, arg_min(f.id, ({D('p', 'f')}, f.id)) AS refuge FROM p, f GROUP BY p.id), l AS (SELECT f.id AS refuge, capacity, (SELECT coalesce(sum(pop), 0) FROM n WHERE n.refuge = f.id) AS a FROM f)"""
query("tsunami_people", lambda p: tsunami(p)[0], P, sql=f"WITH {TSUNAMI} SELECT id, refuge, {R('depth')} AS depth FROM n JOIN s USING (id)")
query("tsunami_refuges", lambda p: tsunami(p)[1], P, sql=f"WITH {TSUNAMI} SELECT refuge, {R('a')} AS assigned, {R('greatest(a - capacity, 0)')} AS deficit FROM l")
query("tsunami_summary", lambda p: tsunami(p)[2], P, sql=f"WITH {TSUNAMI}, t AS (SELECT (SELECT sum(pop) FROM p) AS p, (SELECT sum(greatest(a - capacity, 0)) FROM l) AS d) SELECT {R('p - d')} AS saved, {R('(p - d) / greatest(p, 1)')} AS rate FROM t")
query("slope_failures", lambda p: H.slope_failures(p.selectExpr("u * 60 AS slope", "v * 20 AS cohesion", "20 + w * 20 AS friction", "q * 0.3D AS pga")), P, sql=f"""
WITH f AS (SELECT radians(greatest(least(u * 60, 89), 0.1)) AS a, v * 20 AS c, tan(radians(20 + w * 20)) AS t, q * 0.3 AS k FROM {{plots}}), s AS (SELECT (c + 60 * pow(cos(a), 2) * t) / (60 * sin(a) * cos(a) + k * 60 * pow(cos(a), 2) + 1e-12) AS fs FROM f) SELECT count(*) FILTER (fs < 1) AS unstable, {R('avg((fs < 1)::INT)')} AS share, {R('avg(fs)')} AS mean FROM s""")

# heat
query("canopy_priority", lambda e: H.canopy_priority(e.selectExpr("edge", "capacity AS flow", "shade AS canopy", "lst AS heat"), 25), "block_edges", sql=f"WITH p AS (SELECT edge, capacity * {unit('lst')} * (1 - shade) AS p FROM {{block_edges}}) SELECT edge, {R('p')} AS priority FROM p ORDER BY p DESC, edge DESC LIMIT 25")
trees = lambda p: p.where("id % 5 = 0").selectExpr("id", "w * 1000 AS x", "q * 1000 AS y", "1 + s / 10 AS radius", "u * 5 AS lai")
query("tree_cooling", lambda p: H.tree_cooling(places(p, 1000), trees(p)), P, sql=f"""
WITH p AS ({at(1000)}), t AS (SELECT w * 1000 AS x, q * 1000 AS y, 1 + s / 10 AS radius, u * 5 AS lai FROM {{plots}} WHERE id % 5 = 0), n AS (SELECT p.id, max(0.6 * lai * CASE WHEN {D('p', 't')} <= radius THEN 1 WHEN {D('p', 't')} - radius <= 50 THEN exp(-3 * ({D('p', 't')} - radius) / 50) ELSE 0 END) AS c FROM p, t GROUP BY p.id) SELECT id, {R('c')} AS cooling FROM n""")
query("heat_vulnerability", lambda p: H.heat_vulnerability(p.selectExpr("id", "price AS uhi", "s AS sensitivity", "u AS canopy")), P, sql=f"""
WITH r AS (SELECT id, 0.4 * {unit('price')} + 0.4 * {unit('s')} - 0.2 * {unit('u')} AS r FROM {{plots}}), s AS (SELECT id, 100 * {unit('r')} AS s FROM r) SELECT id, {R('s')} AS score, CASE WHEN s >= 75 THEN 'Very High' WHEN s >= 50 THEN 'High' WHEN s >= 25 THEN 'Moderate' ELSE 'Low' END AS class FROM s""")
STEPS_ = 4
sites = lambda p: places(p, 1000, "price AS lst", "s AS aqi", "w AS people", "q / 2 AS canopy")
_green = [f"g0 AS (SELECT id, u * 1000 AS x, v * 1000 AS y, (0.4 * {unit('price')} + 0.3 * {unit('s')} + 0.3 * {unit('w')}) * (1 - q / 2) AS p FROM {{plots}})"]
for _k in range(STEPS_):
    _d2 = "pow(g.x - t.x, 2) + pow(g.y - t.y, 2)"
    _e = f"CASE WHEN {_d2} <= 10000 THEN exp(-({_d2}) / (2 * pow(100.0 / 3, 2))) ELSE 0 END"
    _green.append(f"t{_k} AS MATERIALIZED (SELECT * FROM g{_k} ORDER BY p DESC, id LIMIT 1), g{_k + 1} AS MATERIALIZED (SELECT g.id, g.x, g.y, CASE WHEN g.id = t.id THEN 0 ELSE greatest(g.p - 0.2 * {_e}, 0) END AS p FROM g{_k} g, t{_k} t)")
query("greening_plan", lambda p: H.greening_plan(sites(p), STEPS_)[0], P, sql=f"WITH {', '.join(_green)} " + " UNION ALL ".join(f"SELECT {k + 1} AS step, id, {R('p')} AS priority FROM t{k}" for k in range(STEPS_)))
query("ember_density", lambda p: H.ember_density(places(p, 1000), p.where("id % 25 = 4").selectExpr("id", "w * 1000 AS x", "q * 1000 AS y"), 20.0), P, sql=f"""
WITH k AS (SELECT 0.05 * pow(20, 1.2) * pow(15, 0.8) * 10 AS far), p AS ({at(1000)}), f AS (SELECT w * 1000 AS x, q * 1000 AS y FROM {{plots}} WHERE id % 25 = 4) SELECT p.id, {R(f"sum(CASE WHEN {D('p', 'f')} <= far THEN exp(-3 * {D('p', 'f')} / far) ELSE 0 END)")} AS density FROM p, f, k GROUP BY p.id""")
query("park_cooling", lambda p: H.park_cooling(places(p, 5000), p.where("id % 40 = 11").selectExpr("id", "w * 5000 AS x", "q * 5000 AS y", "s AS ha")), P, sql=f"""
WITH p AS ({at(5000)}), k AS (SELECT w * 5000 AS x, q * 5000 AS y, s AS ha FROM {{plots}} WHERE id % 40 = 11) SELECT p.id, {R(f"max(CASE WHEN {D('p', 'k')} <= 500 THEN 1.2 * ln(ha + 1) * exp(-3 * {D('p', 'k')} / 500) ELSE 0 END)")} AS cooling FROM p, k GROUP BY p.id""")
query("daily_radiation", lambda p: H.daily_radiation(p.selectExpr("id", "u * 120 - 60 AS lat", "1 + id % 365 AS day")), P, sql=f"""
WITH a AS (SELECT id, radians(u * 120 - 60) AS la, radians(23.45 * sin(radians(360 / 365 * (id % 365 - 80)))) AS d, 1 + 0.033 * cos(radians(360 * (1 + id % 365) / 365)) AS dr FROM {{plots}}), w AS (SELECT *, acos(greatest(-1, least(1, -tan(la) * tan(d)))) AS ws FROM a)
SELECT id, {R('1367 * dr * 0.65')} AS peak, {R('24 * 60 / pi() * 1367 * dr * (ws * sin(la) * sin(d) + cos(la) * cos(d) * sin(ws)) * 0.65 / 3600000')} AS kwh, {R('degrees(d)')} AS declination, {R('degrees(2 * ws / 15)')} AS daylight FROM w""")

query("fire_front", lambda p: H.fire_front(p.where("id < 200").selectExpr("id", "u * 60 AS wind", "0.5D + w * 5 AS hours"), p.selectExpr("id % 200 AS id", "v * 45 AS slope")), P, sql=f"""
WITH s AS (SELECT id % 200 AS id, max(v * 45) AS s FROM {{plots}} GROUP BY 1), r AS (SELECT p.id, (0.5 + 6 * u) * (1 + 0.05 * tan(radians(s.s))) * (1 + 1.2 * u) AS r, 0.5 + w * 5 AS h FROM {{plots}} p JOIN s USING (id) WHERE p.id < 200)
SELECT id, {R('r')} AS rate, {R('r * 60 * h')} AS forward, {R('r * 24 * h')} AS flank, {R('r * 90 * h')} AS buffer, {R('r * 33 * h')} AS semi_major, {R('r * 24 * h')} AS semi_minor FROM r""")
query("mean_cap_rate", lambda p: H.mean_cap_rate(p.selectExpr("u / 10 AS yield")), P, sql=f"SELECT {R('avg(u) * 10')} AS mean_cap_rate_pct FROM {{plots}}")
blocks = lambda p: p.where("id % 4 = 0").selectExpr("id", "3 + s AS height", "array(struct(u * 400 AS x, v * 400 AS y), struct(u * 400 + 4 + s / 5 AS x, v * 400 AS y), struct(u * 400 + 4 + s / 5 AS x, v * 400 + 6 + q * 10 AS y), struct(u * 400 AS x, v * 400 + 6 + q * 10 AS y)) AS coords")
# a cell is in the shade of a box if the box, moved along the beam, comes over it: the moves that do so for x and y overlap
SHADE = """k AS (SELECT 1 / tan(radians(35)) AS l, -sin(radians(140)) AS sx, -cos(radians(140)) AS sy), b AS (SELECT id, u * 400 AS x0, u * 400 + 4 + s / 5 AS x1, v * 400 AS y0, v * 400 + 6 + q * 10 AS y1, 3 + s AS h, (3 + s) * l * sx AS dx, (3 + s) * l * sy AS dy FROM {plots}, k WHERE id % 4 = 0),
e AS (SELECT min(least(x0, x0 + dx)) - 4 AS x, min(least(y0, y0 + dy)) - 4 AS y, max(greatest(x1, x1 + dx)) AS xx, max(greatest(y1, y1 + dy)) AS yy FROM b), g AS (SELECT c, r, x + (c + 0.5) * 4 AS px, y + (r + 0.5) * 4 AS py FROM e, (SELECT unnest(range(200)) AS c), (SELECT unnest(range(200)) AS r) WHERE x + c * 4 <= xx AND y + r * 4 <= yy),
m AS (SELECT id, c, r, px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1 AS own FROM b JOIN g ON px BETWEEN least(x0, x0 + dx) AND greatest(x1, x1 + dx) AND py BETWEEN least(y0, y0 + dy) AND greatest(y1, y1 + dy) WHERE greatest(0, least((px - x1) / dx, (px - x0) / dx), least((py - y1) / dy, (py - y0) / dy)) <= least(1, greatest((px - x1) / dx, (px - x0) / dx), greatest((py - y1) / dy, (py - y0) / dy))), n AS (SELECT c, r, count(*) AS n FROM m GROUP BY c, r)"""
query("shadow_access", lambda p: H.shadow_access(blocks(p), 35.0, 140.0, 4.0)[0], P, sql=f"WITH {SHADE}, a AS (SELECT id, 100 * avg((n < 2)::INT) AS a FROM m JOIN n USING (c, r) WHERE own GROUP BY id) SELECT id, {R('h * (SELECT l FROM k)')} AS shadow, {R('coalesce(a, 100)')} AS access FROM b LEFT JOIN a USING (id)")
query("shadow_area", lambda p: H.shadow_access(blocks(p), 35.0, 140.0, 4.0)[1], P, sql=f"WITH {SHADE} SELECT {R('(SELECT count(*) FROM n) * 16.0')} AS shadow_area, {R('sum((x1 - x0) * (y1 - y0))')} AS footprint_area FROM b")

# ground
built = lambda p: p.selectExpr("id", "price AS area", "1 + id % 9 AS floors", "1970 + id % 55 AS year")
_base = "CASE WHEN 1970 + id % 55 <= 1985 THEN 0.85 WHEN 1970 + id % 55 <= 2000 THEN 0.6 WHEN 1970 + id % 55 <= 2018 THEN 0.25 ELSE 0.05 END"
query("collapse_probability", lambda p: H.seismic_debris(built(p), 7.4).select("id", "p"), P, sql=f"SELECT id, {R(f'greatest(0, least(1, {_base} * exp(0.8 * 0.4)))')} AS p FROM {{plots}}")
query("seismic_debris", lambda p: H.seismic_debris(built(p), 7.4), P)
query("simulate_collapse", lambda p: H.simulate_collapse(p.selectExpr("id", "u AS p")), P)
_pick = lambda n: "CASE id % 5 " + " ".join(f"WHEN {i} THEN {H.FRAGILITY[k][n]}" for i, k in enumerate(["RC", "Masonry", "Timber", "Steel"])) + f" ELSE {H.FRAGILITY[''][n]} END"
houses = lambda p: p.selectExpr("id", "CASE id % 5 WHEN 0 THEN 'RC' WHEN 1 THEN 'Masonry' WHEN 2 THEN 'Timber' WHEN 3 THEN 'Steel' ELSE 'Adobe' END AS kind", "1 + id % 9 AS storeys", "s AS people")
COLLAPSE = f"z AS (SELECT id, s AS people, (ln(0.4 * (1 + 0.05 * (id % 9))) - ln({_pick(0)})) / ({_pick(1)}) AS z FROM {{plots}}), p AS (SELECT id, people, {cdf('z')} AS p FROM z)"
query("collapse_casualties", lambda p: H.collapse_casualties(houses(p), 0.4)[0], P, sql=f"WITH {COLLAPSE} SELECT id, {R('p')} AS p FROM p")
query("collapse_summary", lambda p: H.collapse_casualties(houses(p), 0.4)[1], P, sql=f"WITH {COLLAPSE} SELECT count(*) FILTER (p >= 0.5) AS collapsed, {R('sum(p * people * 0.15)')} AS fatalities, {R('sum(p * people * 0.35)')} AS injuries FROM p")
_medians, _spread = H.DAMAGE["rm1"]
query("damage_loss", lambda a, p: H.damage_loss(a.selectExpr("id / 20 AS pga"), p.selectExpr("s AS count", "price AS value"), "rm1"), "areas", P, sql=f"""
WITH x AS (SELECT id / 20 AS pga, greatest(id / 20, 1e-10) AS g FROM {{areas}}), e AS (SELECT pga, {', '.join(f"CASE WHEN pga > 0 THEN {cdf(f'((ln(g) - ln({m})) / {_spread})')} ELSE 0 END AS e{k}" for k, m in enumerate(_medians))} FROM x), t AS (SELECT sum(s) AS n, sum(s * price) AS v FROM {{plots}}), q AS (SELECT *, 0.02 * (e0 - e1) + 0.1 * (e1 - e2) + 0.5 * (e2 - e3) + e3 AS l FROM e)
SELECT {R('pga')} AS pga, {R('1 - e0')} AS p0, {R('e0 - e1')} AS p1, {R('e1 - e2')} AS p2, {R('e2 - e3')} AS p3, {R('e3')} AS p4, {R('l')} AS loss_ratio, {R('l * v')} AS loss, {R('e3 * n')} AS collapsed FROM q, t""")
query("blockage_summary", lambda p: H.blockage_summary(p.selectExpr("3 + s / 2 AS width", "5 + u * 40 AS height", "v AS collapse")), P, sql=f"""
WITH r AS (SELECT (5 + u * 40) * 0.5 / (3 + s / 2) AS r, v FROM {{plots}}), p AS (SELECT r, v * least(r, 1) AS p FROM r), t AS (SELECT CASE WHEN p >= 0.7 OR r >= 1 THEN 'b' WHEN p >= 0.3 THEN 'r' ELSE 'o' END AS s FROM p) SELECT count(*) FILTER (s = 'b') AS blocked, count(*) FILTER (s = 'r') AS restricted, count(*) FILTER (s = 'o') AS "open", {R("avg((s = 'b')::INT)")} AS blocked_share FROM t""")
query("liquefaction", lambda p: H.liquefaction(p.selectExpr("id % 100 AS id", "u * 25 AS depth", "s AS spt"), 0.3, 2.0), P, sql=f"""
WITH l AS (SELECT id % 100 AS id, sum(CASE WHEN u * 25 <= 20 AND u * 25 >= 2 THEN (10 - 12.5 * u) * greatest(1 - s / 30, 0) ELSE 0 END) AS l FROM {{plots}} GROUP BY 1) SELECT id, {R('l')} AS lpi, CASE WHEN l >= 15 THEN 'Very High' WHEN l >= 5 THEN 'High' WHEN l > 0 THEN 'Low' ELSE 'Very Low' END AS class FROM l""")

# together
_w = {"fire": 2.0, "flood": 1.0, "quake": 1.5}
_values = {"fire": "CASE WHEN id % 11 = 0 THEN NULL ELSE u * 100 END", "flood": "v * 100", "quake": "w * 100"}
COMPOSITE = "h AS (" + " UNION ALL ".join(f"SELECT id, '{n}' AS n, {k} AS k, {_w[n]} AS w, {_values[n]} AS v FROM {{plots}}" for k, n in enumerate(_w)) + "), p AS (SELECT id, n, k, w, v * w AS p FROM h WHERE v IS NOT NULL), s AS (SELECT *, sum(CASE WHEN p > 0 THEN p END) OVER (PARTITION BY id) AS t FROM p), g AS (SELECT id, sum(p) / sum(w) AS score, count(*) FILTER (p > 0) AS m, -sum(CASE WHEN p > 0 THEN p / t * ln(p / t) END) AS h, string_agg(n, ',' ORDER BY p DESC, k) FILTER (p > 0) AS drivers, arg_max(n, (p, -k)) FILTER (p > 0) AS top FROM s GROUP BY id)"
query("hazard_composite", lambda p: H.hazard_composite(p.selectExpr("id", *(f"{c} AS {n}" for n, c in _values.items())), _w), P, sql=f"""
WITH {COMPOSITE} SELECT id, {R('score')} AS score, CASE WHEN score >= 75 THEN 'Very High' WHEN score >= 55 THEN 'High' WHEN score >= 35 THEN 'Moderate' ELSE 'Low' END AS class, coalesce(top, '') AS dominant, {R('CASE WHEN m > 1 THEN 100 * h / ln(m) ELSE 0 END')} AS diversity, coalesce(drivers, '') AS drivers FROM g""")
_amplify = [[0.0, 0.2, 0.0], [0.1, 0.0, 0.3], [0.0, 0.15, 0.0]]
_limits = [0.5, 0.4, 0.6]
_rounds = ["c0 AS (SELECT id, u AS x0, v AS x1, w AS x2, q AS vul FROM {plots})"]
for _k in range(3):
    _gain = [" + ".join(f"CASE WHEN x{i} > {_limits[i]} THEN x{i} * {_amplify[i][j]} ELSE 0 END" for i in range(3) if _amplify[i][j]) or "0" for j in range(3)]
    _rounds.append(f"c{_k + 1} AS (SELECT id, {', '.join(f'x{j} + {_gain[j]} AS x{j}' for j in range(3))}, vul FROM c{_k})")
query("hazard_cascade", lambda p: H.hazard_cascade(p.selectExpr("id", "u AS a", "v AS b", "w AS c", "q"), ["a", "b", "c"], _limits, _amplify, "q", 3), P, sql=f"""
WITH {', '.join(_rounds)} SELECT id, {R('x0')} AS a, {R('x1')} AS b, {R('x2')} AS c, {R('x0 + x1 + x2')} AS total, {R('vul * (1 - exp(-(x0 + x1 + x2)))')} AS damage, CASE WHEN x0 >= x1 AND x0 >= x2 THEN 'a' WHEN x1 >= x2 THEN 'b' ELSE 'c' END AS peak FROM c3""")
query("energy_vulnerability_summary", lambda p: H.energy_vulnerability_summary(p.selectExpr("price AS income", "u * 100 AS efficiency", "v * 100 AS exposure", "w AS vulnerable")), P, sql=f"""
WITH e AS (SELECT 100 * ((1 - price / (SELECT max(price) FROM {{plots}})) * 0.35 + (1 - u) * 0.3 + v * 0.2 + w * 0.15) AS e FROM {{plots}}) SELECT count(*) FILTER (e >= 65) AS high, count(*) FILTER (e >= 40 AND e < 65) AS moderate, count(*) FILTER (e < 40) AS low, {R(plain_gini('e', 'e'))} AS gini FROM e""")

# form
_stop = "(w * h < 600 OR greatest(w / greatest(h, 1e-6), h / greatest(w, 1e-6)) > 3)"
_cut = ["l0 AS (SELECT id, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 10 + s * 2 AS w, 10 + u * 90 AS h FROM {plots})"]
for _k in range(4):
    _cut.append(f"l{_k + 1} AS (SELECT id, CASE WHEN w >= h AND k = 1 THEN x + w / 2 ELSE x END AS x, CASE WHEN w < h AND k = 1 THEN y + h / 2 ELSE y END AS y, CASE WHEN w >= h THEN w / 2 ELSE w END AS w, CASE WHEN w >= h THEN h ELSE h / 2 END AS h FROM l{_k}, (SELECT unnest([0, 1]) AS k) WHERE NOT {_stop})")
query("subdivide", lambda p: H.subdivide(p.selectExpr("id", "10 + s * 2 AS w", "10 + u * 90 AS h")), P, sql=f"WITH {', '.join(_cut)} " + " UNION ALL ".join(f"SELECT id, {R('x')} AS x, {R('y')} AS y, {R('w')} AS w, {R('h')} AS h FROM l{k}" + (f" WHERE {_stop}" if k < 4 else "") for k in range(5)))
query("block_grain", lambda p, a: H.block_grain(p.selectExpr("id % 30 AS block", "s * 10 AS area"), a.selectExpr("id + 2 AS block", "20000D + id AS area")), P, "areas", sql=f"""
WITH b AS (SELECT id % 30 AS block, sum(s * 10) AS s, avg(s * 10) AS m, count(*) AS n FROM {{plots}} GROUP BY 1) SELECT a.id + 2 AS block, {R('greatest(0, 1 - coalesce(s, 0) / (20000 + a.id))')} AS porosity, {R('coalesce(m, 0) / (20000 + a.id) * 100')} AS grain, coalesce(n, 0) AS buildings, {R('coalesce(m, 0)')} AS mean_area FROM {{areas}} a LEFT JOIN b ON block = a.id + 2""")
query("frontal_area", lambda p, a: H.frontal_area(p.selectExpr("id % 30 AS lot", "3 + s AS height", "5 + u * 20 AS width"), a.selectExpr("id + 2 AS lot", "90000D + id AS area"), 30.0), P, "areas", sql=f"""
WITH b AS (SELECT id % 30 AS lot, sum((3 + s) * (5 + u * 20) * (cos(radians(30)) + sin(radians(30)))) AS f, avg(3 + s) AS h FROM {{plots}} GROUP BY 1), l AS (SELECT a.id + 2 AS lot, coalesce(f, 0) / (90000 + a.id) AS l, coalesce(h, 0) AS h FROM {{areas}} a LEFT JOIN b ON lot = a.id + 2)
SELECT lot, {R('l')} AS lambda_f, {R('0.5 * h * l')} AS z0, {R('0.7 * h * pow(l, 0.6)')} AS d0, {R('h')} AS mean_height FROM l""")
links = lambda e: e.selectExpr("edge AS link", "capacity", "cost AS free")
_t = "free * (1 + 0.15 * pow(flow / capacity, 4))"
_flow = ["f0 AS (SELECT edge, capacity, cost AS free, 20000.0 / count(*) OVER () AS flow, count(*) OVER () AS n FROM {block_edges})"]
for _k in range(3):
    _flow.append(f"m{_k} AS MATERIALIZED (SELECT quantile_cont({_t}, 0.5) AS m FROM f{_k}), f{_k + 1} AS MATERIALIZED (SELECT edge, capacity, free, (1 - 2.0 / {_k + 3}) * flow + 2.0 / {_k + 3} * CASE WHEN {_t} <= m THEN 2 * 20000.0 / n ELSE 0 END AS flow, n FROM f{_k}, m{_k})")
query("link_equilibrium", lambda e: H.link_equilibrium(links(e), 20000.0, rounds=3)[0], "block_edges", sql=f"WITH {', '.join(_flow)} SELECT edge AS link, {R('flow')} AS flow, {R(_t)} AS time FROM f3")
query("link_equilibrium_summary", lambda e: H.link_equilibrium(links(e), 20000.0, rounds=3)[1], "block_edges", sql=f"WITH {', '.join(_flow)} SELECT {R(f'sum(flow * {_t})')} AS total_time, {R('max(flow / capacity)')} AS max_vc, {R('avg(flow / capacity)')} AS mean_vc FROM f3")
rates = lambda a: a.where("id < 12").selectExpr("id AS age", "0.99D - id / 100 AS survival", "IF(id BETWEEN 3 AND 7, 0.3D, 0D) AS fertility")
LESLIE = "g AS (SELECT id AS age, 0.99 - id / 100 AS s, CASE WHEN id BETWEEN 3 AND 7 THEN 0.3 ELSE 0 END AS f, max(id) OVER () AS k FROM {areas} WHERE id < 12), m AS (SELECT i, j, sum(v) AS v FROM (SELECT 0 AS i, age AS j, f AS v FROM g UNION ALL SELECT least(age + 1, k), age, s FROM g) GROUP BY ALL HAVING sum(v) <> 0)"
query("leslie", lambda a: H.leslie(rates(a)), "areas", sql=f"WITH {LESLIE} SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, {R('v')} AS value FROM m")
_pop = ["c0 AS (SELECT p.id % 40 AS region, age, sum(CASE WHEN p.id % 12 = age THEN p.s ELSE 0 END)::DOUBLE AS pop FROM {plots} p, g GROUP BY ALL)"]
for _k in range(2):
    _pop.append(f"c{_k + 1} AS (SELECT region, c.age, greatest(0, coalesce((SELECT sum(v * o.pop) FROM m JOIN c{_k} o ON o.age = j WHERE o.region = c.region AND i = c.age), 0) + CASE WHEN c.age = 2 THEN region - 20 ELSE 0 END) AS pop FROM c{_k} c)")


def aged(p, a):
    ages = rates(a).select("age")
    people = p.crossJoin(F.broadcast(ages)).groupBy((F.col("id") % 40).alias("region"), "age").agg(F.sum(F.when(F.col("id") % 12 == F.col("age"), F.col("s")).otherwise(F.lit(0.0))).alias("pop"))
    return H.cohorts(people, rates(a), 2, p.selectExpr("id % 40 AS region").distinct().selectExpr("region", "2 AS age", "region - 20D AS n"))


query("cohorts", aged, P, "areas", sql=f"WITH {LESLIE}, {', '.join(_pop)} " + " UNION ALL ".join(f"SELECT region, {k} AS step, CAST(age AS INT) AS age, {R('pop')} AS pop FROM c{k}" for k in range(3)))
TRIPS = f"z AS (SELECT id, x, y, pop AS p, 10 + id AS a0 FROM {{areas}}), y AS (SELECT *, a0 * (SELECT sum(p) FROM z) / (SELECT sum(a0) FROM z) AS a FROM z), t AS MATERIALIZED (SELECT o.id AS o, d.id AS d, exp(-0.3 * {D('o', 'd')}) * o.p * d.a AS t FROM y o, y d), s0 AS (SELECT id AS d, 1.0::DOUBLE AS s FROM y)"
_balance = ", ".join(f"r{k} AS MATERIALIZED (SELECT o, any_value(p) / sum(t * s) AS r FROM t JOIN s{k} USING (d) JOIN y ON y.id = o GROUP BY o), s{k + 1} AS MATERIALIZED (SELECT d, any_value(a) / sum(t * r) AS s FROM t JOIN r{k} USING (o) JOIN y ON y.id = d GROUP BY d)" for k in range(6))
pairs = lambda a: a.selectExpr("id AS o", "x AS ox", "y AS oy").crossJoin(a.selectExpr("id AS d", "x AS dx", "y AS dy")).selectExpr("o", "d", "sqrt((ox - dx) * (ox - dx) + (oy - dy) * (oy - dy)) AS cost")
query("balanced_trips", lambda a: H.balanced_trips(pairs(a), a.selectExpr("id AS zone", "pop AS p", "10D + id AS a"), 0.3, rounds=6, tol=0.0)[0], "areas", sql=f"WITH {TRIPS}, {_balance} SELECT o, d, {R('t * r * s')} AS trips FROM t JOIN r5 USING (o) JOIN s6 USING (d)")
query("route_rank", lambda p: H.route_rank(p.selectExpr("id", "s * u AS score"), "score"), P, sql=f"SELECT id, {R('s * u')} AS score, CAST(row_number() OVER (ORDER BY s * u DESC, id) AS INT) AS rank FROM {{plots}}")
