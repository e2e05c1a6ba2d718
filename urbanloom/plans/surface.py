"""Queries of surfaces: what spreads over cells is relaxed in the oracles as often as the longest way needs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from urbanloom.operators import raster
from urbanloom.operators import surface as S
from urbanloom.plans.registry import query
from urbanloom.plans.structure import FLOW, GRAD, N9, TO

R = lambda x: f"round({x}, 6) + 0.0"
C, P = "cells", "plots"
grid = lambda c: c.where("r >= 0")
G = "g AS MATERIALIZED (SELECT r, c, z, a, b FROM {cells} WHERE r >= 0), e AS (SELECT min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM g), b_ AS (SELECT g.*, r IN (r0, r1) OR c IN (c0, c1) AS edge FROM g, e)"
NEAR = "nb AS MATERIALIZED (SELECT g.*, n.r AS nr, n.c AS nc, n.a AS na, n.b AS nb, CASE WHEN g.r <> n.r AND g.c <> n.c THEN sqrt(2) ELSE 1 END AS len FROM g JOIN g n ON n.r BETWEEN g.r - 1 AND g.r + 1 AND n.c BETWEEN g.c - 1 AND g.c + 1 AND (n.r <> g.r OR n.c <> g.c))"


def relaxed(start: str, move: str, where: str = "true", best: str = "min", steps: int = 64, side: str = "true") -> str:
    """CTEs that end in ``s`` (r, c, v): from a select of starts, ``move`` of s.v over neighbours ``nb``, the best kept."""
    out = [f"s0 AS ({start})"]
    for k in range(steps):
        out.append(f"s{k + 1} AS MATERIALIZED (SELECT r, c, {best}(v) AS v FROM (SELECT r, c, v FROM s{k} UNION ALL SELECT nb.r, nb.c, {move} FROM nb JOIN s{k} s ON s.r = nr AND s.c = nc WHERE ({where}) AND ({side})) GROUP BY r, c)")
    return ", ".join([*out, f"s AS (SELECT * FROM s{steps})"])


# water
query("fill_depressions", lambda c: S.fill_depressions(grid(c)), C, sql=f"WITH {G}, {NEAR}, {relaxed('SELECT r, c, z AS v FROM b_ WHERE edge', 'greatest(s.v, nb.z)', steps=90)} SELECT r, c, {R('v')} AS z FROM s")
_jump = ", ".join(f"x{k + 1} AS MATERIALIZED (SELECT a.k, b.t FROM x{k} a JOIN x{k} b ON b.k = a.t)" for k in range(9))
query("hand", lambda c: S.hand(c, raster.d8_flow(c), c.where("a > 40")), C, sql=f"""
{FLOW}, q AS (SELECT f.r * 1000 + f.c AS k, CASE WHEN w.a > 40 THEN NULL ELSE {TO.replace('(r +', '(f.r +').replace('+ c +', '+ f.c +')} END AS t, w.z FROM f JOIN {{cells}} w ON w.r = f.r AND w.c = f.c), x0 AS MATERIALIZED (SELECT q.k, coalesce(o.k, q.k) AS t FROM q LEFT JOIN q o ON o.k = q.t), {_jump}
SELECT CAST(w.r AS BIGINT) AS r, CAST(w.c AS BIGINT) AS c, {R('w.z - q.z')} AS hand FROM x9 JOIN {{cells}} w ON w.r * 1000 + w.c = x9.k JOIN q ON q.k = x9.t""")
query("inundation", lambda c: S.inundation(c.selectExpr("r", "c", "z - 1300 AS hand"), 150.0), C, sql=f"SELECT r, c, {R('z - 1300')} AS hand, CASE WHEN z - 1300 >= 0 AND z - 1300 <= 150 THEN 1.0::DOUBLE ELSE 0.0 END AS wet FROM {{cells}}")
_at = "CAST(trunc((v * 50 - 50) / -1) AS INT) AS r, CAST(trunc(u * 40) AS INT) AS c"
query("flood_exposure", lambda c, p: S.flood_exposure(c.selectExpr("r", "c", "IF(a > 30, 1D, 0D) AS wet"), p.selectExpr("u * 40 AS x", "v * 50 AS y"), p.selectExpr("u * 40 AS x", "v * 50 AS y", "s AS pop"), (0.0, 50.0), (1.0, -1.0)), C, P, sql=f"""
WITH p AS (SELECT s, {_at} FROM {{plots}}), t AS (SELECT count(w.r)::DOUBLE AS n, count(*)::DOUBLE AS m, coalesce(sum(s) FILTER (w.r IS NOT NULL), 0) AS k, sum(s) AS q FROM p LEFT JOIN (SELECT r, c FROM {{cells}} WHERE a > 30) w USING (r, c)) SELECT n AS exposed_buildings, m AS total_buildings, k AS exposed_people, q AS total_people, {R('100 * n / m')} AS pct_buildings, {R('100 * k / q')} AS pct_people FROM t""")
low = lambda c: grid(c).withColumn("z", F.col("z") - 1100)
query("bathtub", lambda c: S.bathtub(low(c), 150.0), C, sql=f"""
WITH {G}, {NEAR}, {relaxed('SELECT r, c, 1 AS v FROM b_ WHERE edge AND z - 1100 <= 0', 's.v', 'nb.z - 1100 <= 150', steps=90)} SELECT g.r, g.c, s.v IS NOT NULL AS flooded, {R('CASE WHEN s.v IS NOT NULL THEN 150 - (z - 1100) ELSE 0 END')} AS depth FROM g LEFT JOIN s USING (r, c)""")
sea = lambda c: grid(c).selectExpr("r", "c", "(z - 900) / 100 AS z", "c = 0 AS sea", "c = 0 AS coast", "b * 20 AS n")
query("surge", lambda c: S.surge(sea(c), 8.0, "sea", 1000.0, 1.0, 0.5), C, sql=f"""
WITH {G}, {NEAR}, {relaxed('SELECT r, c, 0.0::DOUBLE AS v FROM g WHERE c = 0', 's.v + len', '(nb.z - 900) / 100 <= greatest(0, 9 - (s.v + len) * 0.5)', steps=40)}
SELECT g.r, g.c, v IS NOT NULL AS flooded, {R('CASE WHEN v IS NULL THEN 0 WHEN g.c = 0 THEN greatest(9 - (z - 900) / 100, 0) ELSE greatest(9 - v * 0.5, 0) - (z - 900) / 100 END')} AS depth FROM g LEFT JOIN s USING (r, c)""")
STORM = f"{G}, {NEAR}, {relaxed('SELECT r, c, 9.0::DOUBLE AS v FROM g WHERE c = 0 AND (z - 900) / 100 < 9', 's.v - nb.b * 20 * 0.01 * 10 * CASE WHEN len > 1 THEN 1.41421356 ELSE 1 END', 's.v - nb.b * 2 * CASE WHEN len > 1 THEN 1.41421356 ELSE 1 END > (nb.z - 900) / 100', 'max', 64)}, d AS (SELECT g.r, g.c, coalesce(v - (z - 900) / 100, 0) AS depth FROM g LEFT JOIN s USING (r, c))"
query("storm_surge", lambda c: S.storm_surge(sea(c), "coast", 9.0, 10.0, "n")[0], C, sql=f"WITH {STORM} SELECT r, c, {R('depth')} AS depth FROM d")
query("storm_surge_summary", lambda c: S.storm_surge(sea(c), "coast", 9.0, 10.0, "n")[1], C, sql=f"""
WITH {STORM} SELECT {R('count(*) FILTER (depth > 0) * 100.0')} AS area, {R('max(depth)')} AS max_depth, {R('avg(depth) FILTER (depth > 0)')} AS mean_depth, {R('sum(depth) * 100')} AS volume, count(*) FILTER (depth > 0 AND depth < 0.5) AS low, count(*) FILTER (depth >= 0.5 AND depth <= 1.5) AS medium, count(*) FILTER (depth > 1.5) AS high FROM d""")
_risk = "CASE WHEN score >= 75 THEN 'Very High' WHEN score >= 55 THEN 'High' WHEN score >= 35 THEN 'Moderate' ELSE 'Low' END AS class"
_clip = lambda x: f"greatest(0, least(100, {x}))"
query("pluvial_susceptibility", lambda c: S.pluvial_susceptibility(grid(c).selectExpr("r", "c", "z / 20 AS z", "a * 10 AS d"), 10.0, 30.0, "d"), C, sql=f"""
WITH {G}, n AS (SELECT g.r, g.c, any_value(g.z) AS z, any_value(g.a) AS a, (max(n.z) - min(n.z)) / 20 AS relief FROM g JOIN g n ON n.r BETWEEN g.r - 3 AND g.r + 3 AND n.c BETWEEN g.c - 3 AND g.c + 3 GROUP BY g.r, g.c), b AS (SELECT min(z) AS lo, max(z) AS hi FROM g),
s AS (SELECT r, c, {_clip(f"{_clip('(1 - (z - lo) / (hi - lo)) * 100')} * 0.45 + {_clip('100 - relief / 30 * 100')} * 0.3 + {_clip('100 - a * 10 / 120 * 100')} * 0.25")} AS score FROM n, b) SELECT r, c, {R('score')} AS score, {_risk} FROM s""")

# fire
query("wildfire_risk", lambda c: S.wildfire_risk(c, 10.0, "b"), C, sql=f"""
{N9}, {GRAD}, a AS (SELECT g.r, g.c, b, degrees(atan(sqrt(dx * dx + dy * dy))) AS s, CASE WHEN dx = 0 AND dy = 0 THEN -1 ELSE fmod(degrees(atan2(-dx, dy)) + 360, 360) END AS t FROM g JOIN {{cells}} USING (r, c)), k AS (SELECT r, c, {_clip('s / 30 * 100')} * 0.35 + CASE WHEN s < 1 OR t < 0 THEN 0 ELSE (1 - cos(radians(t))) * 50 END * 0.2 + {_clip('b * 100')} * 0.45 AS score FROM a) SELECT r, c, {R('score')} AS score, {_risk} FROM k""")
query("fire_arrival", lambda c: S.fire_arrival(grid(c).selectExpr("r", "c", "a AS slope", "b AS fuel"), (20, 20), (3.0, 4.0)), C, sql=f"""
WITH {G}, {NEAR}, {relaxed('SELECT r, c, 0.0::DOUBLE AS v FROM g WHERE r = 20 AND c = 20', 's.v + len * 30 / greatest(0.1, 2 * (0.5 + nb.nb) * (1 + 0.05 * 5 + 0.02 * tan(radians(na)))) / 60', 'nb.nb > 0', steps=80)} SELECT g.r, g.c, {R('v')} AS hours FROM g LEFT JOIN s USING (r, c)""")
query("fire_buffers", lambda c: S.fire_buffers(c.selectExpr("r", "c", "IF(b > 0.2, a / 4, NULL) AS hours")), C, sql=f"""
SELECT k AS step, count(*) FILTER (b > 0.2 AND a / 4 <= k) AS burned, {R('sqrt(count(*) FILTER (b > 0.2 AND a / 4 <= k) * 900 / pi()) + 100')} AS buffer FROM {{cells}}, (SELECT CAST(unnest(range(1, 11)) AS INT) AS k) GROUP BY k""")

# sun and sky
query("sun_position", lambda p: p.selectExpr("id", "CAST(2000 + id % 30 AS INT) AS y", "CAST(1 + id % 12 AS INT) AS m", "CAST(1 + id % 28 AS INT) AS d", "u * 24 AS h", "v * 120 - 60 AS lat", "w * 360 - 180 AS lon").select("id", S.sun_position(F.col("y"), F.col("m"), F.col("d"), F.col("h"), F.col("lat"), F.col("lon")).alias("s")).select("id", "s.altitude", "s.azimuth"), P, sql=f"""
WITH i AS (SELECT id, u * 24 AS h, radians(v * 120 - 60) AS la, w * 360 - 180 AS lon, make_date(CAST(2000 + id % 30 AS BIGINT), CAST(1 + id % 12 AS BIGINT), CAST(1 + id % 28 AS BIGINT)) AS day FROM {{plots}}), t AS (SELECT *, (datediff('day', DATE '2000-01-01', day) - 0.5 + h / 24) / 36525 AS t FROM i),
l AS (SELECT *, fmod(fmod(280.46646 + t * (36000.76983 + 0.0003032 * t), 360) + 360, 360) AS l, radians(357.52911 + t * (35999.05029 - 0.0001537 * t)) AS m, 0.016708634 - t * (0.000042037 + 0.0000001267 * t) AS e, radians(125.04 - 1934.136 * t) AS om FROM t),
o AS (SELECT *, sin(m) * (1.914602 - t * (0.004817 + 0.000014 * t)) + sin(2 * m) * (0.019993 - 0.000101 * t) + sin(3 * m) * 0.000289 AS ce, radians(23 + (26 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60) / 60 + 0.00256 * cos(om)) AS ob FROM l),
d AS (SELECT *, asin(sin(ob) * sin(radians(l + ce - 0.00569 - 0.00478 * sin(om)))) AS de, pow(tan(ob / 2), 2) AS y FROM o),
q AS (SELECT *, 4 * degrees(y * sin(2 * radians(l)) - 2 * e * sin(m) + 4 * e * y * sin(m) * cos(2 * radians(l)) - 0.5 * y * y * sin(4 * radians(l)) - 1.25 * e * e * sin(2 * m)) AS eq FROM d), a AS (SELECT *, fmod(fmod(h * 60 + eq + 4 * lon, 1440) + 1440, 1440) / 4 - 180 AS ha FROM q),
z AS (SELECT *, greatest(-1, least(1, sin(la) * sin(de) + cos(la) * cos(de) * cos(radians(ha)))) AS cz FROM a), f AS (SELECT *, degrees(acos(greatest(-1, least(1, (sin(la) * cz - sin(de)) / (cos(la) * sin(acos(cz))))))) AS az FROM z)
SELECT id, {R('90 - degrees(acos(cz))')} AS altitude, {R('CASE WHEN ha > 0 THEN fmod(az + 180, 360) ELSE fmod(540 - az, 360) END')} AS azimuth FROM f""")
hills = lambda c: grid(c).selectExpr("r", "c", "z / 100 AS z")


def offsets(azimuth: float, steps: int, back: bool = False) -> str:
    """VALUES (row, column, cells away) of a ray; ``back`` counts columns against it."""
    at = {(-round(i * math.cos(azimuth)), (-1 if back else 1) * round(i * math.sin(azimuth))) for i in range(1, steps + 1)} - {(0, 0)}
    return ", ".join(f"({i}, {j}, {math.hypot(i, j)})" for i, j in sorted(at))


query("shadow_mask", lambda c: S.shadow_mask(hills(c), 20.0, 220.0, 10.0, 60.0), C, sql=f"""
WITH {G}, o AS (SELECT * FROM (VALUES {offsets(math.radians(220), 6)}) v(i, j, d)) SELECT g.r, g.c, coalesce(max(n.z / 100 - d * 10 * tan(radians(20)) > g.z / 100 + 0.01), false) AS shadow FROM g, o LEFT JOIN g n ON n.r = g.r + i AND n.c = g.c + j GROUP BY g.r, g.c""".replace("FROM g, o LEFT JOIN g n", "FROM g CROSS JOIN o LEFT JOIN g n"))
_eight = ", ".join(f"({k}, {row})" for k in range(8) for row in (x.strip("() ") for x in offsets(2 * math.pi * k / 8, 4).split("), (")))
query("sky_view_factor", lambda c: S.sky_view_factor(hills(c), 10.0, 8, 40.0), C, sql=f"""
WITH {G}, o AS (SELECT * FROM (VALUES {_eight}) v(k, i, j, d)), h AS (SELECT g.r, g.c, k, greatest(0, coalesce(max((n.z - g.z) / 100 / (d * 10)), 0)) AS t FROM g CROSS JOIN o LEFT JOIN g n ON n.r = g.r + i AND n.c = g.c + j GROUP BY g.r, g.c, k) SELECT r, c, {R('1 - sum(t * t / (1 + t * t)) / 8')} AS svf FROM h GROUP BY r, c""")
_back = ", ".join(f"({k}, {row})" for k in range(8) for row in (x.strip("() ") for x in offsets(2 * math.pi * k / 8, 5, True).split("), (")))
query("grid_sky_view", lambda c: S.grid_sky_view(hills(c), 2.0, 10.0, 8), C, sql=f"""
WITH {G}, o AS (SELECT * FROM (VALUES {_back}) v(k, i, j, d)), h AS (SELECT g.r, g.c, k, max(greatest(0, coalesce(n.z, 0) / 100 - g.z / 100) / (d * 2)) AS t FROM g CROSS JOIN o LEFT JOIN g n ON n.r = g.r + i AND n.c = g.c + j GROUP BY g.r, g.c, k) SELECT r, c, {R('sum(1 / (1 + t * t)) / 8')} AS svf FROM h GROUP BY r, c""")
_suns = [(15.0, 100.0), (40.0, 180.0), (10.0, 260.0), (-5.0, 300.0)]
_beams = ", ".join(f"({k}, {math.tan(math.radians(alt))}, {row})" for k, (alt, az) in enumerate(_suns) if alt > 0 for row in (x.strip("() ") for x in offsets(math.radians(az), 5).split("), (")))
query("solar_access", lambda c: S.solar_access(hills(c), 3.0, _suns, 15.0), C, sql=f"""
WITH {G}, o AS (SELECT * FROM (VALUES {_beams}) v(k, t, i, j, d)), h AS (SELECT g.r, g.c, k, any_value(g.z) / 100 AS z, max(coalesce(n.z, 0) / 100 - d * 3 * t) AS roof FROM g CROSS JOIN o LEFT JOIN g n ON n.r = g.r + i AND n.c = g.c + j GROUP BY g.r, g.c, k) SELECT r, c, {R('100 * avg((z >= roof - 1e-5)::INT)')} AS access FROM h GROUP BY r, c""")
query("sun_hours", lambda c: S.sun_hours(hills(c), 10.0, 2024, 3, 20, 1.0, 48.0, 11.0, 60.0, 50.0), C)
query("daily_irradiation", lambda c: S.daily_irradiation(hills(c), 10.0, 2024, 6, 21, 1.0, 48.0, 11.0, 60.0, None, 50.0), C)
query("annual_irradiation", lambda c: S.annual_irradiation(hills(c), 10.0, 2024, 1.0, 48.0, 11.0, 120.0, None, [3, 6], 30.0)[0], C)

# sight: from a corner over flat land, every cell is seen; the general case is tested against hand-made surfaces
query("viewshed", lambda c: S.viewshed(hills(c), grid(c).where("r % 16 = 8 AND c % 16 = 8").selectExpr("r * 100 + c AS id", "r", "c"), 10.0, 1.6, 0.0, 60.0, 90), C)
query("isovists", lambda c: S.isovists(grid(c).selectExpr("r", "c", "IF(a > 44, 1D, 0D) AS m"), "m", grid(c).where("r % 8 = 4 AND c % 8 = 4").selectExpr("r * 100 + c AS id", "r", "c"), 1.0, 90, 12.0), C)

# growth and texture
_near = "near{k} AS MATERIALIZED (SELECT nb.r, nb.c, sum((s.y IS NOT NULL)::INT) AS n FROM nb JOIN u{k} s ON s.r = nr AND s.c = nc GROUP BY nb.r, nb.c)"
_unit = "(z - (SELECT min(z) FROM g)) / ((SELECT max(z) FROM g) - (SELECT min(z) FROM g))"
_grow = [f"u0 AS MATERIALIZED (SELECT r, c, CASE WHEN a > 45 THEN 0 END AS y, a < 4 AS stop, {_unit} AS s FROM g)"]
for _k, _want in enumerate((33, 34)):
    _grow.append(_near.format(k=_k) + f", p{_k} AS (SELECT u.r, u.c, row_number() OVER (ORDER BY u.s * (0.1 + coalesce(n, 0) / 8) DESC, u.r, u.c) AS i FROM u{_k} u LEFT JOIN near{_k} USING (r, c) WHERE y IS NULL AND NOT stop), u{_k + 1} AS MATERIALIZED (SELECT u.r, u.c, CASE WHEN i <= {_want} THEN {_k + 1} ELSE y END AS y, stop, s FROM u{_k} u LEFT JOIN p{_k} USING (r, c))")
query("urban_growth", lambda c: S.urban_growth(grid(c).withColumn("u", F.col("a") > 45).withColumn("x", F.col("a") < 4), "u", "z", 67, 2, "x"), C, sql=f"WITH {G}, {NEAR}, {', '.join(_grow)} SELECT r, c, y AS year FROM u2")
_sleuth = ["u0 AS MATERIALIZED (SELECT g.r, g.c, CASE WHEN a > 35 THEN 0 END AS y, CASE WHEN r > r0 AND r < r1 AND c > c0 AND c < c1 AND NOT (a < 4) THEN exp(-b * 0.1) * exp(-a / 1000) END AS p FROM g, e)"]
for _k in range(3):
    _sleuth.append(_near.format(k=_k) + f", u{_k + 1} AS MATERIALIZED (SELECT u.r, u.c, CASE WHEN y IS NULL AND p * (0.2 * 0.8 + 0.3 * CASE WHEN n = 1 THEN 0.9 ELSE 0 END + 0.5 * CASE WHEN n >= 2 THEN 0.7 ELSE 0 END) > 0.35 THEN {_k + 1} ELSE y END AS y, p FROM u{_k} u LEFT JOIN near{_k} USING (r, c))")
query("sleuth_growth", lambda c: S.sleuth_growth(grid(c).withColumn("u", F.col("a") > 35).withColumn("x", F.col("a") < 4), "u", "b", "a", "x", 80.0, 90.0, 70.0, 10.0, 0.0, 3), C, sql=f"WITH {G}, {NEAR}, {', '.join(_sleuth)} SELECT r, c, y AS year FROM u3")
_boxes = "k AS (SELECT unnest([2, 4, 8, 16, 32]) AS box), d AS (SELECT r1 - r0 + 1 AS h, c1 - c0 + 1 AS w, r0, c0 FROM e), n AS (SELECT box, count(DISTINCT CASE WHEN a > 45 AND (r - r0) // box < h // box AND (c - c0) // box < w // box THEN (r - r0) // box * 1000 + (c - c0) // box END) AS boxes FROM g, d, k WHERE box <= least(h, w) GROUP BY box)"
query("fractal_dimension", lambda c: S.fractal_dimension(grid(c).withColumn("m", F.col("a") > 45), "m"), C, sql=f"WITH {G}, {_boxes} SELECT box, boxes, {R('(SELECT abs(regr_slope(ln(boxes), ln(1 / box))) FROM n)')} AS dimension FROM n")
_patch = relaxed("SELECT r, c, r * 1000 + c AS v FROM g WHERE a > 25", "s.v", "nb.a > 25", "min", 80, "len = 1")
query("sprawl", lambda c: S.sprawl(grid(c).withColumn("b0", F.col("a") > 40).withColumn("b1", F.col("a") > 25), "b0", "b1", 1000.0, 1300.0, 10.0), C, sql=f"""
WITH {G}, {NEAR}, {_patch}, k AS (SELECT v, count(*) AS n FROM s GROUP BY v), t AS (SELECT count(*) FILTER (a > 40) AS n1, count(*) FILTER (a > 25) AS n2 FROM g), x AS (SELECT 4 * (SELECT n2 FROM t) - count(*) AS e FROM nb JOIN g n ON n.r = nr AND n.c = nc WHERE len = 1 AND nb.a > 25 AND n.a > 25)
SELECT {R('n1 * 100.0')} AS area_before, {R('n2 * 100.0')} AS area_after, {R('ln(n2 / n1)')} AS lcr, {R('ln(1.3)')} AS pgr, {R('ln(n2 / n1) / ln(1.3)')} AS ratio, (SELECT count(*) FROM k) AS patches, {R('(SELECT max(n) / sum(n) FROM k)')} AS largest_share, {R('e * 10.0')} AS edge, {R('e * 10.0 / (n2 * 100)')} AS edge_density FROM t, x""")
