"""Queries of the planning tables."""

from __future__ import annotations

from urbanloom.operators import planning
from urbanloom.plans.registry import query
from urbanloom.plans.statistics import D

R = lambda x: f"round({x}, 6) + 0.0"

query("largest_remainder", lambda a: planning.largest_remainder(a.select("id", "pop"), 1000, "pop"), "areas", sql="""
WITH q AS (SELECT id, 1000.0 * pop / sum(pop) OVER () AS q FROM {areas}), f AS (SELECT id, q, floor(q) AS f FROM q)
SELECT id, CAST(f AS BIGINT) + (row_number() OVER (ORDER BY q - f DESC, id) <= 1000 - sum(f) OVER ())::BIGINT AS n FROM f""")
query("exposure_bands", lambda p: planning.exposure_bands(p.selectExpr("s", "CAST(1 + id % 5 AS DOUBLE) AS w"), "s", "w", [10.0, 20.0, 30.0, 40.0]), "plots", sql=f"""
WITH b AS (SELECT CAST((s >= 10)::INT + (s >= 20)::INT + (s >= 30)::INT + (s >= 40)::INT AS INT) AS band, sum(1 + id % 5)::DOUBLE AS weight FROM {{plots}} GROUP BY 1) SELECT band, weight, {R('weight / sum(weight) OVER ()')} AS share FROM b""")
NEAR = f"SELECT a.id, b.id AS j, {D} AS d FROM {{points}} a JOIN {{points}} b ON b.g < 3 AND {D} <= 80"
src = lambda p: p.where("g < 3").selectExpr("id", "x", "y", "CAST(50 + id % 30 AS DOUBLE) AS level", "CAST(1 + id % 30 AS DOUBLE) AS strength")
query("receiver_levels", lambda p: planning.receiver_levels(src(p), p, 80.0), "points", sql=f"WITH n AS ({NEAR}), l AS (SELECT id, 10 * log10(sum(pow(10, (50 + j % 30 - 20 * log10(greatest(d, 1))) / 10))) AS l FROM n GROUP BY id) SELECT p.id, {R('l')} AS level FROM {{points}} p LEFT JOIN l USING (id)")
query("concentrations", lambda p: planning.concentrations(src(p), p, 80.0, 3.0), "points", sql=f"WITH n AS ({NEAR}), l AS (SELECT id, sum((1 + j % 30) / (3 * (d + 1))) AS l FROM n GROUP BY id) SELECT p.id, {R('coalesce(l, 0)')} AS c FROM {{points}} p LEFT JOIN l USING (id)")
mm = lambda c: f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())"
query("combine_components", lambda p: planning.combine_components(p, ["s", "u", "v"], [1, -1, 1], [2.0, 1.0, 1.0]), "plots", sql=f"SELECT id, {R(f'100 * (0.5 * {mm(chr(115))} + 0.25 * (1 - {mm(chr(117))}) + 0.25 * {mm(chr(118))})')} AS score FROM {{plots}}")
query("shannon_mix", lambda v: planning.shannon_mix(v.selectExpr("id % 50 AS k", "g", "x"), "k", "g", "x"), "values", sql=f"""
WITH a AS (SELECT id % 50 AS k, g, sum(x) AS a FROM {{values}} WHERE x > 0 GROUP BY 1, 2) SELECT k, {R('CASE WHEN count(*) > 1 THEN (ln(sum(a)) - sum(a * ln(a)) / sum(a)) / ln(count(*)) ELSE 0 END')} AS mix FROM a GROUP BY k""")
DIR = {"avg_v": 1, "max_v": -1, "n": 1}
half = lambda s, k: s.where(f"t % 2 = {k}").groupBy().agg({"v": "avg"}).selectExpr("inline(array(struct('avg_v' AS key, `avg(v)` AS value)))").unionByName(s.where(f"t % 2 = {k}").selectExpr("'max_v' AS key", "v AS value").groupBy("key").agg({"value": "max"}).withColumnRenamed("max(value)", "value"))
HALF = lambda k: f"SELECT 'avg_v' AS key, avg(v) AS v FROM {{series}} WHERE t % 2 = {k} UNION ALL SELECT 'max_v', max(v) FROM {{series}} WHERE t % 2 = {k}"
query("scenario_compare", lambda s: planning.scenario_compare(half(s, 0), half(s, 1), DIR), "series", sql=f"""
WITH a AS ({HALF(0)}), b AS ({HALF(1)}) SELECT key, {R('a.v')} AS a, {R('b.v')} AS b, {R('b.v - a.v')} AS delta, {R('100 * (b.v - a.v) / abs(a.v)')} AS pct, CASE WHEN (b.v - a.v) * (CASE key WHEN 'avg_v' THEN 1 ELSE -1 END) > 0 THEN 'B' ELSE 'A' END AS better FROM a JOIN b USING (key)""")
query("scenario_rank", lambda s: planning.scenario_rank(s.selectExpr("k AS scenario", "inline(array(struct('avg_v' AS key, v AS value), struct('max_v' AS key, -v AS value)))").groupBy("scenario", "key").avg("value").withColumnRenamed("avg(value)", "value"), DIR), "series", sql=f"""
WITH m AS (SELECT k, avg(v) AS v FROM {{series}} GROUP BY k), s AS (SELECT k AS scenario, 100 * (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) AS score FROM m) SELECT scenario, {R('score')} AS score, CAST(rank() OVER (ORDER BY round(score, 9) DESC) AS INT) AS rank FROM s""")
query("stop_frequencies", lambda e: planning.stop_frequencies(e.selectExpr("k AS route", "concat(k, CAST(t DIV 10 AS STRING)) AS trip", "t % 7 AS stop", "t AS seq", "t * 1800 AS dep"), 3600, 43200), "series", sql=f"""
WITH s AS (SELECT k AS route, k || CAST(t // 10 AS VARCHAR) AS trip, t % 7 AS stop, t AS seq, t * 1800 AS dep FROM {{series}}), l AS (SELECT *, max(seq) OVER (PARTITION BY trip) AS m FROM s)
SELECT stop, count(*) AS departures, {R('count(*) / 11.0')} AS per_hour, {R('660.0 / count(*)')} AS headway, count(DISTINCT route) AS routes FROM l WHERE seq < m AND dep >= 3600 AND dep < 43200 GROUP BY stop""")
query("merge_intervals", lambda p: planning.merge_intervals(p.selectExpr("id % 40 AS k", "u AS lo", "u + 0.05 * v AS hi"), "k"), "plots", sql=f"""
WITH r AS (SELECT id % 40 AS k, greatest(u, 0) AS lo, least(u + 0.05 * v, 1) AS hi FROM {{plots}}), f AS (SELECT * FROM r WHERE hi > lo), b AS (SELECT *, max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM f),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR lo > p + 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM b) SELECT k, {R('min(lo)')} AS lo, {R('max(hi)')} AS hi FROM g GROUP BY k, g""")
query("balance_rows", lambda v: planning.balance_rows(v.groupBy("g").agg({"x": "sum"}).selectExpr("g AS category", "`sum(x)` AS area"), 1000.0, {"auto": 900.0, "mach": 2000.0, "house": 10.0}), "values", sql=f"""
WITH a AS (SELECT g AS category, sum(x) AS area, CASE WHEN lower(g) LIKE '%auto%' THEN 900.0 WHEN lower(g) LIKE '%mach%' THEN 2000.0 WHEN lower(g) LIKE '%house%' THEN 10.0 END * 1000 AS q FROM {{values}} GROUP BY g)
SELECT category, {R('area')} AS area, {R('area / 1000')} AS per_capita, {R('q::DOUBLE')} AS required, {R('area - q')} AS balance, CASE WHEN q IS NULL THEN 'No standard' WHEN area >= q THEN 'Meets standard' ELSE 'Deficit' END AS status FROM a""")
SVI = f"(2 * 100 * {mm('s')} + 100 * {mm('u')}) / 3"
query("social_vulnerability_index", lambda p: planning.social_vulnerability_index(p, ["s", "u", "v"], [2.0, 1.0, 0.0]), "plots", sql=f"WITH i AS (SELECT id, {SVI} AS svi FROM {{plots}}) SELECT id, {R('svi')} AS svi, CASE WHEN svi >= 75 THEN 'Very High' WHEN svi >= 55 THEN 'High' WHEN svi >= 35 THEN 'Moderate' ELSE 'Low' END AS class FROM i")
