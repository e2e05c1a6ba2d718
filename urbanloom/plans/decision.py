"""Queries of the decision families: multi-criteria ranking, criterion weights, accessibility, demand, series."""

from __future__ import annotations

from pyspark.sql import functions as F

from urbanloom.operators import access, mcda, series
from urbanloom.plans.registry import query

R = lambda x: f"round({x}, 6) + 0.0"
COLS, WEIGHTS, BENEFIT = ["c1", "c2", "c3", "c4", "c5"], [0.3, 0.2, 0.2, 0.1, 0.2], [True, True, True, False, True]
ITEMS = list(zip(COLS, WEIGHTS, BENEFIT))
A = "{alternatives}"
hi = lambda c: f"max({c}) OVER ()"
lo = lambda c: f"min({c}) OVER ()"
best = lambda c, g: hi(c) if g else lo(c)
worst = lambda c, g: lo(c) if g else hi(c)


def ranking(name: str, method, body: str, ascending: bool = False) -> None:
    """``body`` is SQL that gives (id, score)."""
    query(name, lambda a: method(a, COLS, WEIGHTS, BENEFIT), "alternatives", sql=f"WITH r AS ({body}) SELECT id, {R('score')} AS score, CAST(row_number() OVER (ORDER BY score {'ASC' if ascending else 'DESC'}, id) AS INT) AS rank FROM r")


norm = lambda c: f"sqrt(sum({c} * {c}) OVER ())"
gap = lambda pick: "sqrt(" + " + ".join(f"pow(({c} - {pick(c, g)}) / {norm(c)} * {w}, 2)" for c, w, g in ITEMS) + ")"
ranking("topsis", mcda.topsis, f"SELECT id, w / (b + w) AS score FROM (SELECT id, {gap(best)} AS b, {gap(worst)} AS w FROM {A})")
term = lambda c, w, g: f"{w} * ({best(c, g)} - {c}) / (CASE WHEN {best(c, g)} > {worst(c, g)} THEN {best(c, g)} - {worst(c, g)} ELSE 1e-9 END)"
ranking("vikor", mcda.vikor, f"SELECT id, 0.5 * (s - {lo('s')}) / ({hi('s')} - {lo('s')}) + 0.5 * (r - {lo('r')}) / ({hi('r')} - {lo('r')}) AS score FROM (SELECT id, {' + '.join(term(*i) for i in ITEMS)} AS s, greatest({', '.join(term(*i) for i in ITEMS)}) AS r FROM {A})", True)
pref = lambda a, b: " + ".join(f"{w} * least(1, greatest(0, {'' if g else '-'}({a}.{c} - {b}.{c})) / (SELECT max({c}) - min({c}) FROM t))" for c, w, g in ITEMS)
ranking("promethee_ii", mcda.promethee_ii, f"SELECT * FROM (WITH t AS (SELECT * FROM {A}) SELECT x.id, sum(({pref('x', 'y')}) - ({pref('y', 'x')})) / (count(*) - 1) AS score FROM t x, t y GROUP BY x.id)")
nrm = lambda c, g, x: f"({x}) / {hi(c)}" if g else f"{lo(c)} / ({x})"
tot = lambda pick: " + ".join(f"{w} * ({nrm(c, g, pick(c, g))})" for c, w, g in ITEMS)
ranking("marcos", mcda.marcos, f"SELECT id, (p + m) / (1 + (1 - m / (p + m)) / (m / (p + m)) + (1 - p / (p + m)) / (p / (p + m))) AS score FROM (SELECT id, s / sa AS m, s / si AS p FROM (SELECT id, {tot(lambda c, g: c)} AS s, {tot(worst)} AS sa, {tot(best)} AS si FROM {A}))")
ranking("waspas", mcda.waspas, f"SELECT id, 0.5 * ({tot(lambda c, g: c)}) + 0.5 * ({' * '.join(f'pow({nrm(c, g, c)}, {w})' for c, w, g in ITEMS)}) AS score FROM {A}")
share = lambda pick: " + ".join(f"{w} * ({pick(c, g)} / (sum({c}) OVER () + {hi(c)}))" if g else f"{w} * (1 / {pick(c, g)} / (sum(1 / {c}) OVER () + 1 / {lo(c)}))" for c, w, g in ITEMS)
ranking("aras", mcda.aras, f"SELECT id, ({share(lambda c, g: c)}) / ({share(best)}) AS score FROM {A}")
side = lambda want: " + ".join(["0.0"] + [f"{w} * {c} / sum({c}) OVER ()" for c, w, g in ITEMS if g == want])
ranking("copras", mcda.copras, f"SELECT id, q / {hi('q')} * 100 AS score FROM (SELECT id, p + sum(m) OVER () / (m * sum(1 / m) OVER () + 1e-12) AS q FROM (SELECT id, {side(True)} AS p, {side(False)} AS m FROM {A}))")
away = lambda up: " + ".join(f"{w} * greatest(0, {'' if g == up else '-'}({c} - avg({c}) OVER ())) / avg({c}) OVER ()" for c, w, g in ITEMS)
ranking("edas", mcda.edas, f"SELECT id, 0.5 * (p / {hi('p')} + 1 - n / {hi('n')}) AS score FROM (SELECT id, {away(True)} AS p, {away(False)} AS n FROM {A})")
ranking("spotis", mcda.spotis, f"SELECT id, {' + '.join(f'{w} * abs({c} - {best(c, g)}) / ({hi(c)} - {lo(c)})' for c, w, g in ITEMS)} AS score FROM {A}", True)
query("weighted_linear_combination", lambda c: mcda.weighted_linear_combination(c.selectExpr("r", "c", "a * 2 AS a", "b * 100 AS b", "z"), ["a", "b"], [2.0, 1.0]).drop("z"), "cells", sql=f"SELECT r, c, {R('a * 2')} AS a, {R('b * 100')} AS b, {R('(2 * least(greatest(a * 2, 0), 100) + least(greatest(b * 100, 0), 100)) / 3')} AS score FROM {{cells}}")
P = "(x - min(x) OVER (PARTITION BY criterion)) / (max(x) OVER (PARTITION BY criterion) - min(x) OVER (PARTITION BY criterion)) + 1e-12"
LONG = f"SELECT unnest(['c1', 'c2', 'c3', 'c4', 'c5']) AS criterion, unnest([c1, c2, c3, c4, c5]) AS x FROM {A}"
query("entropy_weights", lambda a: mcda.entropy_weights(a, COLS), "alternatives", sql=f"""
WITH z AS (SELECT criterion, {P} AS p FROM ({LONG})), e AS (SELECT criterion, 1 + (sum(p * ln(p)) / sum(p) - ln(sum(p))) / ln(count(*)) AS d FROM z GROUP BY criterion) SELECT criterion, {R('d / sum(d) OVER ()')} AS weight FROM e""")
query("critic_weights", lambda a: mcda.critic_weights(a, COLS, BENEFIT), "alternatives", sql=f"""
WITH z AS (SELECT {', '.join(f'({c} - {lo(c)}) / ({hi(c)} - {lo(c)}) AS {c}' if g else f'({hi(c)} - {c}) / ({hi(c)} - {lo(c)}) AS {c}' for c, _, g in ITEMS)} FROM {A}),
s AS ({' UNION ALL '.join(f"SELECT '{c}' AS criterion, stddev_pop({c}) AS sigma, {' + '.join(f'1 - corr({c}, {o})' for o in COLS if o != c)} AS conflict FROM z" for c in COLS)})
SELECT criterion, {R('sigma * conflict / sum(sigma * conflict) OVER ()')} AS weight, {R('sigma')} AS sigma, {R('conflict')} AS conflict FROM s""")

# accessibility: areas to facilities on the grid, cost is the distance in cells times 300
COST = "sqrt((a.x - f.x) * (a.x - f.x) + (a.y - f.y) * (a.y - f.y)) * 300"
OD = f"SELECT a.id AS o, f.id AS d, {COST} AS cost, a.pop, f.supply FROM {{areas}} a, {{facilities}} f"


def _od(a, f):
    """Zones and facilities are few by nature here; both sides are the query's own derived tables of one row a nation."""
    od = a.alias("a").join(F.broadcast(f.alias("f")), F.lit(True)).selectExpr("a.id AS o", "f.id AS d", f"{COST} AS cost")
    return od, a.selectExpr("id AS o", "pop"), f.selectExpr("id AS d", "supply")


def zones(name: str, build, sql: str) -> None:
    query(name, lambda a, f: build(*_od(a, f)), "areas", "facilities", sql=f"WITH od AS ({OD}) {sql}")


E_ = "exp(-0.002 * cost)"
zones("gravity_accessibility", lambda od, o, d: access.gravity_accessibility(od, d, "exponential", 0.002, 900.0), f"SELECT o, {R(f'sum(CASE WHEN cost <= 900 THEN supply * {E_} ELSE 0 END)')} AS access FROM od GROUP BY o")
zones("cumulative_opportunities", lambda od, o, d: access.cumulative_opportunities(od, d, 700.0), f"SELECT o, {R('sum(CASE WHEN cost <= 700 THEN supply ELSE 0 END)')} AS access FROM od GROUP BY o")


def catchment(name: str, build, w: str, three: bool = False) -> None:
    g = "CASE WHEN sum(w) OVER (PARTITION BY o) > 0 THEN w * w / sum(w) OVER (PARTITION BY o) ELSE 0 END" if three else "w"
    zones(name, build, f", k AS (SELECT *, CASE WHEN cost <= 900 THEN {w} ELSE 0 END AS w FROM od), g AS (SELECT o, d, pop, supply, {g} AS w FROM k), r AS (SELECT *, sum(w * pop) OVER (PARTITION BY d) AS q FROM g) SELECT o, {R('sum(CASE WHEN q > 0 THEN w * supply / q ELSE 0 END)')} AS access FROM r GROUP BY o")


catchment("enhanced_2sfca", lambda od, o, d: access.enhanced_2sfca(od, o, d, 900.0, "gaussian", 400.0), "exp(-0.5 * (cost / 400) * (cost / 400))")
catchment("kernel_density_2sfca", lambda od, o, d: access.kernel_density_2sfca(od, o, d, 900.0), "15.0 / 16 * pow(1 - pow(cost / 900, 2), 2)")
catchment("three_step_2sfca", lambda od, o, d: access.three_step_2sfca(od, o, d, 900.0, "linear"), "greatest(0, 1 - cost / 900)", True)
zones("spatial_equity_gini", lambda od, o, d: access.spatial_equity_gini(access.gravity_accessibility(od, d, "exponential", 0.002), o), f""", a AS (SELECT o, max(pop) AS p, sum(supply * {E_}) AS a FROM od GROUP BY o)
SELECT {R('sum(abs(x.a - y.a) * x.p * y.p) / (2 * (SELECT sum(p) FROM a) * (SELECT sum(p * a) FROM a))')} AS gini FROM a x, a y""")
HUFF = "SELECT o, d, pop, supply / pow(greatest(cost, 1), 2) / sum(supply / pow(greatest(cost, 1), 2)) OVER (PARTITION BY o) AS p FROM od"
zones("huff_gravity", lambda od, o, d: access.huff_gravity(od.withColumn("cost", F.greatest("cost", F.lit(1.0))), d), f"SELECT o, d, {R('p')} AS p FROM ({HUFF})")
zones("huff_market_share", access.huff_market_share, f"SELECT d, {R('sum(p * pop)')} AS captured, {R('sum(p * pop) / (SELECT sum(pop) FROM {areas})')} AS share, count(*) FILTER (p >= 0.5) AS zones FROM ({HUFF}) GROUP BY d")
CAT = {"a": 0.5, "b": 0.3, "c": 0.2}
zones("fifteen_minute_score", lambda od, o, d: access.fifteen_minute_score(od, d.selectExpr("d", "element_at(array('a', 'b', 'c'), cast(d % 3 AS int) + 1) AS category"), CAT, 900.0), f""", c AS (SELECT id AS d, (['a', 'b', 'c'])[id % 3 + 1] AS k FROM {{facilities}}), w AS (SELECT d, (CASE k WHEN 'a' THEN 0.5 WHEN 'b' THEN 0.3 ELSE 0.2 END) / count(*) OVER (PARTITION BY k) AS w FROM c)
SELECT o, {R('100 * sum(CASE WHEN cost <= 900 THEN w ELSE 0 END)')} AS score FROM od JOIN w USING (d) GROUP BY o""")
zones("parking_mismatch", lambda od, o, d: access.parking_mismatch(od, o, d, 700.0), f", s AS (SELECT o, max(pop) AS p, sum(CASE WHEN cost <= 700 THEN (1 - pow(cost / 700, 2)) * supply ELSE 0 END) AS s FROM od GROUP BY o) SELECT o, {R('s')} AS supply, {R('s / p')} AS ratio, {R('greatest(p - s, 0)')} AS deficit FROM s")
zones("transit_frequency", lambda od, o, d: access.transit_frequency(od, d.selectExpr("d", "cast(5 + d % 7 AS double) AS headway", "cast(1 + d % 4 AS double) AS routes"), 800.0), f""", k AS (SELECT o, cost, CASE WHEN cost <= 800 THEN exp(-0.5 * pow(cost / (800.0 / 3), 2)) ELSE 0 END AS w, 5 + d % 7 AS h, 1 + d % 4 AS r FROM od)
SELECT o, {R('sum(w * (0.7 * least(10.0 / h, 1) + 0.3 * (1 - exp(-r / 3)))) / sum(w)')} AS access, count(*) FILTER (cost <= 800) AS stops, {R('min(cost)')} AS nearest, {R('sum(w * h) / sum(w)')} AS headway FROM k GROUP BY o""")
zones("nearest_vehicle", lambda od, o, d: access.nearest_vehicle(od), f"SELECT o, d, {R('cost')} AS cost FROM od QUALIFY row_number() OVER (PARTITION BY o ORDER BY cost, d) = 1")
zones("gravity_od", access.gravity_od, f"SELECT o, d, {R(f'pop * supply * {E_} * (SELECT sum(pop) FROM {{areas}}) / sum(pop * supply * {E_}) OVER ()')} AS trips FROM od")
FUR = "t0 AS (SELECT o, d, pop * supply * exp(-0.002 * cost) AS t FROM od), rt AS (SELECT id AS o, pop AS r FROM {areas}), ct AS (SELECT id AS d, supply * (SELECT sum(pop) FROM {areas}) / (SELECT sum(supply) FROM {facilities}) AS c FROM {facilities})"
STEPS = ", ".join(f"t{2 * i + 1} AS (SELECT o, d, t * r / sum(t) OVER (PARTITION BY o) AS t FROM t{2 * i} JOIN rt USING (o)), t{2 * i + 2} AS (SELECT o, d, t * c / sum(t) OVER (PARTITION BY d) AS t FROM t{2 * i + 1} JOIN ct USING (d))" for i in range(3))
zones("furness", lambda od, o, d: access.furness(access.gravity_od(od, o, d), o.withColumnRenamed("pop", "target"), d.crossJoin(F.broadcast(o.agg(F.sum("pop").alias("p")).crossJoin(d.agg(F.sum("supply").alias("s"))))).selectExpr("d", "supply * p / s AS target"), 3), f", {FUR}, {STEPS} SELECT o, d, {R('t')} AS trips FROM t6")
zones("mode_split", lambda od, o, d: access.mode_split(od.selectExpr("o", "d", "inline(array(struct('car' AS mode, cost / 100 AS time), struct('bus' AS mode, cost / 60 AS time)))"), {"car": -0.1, "bus": -0.08}, {"car": 0.2}), f""", m AS (SELECT o, d, 'car' AS mode, 0.2 - 0.1 * cost / 100 AS u FROM od UNION ALL SELECT o, d, 'bus', -0.08 * cost / 60 FROM od) SELECT o, d, mode, {R('exp(u) / sum(exp(u)) OVER (PARTITION BY o, d)')} AS p FROM m""")

# series
S = "{series}"
MK = f"""p AS (SELECT a.k, sign(b.v - a.v) AS sg, (b.v - a.v) / (b.t - a.t) AS sl FROM {S} a JOIN {S} b ON a.k = b.k AND b.t > a.t), s AS (SELECT k, sum(sg) AS s FROM p GROUP BY k),
sl AS (SELECT k, sl AS slope FROM p WHERE sg <> 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY sl) = count(*) OVER (PARTITION BY k) // 2 + 1),
n AS (SELECT k, count(*)::DOUBLE AS n FROM {S} GROUP BY k), v AS (SELECT k, n, n * (n - 1) * (2 * n + 5) / 18 AS var FROM n)"""
query("mann_kendall", lambda s: series.mann_kendall(s).drop("p"), "series", sql=f"WITH {MK} SELECT k, n::BIGINT AS n, s::DOUBLE AS s, {R('var')} AS variance, {R('CASE WHEN s > 0 THEN (s - 1) / sqrt(var) WHEN s < 0 THEN (s + 1) / sqrt(var) ELSE 0 END')} AS z, {R('slope')} AS slope, {R('s / (n * (n - 1) / 2)')} AS tau FROM s JOIN sl USING (k) JOIN v USING (k)")
query("classify_trend", lambda s: series.classify_trend(series.mann_kendall(s)).select("k", "trend"), "series", sql=f"WITH {MK}, z AS (SELECT k, slope, (s - sign(s)) / sqrt(var) AS z FROM s JOIN sl USING (k) JOIN v USING (k)) SELECT k, CAST(CASE WHEN abs(z) > 1.959964 AND slope > 0 THEN 1 WHEN abs(z) > 1.959964 AND slope < 0 THEN 2 ELSE 0 END AS INT) AS trend FROM z")
query("sen_intercept", lambda s: series.sen_intercept(s, series.mann_kendall(s)), "series", sql=f"WITH {MK} SELECT k, {R('quantile_cont(v - slope * t, 0.5)')} AS intercept FROM {S} JOIN sl USING (k) GROUP BY k")
ROB = f"m AS (SELECT k, quantile_cont(v, 0.5) AS m FROM {S} GROUP BY k), d AS (SELECT k, quantile_cont(abs(v - m), 0.5) AS d FROM {S} JOIN m USING (k) GROUP BY k)"
query("robust_zscores", series.robust_zscores, "series", sql=f"WITH {ROB} SELECT k, t, {R('v')} AS v, {R('0.6745 * (v - m) / d')} AS z FROM {S} JOIN m USING (k) JOIN d USING (k)")
query("detect_anomalies", lambda s: series.detect_anomalies(s, 2.5), "series", sql=f"WITH {ROB} SELECT k, t, {R('v')} AS v, {R('0.6745 * (v - m) / d')} AS z, abs(0.6745 * (v - m) / d) >= 2.5 AS anomaly FROM {S} JOIN m USING (k) JOIN d USING (k)")
query("exponential_smoothing", lambda s: series.exponential_smoothing(s).select("k", "level"), "series", sql=f"""
WITH a AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY t DESC) - 1 AS age, count(*) OVER (PARTITION BY k) AS n FROM {S}) SELECT k, {R('sum(CASE WHEN age = n - 1 THEN 1 ELSE 0.3 END * pow(0.7, age) * v)')} AS level FROM a GROUP BY k""")
query("forecast_metrics", lambda s: series.forecast_metrics(s.withColumn("f", F.col("v") * 0.9 + 3), "v", "f"), "series", sql=f"SELECT {R('avg(abs(v - f))')} AS mae, {R('sqrt(avg((v - f) * (v - f)))')} AS rmse, {R('100 * avg(abs((v - f) / v))')} AS mape FROM (SELECT v, v * 0.9 + 3 AS f FROM {S})")
query("space_time_cube", lambda p: series.space_time_cube(p.selectExpr("x", "y", "CAST(id % 30 AS DOUBLE) AS t", "v"), 100.0, 6), "points", sql=f"""
WITH p AS (SELECT x, y, (id % 30)::DOUBLE AS t, v FROM {{points}}), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(t) AS t0, max(t) AS t1 FROM p)
SELECT CAST(least(floor((x - x0) / 100), greatest(ceil((x1 - x0) / 100) - 1, 0)) AS BIGINT) AS bx, CAST(least(floor((y - y0) / 100), greatest(ceil((y1 - y0) / 100) - 1, 0)) AS BIGINT) AS by, CAST(least(floor((t - t0) / (t1 - t0) * 6), 5) AS BIGINT) AS bt, {R('avg(v)')} AS value, count(*) AS n FROM p, b GROUP BY 1, 2, 3""")
query("regression_quality", lambda s: series.regression_quality(s.withColumn("f", F.col("v") * 0.9 + 3), "v", "f", 2), "series", sql=f"""
WITH t AS (SELECT sum((v - f) * (v - f)) AS sse, var_pop(v) * count(*) AS sst, count(*)::DOUBLE AS n, avg(abs(v - f)) AS mae FROM (SELECT v, v * 0.9 + 3 AS f FROM {S}))
SELECT {R('1 - sse / sst')} AS r2, {R('1 - sse / sst * (n - 1) / (n - 3)')} AS adj_r2, {R('sqrt(sse / n)')} AS rmse, {R('mae')} AS mae, {R('n * ln(sse / n) + 6')} AS aic FROM t""")
