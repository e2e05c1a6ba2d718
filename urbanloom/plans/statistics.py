"""Queries of the statistics families: data quality, inequality, weights, autocorrelation, point patterns."""

from __future__ import annotations

from urbanloom.operators import autocorr, inequality, patterns, quality, weights
from urbanloom.plans.registry import query

R = lambda x: f"round({x}, 6) + 0.0"

# data quality
query("array_summary", lambda v: quality.array_summary(v, "x", "w"), "values", sql=f"""
SELECT count(*) AS n, count(x) AS n_valid, 0::BIGINT AS n_missing, {R('min(x)')} AS min, {R('max(x)')} AS max, {R('avg(x)')} AS mean, {R('sum(x)')} AS sum,
 {R('quantile_cont(x, 0.05)')} AS p05, {R('quantile_cont(x, 0.25)')} AS p25, {R('quantile_cont(x, 0.5)')} AS median, {R('quantile_cont(x, 0.75)')} AS p75, {R('quantile_cont(x, 0.95)')} AS p95,
 {R('sum(x * w) / sum(w)')} AS weighted_mean FROM {{values}}""")
query("quality_weighted_quantile", lambda v: quality.weighted_quantile(v, "x", "w", [0.1, 0.5, 0.9]), "values", sql=f"""
WITH d AS (SELECT x, sum(w) AS w FROM {{values}} GROUP BY x), c AS (SELECT x, sum(w) OVER (ORDER BY x) / sum(w) OVER () AS s FROM d),
b AS (SELECT x, s, lag(x) OVER (ORDER BY x) AS x0, lag(s) OVER (ORDER BY x) AS s0 FROM c)
SELECT q, {R('CASE WHEN s0 IS NULL THEN x ELSE x0 + (x - x0) * (q - s0) / (s - s0) END')} AS value FROM b, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) t(q)
WHERE q <= s AND (s0 IS NULL OR q > s0)""")
query("gini_coefficient", lambda v: quality.gini_coefficient(v, "x", "w"), "values", sql=f"""
WITH d AS (SELECT x, sum(w) AS w FROM {{values}} GROUP BY x), c AS (SELECT x, w, sum(x * w) OVER (ORDER BY x) AS s FROM d)
SELECT {R('1 - sum(w * (2 * s - x * w)) / (sum(w) * sum(x * w))')} AS gini FROM c""")
query("normalize_weights", lambda v: quality.normalize_weights(v.select("id", "w"), "w"), "values", sql=f"SELECT id, w, {R('w / sum(w) OVER ()')} AS share FROM {{values}}")
query("quantile_breaks", lambda v: quality.quantile_breaks(v, "x").selectExpr("explode(breaks) AS b"), "values", sql=f"SELECT DISTINCT {R('unnest(quantile_cont(x, [0.2, 0.4, 0.6, 0.8]))')} AS b FROM {{values}}")
query("classify_values", lambda v: quality.classify_values(v.select("id", "x"), "x", [0.0, 1000.0, 2500.0, 5000.0]), "values", sql=f"SELECT id, {R('x')} AS x, CAST(1 + (x >= 0)::INT + (x >= 1000)::INT + (x >= 2500)::INT + (x >= 5000)::INT AS INT) AS class FROM {{values}}")
query("rank_values", lambda v: quality.rank_values(v.select("id", "x"), "x"), "values", sql=f"SELECT id, {R('x')} AS x, {R('rank() OVER (ORDER BY x DESC) + (count(*) OVER (PARTITION BY x) - 1) / 2')} AS rank FROM {{values}}")
query("bootstrap_mean_ci", lambda v: quality.bootstrap_mean_ci(v, "x", n_boot=500), "values")
query("zscore", lambda v: quality.zscore(v.select("id", "x"), "x"), "values", sql=f"SELECT id, {R('x')} AS x, {R('(x - avg(x) OVER ()) / stddev_pop(x) OVER ()')} AS z FROM {{values}}")
query("top_k", lambda v: quality.top_k(v.select("id", "x"), "x", 25), "values", sql=f"SELECT id, {R('x')} AS x FROM {{values}} ORDER BY x DESC, id LIMIT 25")
query("pareto_front_of", lambda v: quality.pareto_front_of(v.select("id", "c1", "c2", "c3", "c4"), ["c1", "c2", "c3", "c4"], [True, False, True, False]).select("id", "on_front"), "alternatives", sql="""
WITH a AS MATERIALIZED (SELECT * FROM {alternatives}) SELECT id, NOT EXISTS (SELECT 1 FROM a o WHERE o.c1 >= a.c1 AND o.c2 <= a.c2 AND o.c3 >= a.c3 AND o.c4 <= a.c4 AND (o.c1 > a.c1 OR o.c2 < a.c2 OR o.c3 > a.c3 OR o.c4 < a.c4)) AS on_front FROM a""")
query("pareto_front", lambda v: quality.pareto_front(v.select("id", "c1", "c2"), "c1", "c2", True, False), "alternatives", sql=f"""
WITH a AS ({{alternatives}}) SELECT id, {R('c1')} AS c1, {R('c2')} AS c2, NOT EXISTS (SELECT 1 FROM a o WHERE o.c1 >= a.c1 AND o.c2 <= a.c2 AND (o.c1 > a.c1 OR o.c2 < a.c2)) AS on_front FROM a""".replace("({alternatives})", "(SELECT * FROM {alternatives})"))

# inequality
query("weighted_mean", lambda v: inequality.weighted_mean(v, "x", "w"), "values", sql=f"SELECT {R('sum(x * w) / sum(w)')} AS mean FROM {{values}}")
query("weighted_std", lambda v: inequality.weighted_std(v, "x", "w"), "values", sql=f"WITH m AS (SELECT sum(x * w) / sum(w) AS m FROM {{values}}) SELECT {R('sqrt(sum(w * (x - m) * (x - m)) / sum(w))')} AS std FROM {{values}}, m")
query("coefficient_of_variation", lambda v: inequality.coefficient_of_variation(v, "x", "w"), "values", sql=f"WITH m AS (SELECT sum(x * w) / sum(w) AS m FROM {{values}}) SELECT {R('sqrt(sum(w * (x - m) * (x - m)) / sum(w)) / max(m)')} AS cv FROM {{values}}, m")
query("equity_weighted_quantile", lambda v: inequality.weighted_quantile(v, "x", [0.1, 0.5, 0.9], "w", ["g"]), "values", sql=f"""
WITH c AS (SELECT g, x, w, (sum(w) OVER (PARTITION BY g ORDER BY x, w ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY g) AS s FROM {{values}}),
b AS (SELECT g, x, s, lead(x) OVER o AS x1, lead(s) OVER o AS s1, lag(s) OVER o AS s0 FROM c WINDOW o AS (PARTITION BY g ORDER BY x, w, s))
SELECT g, q, {R('CASE WHEN s1 IS NULL OR (s0 IS NULL AND q < s) THEN x ELSE x + (x1 - x) * (q - s) / (s1 - s) END')} AS value
FROM b, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) t(q) WHERE (s0 IS NULL AND q < s) OR (q >= s AND (s1 IS NULL OR q < s1))""")
query("percentile_ratio", lambda v: inequality.percentile_ratio(v.where("x > 0"), "x"), "values", sql=f"""
WITH c AS (SELECT x, (row_number() OVER (ORDER BY x) - 0.5) / count(*) OVER () AS s FROM {{values}} WHERE x > 0), b AS (SELECT x, s, lead(x) OVER (ORDER BY s) AS x1, lead(s) OVER (ORDER BY s) AS s1 FROM c),
q AS (SELECT q, x + (x1 - x) * (q - s) / (s1 - s) AS v FROM b, (VALUES (0.1::DOUBLE), (0.9::DOUBLE)) t(q) WHERE q >= s AND q < s1) SELECT {R('max(v) FILTER (q = 0.9) / max(v) FILTER (q = 0.1)')} AS ratio FROM q""")
query("percentile_rank", lambda v: inequality.percentile_rank(v, "x", "w"), "values", sql=f"""
WITH d AS (SELECT x, sum(w) AS e FROM {{values}} GROUP BY x), c AS (SELECT x, (sum(e) OVER (ORDER BY x) - e / 2) / sum(e) OVER () AS pct FROM d) SELECT v.id, {R('pct')} AS pct FROM {{values}} v JOIN c USING (x)""")
query("equity_gini", lambda v: inequality.gini(v, "x", "w", ["g"]), "values", sql=f"""
WITH d AS (SELECT g, x, sum(w) AS w FROM {{values}} GROUP BY g, x), c AS (SELECT *, coalesce(sum(w) OVER b, 0) AS wb, coalesce(sum(w * x) OVER b, 0) AS sb FROM d WINDOW b AS (PARTITION BY g ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT g, {R('sum(w * (x * wb - sb)) / (sum(w) * sum(w * x))')} AS gini FROM c GROUP BY g""")
query("theil_t", lambda v: inequality.theil_t(v, "x", "w"), "values", sql=f"WITH m AS (SELECT sum(x * w) / sum(w) AS m FROM {{values}}) SELECT {R('sum(CASE WHEN x > 0 THEN w * x / m * ln(x / m) ELSE 0 END) / sum(w)')} AS theil FROM {{values}}, m")
query("theil_decomposition", lambda v: inequality.theil_decomposition(v, "x", "w", "g"), "values", sql=f"""
WITH t AS (SELECT sum(x * w) AS ts, sum(w) AS tn FROM {{values}}), k AS (SELECT g, sum(x * w) AS s, sum(x * w) / sum(w) AS m, sum(w) AS n FROM {{values}} GROUP BY g),
th AS (SELECT v.g, sum(CASE WHEN x > 0 THEN w * x / m * ln(x / m) ELSE 0 END) / sum(w) AS theil FROM {{values}} v JOIN k USING (g) GROUP BY v.g)
SELECT g, {R('m')} AS mean, {R('s / ts')} AS share, {R('theil')} AS theil, {R('s / ts * theil')} AS within, {R('s / ts * ln(m / (ts / tn))')} AS "between" FROM k JOIN th USING (g), t""")
query("atkinson_index", lambda v: inequality.atkinson_index(v, "x", "w", 0.5), "values", sql=f"SELECT {R('1 - pow(sum(w * sqrt(x)) / sum(w), 2) / (sum(x * w) / sum(w))')} AS atkinson FROM {{values}}")
query("lorenz_points", lambda v: inequality.lorenz_points(v, "x", "w"), "values", sql=f"""
WITH d AS (SELECT x, sum(w) AS w FROM {{values}} GROUP BY x) SELECT {R('sum(w) OVER (ORDER BY x) / sum(w) OVER ()')} AS pop_share, {R('sum(w * x) OVER (ORDER BY x) / sum(w * x) OVER ()')} AS value_share FROM d UNION ALL SELECT 0, 0""")
query("gini_from_lorenz", lambda v: inequality.gini_from_lorenz(inequality.lorenz_points(v, "x", "w")), "values", sql=f"""
WITH d AS (SELECT x, sum(w) AS w FROM {{values}} GROUP BY x), p AS (SELECT sum(w) OVER (ORDER BY x) / sum(w) OVER () AS p, sum(w * x) OVER (ORDER BY x) / sum(w * x) OVER () AS v FROM d),
l AS (SELECT p, v, coalesce(lag(p) OVER (ORDER BY p), 0) AS p0, coalesce(lag(v) OVER (ORDER BY p), 0) AS v0 FROM p) SELECT {R('1 - sum((p - p0) * (v + v0))')} AS gini FROM l""")
query("concentration_index", lambda v: inequality.concentration_index(v, "x", "id", "w"), "values", sql=f"""
WITH p AS (SELECT sum(w) OVER (ORDER BY id) / sum(w) OVER () AS p, sum(w * x) OVER (ORDER BY id) / sum(w * x) OVER () AS v FROM {{values}}),
l AS (SELECT p, v, coalesce(lag(p) OVER (ORDER BY p), 0) AS p0, coalesce(lag(v) OVER (ORDER BY p), 0) AS v0 FROM p) SELECT {R('1 - sum((p - p0) * (v + v0))')} AS concentration FROM l""")
query("value_classes", lambda v: inequality.value_classes(v.select("id", "x"), "x", [0.0, 2500.0, 5000.0]), "values", sql=f"SELECT id, {R('x')} AS x, CAST((x > 0)::INT + (x > 2500)::INT + (x > 5000)::INT AS INT) AS class FROM {{values}}")
query("crosstab", lambda v: inequality.crosstab(v, "x", "g", "w", [0.0, 2500.0, 5000.0]), "values", sql=f"""
WITH c AS (SELECT g, CAST((x > 0)::INT + (x > 2500)::INT + (x > 5000)::INT AS INT) AS class, sum(w) AS weight FROM {{values}} GROUP BY ALL)
SELECT g, class, weight, {R('weight / sum(weight) OVER (PARTITION BY g)')} AS share, {R('weight / sum(weight) OVER (PARTITION BY g) / (sum(weight) OVER (PARTITION BY class) / sum(weight) OVER ())')} AS rep_ratio FROM c""")
query("share_below", lambda v: inequality.share_below(v, "x", 3000.0, "w"), "values", sql=f"SELECT {R('sum(w) FILTER (x < 3000) / sum(w)')} AS share FROM {{values}}")
query("share_above", lambda v: inequality.share_above(v, "x", 3000.0, "w"), "values", sql=f"SELECT {R('sum(w) FILTER (x > 3000) / sum(w)')} AS share FROM {{values}}")

# spatial weights
BAND = 60.0
D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
PAIRS = f"SELECT a.id AS i, b.id AS j, {D} AS d FROM {{points}} a JOIN {{points}} b ON a.id <> b.id AND {D} <= {BAND}"
W = f"p AS ({PAIRS}), w AS (SELECT i, j, 1.0::DOUBLE / count(*) OVER (PARTITION BY i) AS w FROM p)"
NEAR = f"SELECT a.id AS i, b.id AS j, {D} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {D}, b.id) AS rank FROM {{points}} a JOIN {{points}} b ON a.id <> b.id"
band = lambda p: weights.distance_band_weights(p, BAND)
query("knn_weights", lambda p: weights.knn_weights(p, 4), "points", sql=f"SELECT i, j, 0.25::DOUBLE AS w FROM ({NEAR}) WHERE rank <= 4")
query("distance_band_weights", lambda p: weights.distance_band_weights(p, BAND, True, False, 1.0), "points", sql=f"SELECT i, j, {R('1 / greatest(d, 1e-12) / sum(1 / greatest(d, 1e-12)) OVER (PARTITION BY i)')} AS w FROM ({PAIRS})")
query("auto_distance_band", weights.auto_distance_band, "points", sql=f"SELECT {R('max(d)')} AS band FROM ({NEAR}) WHERE rank = 1")
query("build_weights", lambda p: weights.build_weights(p, "inverse", distance=BAND, include_self=True, row_standardize_=True), "points", sql=f"SELECT i, j, {R('1 / d / sum(1 / d) OVER (PARTITION BY i)')} AS w FROM ({PAIRS}) UNION ALL SELECT id, id, 1 FROM {{points}}")
query("neighbour_counts", lambda p: weights.neighbour_counts(p, band(p)), "points", sql=f"SELECT p.id, count(j) AS n FROM {{points}} p LEFT JOIN ({PAIRS}) ON i = p.id GROUP BY p.id")

# autocorrelation

query("getis_ord", lambda p: autocorr.getis_ord(p, band(p)).drop("p"), "points", sql=f"""
WITH {W}, s AS (SELECT * FROM w UNION ALL SELECT id, id, 1.0 FROM {{points}}), m AS (SELECT avg(v) AS m, stddev_pop(v) AS sd, count(*)::DOUBLE AS n FROM {{points}}),
l AS (SELECT i, sum(w) AS sw, sum(w * w) AS sww, sum(w * v) AS lag FROM s JOIN {{points}} q ON q.id = j GROUP BY i),
z AS (SELECT i AS id, (lag - m * sw) / (sd * sqrt((n * sww - sw * sw) / (n - 1))) AS z FROM l, m)
SELECT id, {R('z')} AS z, CAST(sign(z) * CASE WHEN abs(z) > 2.5758293035489 THEN 3 WHEN abs(z) > 1.9599639845401 THEN 2 WHEN abs(z) > 1.6448536269515 THEN 1 ELSE 0 END AS INT) AS bin FROM z""")
ZXY = "z AS (SELECT id, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS zx, (v2 - avg(v2) OVER ()) / stddev_pop(v2) OVER () AS zy FROM {points}), c AS (SELECT z.id, z.zx, coalesce(sum(w * o.zy), 0) AS lag FROM z LEFT JOIN w ON i = z.id LEFT JOIN z o ON o.id = j GROUP BY z.id, z.zx)"
QUAD = "CASE WHEN zx >= 0 AND lag >= 0 THEN 'HH' WHEN zx < 0 AND lag < 0 THEN 'LL' WHEN zx >= 0 AND lag < 0 THEN 'HL' ELSE 'LH' END"
query("bivariate_lee_l", lambda p: autocorr.bivariate_lee_l(p, band(p)), "points", sql=f"WITH {W}, {ZXY} SELECT id, {R('zx * lag')} AS l, {QUAD} AS quadrant FROM c")
query("bivariate_moran", lambda p: autocorr.bivariate_moran(p, band(p)).drop("p"), "points", sql=f"""
WITH {W}, {ZXY}, a AS (SELECT avg(zx * lag) AS i, -1.0::DOUBLE / (count(*) - 1) AS e, count(*) AS n FROM c) SELECT {R('i')} AS i, {R('e')} AS expected, {R('1.0::DOUBLE / n - e * e')} AS variance, {R('(i - e) / sqrt(1.0::DOUBLE / n - e * e)')} AS z FROM a""")
query("local_bivariate_moran", lambda p: autocorr.local_bivariate_moran(p, band(p)).select("id", "i", "z"), "points", sql=f"WITH {W}, {ZXY} SELECT id, {R('zx * lag')} AS i, {R('zx * lag / sqrt(1.0::DOUBLE / (count(*) OVER () - 1))')} AS z FROM c")
query("spatial_lag", lambda p: autocorr.spatial_lag(p, band(p)), "points", sql=f"WITH {W} SELECT p.id, {R('coalesce(sum(w * o.v) / sum(w), 0)')} AS lag FROM {{points}} p LEFT JOIN w ON i = p.id LEFT JOIN {{points}} o ON o.id = j GROUP BY p.id")
SUMS = """s0 AS (SELECT sum(a.w) AS s0, sum((a.w + coalesce(b.w, 0)) * (a.w + coalesce(b.w, 0))) / 2 AS s1 FROM w a LEFT JOIN w b ON b.i = a.j AND b.j = a.i),
s2 AS (SELECT sum(t * t) AS s2 FROM (SELECT k, sum(w) AS t FROM (SELECT i AS k, w FROM w UNION ALL SELECT j, w FROM w) GROUP BY k)),
zz AS (SELECT id, v - avg(v) OVER () AS z FROM {points}), mm AS (SELECT sum(z * z) AS m2, sum(z * z * z * z) AS m4, count(*)::DOUBLE AS n FROM zz),
x AS (SELECT sum(w * a.z * b.z) AS cross_, sum(w * (a.z - b.z) * (a.z - b.z)) AS diff FROM w JOIN zz a ON a.id = i JOIN zz b ON b.id = j)"""
query("global_moran", lambda p: autocorr.global_moran(p, band(p)).drop("p"), "points", sql=f"""
WITH {W}, {SUMS}, r AS (SELECT n / s0 * cross_ / m2 AS i, -1 / (n - 1) AS e, n, s0, s1, s2, n * m4 / (m2 * m2) AS k FROM s0, s2, mm, x),
v AS (SELECT i, e, (n * ((n*n - 3*n + 3) * s1 - n * s2 + 3 * s0*s0) - k * ((n*n - n) * s1 - 2 * n * s2 + 6 * s0*s0)) / ((n-1) * (n-2) * (n-3) * s0*s0) - e * e AS var FROM r)
SELECT {R('i')} AS i, {R('e')} AS expected, {R('var')} AS variance, {R('(i - e) / sqrt(var)')} AS z FROM v""")
query("global_geary", lambda p: autocorr.global_geary(p, band(p)).drop("p"), "points", sql=f"""
WITH {W}, {SUMS}, r AS (SELECT (n - 1) * diff / (2 * s0 * m2) AS c, ((2 * s1 + s2) * (n - 1) - 4 * s0*s0) / (2 * (n + 1) * s0*s0) AS var FROM s0, s2, mm, x)
SELECT {R('c')} AS c, 1.0::DOUBLE AS expected, {R('var')} AS variance, {R('(c - 1) / sqrt(var)')} AS z FROM r""")
query("general_g", lambda p: autocorr.general_g(p.selectExpr("id", "x", "y", "v + 1 AS v"), band(p)), "points", sql=f"""
WITH {W}, y AS (SELECT id, v + 1 AS y FROM {{points}}), t AS (SELECT sum(w * a.y * b.y) AS top, sum(w) AS s0 FROM w JOIN y a ON a.id = i JOIN y b ON b.id = j), s AS (SELECT sum(y) AS s, sum(y * y) AS ss, count(*)::DOUBLE AS n FROM y)
SELECT {R('top / (s * s - ss)')} AS g, {R('s0 / (n * (n - 1))')} AS expected FROM t, s""")
query("local_moran", lambda p: autocorr.local_moran(p, band(p)).select("id", "i", "expected", "variance", "z"), "points", sql=f"""
WITH {W}, zz AS (SELECT id, v - avg(v) OVER () AS z FROM {{points}}), mm AS (SELECT avg(z * z) AS m2, avg(z * z * z * z) AS m4, count(*)::DOUBLE AS n FROM zz),
l AS (SELECT a.id, a.z, coalesce(sum(w), 0) AS sw, coalesce(sum(w * w), 0) AS sww, coalesce(sum(w * b.z), 0) AS lag FROM zz a LEFT JOIN w ON i = a.id LEFT JOIN zz b ON b.id = j GROUP BY a.id, a.z),
r AS (SELECT id, z / m2 * lag AS i, -sw / (n - 1) AS e, sww * (n - m4 / (m2 * m2)) / (n - 1) + (sw * sw - sww) * (2 * m4 / (m2 * m2) - n) / ((n - 1) * (n - 2)) - sw * sw / ((n - 1) * (n - 1)) AS var FROM l, mm)
SELECT id, {R('i')} AS i, {R('e')} AS expected, {R('var')} AS variance, {R('CASE WHEN var > 0 THEN (i - e) / sqrt(var) ELSE 0 END')} AS z FROM r""")
query("fdr_adjust", lambda v: autocorr.fdr_adjust(v.selectExpr("id", "(id * 7919 % 10007 + 1) / 10008D AS p")), "values", sql=f"""
WITH p AS (SELECT id, (id * 7919 % 10007 + 1) / 10008::DOUBLE AS p FROM {{values}}), r AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p) AS q FROM p)
SELECT id, {R('p')} AS p, {R('least(min(q) OVER (ORDER BY p DESC), 1)')} AS p_adj FROM r""")

# point patterns
query("mean_center", patterns.mean_center, "points", sql=f"SELECT {R('avg(x)')} AS x, {R('avg(y)')} AS y FROM {{points}}")
query("central_feature", lambda p: patterns.central_feature(p), "points", sql=f"SELECT a.id, {R('a.x')} AS x, {R('a.y')} AS y, {R(f'sum({D})')} AS total FROM {{points}} a, {{points}} b GROUP BY a.id, a.x, a.y ORDER BY sum({D}), a.id LIMIT 1")
query("standard_distance", patterns.standard_distance, "points", sql=f"SELECT {R('sqrt(var_pop(x) + var_pop(y))')} AS standard_distance FROM {{points}}")
query("standard_deviational_ellipse", patterns.standard_deviational_ellipse, "points", sql=f"""
WITH t AS (SELECT avg(x) AS x, avg(y) AS y, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM {{points}}), a AS (SELECT *, 0.5 * atan2(2 * xy, xx - yy) AS th FROM t)
SELECT {R('x')} AS x, {R('y')} AS y, {R('th')} AS theta, {R('sqrt(xx * cos(th) * cos(th) + 2 * xy * sin(th) * cos(th) + yy * sin(th) * sin(th))')} AS along, {R('sqrt(xx * sin(th) * sin(th) - 2 * xy * sin(th) * cos(th) + yy * cos(th) * cos(th))')} AS across FROM a""")
query("median_center", patterns.median_center, "points")
query("average_nearest_neighbor", patterns.average_nearest_neighbor, "points", sql=f"""
WITH m AS (SELECT avg(d) AS o, count(*)::DOUBLE AS n FROM ({NEAR}) WHERE rank = 1), b AS (SELECT (max(x) - min(x)) * (max(y) - min(y)) AS a FROM {{points}})
SELECT {R('o')} AS observed, {R('0.5 / sqrt(n / a)')} AS expected, {R('o / (0.5 / sqrt(n / a))')} AS ratio, {R('(o - 0.5 / sqrt(n / a)) / (0.26136 / sqrt(n * n / a))')} AS z FROM m, b""")
query("distance_band_stats", lambda p: patterns.distance_band_stats(p, 3), "points", sql=f"""
SELECT {R('min(d)')} AS min, {R('max(d)')} AS max, {R('avg(d)')} AS mean, {R('quantile_cont(d, 0.5)')} AS median, {R('quantile_cont(d, 0.25)')} AS p25, {R('quantile_cont(d, 0.75)')} AS p75 FROM ({NEAR}) WHERE rank = 3""")
query("ripleys_k", lambda p: patterns.ripleys_k(p, [20.0, 40.0, 60.0]), "points", sql=f"""
WITH b AS (SELECT count(*)::DOUBLE AS n, (max(x) - min(x)) * (max(y) - min(y)) AS a FROM {{points}}), k AS (SELECT r AS d, max(a) / (max(n) * (max(n) - 1)) * count(p.d) AS k FROM b, (VALUES (20.0::DOUBLE), (40.0::DOUBLE), (60.0::DOUBLE)) t(r) LEFT JOIN ({PAIRS}) p ON p.d <= r GROUP BY r)
SELECT d, {R('k')} AS k, {R('sqrt(k / pi())')} AS l, {R('sqrt(k / pi()) - d')} AS l_minus_d FROM k""")
query("cross_k", lambda p: patterns.cross_k(p.where("g % 2 = 0"), p.where("g % 2 = 1"), [30.0, 60.0], 500000.0), "points", sql=f"""
WITH a AS (SELECT * FROM {{points}} WHERE g % 2 = 0), b AS (SELECT * FROM {{points}} WHERE g % 2 = 1) SELECT r AS d, {R('500000.0 * count(*) FILTER (' + D + ' <= r) / ((SELECT count(*) FROM a) * (SELECT count(*) FROM b))')} AS k FROM a, b, (VALUES (30.0::DOUBLE), (60.0::DOUBLE)) t(r) GROUP BY r""")
query("linear_directional_mean", lambda p: patterns.linear_directional_mean(p.selectExpr("0D AS x0", "0D AS y0", "x AS x1", "y AS y1")), "points", sql=f"""
WITH t AS (SELECT sum(x) AS sx, sum(y) AS sy, sum(sqrt(x * x + y * y)) AS len FROM {{points}}) SELECT {R('fmod(degrees(atan2(sx, sy)) + 360, 360)')} AS direction, {R('1 - sqrt(sx * sx + sy * sy) / len')} AS variance FROM t""")
query("weighted_kde", lambda p: patterns.weighted_kde(p.where("g < 5"), p, BAND, "w") if "w" in p.columns else patterns.weighted_kde(p.where("g < 5"), p, BAND), "points", sql=f"""
SELECT a.id, {R(f'coalesce(sum(15.0 / 16 * pow(1 - pow({D} / {BAND}, 2), 2)) / {BAND * BAND}, 0)')} AS density FROM {{points}} a LEFT JOIN {{points}} b ON b.g < 5 AND {D} <= {BAND} GROUP BY a.id""")
query("similarity_search", lambda a: patterns.similarity_search(a, ["c1", "c2", "c3"], [1, 2, 3]), "alternatives", sql=f"""
WITH z AS (SELECT id, (c1 - avg(c1) OVER ()) / stddev_pop(c1) OVER () AS z1, (c2 - avg(c2) OVER ()) / stddev_pop(c2) OVER () AS z2, (c3 - avg(c3) OVER ()) / stddev_pop(c3) OVER () AS z3 FROM {{alternatives}}),
g AS (SELECT avg(z1) AS g1, avg(z2) AS g2, avg(z3) AS g3 FROM z WHERE id IN (1, 2, 3)) SELECT id, {R('sqrt(pow(z1 - g1, 2) + pow(z2 - g2, 2) + pow(z3 - g3, 2))')} AS distance FROM z, g""")
