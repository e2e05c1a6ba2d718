"""Queries of the structure families: networks, rasters, interpolation, facility location, regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from urbanloom.operators import facility, interpolation, network, raster, regression
from urbanloom.plans.registry import query
from urbanloom.plans.statistics import D

R = lambda x: f"round({x}, 6) + 0.0"

# networks
ARCS = "arcs AS (SELECT src, dst, cost FROM {edges} UNION ALL SELECT dst, src, cost FROM {edges})"


def paths(start: str, steps: int = 16) -> str:
    """CTEs with least costs from ``start`` (source, node, dist), relaxed a fixed number of times; the last is ``d``."""
    out = [ARCS, f"d0 AS ({start})"]
    out += [f"d{k + 1} AS (SELECT source, node, min(dist) AS dist FROM (SELECT * FROM d{k} UNION ALL SELECT source, dst, dist + cost FROM d{k} JOIN arcs ON src = node) GROUP BY source, node)" for k in range(steps)]
    return ", ".join([*out, f"d AS (SELECT * FROM d{steps})"])


ALL = paths("SELECT node AS source, node, 0.0::DOUBLE AS dist FROM {nodes}")
HUBS = paths("SELECT node AS source, node, 0.0::DOUBLE AS dist FROM {nodes} WHERE node IN (0, 13, 24)")
NEAREST = f"{HUBS}, n AS (SELECT node, arg_min(source, (dist, source)) AS source, min(dist) AS dist FROM d GROUP BY node)"
hubs = lambda n: n.where("node IN (0, 13, 24)").select("node")
query("many_to_many", lambda e, n: network.many_to_many(e, n.select("node")), "edges", "nodes", sql=f"WITH {ALL} SELECT source, node, dist FROM d")
query("multi_source", lambda e, n: network.multi_source(e, hubs(n)), "edges", "nodes", sql=f"WITH {NEAREST} SELECT source, node, dist FROM n")
query("closeness", lambda e, n: network.closeness(e, n.select("node")), "edges", "nodes", sql=f"WITH {ALL} SELECT source AS node, count(*) AS reach, sum(dist) AS farness, {R('count(*) / sum(dist) * count(*) / 24')} AS closeness, {R('sum(1 / dist)')} AS harmonic FROM d WHERE source <> node GROUP BY source")
query("gravity_centrality", lambda e, n: network.gravity_centrality(e, n.select("node"), n.select("node", "w"), 8.0, 0.1), "edges", "nodes", sql=f"WITH {ALL} SELECT source AS node, {R('sum(w * exp(-0.1 * dist))')} AS gravity FROM d JOIN {{nodes}} t ON t.node = d.node WHERE dist <= 8 GROUP BY source")
query("service_area", lambda e, n: network.service_area(e, hubs(n), n.select("node", "pop"), [3.0, 6.0]), "edges", "nodes", sql=f"WITH {NEAREST} SELECT t AS threshold, count(*) AS nodes, sum(pop) AS pop, {R('sum(pop) / (SELECT sum(pop) FROM {nodes})')} AS share FROM n JOIN {{nodes}} USING (node), (VALUES (3.0::DOUBLE), (6.0::DOUBLE)) v(t) WHERE dist <= t GROUP BY t")
query("network_voronoi", lambda e, n: network.voronoi(e, hubs(n), n.select("node", "pop")), "edges", "nodes", sql=f"WITH {NEAREST} SELECT source, count(*) AS nodes, sum(pop) AS demand, {R('sum(pop * dist) / sum(pop)')} AS mean, max(dist) AS farthest FROM n JOIN {{nodes}} USING (node) GROUP BY source")
LOW = "arcs AS (SELECT src, dst FROM {edges} WHERE lts <= 2 UNION ALL SELECT dst, src FROM {edges} WHERE lts <= 2), c0 AS (SELECT node, node AS c FROM {nodes}), " + ", ".join(f"c{k + 1} AS (SELECT a.node, least(a.c, coalesce(min(b.c), a.c)) AS c FROM c{k} a LEFT JOIN arcs ON src = a.node LEFT JOIN c{k} b ON b.node = dst GROUP BY a.node, a.c)" for k in range(14))
query("connected_components", lambda e, n: network.connected_components(e.where("lts <= 2"), n.select("node")), "edges", "nodes", sql=f"WITH {LOW} SELECT node, c AS component FROM c14")
query("low_stress_islands", lambda e, n: network.low_stress_islands(e, n.select("node")), "edges", "nodes", sql=f"WITH {LOW}, l AS (SELECT c, sum(cost) AS length FROM {{edges}} JOIN c14 ON node = src WHERE lts <= 2 GROUP BY c) SELECT c14.c AS component, count(*) AS nodes, coalesce(max(length), 0) AS length FROM c14 LEFT JOIN l ON l.c = c14.c GROUP BY c14.c")
query("street_morphometry", network.morphometry, "edges", "nodes", sql=f"""
WITH {ARCS}, k AS (SELECT node, count(src) AS k FROM {{nodes}} LEFT JOIN arcs ON src = node GROUP BY node), n AS (SELECT count(*)::DOUBLE AS n, avg(k) AS a, avg((k = 1)::INT) AS d, avg((k >= 3)::INT) AS c FROM k), e AS (SELECT count(*)::DOUBLE AS e, avg(cost) AS l FROM {{edges}})
SELECT n, e, {R('a')} AS mean_degree, {R('l')} AS mean_length, {R('(e - n + 1) / (2 * n - 5)')} AS meshedness, {R('d')} AS dead_ends, {R('c')} AS crossings FROM n, e""")
# each step is taken for as long as the one before changed the ranks by a millionth in all
PR = f"{ARCS}, p AS MATERIALIZED (SELECT src, dst, 1 / cost / sum(1 / cost) OVER (PARTITION BY src) AS p FROM arcs), r0 AS (SELECT node, 1.0::DOUBLE / 25 AS r, 1.0::DOUBLE AS d FROM {{nodes}}), " + ", ".join(f"s{k} AS (SELECT dst AS node, 0.15 / 25 + 0.85 * sum(r * p) AS r FROM r{k} JOIN p ON src = node GROUP BY dst), r{k + 1} AS MATERIALIZED (SELECT node, CASE WHEN o.d < 1e-6 THEN o.r ELSE s.r END AS r, CASE WHEN o.d < 1e-6 THEN o.d ELSE sum(abs(s.r - o.r)) OVER () END AS d FROM r{k} o JOIN s{k} s USING (node))" for k in range(100))
query("pagerank", lambda e, n: network.pagerank(e, n.select("node")), "edges", "nodes", sql=f"WITH {PR} SELECT node, {R('r')} AS rank FROM r100")
# the largest eigenvector of a 5 x 5 grid is known
query("eigenvector", lambda e, n: network.eigenvector(e, n.select("node")), "edges", "nodes", sql=f"SELECT node, {R('sin(pi() * (1 + node % 5) / 6) * sin(pi() * (1 + node // 5) / 6)')} AS value FROM {{nodes}}")
query("probability_of_connectivity", lambda e, n: network.probability_of_connectivity(e.where("lts <= 2"), n.selectExpr("node", "pop AS area")), "edges", "nodes", sql=f"WITH {LOW}, s AS (SELECT c, sum(pop) AS a FROM c14 JOIN {{nodes}} USING (node) GROUP BY c) SELECT {R('sum(a * a) / pow(sum(a), 2)')} AS pc, count(*) AS components FROM s")
query("critical_bottlenecks", lambda e: network.bottlenecks(e.selectExpr("src * 100 + dst AS edge", "cost * 3 AS pre", "cost * cost + lts AS post"), 10), "edges", sql="SELECT src * 100 + dst AS edge, greatest(cost * cost + lts - cost * 3, 0) AS growth FROM {edges} ORDER BY growth DESC, edge LIMIT 10")
query("debris_priority", lambda e: network.debris_priority(e.selectExpr("src * 100 + dst AS edge", "cost AS volume", "CAST(lts AS DOUBLE) AS criticality")), "edges", sql=f"WITH p AS (SELECT src * 100 + dst AS edge, lts / (cost + 1e-6) AS p FROM {{edges}}) SELECT edge, {R('p')} AS priority, CAST(row_number() OVER (ORDER BY p DESC, edge) AS INT) AS rank FROM p")

# rasters
N9 = "WITH n AS (SELECT a.r, a.c, a.z AS n4, " + ", ".join(f"max(b.z) FILTER (b.r = a.r + {i} AND b.c = a.c + {j}) AS n{k}" for k, (i, j) in enumerate(raster.OFFSETS) if k != 4) + " FROM {cells} a LEFT JOIN {cells} b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.r, a.c, a.z)"
V = [f"coalesce(n{k}, n4)" for k in range(9)]
GRAD = f"g AS (SELECT r, c, (({V[2]} + 2 * {V[5]} + {V[8]}) - ({V[0]} + 2 * {V[3]} + {V[6]})) / 80 AS dx, (({V[6]} + 2 * {V[7]} + {V[8]}) - ({V[0]} + 2 * {V[1]} + {V[2]})) / 80 AS dy FROM n)"
query("raster_slope", lambda c: raster.slope(c, 10.0), "cells", sql=f"{N9}, {GRAD} SELECT r, c, {R('degrees(atan(sqrt(dx * dx + dy * dy)))')} AS slope, {R('CASE WHEN dx = 0 AND dy = 0 THEN -1 ELSE fmod(degrees(atan2(-dx, dy)) + 360, 360) END')} AS aspect FROM g")
query("local_relief", raster.local_relief, "cells", sql=f"{N9} SELECT r, c, {R('greatest(n0, n1, n2, n3, n4, n5, n6, n7, n8) - least(n0, n1, n2, n3, n4, n5, n6, n7, n8)')} AS relief FROM n")
DROPS = [(code, f"(n4 - n{raster.OFFSETS.index((i, j))}) / {1.0 if i == 0 or j == 0 else 2 ** 0.5}") for code, i, j in raster.D8]
MAXD = "greatest(0, " + ", ".join(f"coalesce({x}, 0)" for _, x in DROPS) + ")"
D8 = "CASE WHEN m <= 0 THEN 0 " + " ".join(f"WHEN {x} = m THEN {code}" for code, x in DROPS) + " END"
FLOW = f"{N9}, m AS (SELECT *, {MAXD} AS m FROM n), f AS (SELECT r, c, CAST({D8} AS INT) AS dir FROM m)"
query("d8_flow", raster.d8_flow, "cells", sql=f"{FLOW} SELECT r, c, dir FROM f")
TO = "CASE dir " + " ".join(f"WHEN {code} THEN (r + {i}) * 1000 + c + {j}" for code, i, j in raster.D8) + " END"
ACC = ", ".join(f"a{k + 1} AS (SELECT x.k, y.t AS t, x.n + coalesce(g, 0) AS n FROM a{k} x LEFT JOIN a{k} y ON y.k = x.t LEFT JOIN (SELECT t, sum(n) AS g FROM a{k} WHERE t IS NOT NULL GROUP BY t) z ON z.t = x.k)" for k in range(8))
query("flow_accumulation", raster.flow_accumulation, "cells", sql=f"{FLOW}, a0 AS (SELECT r * 1000 + c AS k, {TO} AS t, 1::BIGINT AS n FROM f), {ACC} SELECT CAST(k // 1000 AS INT) AS r, CAST(k % 1000 AS INT) AS c, CAST(n AS BIGINT) AS n FROM a8")
CLS = "cells AS (SELECT r, c, z, CAST(a AS INT) % 4 AS k1, CAST(b * 7 AS INT) % 4 AS k2 FROM {cells})"
kinds = lambda c: c.selectExpr("r", "c", "z", "CAST(a AS INT) % 4 AS k1", "CAST(round(b * 7) AS INT) % 4 AS k2")
query("change_matrix", lambda c: raster.change_matrix(kinds(c), "k1", "k2"), "cells", sql=f"WITH {CLS} SELECT k1 AS before, k2 AS after, count(*) AS cells FROM cells GROUP BY ALL")
query("transition_probabilities", lambda c: raster.transition_probabilities(kinds(c), "k1", "k2"), "cells", sql=f"WITH {CLS} SELECT k1 AS before, k2 AS after, count(*) AS cells, {R('count(*) / sum(count(*)) OVER (PARTITION BY k1)')} AS p FROM cells GROUP BY k1, k2")
query("edge_length", lambda c: raster.edge_length(c.withColumn("m", F.col("z") > 1000), "m", 10.0), "cells", sql="SELECT round(10.0 * count(*), 6) + 0.0 AS edge FROM {cells} a JOIN {cells} b ON (b.r = a.r AND b.c = a.c + 1) OR (b.r = a.r + 1 AND b.c = a.c) WHERE (a.z > 1000) <> (b.z > 1000)")
query("landslide_susceptibility", lambda c: raster.landslide_susceptibility(c.withColumn("s", F.col("a") * 2).withColumn("l", F.col("b") * 100), 10.0, "s", "l"), "cells", sql=f"{N9}, {GRAD} SELECT g.r, g.c, {R('0.5 * least(greatest((degrees(atan(sqrt(dx * dx + dy * dy))) - 5) / 30 * 100, 0), 100) + 0.25 * a * 2 + 0.25 * b * 100')} AS score FROM g JOIN {{cells}} k ON k.r = g.r AND k.c = g.c")

# interpolation
query("idw", lambda p: interpolation.idw(p.where("g < 5"), p.where("g >= 5"), 2.0, 12), "points", sql=f"""
WITH s AS (SELECT * FROM {{points}} WHERE g < 5), n AS (SELECT a.id, b.v, {D} AS d FROM {{points}} a, s b WHERE a.g >= 5 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {D}, b.id) <= 12)
SELECT id, {R('sum(v / (d * d)) / sum(1 / (d * d))')} AS value FROM n GROUP BY id""")
query("space_time_weighting", lambda p: interpolation.space_time_weighting(p.where("g < 5").withColumn("t", (F.col("id") % 30).cast("double")), p.where("g >= 5").withColumn("t", (F.col("id") % 20).cast("double")), 20.0, 10.0), "points", sql=f"""
WITH n AS (SELECT a.id, b.v, exp(-sqrt(pow({D} / 20, 2) + pow((a.id % 20 - b.id % 30) / 10.0, 2))) AS w FROM {{points}} a, {{points}} b WHERE a.g >= 5 AND b.g < 5)
SELECT id, {R('sum(w * v) / sum(w)')} AS value, {R('1 - max(w) / sum(w)')} AS variance FROM n GROUP BY id""")

# facility location
cand = lambda p: p.where("g < 2").select("id", "x", "y")
people = lambda p: p.selectExpr("id", "x", "y", "CAST(1 + id % 9 AS DOUBLE) AS pop")
query("greedy_mclp", lambda p: facility.greedy_mclp(cand(p), people(p), 80.0, 5), "points")
query("greedy_lscp", lambda p: facility.greedy_lscp(cand(p), people(p), 150.0, 0.7), "points")
query("greedy_p_median", lambda p: facility.greedy_p_median(cand(p), people(p), 3), "points")
query("assign_to_nearest", lambda p: facility.assign_to_nearest(cand(p), people(p)), "points", sql=f"""
SELECT a.id, b.id AS facility, {R(D)} AS d FROM {{points}} a, {{points}} b WHERE b.g < 2 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {D}, b.id) = 1""")
query("label_components", lambda c: facility.label_components(c.withColumn("m", F.col("a") > 30), "m", 4), "cells")
query("rank_sites", lambda c: facility.rank_sites(c, facility.label_components(c.withColumn("m", F.col("a") > 30), "m", 4), 100.0), "cells")

# regression
XY = "SELECT u AS x1, v AS x2, s + 3 * u - 2 * v AS y FROM {plots}"
query("ols", lambda p: regression.ols(p.selectExpr("u AS x1", "s + 3 * u - 2 * v AS y"), "y", ["x1"]).select("term", "beta", "r2"), "plots", sql=f"WITH d AS ({XY}) SELECT 'intercept' AS term, {R('regr_intercept(y, x1)')} AS beta, {R('regr_r2(y, x1)')} AS r2 FROM d UNION ALL SELECT 'x1', {R('regr_slope(y, x1)')}, {R('regr_r2(y, x1)')} FROM d")
query("land_value_uplift", lambda p: regression.difference_in_differences(p.withColumn("t", F.col("u") > 0.5).withColumn("after", F.col("price") * (1 + 0.1 * F.col("v")) + F.when(F.col("u") > 0.5, 50).otherwise(0)), "price", "after", "t"), "plots", sql=f"""
WITH d AS (SELECT price AS b, price * (1 + 0.1 * v) + CASE WHEN u > 0.5 THEN 50 ELSE 0 END AS a, u > 0.5 AS t FROM {{plots}}), m AS (SELECT avg(b) FILTER (t) AS tb, avg(a) FILTER (t) AS ta, avg(b) FILTER (NOT t) AS cb, avg(a) FILTER (NOT t) AS ca, count(*) FILTER (t) AS n FROM d)
SELECT {R('ta - tb - (ca - cb)')} AS att, {R('(ta - tb - (ca - cb)) / tb * 100')} AS pct, {R('greatest((ta - tb - (ca - cb)) * n, 0)')} AS captured FROM m""")
query("comparable_sales", lambda p: regression.comparable_sales({"x": 0.0, "y": 0.0, "v": 0.1, "v2": 0.0}, p, ["v", "v2"], 10), "points", sql=f"""
WITH d AS (SELECT id, sqrt(x * x + y * y) AS ds, sqrt(pow((v - 0.1) / stddev_pop(v) OVER (), 2) + pow(v2 / stddev_pop(v2) OVER (), 2)) AS df FROM {{points}}), s AS (SELECT id, 0.5 * ds / max(ds) OVER () + 0.5 * df / max(df) OVER () AS score FROM d) SELECT id, {R('score')} AS score FROM s ORDER BY s.score, id LIMIT 10""")
