"""Queries of networks from lines, paths and what runs over them, on blocks of streets whose number grows with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from urbanloom.core.graph import both_ways
from urbanloom.functions import geometry as G
from urbanloom.operators import routes, streets
from urbanloom.plans.registry import query

R = lambda x: f"round({x}, 6) + 0.0"
E, N = "block_edges", "block_nodes"
nodes_ = lambda n: n.select("node")
edges_ = lambda e: e.select("edge", "src", "dst", "cost")
#: Middles of blocks, and corners.
hubs = lambda n: n.where("node % 25 IN (0, 12, 24)").select("node")

# geometry of rings
ring = lambda c: G.points_of(c, "id").where("size(coords) = 4")
RING = "q AS (SELECT id, count(*) AS n, max(x) FILTER (seq = 0) AS x0, max(y) FILTER (seq = 0) AS y0, max(x) FILTER (seq = 1) AS x1, max(y) FILTER (seq = 1) AS y1, max(x) FILTER (seq = 2) AS x2, max(y) FILTER (seq = 2) AS y2, max(x) FILTER (seq = 3) AS x3, max(y) FILTER (seq = 3) AS y3 FROM {corners} GROUP BY id HAVING count(*) = 4)"
hop = lambda a, b: f"sqrt(pow(x{b} - x{a}, 2) + pow(y{b} - y{a}, 2))"
_around = " + ".join(hop(k, (k + 1) % 4) for k in range(4))
_shoe = "abs(" + " + ".join(f"x{k} * y{(k + 1) % 4} - x{(k + 1) % 4} * y{k}" for k in range(4)) + ") / 2"
_bear = lambda a, b: f"degrees(atan2(y{b} - y{a}, x{b} - x{a}))"
_fold = lambda d: f"(CASE WHEN fmod(abs({d}), 360) > 180 THEN 360 - fmod(abs({d}), 360) ELSE fmod(abs({d}), 360) END)"
query("ring_measures", lambda c: ring(c).select("id", G.ring_area(F.col("coords")).alias("area"), G.ring_perimeter(F.col("coords")).alias("perimeter"), G.polyline_length(F.col("coords")).alias("length"), G.internal_curvature(F.col("coords")).alias("curvature"), G.projected_width(F.col("coords"), 30.0).alias("width")), "corners", sql=f"""
WITH {RING}, p AS (SELECT id, unnest([x0 * cos(radians(30)) - y0 * sin(radians(30)), x1 * cos(radians(30)) - y1 * sin(radians(30)), x2 * cos(radians(30)) - y2 * sin(radians(30)), x3 * cos(radians(30)) - y3 * sin(radians(30))]) AS p FROM q), w AS (SELECT id, max(p) - min(p) AS w FROM p GROUP BY id)
SELECT id, {R(_shoe)} AS area, {R(_around)} AS perimeter, {R(' + '.join(hop(k, k + 1) for k in range(3)))} AS length, {R(f'{_fold(_bear(0, 1) + " - " + _bear(1, 2))} + {_fold(_bear(1, 2) + " - " + _bear(2, 3))}')} AS curvature, {R('w')} AS width FROM q JOIN w USING (id)""")
_turn = lambda a, b, c: f"CASE WHEN degrees(abs(atan2((x{b} - x{a}) * (y{c} - y{b}) - (y{b} - y{a}) * (x{c} - x{b}), (x{b} - x{a}) * (x{c} - x{b}) + (y{b} - y{a}) * (y{c} - y{b})))) >= 75 THEN 1 ELSE 0 END"
query("corner_count", lambda c: ring(c).select("id", G.corner_count(F.col("coords"), 75.0).alias("corners")), "corners", sql=f"WITH {RING} SELECT id, CAST({' + '.join(_turn((k - 1) % 4, k, (k + 1) % 4) for k in range(4))} AS INT) AS corners FROM q")
_dir = [f"(x{(k + 1) % 4} - x{k}) / {hop(k, (k + 1) % 4)} AS ux{k}, (y{(k + 1) % 4} - y{k}) / {hop(k, (k + 1) % 4)} AS uy{k}" for k in range(4)]
_rects = " UNION ALL ".join(f"SELECT id, greatest({', '.join(f'x{m} * ux{k} + y{m} * uy{k}' for m in range(4))}) - least({', '.join(f'x{m} * ux{k} + y{m} * uy{k}' for m in range(4))}) AS w, greatest({', '.join(f'y{m} * ux{k} - x{m} * uy{k}' for m in range(4))}) - least({', '.join(f'y{m} * ux{k} - x{m} * uy{k}' for m in range(4))}) AS h FROM u" for k in range(4))
query("shape_metrics", lambda c: ring(c).select("id", *G.shape_metrics(F.col("coords"))).select("id", "area", "ipq", "convexity", "rectangularity", "elongation", "length", "width", "fractal"), "corners", sql=f"""
WITH {RING}, u AS (SELECT *, {', '.join(_dir)} FROM q), r AS ({_rects}), b AS (SELECT id, arg_min(greatest(w, h), w * h) AS l, arg_min(least(w, h), w * h) AS t FROM r GROUP BY id), m AS (SELECT id, {_shoe} AS a, {_around} AS p FROM q)
SELECT id, {R('a')} AS area, {R('4 * pi() * a / (p * p)')} AS ipq, 1.0::DOUBLE AS convexity, {R('a / (l * t)')} AS rectangularity, {R('1 - t / l')} AS elongation, {R('l')} AS length, {R('t')} AS width, {R('2 * ln(p / 4) / ln(a)')} AS fractal FROM m JOIN b USING (id)""")
query("convex_hull", lambda c: ring(c).select("id", F.size(G.convex_hull("coords")).alias("corners")), "corners", sql=f"WITH {RING} SELECT id, 4 AS corners FROM q")
query("point_at", lambda c: ring(c).select("id", G.point_at(F.col("coords"), F.lit(0.5)).alias("p")).select("id", "p.x", "p.y"), "corners", sql=f"""
WITH {RING}, l AS (SELECT *, {hop(0, 1)} AS a, {hop(1, 2)} AS b, {hop(2, 3)} AS c FROM q), h AS (SELECT *, (a + b + c) / 2 AS s FROM l)
SELECT id, {R('CASE WHEN s < a THEN x0 + s / a * (x1 - x0) WHEN s < a + b THEN x1 + (s - a) / b * (x2 - x1) ELSE x2 + (s - a - b) / c * (x3 - x2) END')} AS x, {R('CASE WHEN s < a THEN y0 + s / a * (y1 - y0) WHEN s < a + b THEN y1 + (s - a) / b * (y2 - y1) ELSE y2 + (s - a - b) / c * (y3 - y2) END')} AS y FROM h""")
query("cut_polyline", lambda c: ring(c).select("id", G.cut_polyline(F.col("coords"), F.lit(0.2), F.lit(0.7)).alias("c")).select("id", G.polyline_length(F.col("c")).alias("length")), "corners", sql=f"WITH {RING} SELECT id, {R(f'0.5 * ({hop(0, 1)} + {hop(1, 2)} + {hop(2, 3)})')} AS length FROM q")

# lines of three points, the middle one off the straight
LINES = "SELECT e.edge, a.x AS ax, a.y AS ay, (a.x + b.x) / 2 + 0.1 * e.shade AS mx, (a.y + b.y) / 2 + 0.05 AS my, b.x AS bx, b.y AS by_ FROM {block_edges} e JOIN {block_nodes} a ON a.node = e.src JOIN {block_nodes} b ON b.node = e.dst"


def lines(e, n):
    a, b = n.select(F.col("node").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay")), n.select(F.col("node").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by_"))
    p = lambda x, y: F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"))
    return e.join(a, "src").join(b, "dst").select(F.col("edge").alias("id"), F.array(p("ax", "ay"), p("(ax + bx) / 2 + 0.1D * shade", "(ay + by_) / 2 + 0.05D"), p("bx", "by_")).alias("coords"))


_len = "sqrt(pow(mx - ax, 2) + pow(my - ay, 2)) + sqrt(pow(bx - mx, 2) + pow(by_ - my, 2))"
ENDS = f"l AS ({LINES}), e AS (SELECT edge, 0 AS k, ax AS x, ay AS y FROM l UNION ALL SELECT edge, 1, bx, by_ FROM l), f AS (SELECT x, y, min(edge * 2 + k) AS o FROM e GROUP BY x, y), n AS (SELECT *, row_number() OVER (ORDER BY o) - 1 AS node FROM f)"
query("build_graph_edges", lambda e, n: streets.build_graph(lines(e, n))[1], E, N, sql=f"WITH {ENDS} SELECT l.edge, a.node AS src, b.node AS dst, {R(_len)} AS cost, {R(_len)} AS len FROM l JOIN n a ON a.x = ax AND a.y = ay JOIN n b ON b.x = bx AND b.y = by_")
query("build_graph_nodes", lambda e, n: streets.build_graph(lines(e, n))[0], E, N, sql=f"WITH {ENDS} SELECT node, {R('x')} AS x, {R('y')} AS y FROM n")
query("graph_size", lambda e, n: streets.graph_size(n, e), E, N, sql="SELECT (SELECT count(*) FROM {block_nodes}) AS nodes, (SELECT count(*) FROM {block_edges}) AS edges")
query("node_degrees", lambda e, n: streets.degrees(n, e), E, N, sql="SELECT node, (SELECT count(*) FROM {block_edges} WHERE src = node) + (SELECT count(*) FROM {block_edges} WHERE dst = node) AS degree FROM {block_nodes}")
query("adjacency", lambda e: streets.adjacency(e), E, sql="SELECT src, dst, edge, cost FROM {block_edges} UNION ALL SELECT dst, src, edge, cost FROM {block_edges}")
query("nearest_nodes", lambda p, n: streets.nearest_nodes(n.selectExpr("node", "x * 5 AS x", "y * 50 AS y"), p), "points", N, sql=f"""
SELECT p.id, arg_min(n.node, (sqrt(pow(p.x - n.x * 5, 2) + pow(p.y - n.y * 50, 2)), n.node)) AS node, {R('min(sqrt(pow(p.x - n.x * 5, 2) + pow(p.y - n.y * 50, 2)))')} AS d FROM {{points}} p, {{block_nodes}} n GROUP BY p.id""")
_tw = lambda d: f"(CASE WHEN fmod(abs({d}), 360) > 180 THEN 360 - fmod(abs({d}), 360) ELSE fmod(abs({d}), 360) END / 90)"
SEG = f"l AS ({LINES}), m AS (SELECT *, {_len} AS len, {_tw('degrees(atan2(my - ay, mx - ax)) - degrees(atan2(by_ - my, bx - mx))')} AS curve FROM l), e AS (SELECT edge, len, curve, ax AS x, ay AS y, degrees(atan2(my - ay, mx - ax)) AS b FROM m UNION ALL SELECT edge, len, curve, bx, by_, degrees(atan2(my - by_, mx - bx)) FROM m)"
SEG_ARCS = f"{SEG}, t AS (SELECT s.edge AS src, o.edge AS dst, CASE WHEN s.edge < o.edge THEN {_tw('s.b + 180 - o.b')} ELSE {_tw('o.b + 180 - s.b')} END + (s.curve + o.curve) / 2 AS cost, (s.len + o.len) / 2 AS metric FROM e s JOIN e o ON s.x = o.x AND s.y = o.y AND s.edge <> o.edge)"
query("segment_graph", lambda e, n: streets.segment_graph(lines(e, n)), E, N, sql=f"WITH {SEG_ARCS} SELECT src, dst, {R('cost')} AS cost, {R('metric')} AS metric FROM t")
query("segment_connectivity", lambda e, n: streets.segment_connectivity(lines(e, n), streets.segment_graph(lines(e, n))), E, N, sql=f"WITH {SEG_ARCS} SELECT l.edge AS id, count(DISTINCT dst) AS connectivity FROM l LEFT JOIN t ON src = l.edge GROUP BY l.edge")
query("segment_analysis", lambda e, n: routes.segment_analysis(streets.segment_graph(lines(e, n)), e.select(F.col("edge").alias("id")), 2.5), E, N)
axial = lambda p: p.selectExpr("id", "u * 100 + 300 * floor((id - 1) / 40) AS x0", "v * 100 AS y0", "w * 100 + 300 * floor((id - 1) / 40) AS x1", "q * 100 AS y1")
AXIAL = "a AS (SELECT id, u * 100 + 300 * floor((id - 1) / 40) AS x0, v * 100 AS y0, w * 100 + 300 * floor((id - 1) / 40) AS x1, q * 100 AS y1 FROM {plots}), h AS (SELECT a.*, b.id AS o, ((b.x1 - b.x0) * (a.y0 - b.y0) - (b.y1 - b.y0) * (a.x0 - b.x0)) / d AS ua, ((a.x1 - a.x0) * (a.y0 - b.y0) - (a.y1 - a.y0) * (a.x0 - b.x0)) / d AS ub FROM (SELECT a.id AS i, b.id AS k, (b.y1 - b.y0) * (a.x1 - a.x0) - (b.x1 - b.x0) * (a.y1 - a.y0) AS d FROM a JOIN a b ON a.id <> b.id AND floor((a.id - 1) / 40) = floor((b.id - 1) / 40)) JOIN a ON a.id = i JOIN a b ON b.id = k WHERE abs(d) >= 1e-6)"
query("axial_segments", lambda p: streets.split_axial(axial(p)).groupBy("id").agg(F.count("*").alias("parts"), F.sum(F.expr("sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))")).alias("length")), "plots", sql=f"""
WITH {AXIAL}, s AS (SELECT id, x0 AS x, y0 AS y FROM a UNION SELECT id, x1, y1 FROM a UNION SELECT id, round(x0 + ua * (x1 - x0), 6), round(y0 + ua * (y1 - y0), 6) FROM h WHERE ua BETWEEN 0 AND 1 AND ub BETWEEN 0 AND 1),
o AS (SELECT s.*, lead(s.x) OVER w AS nx, lead(s.y) OVER w AS ny FROM s JOIN a USING (id) WINDOW w AS (PARTITION BY id ORDER BY (s.x - x0) * (x1 - x0) + (s.y - y0) * (y1 - y0), s.x, s.y)) SELECT id, count(*) AS parts, {R('sum(sqrt(pow(nx - x, 2) + pow(ny - y, 2)))')} AS length FROM o WHERE pow(nx - x, 2) + pow(ny - y, 2) > 1e-6 GROUP BY id""")
straight = lambda e, n: e.join(n.select(F.col("node").alias("src"), F.col("x").alias("x0"), F.col("y").alias("y0")), "src").join(n.select(F.col("node").alias("dst"), F.col("x").alias("x1"), F.col("y").alias("y1")), "dst").select(F.col("edge").alias("id"), "x0", "y0", "x1", "y1")
query("angular_centrality", lambda e, n: routes.angular_centrality(straight(e, n), 3.0), E, N)

# directions
query("compass_entropy", lambda e, n: streets.compass_entropy(n.withColumn("x", F.col("x") + F.col("pop") * 0.01), e, 36), E, N, sql=f"""
WITH n AS (SELECT node, x + pop * 0.01 AS x, y FROM {{block_nodes}}), a AS (SELECT src, dst FROM {{block_edges}} UNION ALL SELECT dst, src FROM {{block_edges}}), b AS (SELECT least(35, floor(fmod(degrees(atan2(q.x - p.x, q.y - p.y)) + 360, 360) / 10)) AS b FROM a JOIN n p ON p.node = src JOIN n q ON q.node = dst), c AS (SELECT count(*)::DOUBLE AS c FROM b GROUP BY b)
SELECT {R('-sum(c / (SELECT sum(c) FROM c) * ln(c / (SELECT sum(c) FROM c))) / ln(36)')} AS entropy FROM c""")
_rose = "d AS (SELECT u - 0.5 AS dx, v - 0.5 AS dy FROM {plots} WHERE sqrt(pow(u - 0.5, 2) + pow(v - 0.5, 2)) > 1e-9), a AS (SELECT sqrt(dx * dx + dy * dy) AS l, fmod(degrees(atan2(dy, dx)) + 360, 180) AS a FROM d), b AS (SELECT l, a FROM a UNION ALL SELECT l, fmod(a + 180, 360) FROM a), c AS (SELECT CAST(least(35, floor(a / 10)) AS INT) AS bin, count(*) AS n, sum(l) AS length FROM b GROUP BY 1)"
query("orientation_rose", lambda p: streets.rose(p.selectExpr("0.5D AS x0", "0.5D AS y0", "u AS x1", "v AS y1")).select("bin", "n", "length", "anisotropy"), "plots", sql=f"WITH {_rose}, t AS (SELECT sum(length) AS t FROM c), h AS (SELECT -sum(length / t * ln(length / t)) AS h FROM c, t) SELECT bin, n, {R('length')} AS length, {R('1 - h / ln(36)')} AS anisotropy FROM c, h")
query("orientation_order", lambda p: streets.orientation_order(p.selectExpr("u * 360 AS b", "1 + v AS len")), "plots", sql=f"""
WITH b AS (SELECT fmod(u * 360, 360) AS a, 1 + v AS l FROM {{plots}} UNION ALL SELECT fmod(u * 360 + 180, 360), 1 + v FROM {{plots}}), c AS (SELECT least(35, floor(fmod(a + 5, 360) / 10)) AS b, sum(l) AS l FROM b GROUP BY 1), h AS (SELECT -sum(l / (SELECT sum(l) FROM c) * ln(l / (SELECT sum(l) FROM c))) AS h FROM c)
SELECT {R('h')} AS entropy, {R('greatest(0, least(1, 1 - pow((h - ln(4)) / (ln(36) - ln(4)), 2)))')} AS "order" FROM h""")
query("dead_ends", lambda e, n: streets.dead_ends(n, e), E, N, sql=f"WITH d AS (SELECT node, (SELECT count(*) FROM {{block_edges}} WHERE src = node) + (SELECT count(*) FROM {{block_edges}} WHERE dst = node) AS d FROM {{block_nodes}}) SELECT count(*) FILTER (d = 1) AS dead_ends, {R('avg((d = 1)::INT)')} AS share FROM d")

# reach: least costs within blocks, relaxed as often as a block has nodes on a path
ARCS = "arcs AS (SELECT edge, src, dst, cost, lts FROM {block_edges} UNION ALL SELECT edge, dst, src, cost, lts FROM {block_edges})"


def paths(start: str, steps: int = 14, arcs: str = "arcs", name: str = "d") -> str:
    out = [f"{name}0 AS ({start})"]
    out += [f"{name}{k + 1} AS MATERIALIZED (SELECT source, node, min(dist) AS dist FROM (SELECT * FROM {name}{k} UNION ALL SELECT source, dst, dist + cost FROM {name}{k} JOIN {arcs} ON src = node) GROUP BY source, node)" for k in range(steps)]
    return ", ".join([*out, f"{name} AS (SELECT * FROM {name}{steps})"])


START = "SELECT node AS source, node, 0.0::DOUBLE AS dist FROM {block_nodes}"
ALL = f"{ARCS}, {paths(START)}"
HUBS = f"{ARCS}, {paths(START + ' WHERE node % 25 IN (0, 12, 24)')}"
query("block_many_to_many", lambda e, n: routes.path_tree(edges_(e), hubs(n)).select("source", "node", "dist"), E, N, sql=f"WITH {HUBS} SELECT source, node, dist FROM d")
query("straightness", lambda e, n: streets.straightness(e, n), E, N, sql=f"""
WITH {ALL} SELECT n.node, {R('coalesce(avg(sqrt(pow(n.x - m.x, 2) + pow(n.y - m.y, 2)) / dist), 0)')} AS straightness FROM {{block_nodes}} n LEFT JOIN d ON source = n.node AND d.node <> n.node LEFT JOIN {{block_nodes}} m ON m.node = d.node GROUP BY n.node""")
query("route_circuity", lambda e, n: streets.circuity(e, n, 2000), E, N)
query("intersection_profile", lambda e, n: streets.intersection_profile(e, n, 6.0), E, N, sql=f"""
WITH {ALL}, s AS (SELECT n.node, count(d.node) AS reached, coalesce(avg(dist), 0) AS mean FROM {{block_nodes}} n LEFT JOIN d ON source = n.node AND d.node <> n.node AND dist <= 6 GROUP BY n.node) SELECT node, reached, {R('mean')} AS mean, {R('CASE WHEN mean > 0 THEN reached / mean ELSE 0 END / max(CASE WHEN mean > 0 THEN reached / mean ELSE 0 END) OVER () * 100')} AS score FROM s""")
HOPS = f"arcs AS (SELECT src, dst, 1.0::DOUBLE AS cost FROM {{block_edges}} UNION ALL SELECT dst, src, 1.0 FROM {{block_edges}}), {paths(START, 9)}"
query("hop_integration", lambda e, n: streets.hop_integration(e, n), E, N, sql=f"""
WITH {HOPS}, n AS (SELECT count(*)::DOUBLE AS n FROM {{block_nodes}}), s AS (SELECT source AS node, sum(dist) / max(n) AS m, sum(CASE WHEN dist <= 3 THEN dist ELSE 0 END) / max(n) AS l FROM d, n GROUP BY source), t AS (SELECT node, CASE WHEN m = 0 THEN 1 ELSE m END AS m, CASE WHEN l = 0 THEN 1 ELSE l END AS l, n FROM s, n),
r AS (SELECT *, 2 * (m - 1) / greatest(1, n - 2) AS ra FROM t) SELECT node, {R('2 * (n * (log2((n + 2) / 3) - 1) + 1) / greatest(1, (n - 1) * (n - 2)) / CASE WHEN ra = 0 THEN 1e-6 ELSE ra END')} AS integration, {R('1 / l')} AS local, {R('m')} AS depth FROM r""")
LOWS = "la AS (SELECT src, dst, cost FROM {block_edges} WHERE lts <= 2 UNION ALL SELECT dst, src, cost FROM {block_edges} WHERE lts <= 2)"
LOW = f"{ARCS}, {LOWS}, {paths(START, 24, 'la', 'e')}"
query("permeability", lambda e, n: streets.permeability(n, e.withColumn("low", F.col("lts") <= 2), "low"), E, N, sql=f"WITH {LOW}, {paths(START)} SELECT n.node, {R('100 * ((SELECT count(*) FROM e WHERE source = n.node) - 1.0) / ((SELECT count(*) FROM d WHERE source = n.node) - 1)')} AS permeability FROM {{block_nodes}} n")
query("barriers", lambda e, n: streets.barriers(n, e), E, N, sql=f"WITH {LOW}, c AS (SELECT source AS node, min(node) AS c, count(*) AS n FROM e GROUP BY source) SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst, a.n + b.n AS score FROM {{block_edges}} JOIN c a ON a.node = src JOIN c b ON b.node = dst WHERE lts > 2 AND a.c <> b.c")
query("low_stress_summary", lambda e: streets.low_stress_summary(e), E, sql=f"""
WITH n AS (SELECT DISTINCT unnest([src, dst]) AS node FROM {{block_edges}} WHERE lts <= 2), {LOWS}, {paths('SELECT node AS source, node, 0.0::DOUBLE AS dist FROM n', 24, 'la', 'e')}, c AS (SELECT source AS node, min(node) AS c FROM e GROUP BY source), l AS (SELECT c, sum(cost) AS l, (SELECT count(*) FROM c k WHERE k.c = c.c) AS m FROM {{block_edges}} JOIN c ON node = src WHERE lts <= 2 GROUP BY c), t AS (SELECT * FROM l ORDER BY l DESC, c LIMIT 1)
SELECT {R('(SELECT sum(l) FROM l) / (SELECT sum(cost) FROM {block_edges})')} AS low_share, (SELECT count(*) FROM l) AS islands, l AS largest, m AS nodes, {R('l / (SELECT sum(l) FROM l)')} AS largest_share FROM t""")
query("path_tree_forest", lambda e, n: routes.path_tree(edges_(e), hubs(n), together=True).select("source", "node", "dist"), E, N, sql=f"WITH {HUBS} SELECT arg_min(source, (dist, source)) AS source, node, min(dist) AS dist FROM d GROUP BY node")
query("offset_sources", lambda e, n: routes.path_tree(edges_(e), hubs(n).withColumn("offset", (F.col("node") % 4).cast("double")), together=True).select("source", "node", "dist"), E, N, sql=f"WITH {ARCS}, {paths('SELECT node AS source, node, (node % 4)::DOUBLE AS dist FROM {block_nodes} WHERE node % 25 IN (0, 12, 24)')} SELECT arg_min(source, (dist, source)) AS source, node, min(dist) AS dist FROM d GROUP BY node")
query("reconstructed_paths", lambda e, n: routes.reconstruct(routes.path_tree(edges_(e), hubs(n)), n.where("node % 25 = 18")).join(e.select(F.col("edge").alias("e"), "cost"), F.expr("array_contains(edges, e)")).groupBy("source", "target").agg(F.sum("cost").alias("dist")), E, N, sql=f"WITH {HUBS} SELECT source, node AS target, dist FROM d WHERE node % 25 = 18")
query("path_to_root", lambda e, n: routes.reconstruct(routes.path_tree(edges_(e), hubs(n), together=True), n.where("node % 25 = 18")).select("target", F.element_at("nodes", 1).alias("root"), F.element_at("nodes", -1).alias("end")), E, N, sql=f"WITH {HUBS} SELECT node AS target, arg_min(source, (dist, source)) AS root, node AS end FROM d WHERE node % 25 = 18 GROUP BY node")
query("route", lambda e, n: routes.route(edges_(e), n.where("node % 25 IN (0, 7)").selectExpr("node AS o", "node - node % 25 + 17 AS d").join(n.selectExpr("node AS d"), "d")).select("o", "d", "dist"), E, N, sql=f"WITH {ALL} SELECT source AS o, node AS d, dist FROM d WHERE source % 25 IN (0, 7) AND node = source - source % 25 + 17")
query("pruned_costs", lambda e, n: routes.pruned_costs(e.withColumn("metric", F.lit(1.0)), hubs(n), None).select("source", "node", "cost"), E, N, sql=f"WITH {HUBS} SELECT source, node, dist AS cost FROM d")

# betweenness by numbers of shortest paths
SIGMA = f"{ALL}, s0 AS (SELECT source, node, 1.0::DOUBLE AS c FROM d WHERE source = node), " + ", ".join(f"s{k + 1} AS MATERIALIZED (SELECT s.source, a.dst AS node, sum(s.c) AS c FROM s{k} s JOIN arcs a ON a.src = s.node JOIN d p ON p.source = s.source AND p.node = s.node JOIN d q ON q.source = s.source AND q.node = a.dst AND abs(q.dist - p.dist - a.cost) <= 1e-9 GROUP BY s.source, a.dst)" for k in range(14)) + ", sg AS MATERIALIZED (SELECT source, node, sum(c) AS c FROM (" + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(15)) + ") GROUP BY source, node)"
DEP = "d st JOIN sg ON sg.source = st.source AND sg.node = st.node"
query("betweenness", lambda e, n: routes.betweenness(edges_(e), n)[0], E, N, sql=f"""
WITH {SIGMA}, b AS (SELECT a.node, sum(x.c * y.c / z.c) AS b FROM d a JOIN d b ON b.source = a.node AND b.node <> a.node JOIN d c ON c.source = a.source AND c.node = b.node AND abs(a.dist + b.dist - c.dist) <= 1e-9 JOIN sg x ON x.source = a.source AND x.node = a.node JOIN sg y ON y.source = a.node AND y.node = b.node JOIN sg z ON z.source = a.source AND z.node = b.node WHERE a.source <> a.node AND a.source <> b.node GROUP BY a.node)
SELECT n.node, {R('coalesce(b, 0)')} AS value FROM {{block_nodes}} n LEFT JOIN b USING (node)""")
query("edge_betweenness", lambda e, n: routes.betweenness(edges_(e), n)[1], E, N, sql=f"""
WITH {SIGMA} SELECT a.edge, {R('sum(x.c * y.c / z.c)')} AS value FROM arcs a JOIN d p ON p.node = a.src JOIN d q ON q.source = a.dst JOIN d r ON r.source = p.source AND r.node = q.node AND abs(p.dist + a.cost + q.dist - r.dist) <= 1e-9 JOIN sg x ON x.source = p.source AND x.node = p.node JOIN sg y ON y.source = q.source AND y.node = q.node JOIN sg z ON z.source = p.source AND z.node = q.node GROUP BY a.edge""")
query("choice", lambda e, n: routes.choice(edges_(e), n, n.selectExpr("node", "pop AS w"), n.selectExpr("node", "CAST(1 + node % 3 AS DOUBLE) AS w"), 8.0, "linear"), E, N, sql=f"""
WITH {SIGMA}, b AS (SELECT a.node, sum(o.pop * (1 + b.node % 3) * (1 - c.dist / 8) * x.c * y.c / z.c) AS b FROM d a JOIN d b ON b.source = a.node AND b.node <> a.node JOIN d c ON c.source = a.source AND c.node = b.node AND abs(a.dist + b.dist - c.dist) <= 1e-9 AND c.dist <= 8 JOIN sg x ON x.source = a.source AND x.node = a.node JOIN sg y ON y.source = a.node AND y.node = b.node JOIN sg z ON z.source = a.source AND z.node = b.node JOIN {{block_nodes}} o ON o.node = a.source WHERE a.source <> a.node AND a.source <> b.node GROUP BY a.node)
SELECT n.node, {R('coalesce(b, 0)')} AS choice FROM {{block_nodes}} n LEFT JOIN b USING (node)""")
query("nearest_usage", lambda e, n: routes.nearest_usage(edges_(e), n.where("node % 25 <> 12"), n.where("node % 25 = 12")), E, N)

# what is lost when something goes
query("edge_criticality", lambda e, n: routes.edge_criticality(edges_(e).where("src < 25"), n.where("node < 25 AND node % 5 = 0"), n.where("node < 25 AND node % 5 = 4")), E, N)
query("efficiency_loss", lambda e, n: routes.efficiency_loss(edges_(e).where("src < 25"), n.where("node < 25"), "node"), E, N)
query("network_disruption", lambda e, n: routes.disrupted(edges_(e), e.where("lts = 4").select("edge"), n.where("node % 25 = 6")), E, N, sql="SELECT edge, src, dst, cost FROM {block_edges} WHERE lts <> 4 AND src % 25 <> 6 AND dst % 25 <> 6")
_after = lambda e, n: routes.path_tree(routes.disrupted(edges_(e), e.where("lts >= 3").select("edge")), hubs(n)).selectExpr("node AS o", "source AS d", "dist AS cost")
query("service_loss", lambda e, n: routes.service_loss(routes.path_tree(edges_(e), hubs(n)).selectExpr("node AS o", "source AS d", "dist AS cost"), _after(e, n), n.selectExpr("node AS o", "pop"), 9.0), E, N, sql=f"""
WITH {HUBS}, {LOWS}, {paths(START + ' WHERE node % 25 IN (0, 12, 24)', 24, 'la', 'e')}, b AS (SELECT n.pop, (SELECT min(dist) FROM d WHERE d.node = n.node AND dist <= 9) AS pre, (SELECT min(dist) FROM e WHERE e.node = n.node AND dist <= 9) AS post FROM {{block_nodes}} n),
t AS (SELECT sum(pop) AS a, coalesce(sum(pop) FILTER (pre IS NOT NULL AND post IS NULL), 0) AS i, sum(pop * (post - pre)) / sum(pop) FILTER (pre IS NOT NULL AND post IS NOT NULL) AS d, sum(pop * (post - pre) / greatest(pre, 1)) / sum(pop) FILTER (pre IS NOT NULL AND post IS NOT NULL) AS p FROM b)
SELECT {R('i / a')} AS isolation_rate, i AS isolated, {R('d')} AS mean_delay, {R('100 * (0.7 * i / a + 0.3 * least(p, 1))')} AS index FROM t""")
pairs = lambda n: n.where("node % 25 = 0").selectExpr("node AS o", "node + 24 AS d").join(n.selectExpr("node AS d"), "d")
COMFORT = f"ca AS (SELECT src, dst, cost * (1 + 0.5 * (1 - shade)) AS cost FROM {{block_edges}} UNION ALL SELECT dst, src, cost * (1 + 0.5 * (1 - shade)) FROM {{block_edges}}), {paths(START + ' WHERE node % 25 = 0', 18, 'ca', 'f')}"
query("comfort_routes", lambda e, n: routes.comfort_routes(e, pairs(n)).select("o", "d", "shortest_length"), E, N, sql=f"WITH {HUBS} SELECT source AS o, node AS d, dist AS shortest_length FROM d WHERE source % 25 = 0 AND node = source + 24")
query("comfort_route_choice", lambda e, n: routes.route(e.withColumn("cost", F.expr("cost * (1 + 0.5D * (1 - shade))")), pairs(n)).select("o", "d", "dist"), E, N, sql=f"WITH {COMFORT} SELECT source AS o, node AS d, {R('dist')} AS dist FROM f WHERE node = source + 24")
COOL = f"ca AS (SELECT src, dst, cost * (0.5 + 0.5 * (1 - 0.5 * shade) * lst / 30) AS cost FROM {{block_edges}}), {paths(START + ' WHERE node % 25 = 0', 18, 'ca', 'f')}, da AS (SELECT src, dst, cost FROM {{block_edges}}), {paths(START + ' WHERE node % 25 = 0', 18, 'da', 'g')}"
query("cool_routes", lambda e, n: routes.cool_routes(e, pairs(n)).select("o", "d", "impedance", "shortest_length"), E, N, sql=f"WITH {COOL} SELECT f.source AS o, f.node AS d, {R('f.dist')} AS impedance, {R('g.dist')} AS shortest_length FROM f JOIN g ON g.source = f.source AND g.node = f.node WHERE f.node = f.source + 24")
query("evacuation_flows", lambda e, n: routes.evacuation(both_ways(e.select("src", "dst", "cost")).join(both_ways(e.select("src", "dst", F.col("capacity").alias("cost"))).withColumnRenamed("cost", "capacity"), ["src", "dst"]), n.select("node", "pop"), n.where("node % 25 = 12"))[0], E, N)
query("evacuation_clearance", lambda e, n: routes.evacuation(both_ways(e.select("src", "dst", "cost")).join(both_ways(e.select("src", "dst", F.col("capacity").alias("cost"))).withColumnRenamed("cost", "capacity"), ["src", "dst"]), n.select("node", "pop"), n.where("node % 25 = 12"))[1].select("unassigned"), E, N, sql="SELECT coalesce(sum(pop), 0.0) AS unassigned FROM {block_nodes} n WHERE NOT EXISTS (SELECT 1 FROM {block_nodes} m WHERE m.node = n.node - n.node % 25 + 12)")
query("evacuation_steps", lambda e, n: routes.evacuation_steps(e.select("edge", "src", "dst", "cost", "capacity"), n.select("node", F.col("pop").alias("demand"), F.when(F.col("node") % 25 == 24, 1000.0).otherwise(0.0).alias("capacity")), 24)[1], E, N)
query("clearance_order", lambda e, n: routes.clearance_order(edges_(e).where("src < 25"), e.where("src < 25 AND lts = 4").selectExpr("edge", "cost AS volume", "CAST(lst AS DOUBLE) AS criticality"), 0), E, N)
query("infrastructure_cascade", lambda e, n: routes.cascade(e.selectExpr("src AS a", "dst AS b"), e.where("lts <= 2").selectExpr("src AS a", "dst AS b"), n.selectExpr("node AS power", "node AS water"), n.where("node % 25 IN (1, 5)"))[0], E, N)
query("patch_importance", lambda e, n: routes.patch_importance(e.where("lts <= 2"), n.selectExpr("node", "pop AS area")).select("node", "component", "component_area"), E, N, sql=f"WITH {LOW}, c AS (SELECT source AS node, min(e.node) AS component, sum(pop) AS a FROM e JOIN {{block_nodes}} n ON n.node = e.node GROUP BY source) SELECT node, component, a AS component_area FROM c")
query("segment_density", lambda p: streets.segment_density(p.where("g < 3").select((F.col("id") % 20).alias("segment"), F.col("id").alias("sample"), "x", "y"), p.withColumn("w", 1 + F.col("id") % 3), 60.0), "points", sql=f"""
WITH s AS (SELECT a.id % 20 AS segment, a.id, coalesce(sum((1 + b.id % 3) * exp(-4.5 * (pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 3600)), 0) AS d FROM {{points}} a LEFT JOIN {{points}} b ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 60 WHERE a.g < 3 GROUP BY a.id) SELECT segment, {R('avg(d)')} AS density FROM s GROUP BY segment""")
