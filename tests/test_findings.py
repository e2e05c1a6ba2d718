"""What the reviews found, one small case each."""

import math

from pyspark.sql import functions as F

from urbanloom.core import blocks, graph, spatial_join
from urbanloom.operators import facility, hazards, local, outranking, resampling, routes, services, siting
from urbanloom.plans import QUERIES
from urbanloom.sources.derived import relation


def test_means_do_not_hang_on_the_order_of_rows(spark, tmp_path):
    one, many = [0.1, 0.2, 0.3], [0.3, 0.2, 0.1]  # 0.6000000000000001 and 0.6 if added as doubles
    rows = [(s, x, x, x, x) for s, xs in ((1, one), (2, many), (3, [1e300, 2.0]), (4, [float("nan")])) for x in xs]
    spark.createDataFrame(rows, "l_suppkey long, l_extendedprice double, l_quantity double, l_discount double, l_tax double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["id"]: r for r in relation(spark, str(tmp_path), "alternatives").collect()}
    assert all(got[1][c] == got[2][c] for c in ("c1", "c2", "c3", "c4"))
    assert got[3]["c1"] == 5e299 and got[4]["c1"] != got[4]["c1"]


def test_networks_beyond_a_task_go_by_regions(spark, monkeypatch):
    grid = [(k * 25 + i, k * 25 + j, 1.0 + (i * 7 + j * 3) % 5) for k in range(2) for i in range(25) for j in ((i + 1,) if i % 5 < 4 else ()) + ((i + 5,) if i < 20 else ())]
    rows = [(n, a, b, c, 5.0) for n, (a, b, c) in enumerate([*grid, *((100 + 2 * k, 101 + 2 * k, 2.0) for k in range(20))])]
    edges = spark.createDataFrame(rows, "edge long, src long, dst long, cost double, capacity double")
    nodes = edges.selectExpr("explode(array(src, dst)) AS node").distinct().unionByName(spark.createDataFrame([(999,)], "node long"))
    some, few = nodes.where("node % 3 = 0"), nodes.where("node % 25 = 12 OR node > 110")
    people = nodes.selectExpr("node", "CAST(1 + node % 4 AS DOUBLE) AS w")

    def found():
        pairs = some.select(F.col("node").alias("o")).crossJoin(few.select(F.col("node").alias("d")))
        evacuated = routes.evacuation(edges, people.withColumnRenamed("w", "pop"), few)
        tables = [
            routes.path_tree(edges, some).select("source", "node", "dist"),
            routes.path_tree(edges.drop("edge"), few, together=True),
            routes.route(edges, pairs),
            routes.pruned_costs(edges.withColumn("metric", F.lit(1.0)), some, 3.0),
            *routes.betweenness(edges, nodes),
            routes.choice(edges, nodes, people, people.where("node % 2 = 0"), 8.0, "linear"),
            routes.nearest_usage(edges, some, few),
            *evacuated,
        ]
        return [sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in t.collect()) for t in tables]

    whole = found()
    monkeypatch.setattr(routes, "ARCS", 100)  # a grid has 80, everything 200
    assert isinstance(routes._net(edges), routes.Regions)
    assert found() == whole


def places(spark, n, spots, step=1):
    """n points (id, x, y, w) on some spots."""
    return spark.createDataFrame([(k, 100.0 * (k * step % spots), 0.0, float(1 + k % 3)) for k in range(n)], "id long, x double, y double, w double")


def test_points_of_one_place_are_paired_once(spark, monkeypatch):
    people, hubs = places(spark, 300, 6), places(spark, 60, 4, 3).withColumn("id", F.col("id") + 1000)
    p, h = people.collect(), hubs.collect()
    far = lambda a, b: math.hypot(a.x - b.x, a.y - b.y)
    sizes, join, median = [], spatial_join.range_join, siting.p_median

    def counted(left, right, *a):
        sizes.append(left.count() * right.count())
        return join(left, right, *a)

    for m in (spatial_join, services, siting):
        monkeypatch.setattr(m, "range_join", counted)
    monkeypatch.setattr(siting, "p_median", lambda costs, *a, **k: (sizes.append(costs.count()), median(costs, *a, **k))[1])

    rows, load, _ = hazards.tsunami_shelter(people.withColumnRenamed("w", "pop"), hubs.where("x = 300"), hubs.withColumn("capacity", F.lit(20.0)))
    want = {a.id: min((far(a, b), b.id) for b in h) for a in p}
    assert {r.id: r.refuge for r in rows.collect()} == {i: b for i, (_, b) in want.items()}
    assert all(abs(r.depth - 10 * math.exp(-min(far(p[r.id], b) for b in h if b.x == 300) / 1000)) < 1e-9 for r in rows.collect())
    assert sum(r.assigned for r in load.collect()) == sum(a.w for a in p)

    access = {r.id: r.access for r in services.health_equity(people.withColumnRenamed("w", "a"), hubs.selectExpr("id", "x", "y", "id % 7 + 1D AS capacity"), {"a": 1.0}, 250.0)[0].collect()}
    zone = lambda d: 0 if d > 250 else 1.0 if d <= 0.33 * 250 else 0.6 if d <= 0.66 * 250 else 0.2
    ratio = {b.id: (b.id % 7 + 1) / sum(zone(far(a, b)) * a.w for a in p) for b in h}
    assert all(abs(access[a.id] - sum(zone(far(a, b)) * ratio[b.id] for b in h)) < 1e-9 for a in p)

    cover = {r.site: r.weight for r in siting.coverage_of(hubs, people, 150.0).collect()}
    assert cover == {b.id: sum(a.w for a in p if far(a, b) <= 150) for b in h}
    costs, demand = siting.costs_between(hubs, people, 200.0), people.selectExpr("id AS demand", "w")
    sizes.pop()
    plain = [(r.step, r.site, round(r.added, 6)) for r in siting.decayed_cover(costs, demand, 3, 200.0).collect()]
    assert [(r.step, r.site, round(r.added, 6)) for r in siting.decayed_cover_of(hubs, people, 3, 200.0).collect()] == plain

    served, km = siting.micro_hubs(hubs, people, 2, 0.1)
    total = lambda s: sum(a.w * min(abs(a.x - x) for x in s) for a in p) / 1000
    first = min({b.x for b in h}, key=lambda x: (total([x]), min(b.id for b in h if b.x == x)))
    best = min(total([first, b.x]) for b in h if b.x != first)
    assert abs(km.first().km - best) < 1e-9 and served.count() == len(p)
    assert max(sizes) <= 6 * 4


def small_tables(monkeypatch, module, most):
    """``bounded`` of the module refuses more than ``most`` rows."""
    real = services.bounded
    monkeypatch.setattr(module, "bounded", lambda df, order, limit=most: real(df, order, min(limit, most)))


def test_trips_pass_one_by_one_without_a_bound(spark, monkeypatch):
    small_tables(monkeypatch, siting, 50)
    trips = [(k, k * 7 % 40 / 2.0, k * 3 % 11 / 1.0, k * 5 % 37 / 2.0, k * 2 % 13 / 1.0) for k in range(400)]
    depots = [(k, 4.0 * k, 5.0, 2000.0) for k in range(6)]
    far = lambda t, d: math.hypot(t[1] - d[1], t[2] - d[2]) + math.hypot(t[3] - d[1], t[4] - d[2]) - math.hypot(t[1] - t[3], t[2] - t[4])
    chosen = []
    for _ in range(2):
        least = {d: [x for t in trips if (x := min(far(t, depots[c]) for c in (*chosen, d))) <= 6.0] for d in range(6) if d not in chosen}
        chosen.append(max(least, key=lambda d: (len(least[d]) * 1e5 - sum(least[d]), -d)))
    used, want = dict.fromkeys(chosen, 0.0), {}
    for t in trips:
        want[t[0]] = next((c for _, _, c in sorted((far(t, depots[c]), k, c) for k, c in enumerate(chosen)) if far(t, depots[c]) <= 6.0 and used[c] + 50 <= 2000), None)
        if want[t[0]] is not None:
            used[want[t[0]]] += 50
    rows = spark.createDataFrame(trips, "id long, x double, y double, to_x double, to_y double").repartition(7)
    served, loads, summary = siting.fleet_depots(rows, spark.createDataFrame(depots, "id long, x double, y double, kw double"), 2, True, 6.0)
    assert {r.trip: r.depot for r in served.collect()} == want
    assert [tuple(r) for r in loads.collect()] == [(c, used[c]) for c in chosen] and used[chosen[0]] == 2000
    assert math.isclose(summary.first().total, sum(far(trips[i], depots[c]) for i, c in want.items() if c is not None))


def test_clusters_are_balanced_whatever_the_number_of_points(spark, monkeypatch):
    small_tables(monkeypatch, siting, 50)
    rows = [(k, k * 37 % 500 / 1.0, k * 61 % 300 / 1.0, 1.0 + k * 13 % 50) for k in range(300)]
    label, centres = siting.balanced_clusters(spark.createDataFrame(rows, "id long, x double, y double, w double").repartition(5), 4)
    got, sums = {r.id: r.cluster for r in label.collect()}, {r.cluster: r for r in centres.collect()}
    assert set(got) == set(range(300)) and sorted(sums) == [0, 1, 2, 3]
    assert all(sums[c].weight == sum(r[3] for r in rows if got[r[0]] == c) for c in sums)

    # one after another, as the definition goes
    import numpy as np

    xy, w = np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows])
    at, share = np.array([[sums[c].x, sums[c].y] for c in range(4)]), w.sum() / 4
    order, held, alone = np.lexsort((np.arange(300), -w)), np.zeros(4), np.zeros(300, int)
    for i in order.tolist():
        stretch = np.where(held >= 0.95 * share, 1 + 0.6 * (held / share) ** 1.5, 1.0)
        alone[i] = int(np.argmin(((xy[i] - at) ** 2).sum(axis=1) * stretch))
        held[alone[i]] += w[i]
    assert held.max() > share and (siting._chosen_in_turn(xy, w, order, at, share)[0] == alone).all()


def test_electre_iii_weighs_all_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SIZE", 4)
    monkeypatch.setattr(outranking, "PAIRED", 3)
    rows = [(k, float(k * 7 % 11), float(k * 5 % 9)) for k in range(20)] + [(100 + k, float(k * 7 % 11), float(k * 5 % 9)) for k in range(20)]
    weights, good, q, p, v = [0.6, 0.4], [True, False], [0.5, 1.0], [3.0, 2.5], [7.0, 6.0]
    got = {r.id: (r.score, r.rank) for r in outranking.electre_iii(spark.createDataFrame(rows, "id long, a double, b double"), ["a", "b"], weights, good, q, p, v).collect()}

    def credit(i, k):
        short = [(k[j] - i[j]) * (1 if good[j - 1] else -1) for j in (1, 2)]
        part = lambda x, lo, hi: min(1.0, max(0.0, (x - lo) / (hi - lo)))
        c = sum(w * (1 - part(x, a, b)) for w, x, a, b in zip(weights, short, q, p))
        for d in (part(x, a, b) for x, a, b in zip(short, p, v)):
            c0 = sum(w * (1 - part(x, a, b)) for w, x, a, b in zip(weights, short, q, p))
            c *= (1 - d) / max(1 - c0, 1e-9) if d > c0 else 1.0
        return c

    want = {i[0]: sum(credit(i, k) - credit(k, i) for k in rows if k[0] != i[0]) for i in rows}
    assert all(math.isclose(got[i][0], want[i], abs_tol=1e-9) for i in want) and sorted(r for _, r in got.values()) == list(range(1, 41))
    assert all(got[k][0] == got[100 + k][0] and got[k][1] < got[100 + k][1] for k in range(20))


def test_p_median_takes_any_number_of_candidates(spark, monkeypatch):
    candidates = spark.range(20_001).selectExpr("id", "CAST(id % 10000 AS DOUBLE) AS x", "0D AS y")
    demand = spark.createDataFrame([(1, 10.0, 3.0, 1.0), (2, 9000.0, 4.0, 5.0), (3, 9000.0, 4.0, 5.0), (4, 30.0, 0.0, 2.0)], "id long, x double, y double, pop double")
    got = [tuple(r) for r in facility.greedy_p_median(candidates, demand, 2).collect()]
    at = {10: (10.0, 3.0, 1.0), 9000: (9000.0, 4.0, 10.0), 30: (30.0, 0.0, 2.0)}
    cost = lambda *open_: sum(w * min(math.hypot(x - f, y) for f in open_) for x, y, w in at.values())
    one = min(range(10_000), key=cost)
    two = min((f for f in range(10_000) if f != one), key=lambda f: cost(one, f))
    assert [r[:2] for r in got] == [(1, one), (2, two)]
    assert math.isclose(got[0][2], cost(one)) and math.isclose(got[1][2], cost(one, two))


def test_local_logistic_regression_writes_no_pairs(spark, monkeypatch):
    rows = [(k, k * 37 % 101 / 10.0, k * 61 % 97 / 10.0, float(k * k % 7 < 3), k * 13 % 29 / 29.0) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, x double, y double, hit double, v double")
    with monkeypatch.context() as m:
        m.setattr(local, "SENT", 0)
        grouped = {k: {r.id: tuple(r) for r in local.gwlr(df, "hit", ["v"], 3.0, k).collect()} for k in ("fixed_gaussian", "fixed_bisquare")}

    def refuse(*_):
        raise AssertionError("pairs")

    monkeypatch.setattr(local, "kernel_pairs", refuse)
    monkeypatch.setattr(local, "BLOCK", 200)
    for k, want in grouped.items():
        got = {r.id: tuple(r) for r in local.gwlr(df, "hit", ["v"], 3.0, k).collect()}
        assert got.keys() == want.keys() and all(math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-9) for i in want for a, b in zip(got[i], want[i]))


def test_draws_do_not_grow_with_the_cube_of_the_neighbours(spark, monkeypatch):
    n = 300
    values = spark.range(n).selectExpr("id", "IF(id % 2 = 0, 1D, -1D) AS v")
    everyone = values.select(F.col("id").alias("i")).crossJoin(values.select(F.col("id").alias("j"))).where("i <> j").withColumn("w", F.lit(1.0))
    # all others are neighbours, so every draw is all others, each once
    got = resampling.local_geary(values, everyone, 5).collect()
    assert len(got) == n and all(math.isclose(r.c, 4.0 * n / 2) and r.z == 0.0 for r in got)

    some = everyone.where("abs(i - j) <= 1 + i % 5").withColumn("w", 1 / (1 + F.abs(F.col("i") - F.col("j"))))
    uneven = values.withColumn("v", F.col("id") * 37 % 101 / 10.0)
    sent = sorted(map(tuple, resampling.local_geary(uneven, some, 9).collect()))
    monkeypatch.setattr(resampling, "SENT", 0)
    joined = sorted(map(tuple, resampling.local_geary(uneven, some, 9).collect()))
    assert all(a[0] == b[0] and a[3:] == b[3:] and math.isclose(a[2], b[2], rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(sent, joined)) and len({a[3] for a in sent}) > 2


def test_angular_costs_of_a_part_are_held_by_one_task(spark, monkeypatch):
    lines = [(k * 10 + i, 20.0 * k + a, b, 20.0 * k + c, d) for k in range(3) for i, (a, b, c, d) in enumerate([(0.0, 0.0, 1.0, 0.0), (1.0, 0.0, 2.0, 1.0 + k), (1.0, 0.0, 1.0, 2.0), (2.0, 1.0 + k, 3.0, 0.0), (1.0, 2.0, 2.0, 1.0 + k)])]
    df = spark.createDataFrame([*lines, (99, 500.0, 0.0, 501.0, 0.0)], "id long, x0 double, y0 double, x1 double, y1 double")
    found = lambda metric: [tuple(round(x, 9) for x in r) for r in sorted(map(tuple, routes.angular_centrality(df, 1.5, metric).collect()))]
    with monkeypatch.context() as m:
        m.setattr(routes, "TOGETHER", 0.5)
        joined = found(False), found(True)

    def refuse(*_, **__):
        raise AssertionError("tables of all pairs")

    monkeypatch.setattr(graph, "shortest", refuse)
    assert (found(False), found(True)) == joined and len(joined[0]) == 16 and max(r[2] for r in joined[0]) > 0


def test_capacities_are_filled_in_a_stream(spark, monkeypatch):
    monkeypatch.setattr(siting, "WHOLE", 20)
    cost = {(s, d): float((s * 31 + d * 17) % 23) + s / 8 for s in range(6) for d in range(40) if (s + d) % 3 and s // 3 == d % 2}
    w, cap = {d: 1.0 + d * 7 % 5 for d in range(40)}, {s: 9.0 + s for s in range(6)}
    tables = [spark.createDataFrame([(s, d, c) for (s, d), c in cost.items()], "site long, demand long, cost double").repartition(5), spark.createDataFrame(list(cap.items()), "site long, capacity double"), spark.createDataFrame(list(w.items()), "demand long, w double")]
    least = {d: min((c for (_, e), c in cost.items() if e == d), default=None) for d in w}
    for by_demand in (False, True):
        room, want = dict(cap), {}
        for _, _, c, s, d in sorted((least[d] if by_demand else c, d if by_demand else 0, c, s if by_demand else d, d if by_demand else s) for (s, d), c in cost.items()):
            s, d = (s, d) if by_demand else (d, s)
            if d not in want and room[s] >= w[d]:
                room[s] -= w[d]
                want[d] = s
        given, loads = siting.capacitated(*tables, by_demand=by_demand)
        assert {r.demand: r.site for r in given.collect()} == {d: want.get(d) for d in w}
        assert {r.site: r.remaining for r in loads.collect()} == room and len(want) < len(w)


def test_capacities_fill_without_written_pairs(spark, monkeypatch, tmp_path):
    # places share plots, sites share places; the whole region is full in the end
    rows = [(97 * 89 * (k % 3) * 50 + k // 3, 1 + k * 7 % 50) for k in range(900)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").withColumn("p_retailprice", F.lit(1.0)).write.parquet(f"{tmp_path}/part.parquet")
    xy = {k: (k % 97 / 97 * 5000, k % 89 / 89 * 5000) for k, _ in rows}
    room = {k: 500.0 for k, _ in rows if k % 50 == 3}
    load = dict.fromkeys(room, 0.0)
    costs = {k: sorted((d, f) for f in room if (d := math.sqrt((xy[f][0] - x) ** 2 + (xy[f][1] - y) ** 2)) <= 800.0) for k, (x, y) in xy.items()}
    size = dict(rows)
    for k in sorted((k for k in xy if costs[k]), key=lambda k: (costs[k][0][0], k)):
        for _, f in costs[k]:
            if room[f] - load[f] >= size[k]:
                load[f] += size[k]
                break

    def refuse(*_, **__):
        raise AssertionError("pairs")

    monkeypatch.setattr(siting, "costs_between", refuse)
    got = QUERIES["capacitated_loads"](spark, str(tmp_path)).collect()
    assert {r.site: (r.load, r.remaining) for r in got} == {f: (x, 500.0 - x) for f, x in load.items()}


def test_capacities_within_a_radius_as_from_written_costs(spark, monkeypatch):
    monkeypatch.setattr(siting._Rooms, "VISITS", 3)
    odd = [float("nan"), float("inf"), None]
    points = [(k, k * 37 % 23 * 10.0, k * k % 19 * 10.0, float(1 + k * 5 % 7)) for k in range(120)]
    far = [(200 + k, 5000.0 + 300.0 * k, -0.0 if k % 2 else 0.0, 2.0) for k in range(6)]
    demand = spark.createDataFrame([*points, *far, (300, None, 0.0, 1.0), (301, odd[0], 0.0, 1.0), (302, odd[1], 0.0, 1.0), (303, 10.0, 10.0, None), (304, 10.0, 10.0, odd[0]), (305, 10.0, 10.0, -2.0)], "id long, x double, y double, w double")
    sites = spark.createDataFrame([(1000 - k, x, y, 9.0 + k % 3) for k, x, y, _ in points[::5]] + [(1100, 5000.0, 0.0, 3.0), (1101, 5601.0, 0.0, 30.0), (1102, 1e6, 1e6, 5.0), (1103, 10.0, 10.0, None), (1104, None, 1.0, 4.0)], "id long, x double, y double, capacity double")
    asked, rooms = demand.select(F.col("id").alias("demand"), "w"), sites.select(F.col("id").alias("site"), "capacity")
    for radius in (45.0, 300.0):
        want = siting.capacitated(siting.costs_between(sites, demand.where("x < double('inf')"), radius), rooms, asked, by_demand=True)
        got = siting.capacitated_within(sites, demand, radius)
        for a, b in zip(got, want):
            assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    empty = siting.capacitated_within(sites.limit(0), demand, 45.0)
    assert empty[0].where("site is not null").isEmpty() and empty[1].isEmpty()


def test_local_logistic_regression_reads_all_labels(spark, tmp_path):
    rows = [(k, [k * 37 % 101 / 500.0, k * 61 % 97 / 500.0, float(k * k % 7 < 3) - 0.5, k * 13 % 29 / 29.0], k % 10) for k in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.id: tuple(r) for r in QUERIES["gwlr"](spark, str(tmp_path)).collect()}
    points = relation(spark, str(tmp_path), "points").withColumn("hit", (F.col("v") > 0).cast("double"))
    want = {r.id: tuple(r) for r in local.gwlr(points, "hit", ["v2"], 150.0).collect()}
    assert got.keys() == want.keys() == {k for k, _, _ in rows}
    assert all(math.isclose(a, b, abs_tol=1e-6) for k in want for a, b in zip(got[k], want[k]))
