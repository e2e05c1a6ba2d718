import math

import pytest

from urbanloom.core.graph import components
from urbanloom.core.spatial_join import nearest, range_join
from urbanloom.functions import formulas
from urbanloom.operators import access, autocorr, facility, inequality, interpolation, mcda, network, patterns, quality, raster, regression, series, weights


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_quality(spark):
    df = spark.createDataFrame([(0, 10.0), (1, 20.0), (2, 20.0), (3, 5.0), (4, float("nan")), (5, None)], "id long, x double")
    assert dict(rows(quality.rank_values(df, "x"), "id", "rank")) == {0: 3.0, 1: 1.5, 2: 1.5, 3: 4.0, 4: 0.0, 5: 0.0}
    z = dict(rows(quality.zscore(df.where("id in (0, 1, 3, 4)"), "x"), "id", "z"))
    assert z[4] is None and abs(z[3] + z[1] + z[0]) < 1e-9
    assert rows(quality.top_k(df, "x", 2), "id") == [(1,), (2,)]
    s = quality.array_summary(df, "x").first()
    assert (s.n, s.n_valid, s.n_missing, s.median) == (6, 4, 2, 15.0)
    classes = dict(rows(quality.classify_values(df, "x", [5.0, 20.0]), "id", "class"))
    assert classes == {0: 2, 1: 3, 2: 3, 3: 2, 4: -1, 5: -1}
    p = spark.createDataFrame([(0, 1.0, 4.0), (1, 2.0, 3.0), (2, 1.0, 5.0), (3, None, 2.0)], "id long, a double, b double")
    assert dict(rows(quality.pareto_front(p, "a", "b"), "id", "on_front")) == {0: False, 1: True, 2: True, 3: False}
    ci = quality.bootstrap_mean_ci(df, "x", n_boot=200).first()
    assert ci.ci_low <= ci["mean"] <= ci.ci_high


def test_inequality(spark):
    df = spark.createDataFrame([(0, 20.0, "N"), (1, 20.0, "N"), (2, 80.0, "S"), (3, 80.0, "S")], "id long, x double, g string")
    assert abs(inequality.gini(df, "x").first().gini - 0.3) < 1e-9
    assert abs(quality.gini_coefficient(df.selectExpr("x", "1D AS w"), "x", "w").first().gini - 0.3) < 1e-9
    assert abs(inequality.percentile_ratio(df, "x").first().ratio - 4) < 1e-9
    assert sorted(rows(inequality.percentile_rank(df, "x"), "pct")) == [(0.25,), (0.25,), (0.75,), (0.75,)]
    two = spark.createDataFrame([(0.0,), (2.0,)], "x double")
    assert abs(inequality.theil_t(two, "x").first().theil - math.log(2)) < 1e-9
    d = inequality.theil_decomposition(df.withColumn("w", df.id * 0 + 100.0), "x", "w", "g").collect()
    assert all(abs(r.within) < 1e-9 for r in d) and sum(r.between for r in d) > 0
    assert abs(inequality.gini_from_lorenz(inequality.lorenz_points(df, "x")).first().gini - 0.3) < 1e-9
    assert inequality.share_below(df, "x", 50.0).first().share == 0.5
    assert inequality.gini(df.selectExpr("0D AS x"), "x").first().gini == 0.0


@pytest.fixture(scope="module")
def scatter(spark):
    import random

    rng = random.Random(1)
    return spark.createDataFrame([(i, rng.random() * 100, rng.random() * 100, rng.random()) for i in range(120)] + [(500, 900.0, 900.0, 1.0), (501, None, 1.0, 1.0)], "id long, x double, y double, v double").cache()


def test_distance_joins_equal_cross_joins(scatter):
    a, b = scatter.selectExpr("id AS i", "x", "y"), scatter.selectExpr("id AS j", "x", "y")
    got = set(rows(range_join(a, b, 17.0, ["i"], ["j"]), "i", "j"))
    pts = {r.id: (r.x, r.y) for r in scatter.collect() if r.x is not None}
    assert got == {(i, j) for i, p in pts.items() for j, q in pts.items() if math.dist(p, q) <= 17.0}
    near = rows(nearest(scatter, scatter, 3, exclude_self=True), "i", "j", "rank")
    assert set(near) == {(i, j, k + 1) for i, p in pts.items() for k, (_, j) in enumerate(sorted((math.dist(p, q), j) for j, q in pts.items() if j != i)[:3])}


def test_weights_and_statistics(spark):
    pts = spark.createDataFrame([(100, 0.0, 0.0), (101, 1.0, 0.0), (102, 2.0, 0.0)], "id long, x double, y double")
    assert sorted(rows(weights.knn_weights(pts, 2).where("i = 101"), "j", "w")) == [(100, 0.5), (102, 0.5)]
    assert rows(weights.distance_band_weights(pts, 1.5).where("i = 100"), "j", "w") == [(101, 1.0)]
    assert sorted(rows(weights.distance_band_weights(pts, 2.5, False, False).where("i = 100"), "j", "w")) == [(101, 1.0), (102, 0.5)]
    values = spark.createDataFrame([(0, 10.0), (1, 100.0), (2, 10.0)], "id long, v double")
    w = spark.createDataFrame([(0, 1, 1.0), (1, 0, 0.5), (1, 2, 0.5), (2, 1, 1.0)], "i long, j long, w double")
    assert dict(rows(autocorr.getis_ord(values, w), "id", "z"))[1] > 0
    chain = spark.createDataFrame([(i, j, 1.0) for i in range(4) for j in (i - 1, i + 1) if 0 <= j < 4], "i long, j long, w double")
    m = autocorr.global_moran(spark.createDataFrame([(i, i + 1.0) for i in range(4)], "id long, v double"), chain).first()
    assert abs(m.expected + 1 / 3) < 1e-9 and m.i > m.expected and m.variance > 0
    assert patterns.mean_center(spark.createDataFrame([(0.0, 0.0, 1.0), (10.0, 20.0, 2.0), (20.0, 40.0, 1.0)], "x double, y double, w double"), "w").first() == (10.0, 20.0)


def test_idw(spark):
    src = spark.createDataFrame([(1, 0.0, 0.0, 10.0), (2, 10.0, 0.0, 20.0), (3, 0.0, 10.0, 30.0), (4, 10.0, 10.0, 40.0)], "id long, x double, y double, v double")
    dst = spark.createDataFrame([(1, 5.0, 5.0), (2, 0.0, 0.0), (3, 5.0, 0.0)], "id long, x double, y double")
    got = dict(rows(interpolation.idw(src, dst), "id", "value"))
    assert abs(got[1] - 25) < 1e-9 and got[2] == 10.0 and abs(got[3] - 220 / 12) < 1e-9
    far = spark.createDataFrame([(9, 50.0, 50.0)], "id long, x double, y double")
    assert rows(interpolation.idw(src, far, radius=10.0), "value") == [(None,)]
    assert interpolation.grid(spark, 0, 0, 10, 10, 5.0).count() == 4


def test_access(spark):
    od = spark.createDataFrame([(0, 0, 10.0), (0, 1, 50.0), (1, 0, 30.0), (1, 1, 10.0)], "o long, d long, cost double")
    o, d = spark.createDataFrame([(0, 100.0), (1, 200.0)], "o long, pop double"), spark.createDataFrame([(0, 10.0), (1, 20.0)], "d long, supply double")
    got = dict(rows(access.enhanced_2sfca(od, o, d, 40.0), "o", "access"))
    assert abs(got[0] - 1 / 30) < 1e-9 and abs(got[1] - (1 / 30 + 0.1)) < 1e-9
    lin = dict(rows(access.enhanced_2sfca(od, o, d, 40.0, "linear"), "o", "access"))
    assert abs(lin[0] - 0.06) < 1e-9 and abs(lin[1] - 0.12) < 1e-9
    with pytest.raises(ValueError):
        access.decay(od.cost, "linear", 1.0)
    t = access.furness(spark.createDataFrame([(0, 0, 10.0), (0, 1, 20.0), (1, 0, 30.0), (1, 1, 40.0)], "o long, d long, trips double"), spark.createDataFrame([(0, 50.0), (1, 100.0)], "o long, target double"), spark.createDataFrame([(0, 60.0), (1, 90.0)], "d long, target double"), 4)
    assert abs(sum(r.trips for r in t.where("o = 0").collect()) - 50) < 0.1


def test_mcda(spark):
    a = spark.createDataFrame([(1, 10.0, 100.0), (2, 5.0, 50.0), (3, 1.0, 10.0)], "id long, c1 double, c2 double")
    for method in (mcda.topsis, mcda.vikor, mcda.promethee_ii, mcda.marcos, mcda.waspas, mcda.aras, mcda.copras, mcda.edas, mcda.spotis):
        assert rows(method(a, ["c1", "c2"], [0.5, 0.5], [True, True]).orderBy("rank"), "id") == [(1,), (2,), (3,)], method
    assert abs(sum(r.weight for r in mcda.critic_weights(a, ["c1", "c2"], [True, False]).collect()) - 1) < 1e-9


def test_networks(spark):
    e = spark.createDataFrame([(0, 1, 10.0), (1, 2, 5.0)], "src long, dst long, cost double")
    nodes = spark.createDataFrame([(0,), (1,), (2,), (9,)], "node long")
    demand = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 1.0)], "node long, pop double")
    got = {r.source: (r.nodes, r.demand, r["mean"], r.farthest) for r in network.voronoi(e, nodes.where("node in (0, 2)"), demand).collect()}
    assert got == {0: (1, 1.0, 0.0, 0.0), 2: (2, 2.0, 2.5, 5.0)}
    c = {r.node: r for r in network.closeness(e, nodes).collect()}
    assert c[1].reach == 2 and c[9].reach == 0 and abs(c[1].harmonic - 0.3) < 1e-9
    assert dict(rows(network.connected_components(e, nodes), "node", "component")) == {0: 0, 1: 0, 2: 0, 9: 9}
    assert abs(sum(r.rank for r in network.pagerank(e, nodes, iterations=5).collect()) - 1) < 1e-9
    patches = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 2.0)], "node long, area double")
    assert network.probability_of_connectivity(e, patches).first().pc == 1.0
    assert components(e.selectExpr("src AS u", "dst AS v")).count() == 3


def test_rasters(spark):
    dem = spark.createDataFrame([(0, c, 5.0 - c) for c in range(5)], "r int, c int, z double")
    assert [r.dir for r in raster.d8_flow(dem).orderBy("c").collect()] == [1, 1, 1, 1, 0]
    assert [r.n for r in raster.flow_accumulation(dem).orderBy("c").collect()] == [1, 2, 3, 4, 5]
    mask = spark.createDataFrame([(0, 0, True), (0, 1, True), (1, 2, True), (3, 3, True), (2, 0, False)], "r int, c int, m boolean")
    assert facility.label_components(mask, "m").select("component").distinct().count() == 2
    assert facility.label_components(mask, "m", 4).select("component").distinct().count() == 3


def test_facilities(spark):
    c = spark.createDataFrame([(0, 0.0, 0.0), (1, 10.0, 10.0), (2, 20.0, 20.0)], "id long, x double, y double")
    d = spark.createDataFrame([(0, 1.0, 1.0, 100.0), (1, 11.0, 11.0, 200.0), (2, 25.0, 25.0, 500.0)], "id long, x double, y double, pop double")
    assert rows(facility.greedy_mclp(c, d, 5.0, 2), "id", "added", "covered") == [(1, 200.0, 200.0), (0, 100.0, 300.0)]
    assert rows(facility.greedy_p_median(c, d, 1), "id") == [(2,)]
    assert rows(facility.assign_to_nearest(c, d).orderBy("id"), "facility") == [(0,), (1,), (2,)]


def test_series_and_regression(spark):
    s = spark.createDataFrame([("a", t, float(t)) for t in range(1, 7)] + [("b", t, 5.0) for t in range(1, 7)], "k string, t int, v double")
    mk = {r.k: r for r in series.classify_trend(series.mann_kendall(s)).collect()}
    assert mk["a"].tau == 1.0 and mk["a"].slope == 1.0 and mk["a"].p < 0.05 and mk["a"].trend == 1 and mk["b"].trend == 0
    pts = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (5.0, 5.0, 5.0, 2.0), (20.0, 20.0, 10.0, 3.0), (1.0, 1.0, 1.0, 3.0)], "x double, y double, t double, v double")
    cube = {(r.bx, r.by, r.bt): (r.value, r.n) for r in series.space_time_cube(pts, 10.0, 2, "sum").collect()}
    assert cube == {(0, 0, 0): (4.0, 2), (0, 0, 1): (2.0, 1), (1, 1, 1): (3.0, 1)}
    fit = {r.term: r for r in regression.ols(spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(10)], "x double, y double"), "y", ["x"]).collect()}
    assert abs(fit["x"].beta - 2) < 1e-9 and abs(fit["intercept"].beta - 1) < 1e-9 and fit["x"].r2 > 0.999999


def test_formulas(spark):
    df = spark.createDataFrame([(1, 500.0, 1000.0, 10.0), (2, None, 1000.0, 10.0)], "id long, flow double, cap double, t0 double")
    got = [r.time for r in formulas.apply(df, "bpr_travel_time", {"capacity": "cap", "free": "t0"}).orderBy("id").collect()]
    assert abs(got[0] - 10 * (1 + 0.15 * 0.5**4)) < 1e-9 and got[1] is None or got[1] == 10.0
    with pytest.raises(ValueError):
        formulas.apply(df, "bpr_travel_time", {"capacity": "cap", "free": "t0"}, wrong=1.0)
    zones = spark.createDataFrame([(0.5, 0.2, 30.0), (0.3, 0.6, 12.0), (0.01, 0.5, 5.0), (0.1, 0.2, 10.0)], "built double, sealed double, height double")
    assert [r.lcz for r in formulas.apply(zones, "local_climate_zone").collect()] == [1, 8, 11, 9]


def test_streaming_cube_equals_batch(spark, tmp_path):
    from urbanloom.streaming.cube import event_cube

    ev = spark.createDataFrame([("2024-01-01 01:00:00", "a", 1.0), ("2024-01-01 23:00:00", "a", 2.0), ("2024-01-02 01:00:00", "b", 4.0)], "ts string, event_type string, value double").selectExpr("CAST(ts AS timestamp) ts", "event_type", "value")
    ev.write.parquet(str(tmp_path / "in"))
    stream = event_cube(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("cube_out").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(rows(spark.table("cube_out"), "key", "n", "total")) == sorted(rows(event_cube(ev), "key", "n", "total")) == [("a", 2, 3.0), ("b", 1, 4.0)]


def test_space_time_weighting_reads_all_sources(spark):
    # near in space but late, far in space, out of any radius, a repeated and a null id, and so far that weights vanish
    src = [(0.0, 0.0, 0.0, 10.0), (1.0, 0.0, 14.0, 20.0), (12.0, 0.0, 0.0, 40.0), (90.0, 5.0, 3.0, 80.0)]
    tgt = [(1, 0.5, 0.0, 0.0), (2, 1.0, 0.0, 28.0), (3, 70.0, 0.0, 0.0), (3, 70.0, 0.0, 0.0), (None, 400.0, 0.0, 5.0), (5, 1e5, 0.0, 0.0), (6, None, 0.0, 0.0)]
    s, t = spark.createDataFrame(src, "x double, y double, t double, v double"), spark.createDataFrame(tgt, "id long, x double, y double, t double")

    def want(x, y, at):
        w = [math.exp(-math.hypot(math.dist((x, y), p[:2]), at - p[2])) for p in src]
        if not sum(w):
            return sum(p[3] for p in src) / 4, 2.0
        return sum(a * p[3] for a, p in zip(w, src)) / sum(w), 2 * (1 - max(w) / sum(w)) + 0.5

    got = interpolation.space_time_weighting(s, t, 1.0, 1.0, 0.5, 2.0).collect()
    key = lambda r: str(r[0])
    assert len(got) == len(tgt)
    for r, (i, x, y, at) in zip(sorted(got, key=key), sorted(tgt, key=key)):
        assert r.id == i and (r["value"], r.variance) == (pytest.approx(want(x, y, at), rel=1e-12) if x is not None else (None, None))
    assert interpolation.space_time_weighting(s.limit(0), t, 1.0, 1.0).where("value is null").count() == len(tgt)


def test_centralities_converge(spark):
    import numpy as np

    n = 10  # a path: the slowest small graph; node 10 has no edge
    links = [(i, i + 1, 1.0 + i % 3) for i in range(n - 1)]
    e, nodes = spark.createDataFrame(links, "src long, dst long, cost double"), spark.range(n + 1).withColumnRenamed("id", "node")
    a, p = np.eye(n + 1), np.zeros((n + 1, n + 1))
    for i, j, c in links:
        a[i, j] = a[j, i] = 1
        p[i, j] = p[j, i] = 1 / c
    v = np.abs(np.linalg.eigh(a)[1][:, -1])
    got = dict(rows(network.eigenvector(e, nodes), "node", "value"))
    assert len(got) == n + 1 and max(abs(got[i] - v[i] / v.max()) for i in range(n + 1)) < 1e-6
    p[n] = 1  # a dead end's rank goes to all
    p = 0.85 * p / p.sum(1, keepdims=True) + 0.15 / (n + 1)
    r = np.linalg.matrix_power(p, 5000)[0]
    got = dict(rows(network.pagerank(e, nodes), "node", "rank"))
    assert len(got) == n + 1 and max(abs(got[i] - r[i]) for i in range(n + 1)) < 1e-5
    assert network.eigenvector(e.limit(0), nodes.limit(0)).count() == network.pagerank(e.limit(0), nodes.limit(0)).count() == 0
