"""Settings, timetables, sites, land uses, snapshots, reports and the made-up city, against hand-made cases and brute force."""

import itertools
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanloom.functions import intervals, text
from urbanloom.operators import allocation, profiles, report, scenario, series, siting, transit
from urbanloom.sources import settings
from urbanloom.sources.demo import demo_city
from urbanloom.sources.gtfs import read_gtfs


def test_settings():
    assert settings.breaks(" ") == (5.0, 8.0, 12.0) and settings.breaks("1, 2.5") == (1.0, 2.5)
    assert settings.lts_rules("Path_LTS=2; mixed_lts1_aadt = 500")["path_lts"] == 2.0 and settings.lts_rules(None) == settings.LTS_RULES
    assert settings.hierarchy("2=800, 0.5=300") == [(0.5, 300.0), (2.0, 800.0)]
    assert settings.standards("Green=10; health=1.5") == [("green", 10.0), ("health", 1.5)] and settings.targets("a=0") == [("a", 0.0)]
    assert settings.weights("access_mean=2, own=1, own=3", {"access_mean"}) == ({"access_mean": 2.0, "own": 3.0}, ["own"]) and settings.weights("", ()) == ({}, [])
    assert settings.radii("400; n, 800.5") == [400.0, None, 800.5] and settings.radii("") == [None]
    assert [settings.radius_label(r) for r in (None, 400.0, 0.5)] == ["n", "400", "0.5"]
    bad = [(settings.breaks, "3, 2"), (settings.breaks, "x"), (settings.lts_rules, "nope=1"), (settings.lts_rules, "path_lts"), (settings.hierarchy, ""), (settings.hierarchy, "a=1"), (settings.standards, "green"), (settings.standards, "green=-1"), (settings.targets, " "), (settings.radii, "0"), (settings.radii, "far")]
    for f, value in bad:
        with pytest.raises(ValueError):
            f(value)
    for value in ("a=0", "a=x", "a", "=1"):
        with pytest.raises(ValueError):
            settings.weights(value, ())


def test_times_that_cant_be_read_are_errors(spark):
    df = spark.createDataFrame([("25:00:01",), (" 8:05:00",), (None,)], "t string")
    assert [r[0] for r in df.select(text.seconds(F.col("t"))).collect()] == [90001, 29100, None]
    for t in ("8:61:00", "8:05", "x"):
        with pytest.raises(Exception, match="not a time"):
            spark.createDataFrame([(t,)], "t string").select(text.seconds(F.col("t"))).collect()


def test_intervals(spark):
    rng = random.Random(3)
    rows = [(i, [tuple(sorted((rng.uniform(-0.2, 1.2), rng.uniform(-0.2, 1.2)))) for _ in range(rng.randrange(5))], [tuple(sorted((rng.random(), rng.random()))) for _ in range(rng.randrange(4))]) for i in range(60)]
    kind = "array<struct<lo:double,hi:double>>"
    df = spark.createDataFrame(rows, f"id int, a {kind}, b {kind}")
    out = df.select("id", intervals.merged(F.col("a")).alias("m"), intervals.without(intervals.merged(F.col("a")), F.col("b")).alias("w")).collect()
    grid = np.linspace(0, 1, 2001)[1:-1]
    inside = lambda spans: np.any([(grid > lo) & (grid < hi) for lo, hi in spans], axis=0) if len(spans) else np.zeros(len(grid), bool)
    for (_, a, b), r in zip(rows, sorted(out, key=lambda r: r.id)):
        assert (inside(a) == inside(r.m)).mean() > 0.995 and all(x[1] < y[0] for x, y in zip(r.m, r.m[1:]))
        assert (inside(r.w) == (inside(a) & ~inside(b))).mean() > 0.995


def test_reach_with_entries_and_unknown_costs(spark):
    edges = spark.createDataFrame([(1, 1, 2, 4.0), (2, 2, 3, 4.0), (3, 8, 9, 10.0)], "edge int, src int, dst int, cost double")
    costs = spark.createDataFrame([(1, 0.0), (2, float("inf")), (3, None)], "node int, dist double")
    entries = spark.createDataFrame([(3, 0.5, 1.0), (1, 0.9, 2.0), (2, 0.1, 9.0)], "edge int, t double, snap double")
    got = {r.edge: [tuple(x) for x in r.intervals] for r in profiles.reach_intervals(edges, costs, 3.0, entries).collect()}
    assert got == {1: [(0.0, 1.0)], 3: [(0.3, 0.7)]}
    assert profiles.reach_intervals(edges, costs, 3.0).count() == 1 and profiles.reach_intervals(edges.limit(0), costs, 3.0).count() == 0
    flat = spark.createDataFrame([("a", 0, 5.0, 0.0), ("b", 0, 1.0, 0.0), ("b", 1, 3.0, 10.0), ("b", 2, 2.0, 10.0)], "id string, seq int, z double, d double")
    assert {r.id: tuple(r)[1:] for r in profiles.grade_stats(flat).collect()} == {"a": (0, 0, 0, 0), "b": (0.2, 0.2, 2.0, 1.0)}


FEED = {
    "stops.txt": "﻿stop_id,stop_name,stop_lat,stop_lon\nA,Alpha,1.5,2\nB,,,\n,none,0,0\nC,Gamma,3,4\n",
    "routes.txt": "route_id,route_short_name,route_type\nr1,1,3\nr2,2,x\n",
    "trips.txt": "route_id,service_id,trip_id\nr1,wk,t1\nr1,wk,t2\nr2,we,t3\nr2,ex,t4\n",
    "stop_times.txt": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt1,08:00:00,08:01:00,A,1\nt1,08:10:00,,B,2\nt2,09:00:00,09:00:00,A,1\nt2,09:10:00,09:10:00,B,2\nt4,08:20:00,08:20:00,B,1\nt4,,25:00:00,C,2\nt1,07:00:00,07:00:00,nowhere,3\nt9,07:00:00,07:00:00,A,3\nt3,10:00:00,10:00:00,C,1\n",
    "calendar.txt": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nwk,1,1,1,1,1,0,0,20240106,20240131\nwe,0,0,0,0,0,1,1,20240101,20240131\n",
    "calendar_dates.txt": "service_id,date,exception_type\nex,20240110,1\nwk,20240111,2\nwk,20240112,9\n",
}


def feed(path, files):
    with zipfile.ZipFile(path, "w") as z:
        for name, content in files.items():
            z.writestr("sub/" + name, content)


def test_timetables(spark, tmp_path):
    feed(tmp_path / "city.zip", FEED)
    t = read_gtfs(spark, str(tmp_path))
    assert sorted((r.stop, r.name, str(r.lat)) for r in t["stops"].collect()) == [("A", "Alpha", "1.5"), ("B", "B", "nan"), ("C", "Gamma", "3.0")]
    assert sorted((r.route, r.type) for r in t["routes"].collect()) == [("r1", 3), ("r2", -1)]
    assert sorted((r.trip, r.stop, r.arr, r.dep) for r in t["stop_times"].collect() if r.trip in ("t1", "t4")) == [("t1", "A", 28800, 28860), ("t1", "B", 29400, 29400), ("t4", "B", 30000, 30000), ("t4", "C", 90000, 90000)]
    active = lambda d: sorted(r[0] for r in transit.active_services(t["calendar"], t["calendar_dates"], d).collect())
    assert active("20240110") == ["ex", "wk"] and active("20240111") == [] and active("20240113") == ["we"] and active("20240112") == ["wk"]
    assert transit.first_service_day(t["calendar"], t["calendar_dates"]) == "20240106"
    services = transit.active_services(t["calendar"], t["calendar_dates"], "20240110")
    patterns, runs = transit.compile_day(t["trips"], t["stop_times"], services)
    assert sorted((r.route, tuple(r.stops), r.trips) for r in patterns.collect()) == [("r1", ("A", "B"), 2), ("r2", ("B", "C"), 1)]
    start = spark.createDataFrame([("A", 28000.0)], "stop string, t double")
    best = lambda n: {r.stop: r.t for r in transit.earliest_arrival(runs, start, n).collect()}
    assert best(0) == {"A": 28000.0, "B": 29400.0} and best(1) == {"A": 28000.0, "B": 29400.0, "C": 90000.0}
    with pytest.raises(ValueError):
        transit.active_services(t["calendar"], t["calendar_dates"], "2024")
    for gone in ("trips.txt", "calendar.txt"):
        files = {k: v for k, v in FEED.items() if k != gone and (gone != "calendar.txt" or k != "calendar_dates.txt")}
        (tmp_path / gone).mkdir()
        feed(tmp_path / gone / "bad.zip", files)
        with pytest.raises(ValueError, match="lacks"):
            read_gtfs(spark, str(tmp_path / gone))


def assigned(rows, pairs, w, cap):
    room, out = dict(cap), {}
    for c, d, s in sorted((c, d, s) for s, d, c in pairs):
        if d not in out and room[s] + 1e-9 >= w[d]:
            room[s] -= w[d]
            out[d] = s
    return out


def test_capacities_and_interchange_equal_brute_force(spark):
    rng = random.Random(6)
    for n_sites, n_demand, reach in ((4, 12, 60.0), (6, 20, 45.0)):
        at = lambda: (rng.uniform(0, 100), rng.uniform(0, 100))
        sites, demand = [at() for _ in range(n_sites)], [at() for _ in range(n_demand)]
        w = {d: float(rng.randrange(1, 9)) for d in range(n_demand)}
        cap = {s: float(rng.randrange(5, 25)) for s in range(n_sites)}
        pairs = [(s, d, float(np.hypot(sites[s][0] - demand[d][0], sites[s][1] - demand[d][1]))) for s in range(n_sites) for d in range(n_demand)]
        costs = spark.createDataFrame(pairs, "site long, demand long, cost double")
        people = spark.createDataFrame(list(w.items()), "demand long, w double")
        rooms = spark.createDataFrame(list(cap.items()), "site long, capacity double")
        near = [(s, d, c) for s, d, c in pairs if c <= reach]
        given, loads = siting.capacitated(costs, rooms, people, reach)
        want = assigned(None, near, w, cap)
        assert {r.demand: r.site for r in given.collect()} == {d: want.get(d) for d in w}
        assert {r.site: r.load for r in loads.collect()} == {s: sum(w[d] for d, x in want.items() if x == s) for s in cap}
        steps, served = siting.p_median(costs, people, 2)
        best = min(sum(w[d] * min(c for s, e, c in pairs if e == d and s in two) for d in w) for two in itertools.combinations(range(n_sites), 2))
        assert steps.first().objective == pytest.approx(best) and served.count() == n_demand
        value = lambda open_: (lambda a: (-sum(w[d] for d in a), sum(w[d] * next(c for s, e, c in pairs if e == d and s == x) for d, x in a.items())))(assigned(None, [p for p in near if p[0] in open_], w, cap))
        chosen, _, _ = siting.capacitated_siting(costs, rooms, people, 2, max_cost=reach)
        got = value([r.site for r in chosen.collect()])
        alone = min(value([s]) for s in range(n_sites))
        assert got <= alone and all(got <= value([s, t]) or got[0] <= value([s, t])[0] for s, t in [(r.site, x) for r in chosen.collect() for x in range(n_sites)])
    empty = siting.capacitated(costs.limit(0), rooms, people)
    assert empty[0].where("site is null").count() == n_demand


def score(plan, use):
    suit = sum(plan.area[p] * plan.suit[p, u] for p, u in enumerate(use) if u >= 0)
    return plan.weight * suit + sum(n * plan.compat[use[a], use[b]] for (a, b), n in zip(plan.pairs.tolist(), plan.lengths) if use[a] >= 0 and use[b] >= 0)


def test_land_uses_are_at_a_local_optimum(spark):
    rng = np.random.default_rng(4)
    for contiguous in (False, True):
        pairs = np.array([(i, i + 1) for i in range(15) if i % 4 < 3] + [(i, i + 4) for i in range(12)])
        suit, area = rng.random((16, 3)), rng.integers(1, 4, 16).astype(float)
        plan = allocation.Plan(suit, area, np.array([12.0, 11.0, 9.0]), pairs, rng.random(len(pairs)), np.array([-1] * 15 + [2]), np.eye(3), 1.0)
        if contiguous:
            plan.grow()
        else:
            plan.greedy()
        before = score(plan, plan.use)
        plan.improve(50, 1200, contiguous)
        s, n, border = plan.scores()
        assert score(plan, plan.use) == pytest.approx(s + n) and s + n >= before - 1e-9 and plan.use[15] == 2
        touch = np.zeros_like(plan.touch)
        for (a, b), x in zip(pairs.tolist(), plan.lengths):
            for p, q in ((a, b), (b, a)):
                if plan.use[q] >= 0:
                    touch[p] += x * plan.compat[:, plan.use[q]]
        assert np.allclose(touch, plan.touch)
        if contiguous:
            assert all(plan.whole(u) for u in range(3))
        else:  # no single move or swap gains
            for p, q in itertools.combinations(range(15), 2):
                use = plan.use.copy()
                use[p], use[q] = use[q], use[p]
                room = np.array([12.0, 11.0, 9.0]) - [area[use == u].sum() for u in range(3)]
                assert (room < -1e-9).any() or score(plan, use) <= s + n + 1e-9
    parcels = spark.createDataFrame([(1, 2.0, 1.0, 0.0, None), (2, 2.0, 1.0, 0.5, "b"), (3, 9.0, 1.0, 1.0, None)], "id long, area double, a double, b double, locked string")
    given, totals, one = allocation.allocate(parcels, {"a": 4.0, "b": 2.0})
    assert {r.id: r.use for r in given.collect()} == {1: "a", 2: "b", 3: None} and one.first().objective == pytest.approx(3.0)
    pieces = allocation.use_pieces(spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, None)], "id long, use string"), spark.createDataFrame([(1, 2), (3, 4), (4, 5)], "src long, dst long"))
    assert {r.use: (r.pieces, r.whole) for r in pieces.collect()} == {"a": (2, False), "b": (1, True)}


def test_snapshots_and_reports(spark):
    values = spark.createDataFrame([("access_mean", "71.5"), ("note", "n/a"), ("density_max", "NaN"), ("own", "3")], "metric string, value string")
    snap = scenario.snapshot(values, "Plan & <A>", "now")
    text_ = scenario.to_json(snap)
    assert '"kind":"scenario-snapshot"' in text_.first().json
    assert sorted((r.metric, r.value) for r in scenario.from_json(text_).collect()) == [("access_mean", 71.5), ("own", 3.0)]
    for bad in ("{}", "nothing"):
        with pytest.raises(Exception, match="no snapshot"):
            scenario.from_json(spark.createDataFrame([(bad,)], "json string")).collect()
    nothing = spark.createDataFrame([], "score double")
    assert tuple(scenario.access_summary(nothing).first()) == (0, 0.0, 0.0, 0.0, 0.0)
    assert scenario.overall_score(scenario.access_summary(nothing)).first().overall is None
    scores = spark.createDataFrame([(float(i), float(i), 10.0 * i) for i in range(11)], "x double, y double, score double")
    balance = spark.createDataFrame([("<park>", 10.0, 20.0, -10.0, "Deficit"), ("odd", 5.0, 0.0, 0.0, "No standard")], "category string, area_m2 double, required_m2 double, balance_m2 double, status string")
    shops = spark.createDataFrame([("a & b", 5.0, 4.0, 0.8, "Adequate"), ("c", 5.0, 0.0, 0.0, "Unused")], "facility string, capacity double, assigned double, utilization double, status string")
    people = spark.createDataFrame([(3.0, 1), (None, 1), (-4.0, 0), (1.0, 0)], "pop double, covered int")
    page = report.plan_html("Plan <1>", scores, balance, shops, people, scores.selectExpr("score AS value"), 100.0, "today")
    assert "Plan &lt;1&gt;" in page and "&lt;park&gt;" in page and "75.0% of the population" in page and page.count("<svg") == 3 and "a &amp; b" in page
    assert report.svg_point_map(scores.limit(0).selectExpr("x", "y", "score AS value")) == "" and report.svg_balance_bars(balance.where("status = 'No standard'")) == ""
    rows = spark.createDataFrame([("access_mean", 1.0, 2.0, 1.0, "B"), ("own_one", None, 2.0, None, "n/a")], "metric string, a double, b double, delta double, better string")
    page = report.compare_html("Two", rows, "now", "then", "then leads")
    assert "Accessibility score (mean)" in page and "Own One" in page and "+1.00 (+100.0%)" in page
    ranking = spark.createDataFrame([("A", 80.0, 1), ("B", 20.0, 2)], "name string, score double, rank int")
    cells = spark.createDataFrame([("access_mean", "A", 3.0, 1.0), ("access_mean", "B", 1.0, 0.0)], "metric string, name string, value double, norm double")
    assert "#27ae60" in report.rank_html("Rank", ranking, cells) and "<td class=n>80.0" in report.rank_html("Rank", ranking)
    bars = report.svg_pyramid(spark.createDataFrame([(0, "0-9", 5.0, 4.0), (1, "10+", 1.0, 2.0)], "k int, label string, start double, end double"))
    assert report.TONES["bad"] in bars and report.TONES["good"] in bars


def test_short_series(spark):
    rows = [("none", 1, None), ("none", 2, float("nan")), ("one", 1, 4.0), ("two", 1, 1.0), ("two", 2, 2.0)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    got = {(r.k, r.method): r.value for r in series.forecast_cells(df, 2).collect()}
    assert got == {("none", "none"): 0.0, ("one", "constant"): 4.0, ("two", "exponential_smoothing"): pytest.approx(1.3)}
    assert series.backtest(df, 3).count() == 0


def test_demo_city_follows_its_seed(spark):
    a, b, c = demo_city(spark, 1, 5, 3, 80.0), demo_city(spark, 1, 5, 3, 80.0), demo_city(spark, 2, 5, 3, 80.0)
    for name in a:
        assert sorted(a[name].collect()) == sorted(b[name].collect())
    assert sorted(a["buildings"].collect()) != sorted(c["buildings"].collect())
    uses = {(r.bx, r.by): r.use for r in a["blocks"].collect()}
    assert [uses[k] for k in ((0, 0), (0, 1), (1, 0), (1, 1))] == ["residential", "commercial", "green", "school"]
    assert a["heights"].agg(F.max("z")).first()[0] == pytest.approx(a["buildings"].agg(F.max("height")).first()[0])
    assert a["buildings"].join(a["blocks"].where("use = 'green'"), ["bx", "by"]).count() == 0 and a["demand"].where("pop < 1").count() == 0


def test_queries_are_registered_before_spark_starts():
    """The entry module is imported by a process that has no session yet."""
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[1])
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout) > 400, out.stderr


def test_fronts_of_many_objectives_equal_brute_force(spark):
    from urbanloom.operators import quality

    rng = random.Random(9)
    rows = [(i, float(rng.randrange(6)), float(rng.randrange(6)), rng.choice([1.0, 2.0, 3.0, None, float("nan")])) for i in range(150)] * 2
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    good = [(i, a, -b, c) for i, a, b, c in rows if c is not None and c == c]
    beats = lambda x, y: all(p >= q for p, q in zip(x[1:], y[1:])) and x[1:] != y[1:]
    want = sorted(i for i, *v in good if not any(beats(o, (i, *v)) for o in good))
    out = quality.pareto_front_of(df, ["a", "b", "c"], [True, False, True])
    assert sorted(r.id for r in out.where("on_front").collect()) == want and out.count() == 300
    assert quality.pareto_front_of(df.limit(0), ["a"]).count() == 0
    with pytest.raises(ValueError):
        quality.pareto_front_of(df, ["a", "b"], [True])


def test_shadows(spark):
    from urbanloom.operators import hazards

    square = lambda x, y, n: [(x, y), (x + n, y), (x + n, y + n), (x, y + n)]
    df = spark.createDataFrame([(1, square(0.0, 0.0, 10.0), 20.0), (2, square(0.0, 14.0, 10.0), 5.0), (3, square(100.0, 0.0, 4.0), 5.0)], "id int, coords array<struct<x:double,y:double>>, height double")
    rows, area = hazards.shadow_access(df, 45.0, 180.0, 1.0)
    got = {r.id: (round(r.shadow, 6), r.access) for r in rows.collect()}
    assert got == {1: (20.0, 100.0), 2: (5.0, 0.0), 3: (5.0, 100.0)}
    assert area.first().footprint_area == 216.0 and area.first().shadow_area == 10 * 30 + 4 * 9
    assert hazards.shadow_access(df.limit(0), 45.0, 180.0)[1].first().shadow_area == 0.0
