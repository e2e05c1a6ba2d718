"""Queries of outranking, fuzzy criteria and judgements."""

from __future__ import annotations

from pyspark.sql import functions as F

from urbanloom.operators import fuzzy, judgement, outranking
from urbanloom.plans.linear import eliminate
from urbanloom.plans.registry import query

R = lambda x: f"round({x}, 6) + 0.0"
COLS, WEIGHTS, BENEFIT = ["c1", "c2", "c3", "c4"], [0.4, 0.3, 0.2, 0.1], [True, True, True, False]
ITEMS = list(zip(COLS, WEIGHTS, BENEFIT))


def placed(body: str, ascending: bool = False) -> str:
    """SQL of (id, score, rank) from one of (id, score)."""
    return f"WITH r AS ({body}) SELECT id, {R('score')} AS score, CAST(row_number() OVER (ORDER BY score {'ASC' if ascending else 'DESC'}, id) AS INT) AS rank FROM r"


over = lambda f, x: f"{f}({x}) OVER ()"
unit = lambda x: f"(({x}) - {over('min', x)}) / CASE WHEN {over('max', x)} = {over('min', x)} THEN 1 ELSE {over('max', x)} - {over('min', x)} END"

# pairs
THRESHOLDS = [300.0, 2.0, None, 0.005]
less = lambda a, b, g: f"(a.{a} - b.{b})" if g else f"(b.{b} - a.{a})"
_pref = " + ".join(f"{w} * (CASE WHEN {less(c, c, g)} > 0 THEN least(1, {less(c, c, g)} / {t if t is not None else f'(SELECT max({c}) - min({c}) FROM alts)'}) ELSE 0 END - CASE WHEN {less(c, c, g)} < 0 THEN least(1, -{less(c, c, g)} / {t if t is not None else f'(SELECT max({c}) - min({c}) FROM alts)'}) ELSE 0 END)" for (c, w, g), t in zip(ITEMS, THRESHOLDS))
query("promethee_thresholds", lambda a: outranking.promethee_ii(a, COLS, WEIGHTS, BENEFIT, THRESHOLDS), "alternatives", sql=f"WITH alts AS (SELECT * FROM {{alternatives}}), " + placed(f"SELECT a.id, sum({_pref}) / (SELECT count(*) - 1 FROM alts) AS score FROM alts a, alts b WHERE a.id <> b.id GROUP BY a.id").removeprefix("WITH "))
_c = " + ".join(f"CASE WHEN {less(c, c, g)} >= 0 THEN {w} ELSE 0 END" for c, w, g in ITEMS)
_d = "greatest(" + ", ".join(f"greatest(-{less(c, c, g)} / (SELECT max({c}) - min({c}) FROM alts), 0)" for c, w, g in ITEMS) + ")"
query("electre_i", lambda a: outranking.electre_i(a, COLS, WEIGHTS, BENEFIT, 0.65, 0.35), "alternatives", sql=f"""
WITH alts AS (SELECT * FROM {{alternatives}}), o AS (SELECT a.id AS i, b.id AS k FROM alts a, alts b WHERE a.id <> b.id AND {_c} >= 0.65 AND {_d} <= 0.35)
SELECT id, (SELECT count(*) FROM o WHERE i = id) AS beats, (SELECT count(*) FROM o WHERE k = id) AS beaten, NOT EXISTS (SELECT 1 FROM o WHERE k = id) AS kernel FROM alts""")
Q, P, V = [100.0, 0.5, 0.001, 0.001], [400.0, 2.0, 0.004, 0.004], [2000.0, 8.0, 0.02, 0.02]
_s = [f"(-{less(c, c, g)})" for c, _, g in ITEMS]
_ck = ", ".join(f"CASE WHEN {s} <= {q} THEN 1 WHEN {s} >= {p} THEN 0 ELSE ({p} - {s}) / {p - q} END AS c{j}" for j, (s, q, p) in enumerate(zip(_s, Q, P)))
_dk = ", ".join(f"CASE WHEN {s} <= {p} THEN 0 WHEN {s} >= {v} THEN 1 ELSE ({s} - {p}) / {v - p} END AS d{j}" for j, (s, p, v) in enumerate(zip(_s, P, V)))
query("electre_iii", lambda a: outranking.electre_iii(a, COLS, WEIGHTS, BENEFIT, Q, P, V), "alternatives", sql=f"WITH alts AS (SELECT * FROM {{alternatives}}), k AS (SELECT a.id AS i, b.id AS k, {_ck}, {_dk} FROM alts a, alts b WHERE a.id <> b.id), g AS (SELECT *, {' + '.join(f'{w} * c{j}' for j, w in enumerate(WEIGHTS))} AS c FROM k), s AS (SELECT i, k, c * {' * '.join(f'CASE WHEN d{j} > c THEN (1 - d{j}) / greatest(1 - c, 1e-9) ELSE 1 END' for j in range(4))} AS s FROM g), " + placed("SELECT id, coalesce((SELECT sum(s) FROM s WHERE i = id), 0) - coalesce((SELECT sum(s) FROM s WHERE k = id), 0) AS score FROM alts").removeprefix("WITH "))
query("mcda_rank_spread", lambda a: outranking.rank_spread(a, COLS, WEIGHTS, BENEFIT, simulations=200), "alternatives")

# fuzzy numbers about the crisp criteria
tri = lambda a: a.select("id", *(F.struct((F.col(c) * 0.9).alias("l"), F.col(c).alias("m"), (F.col(c) * 1.2).alias("u")).alias(c) for c in COLS))
TRI = "t AS (SELECT id, " + ", ".join(f"{c} * {k} AS {p}{j}" for j, c in enumerate(COLS) for p, k in (("l", "0.9::DOUBLE"), ("m", "1"), ("u", "1.2::DOUBLE"))) + " FROM {alternatives})"
TW = [(0.2, 0.4, 0.5), (0.1, 0.3, 0.4), (0.1, 0.2, 0.3), (0.05, 0.1, 0.2)]
_v = []
for _j, ((_cc, _w, _g), _tw) in enumerate(zip(ITEMS, TW)):
    for _p, _k, _o in zip("lmu", _tw, "uml"):
        _v.append((f"{_p}{_j} / max(u{_j}) OVER () * {_k}" if _g else f"min(l{_j}) OVER () / {_o}{_j} * {_k}") + f" AS v{_p}{_j}")
_gap = lambda f: " + ".join("sqrt((" + " + ".join(f"pow(v{p}{j} - {f}(v{p}{j}) OVER (), 2)" for p in "lmu") + ") / 3)" for j in range(4))
query("fuzzy_topsis", lambda a: fuzzy.fuzzy_topsis(tri(a), COLS, TW, BENEFIT), "alternatives", sql=f"WITH {TRI}, v AS (SELECT id, {', '.join(_v)} FROM t), g AS (SELECT id, {_gap('max')} AS b, {_gap('min')} AS w FROM v), " + placed("SELECT id, w / (b + w) AS score FROM g").removeprefix("WITH "))
_x = [f"((l{j} + m{j} + u{j}) / 3)" for j in range(4)]
_t = [f"{sum(tw) / 3} * abs({over('max' if g else 'min', x)} - {x}) / ({over('max', x)} - {over('min', x)})" for x, tw, g in zip(_x, TW, BENEFIT)]
query("fuzzy_vikor", lambda a: fuzzy.fuzzy_vikor(tri(a), COLS, TW, BENEFIT), "alternatives", sql=f"""
WITH {TRI}, s AS (SELECT id, {' + '.join(_t)} AS s, greatest({', '.join(_t)}) AS r FROM t), q AS (SELECT id, s, r, 0.5 * ({unit('s')}) + 0.5 * ({unit('r')}) AS q FROM s), k AS (SELECT *, row_number() OVER (ORDER BY q, id) AS rank FROM q),
f AS (SELECT min(q) AS q1, min(q) FILTER (rank = 2) AS q2, 1.0::DOUBLE / (count(*) - 1) AS dq, bool_or(rank = 1 AND (s = (SELECT min(s) FROM k) OR r = (SELECT min(r) FROM k))) AS stable FROM k)
SELECT id, {R('q')} AS score, CAST(rank AS INT) AS rank, {R('s')} AS s, {R('r')} AS r, CASE WHEN q2 - q1 < dq THEN q - q1 < dq WHEN stable THEN rank = 1 ELSE rank <= 2 END AS compromise FROM k, f""")
UNITS = "n AS (SELECT id, " + ", ".join(f"{unit(c)} AS u{j}" for j, c in enumerate(COLS)) + " FROM {alternatives})"


def units(a):
    return fuzzy._unit(a, [F.col(c) for c in COLS])


ivif = lambda a: units(a).select("id", *(F.struct((0.1 + 0.5 * F.col(f"u{j}")).alias("mu_l"), (0.2 + 0.5 * F.col(f"u{j}")).alias("mu_u"), (0.05 + 0.1 * (1 - F.col(f"u{j}"))).alias("nu_l"), (0.1 + 0.15 * (1 - F.col(f"u{j}"))).alias("nu_u")).alias(c) for j, c in enumerate(COLS)))
_iv = ", ".join(f"1 - pow(1 - (0.1 + 0.5 * u{j}), {w}) AS a{j}, 1 - pow(1 - (0.2 + 0.5 * u{j}), {w}) AS b{j}, pow(0.05 + 0.1 * (1 - u{j}), {w}) AS c{j}, pow(0.1 + 0.15 * (1 - u{j}), {w}) AS d{j}" for j, w in enumerate(WEIGHTS))
_ig = lambda best: " + ".join("sqrt((" + " + ".join(f"pow({p}{j} - {'max' if (p in 'ab') == (g == best) else 'min'}({p}{j}) OVER (), 2)" for p in "abcd") + ") / 4)" for j, g in enumerate(BENEFIT))
query("ivif_topsis", lambda a: fuzzy.ivif_topsis(ivif(a), COLS, WEIGHTS, BENEFIT), "alternatives", sql=f"WITH {UNITS}, v AS (SELECT id, {_iv} FROM n), g AS (SELECT id, {_ig(True)} AS b, {_ig(False)} AS w FROM v), " + placed("SELECT id, w / (b + w) AS score FROM g").removeprefix("WITH "))


def crisp(values: list[str]) -> str:
    """TOPSIS on unit scores of the values (over the CTE t)."""
    n = ", ".join(f"{w} * ({unit(x)}) AS v{j}" for j, (x, w) in enumerate(zip(values, WEIGHTS)))
    gap = lambda f: "sqrt(" + " + ".join(f"pow(v{j} - {f}(v{j}) OVER (), 2)" for j in range(4)) + ")"
    return f"v AS (SELECT id, {n} FROM t), g AS (SELECT id, {gap('max')} AS b, {gap('min')} AS w FROM v), " + placed("SELECT id, w / (b + w + 1e-12) AS score FROM g").removeprefix("WITH ")


PLAIN = "t AS (SELECT * FROM {alternatives})"
rough = lambda a: a.select("id", *(F.struct((F.col(c) * 0.8).alias("lo"), (F.col(c) * 1.1 + F.col("id") % 3).alias("hi")).alias(c) for c in COLS))
query("rough_topsis", lambda a: fuzzy.rough_topsis(rough(a), COLS, WEIGHTS), "alternatives", sql=f"WITH {PLAIN}, " + crisp([f"(0.5 * ({c} * 0.8::DOUBLE + {c} * 1.1::DOUBLE + id % 3))" for c in COLS]))
picture = lambda a: a.select("id", *(F.struct(F.col(c).alias("pos"), F.lit(0.0).alias("neu"), (F.col("id") % 5 * 0.1).alias("neg")).alias(c) for c in COLS))
query("picture_fuzzy_topsis", lambda a: fuzzy.picture_fuzzy_topsis(picture(a), COLS, WEIGHTS), "alternatives", sql=f"WITH {PLAIN}, " + crisp([f"({c} - (id % 5) * 0.1::DOUBLE)" for c in COLS]))
spherical = lambda a: a.select("id", *(F.struct(F.col(c).alias("mu"), (F.col("id") % 5 * 0.1).alias("nu"), F.lit(0.0).alias("pi")).alias(c) for c in COLS))
query("spherical_fuzzy_topsis", lambda a: fuzzy.spherical_fuzzy_topsis(spherical(a), COLS, WEIGHTS), "alternatives", sql=f"WITH {PLAIN}, " + crisp([f"({c} * {c} - pow((id % 5) * 0.1::DOUBLE, 2))" for c in COLS]))
_ns = [f"((2 + u{j} - (1 - u{j}) - (1 - u{j} * u{j})) / 3)" for j in range(4)]
query("neutrosophic_waspas", lambda a: fuzzy.neutrosophic_waspas(a, COLS, WEIGHTS), "alternatives", sql=f"WITH {UNITS}, " + placed(f"SELECT id, 0.5 * ({' + '.join(f'{w} * {x}' for x, w in zip(_ns, WEIGHTS))}) + 0.5 * ({' * '.join(f'pow({x}, {w})' for x, w in zip(_ns, WEIGHTS))}) AS score FROM n").removeprefix("WITH "))
_iq = [f"{w} * (1 - u{j}) / (1 + 1e-12)" for j, w in enumerate(WEIGHTS)]
query("if_vikor", lambda a: fuzzy.intuitionistic_vikor(a, COLS, WEIGHTS), "alternatives", sql=f"WITH {UNITS}, s AS (SELECT id, {' + '.join(_iq)} AS s, greatest({', '.join(_iq)}) AS r FROM n), " + placed("SELECT id, 0.5 * (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER () + 1e-12) + 0.5 * (r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER () + 1e-12) AS score FROM s", True).removeprefix("WITH "))
_fc = [f"{w} * ((l{j} + 4 * m{j} + u{j}) / 6) / sum((l{j} + 4 * m{j} + u{j}) / 6) OVER ()" for j, w in enumerate(WEIGHTS)]
query("fuzzy_copras", lambda a: fuzzy.fuzzy_copras(tri(a), COLS, WEIGHTS, BENEFIT), "alternatives", sql=f"""WITH {TRI}, s AS (SELECT id, {' + '.join(x for x, g in zip(_fc, BENEFIT) if g)} AS p, {' + '.join(x for x, g in zip(_fc, BENEFIT) if not g)} AS m FROM t),
q AS (SELECT id, p + sum(m) OVER () * min(m) OVER () / (m * (SELECT sum((SELECT min(m) FROM s) / (m + 1e-12)) FROM s) + 1e-12) AS q FROM s), """ + placed("SELECT id, q / max(q) OVER () * 100 AS score FROM q").removeprefix("WITH "))
KINDS = ("benefit_minmax", "cost_minmax", "benefit_sigmoid", "cost_sigmoid", "benefit_gaussian")
query("normalize_criterion", lambda p: p.select("id", *(fuzzy.normalize_criterion(F.col("s"), k, 5.0, 40.0, 25.0, 8.0, 13.0).alias(k) for k in KINDS)), "plots", sql=f"""
SELECT id, {', '.join(f'CASE WHEN s = 13 THEN 13.0::DOUBLE ELSE {R(e)} END AS {k}' for k, e in zip(KINDS, ('100 * least(greatest((s - 5) / 35, 0), 1)', '100 * least(greatest((40 - s) / 35, 0), 1)', '100 / (1 + exp(-(s - 25) / 8))', '100 - 100 / (1 + exp(-(s - 25) / 8))', '100 * exp(-0.5 * pow((s - 25) / 8, 2))')))} FROM {{plots}}""")

# judgements
_power = ", ".join(f"w{k + 1} AS (SELECT i, v / sum(v) OVER () AS v FROM (SELECT m.i, sum(value * v) AS v FROM m JOIN w{k} ON w{k}.i = m.j GROUP BY m.i))" for k in range(25))
query("ahp_weights", judgement.ahp_weights, "judgements", sql=f"""
WITH m AS (SELECT * FROM {{judgements}}), w0 AS (SELECT i, 0.2::DOUBLE AS v FROM m GROUP BY i), {_power}, l AS (SELECT sum(value * w25.v) AS lam FROM m JOIN w25 ON w25.i = m.j)
SELECT i AS criterion, {R('v')} AS weight, {R('(lam - 5) / 4 / 1.12')} AS consistency FROM w25, l""")
query("ahp_from_json", lambda m: judgement.ahp_from_json(m.sparkSession, "[[1, 3, 5], [0.333333333333, 1, 2], [0.2, 0.5, 1]]"), "judgements", sql=f"""
WITH m(i, j, value) AS (VALUES (0, 0, 1.0::DOUBLE), (0, 1, 3), (0, 2, 5), (1, 0, 0.333333333333), (1, 1, 1), (1, 2, 2), (2, 0, 0.2), (2, 1, 0.5), (2, 2, 1)), w0 AS (SELECT i, 1.0::DOUBLE / 3 AS v FROM m GROUP BY i), {_power},
l AS (SELECT sum(value * w25.v) AS lam FROM m JOIN w25 ON w25.i = m.j) SELECT i AS criterion, {R('v')} AS weight, {R('(lam - 3) / 2 / 0.58')} AS consistency FROM w25, l""")
fuzzy_matrix = lambda m: m.select("i", "j", *((F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.col("value") * k)).alias(n) for n, k in (("l", 0.6), ("m", 1.0), ("u", 1.7))))
_fm = ", ".join(f"CASE WHEN i = j THEN 1 ELSE value * {k} END AS {n}" for n, k in (("l", "0.6::DOUBLE"), ("m", "1"), ("u", "1.7::DOUBLE")))
query("fuzzy_ahp_weights", lambda m: judgement.fuzzy_ahp_weights(fuzzy_matrix(m)).select("criterion", "weight"), "judgements", sql=f"""
WITH f AS (SELECT i, {_fm} FROM {{judgements}}), r AS (SELECT i, sum(l) AS l, sum(m) AS m, sum(u) AS u FROM f GROUP BY i), s AS (SELECT i, l / sum(u) OVER () AS l, m / sum(m) OVER () AS m, u / sum(l) OVER () AS u FROM r),
d AS (SELECT a.i, min(CASE WHEN a.m >= b.m THEN 1 WHEN b.l >= a.u THEN 0 ELSE (b.l - a.u) / (a.m - a.u - (b.m - b.l)) END) AS d FROM s a JOIN s b ON a.i <> b.i GROUP BY a.i) SELECT i AS criterion, {R('d / sum(d) OVER ()')} AS weight FROM d""")


def _influence(scale: str) -> str:
    """CTEs of the total influence of five criteria: x, then t<i> from (I - X') T' = X' row by row."""
    cells = ", ".join(f"max(x) FILTER (i = {i} AND j = {j}) AS x{i}{j}" for i in range(5) for j in range(5))
    matrix = [[f"{1 if i == j else 0} - x{j}{i}" for j in range(5)] for i in range(5)]
    rhs = [[f"x{j}{i}" for j in range(5)] for i in range(5)]
    return f"x AS (SELECT i, j, CASE WHEN i = j THEN 0 ELSE value END / {scale} AS x FROM {{judgements}}), w AS (SELECT {cells} FROM x), {eliminate('e', 'w', matrix, rhs)}"


_sums = " UNION ALL ".join(f"SELECT {k} AS criterion, {' + '.join(f's{j}_{k}' for j in range(5))} AS d, {' + '.join(f's{k}_{i}' for i in range(5))} AS r FROM e5" for k in range(5))
_rows = "(SELECT max(s) FROM (SELECT sum(CASE WHEN i = j THEN 0 ELSE value END) AS s FROM {judgements} GROUP BY i))"
_both = "(SELECT max(s) FROM (SELECT sum(CASE WHEN i = j THEN 0 ELSE value END) AS s FROM {judgements} GROUP BY i UNION ALL SELECT sum(CASE WHEN i = j THEN 0 ELSE value END) FROM {judgements} GROUP BY j))"
influence = lambda m: m.withColumn("value", F.when(F.col("i") == F.col("j"), F.lit(0.0)).otherwise(F.col("value")))
query("dematel", lambda m: judgement.dematel(influence(m)), "judgements", sql=f"WITH {_influence(_both)}, s AS ({_sums}) SELECT criterion, {R('d + r')} AS prominence, {R('d - r')} AS relation, CASE WHEN d - r >= 0 THEN 'cause' ELSE 'effect' END AS role FROM s")
query("hesitant_dematel", lambda m: judgement.dematel(influence(m).unionByName(influence(m)), True), "judgements", sql=f"WITH {_influence(_rows)}, s AS ({_sums}) SELECT criterion, {R('d + r')} AS prominence, {R('d - r')} AS relation, CASE WHEN d - r > 0 THEN 'cause' ELSE 'effect' END AS role FROM s")
_pc = ["c1", "c2", "c5"]
_cor = ", ".join(f"corr({a}, {b}) AS r{i}{j}" for i, a in enumerate(_pc) for j, b in enumerate(_pc))
query("pca_weights", lambda a: judgement.pca_weights(a, _pc), "alternatives", sql=f"""
WITH RECURSIVE k AS (SELECT {_cor} FROM {{alternatives}}), v(n, a, b, c) AS (SELECT 0, 1.0::DOUBLE, 0.7::DOUBLE, -0.4::DOUBLE UNION ALL SELECT n + 1, x / m, y / m, z / m FROM (SELECT n, x, y, z, sqrt(x * x + y * y + z * z) AS m FROM (SELECT n, 2 * a + r01 * b + r02 * c AS x, r10 * a + 2 * b + r12 * c AS y, r20 * a + r21 * b + 2 * c AS z FROM v, k WHERE n < 4000)))
SELECT unnest(['c1', 'c2', 'c5']) AS criterion, unnest([{R('abs(a) / (abs(a) + abs(b) + abs(c))')}, {R('abs(b) / (abs(a) + abs(b) + abs(c))')}, {R('abs(c) / (abs(a) + abs(b) + abs(c))')}]) AS weight FROM v WHERE n = 4000""")
bw = lambda m: m.where("j = 0").selectExpr("i AS criterion", "CAST(1 + i AS DOUBLE) AS best_to", "CAST(5 AS DOUBLE) / (1 + i) AS to_worst")
query("bwm_weights", lambda m: judgement.bwm_weights(bw(m)), "judgements", sql=f"SELECT i AS criterion, {R('(1.0::DOUBLE / (1 + i)) / sum(1.0::DOUBLE / (1 + i)) OVER ()')} AS weight, 0.0::DOUBLE AS deviation FROM {{judgements}} WHERE j = 0")
query("fucom_weights", lambda m: judgement.fucom_weights(m.where("j = 0").selectExpr("i AS criterion", "i AS place", "CAST(i + 2 AS DOUBLE) / (i + 1) AS priority")), "judgements", sql=f"SELECT i AS criterion, {R('(1.0::DOUBLE / (1 + i)) / sum(1.0::DOUBLE / (1 + i)) OVER ()')} AS weight, 0.0::DOUBLE AS deviation FROM {{judgements}} WHERE j = 0")
query("decision_matrix", lambda c: judgement.decision_matrix([c.select("r", "c", F.col("z").alias("v")), c.where("a > 5").select("r", "c", F.col("a").alias("v")), c.select("r", "c", F.col("b").alias("v"))], 7.0), "cells", sql=f"SELECT r, c, {R('z')} AS v0, {R('a')} AS v1, {R('b')} AS v2 FROM {{cells}} WHERE z <> 7 AND a <> 7 AND b <> 7 AND a > 5")
