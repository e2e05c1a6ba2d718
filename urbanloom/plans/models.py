"""Queries of regressions, panels, local statistics, rearrangements and grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from urbanloom.operators import interpolation, linear, local, panel, resampling
from urbanloom.plans.linear import dot, eliminate, products, regression
from urbanloom.plans.registry import query
from urbanloom.plans.statistics import PAIRS, D, W, band

R = lambda x: f"round({x}, 6) + 0.0"
table = lambda df, fit, *cols: fit.table(df.sparkSession).select(*(cols or ("term", "beta")))


def terms(names: list[str], source: str, first: int = 0) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS term, {R(f's{i + first}_0')} AS beta FROM {source}" for i, n in enumerate(names))


# least squares with an intercept over plots
PLOT = "d AS (SELECT id, u AS x1, v AS x2, w AS x3, s + 3 * u - 2 * v AS y, CASE WHEN s + 20 * u > 30 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit, floor(s / 10) + 0.0 AS n FROM {plots})"
plot = lambda p: p.select("id", F.col("u").alias("x1"), F.col("v").alias("x2"), F.col("w").alias("x3"), F.expr("s + 3 * u - 2 * v").alias("y"), F.when(F.expr("s + 20 * u > 30"), 1.0).otherwise(0.0).alias("hit"), (F.floor(F.col("s") / 10) + 0.0).alias("n"))


def ols(prefix: str, source: str, xs: list[str], y: str) -> str:
    """CTEs of y on a constant and xs; {prefix}g has the sums and {prefix}<k> the solution."""
    cols = {"one": "1"} | {x: x for x in xs} | {"yy": y}
    names = list(cols)
    return f"{prefix}g AS (SELECT {products(cols)} FROM {source}), {regression(prefix, f'{prefix}g', names, ['one', *xs], 'yy', [f'p_{a}_{b}' for i, a in enumerate(names) for b in names[i:]])}"


_sse = "(p_yy_yy - s0_0 * p_one_yy - s1_0 * p_x1_yy - s2_0 * p_x2_yy)"
query("ols_model", lambda p: table(p, linear.ols_model(plot(p), "y", ["x1", "x2"]), "term", "beta", "se", "z"), "plots", sql=f"""
WITH {PLOT}, {ols('e', 'd', ['x1', 'x2'], 'y')}, t AS (SELECT *, {_sse} / (p_one_one - 3) AS s2 FROM e3)
{' UNION ALL '.join(f"SELECT '{n}' AS term, {R(f's{i}_0')} AS beta, {R(f'sqrt(s2 * s{i}_{i + 1})')} AS se, {R(f's{i}_0 / sqrt(s2 * s{i}_{i + 1})')} AS z FROM t" for i, n in enumerate(('intercept', 'x1', 'x2')))}""")
query("ols_diagnostics", lambda p: linear.ols_model(plot(p), "y", ["x1", "x2"]).summary(p.sparkSession).where("figure in ('n', 'r2', 'adj_r2', 'jarque_bera', 'breusch_pagan')"), "plots", sql=f"""
WITH {PLOT}, {ols('e', 'd', ['x1', 'x2'], 'y')}, r AS (SELECT d.*, y - s0_0 - s1_0 * x1 - s2_0 * x2 AS e FROM d, e3), q AS (SELECT *, e * e AS g FROM r), {ols('f', 'q', ['x1', 'x2'], 'g')},
m AS (SELECT count(*)::DOUBLE AS n, avg(e * e) AS m2, avg(e * e * e) AS m3, avg(e * e * e * e) AS m4, var_pop(y) AS vy, var_pop(g) AS vg FROM q), a AS (SELECT var_pop(g - s0_0 - s1_0 * x1 - s2_0 * x2) AS va FROM q, f3)
SELECT 'n' AS figure, n AS value FROM m UNION ALL SELECT 'r2', {R('1 - m2 / vy')} FROM m UNION ALL SELECT 'adj_r2', {R('1 - m2 / vy * (n - 1) / (n - 3)')} FROM m UNION ALL SELECT 'jarque_bera', {R('n / 6 * (m3 * m3 / pow(m2, 3) + pow(m4 / (m2 * m2) - 3, 2) / 4)')} FROM m UNION ALL SELECT 'breusch_pagan', {R('n * (1 - va / vg)')} FROM m, a""")
_subsets = [["x1"], ["x2"], ["x3"], ["x1", "x2"], ["x1", "x3"], ["x2", "x3"]]
_each = ", ".join(f"{ols(f's{k}_', 'd', xs, 'y')}, r{k} AS (SELECT '{','.join(xs)}' AS variables, {len(xs)} AS n_vars, p_one_one AS n, p_yy_yy - s0_0 * p_one_yy - {' - '.join(f's{i + 1}_0 * p_{x}_yy' for i, x in enumerate(xs))} AS sse, p_yy_yy - p_one_yy * p_one_yy / p_one_one AS sst FROM s{k}_{len(xs) + 1})" for k, xs in enumerate(_subsets))
query("exploratory_regression", lambda p: linear.exploratory(plot(p), "y", ["x1", "x2", "x3"], 2), "plots", sql=f"""
WITH {PLOT}, {_each}, r AS ({' UNION ALL '.join(f'SELECT * FROM r{k}' for k in range(len(_subsets)))})
SELECT variables, n_vars, {R('1 - sse / sst')} AS r2, {R('1 - sse / sst * (n - 1) / (n - n_vars - 1)')} AS adj_r2, {R('n * (ln(2 * pi() * sse / n) + 1) + 2 * (n_vars + 2) + 2.0 * (n_vars + 2) * (n_vars + 3) / (n - n_vars - 3)')} AS aicc FROM r""")
query("glr_gaussian", lambda p: table(p, linear.generalized(plot(p), "y", ["x1", "x2"]), "term", "beta", "se"), "plots", sql=f"""
WITH {PLOT}, {ols('e', 'd', ['x1', 'x2'], 'y')}, t AS (SELECT *, {_sse} / (p_one_one - 3) AS s2 FROM e3) {' UNION ALL '.join(f"SELECT '{n}' AS term, {R(f's{i}_0')} AS beta, {R(f'sqrt(s2 * s{i}_{i + 1})')} AS se FROM t" for i, n in enumerate(('intercept', 'x1', 'x2')))}""")


def irls(y: str, mu: str, weight: str, rounds: int = 12) -> str:
    """CTEs b0 .. b<rounds> of reweighted least squares on a constant, x1 and x2 of the CTE d; {eta} is the predictor."""
    out = ["b0 AS (SELECT 0.0::DOUBLE AS s0_0, 0.0::DOUBLE AS s1_0, 0.0::DOUBLE AS s2_0)"]
    cols = {"one": "1", "x1": "x1", "x2": "x2", "z": "z"}
    for k in range(rounds):
        last = "b0" if k == 0 else f"i{k - 1}_3"
        out.append(f"e{k} AS (SELECT x1, x2, {y} AS y, s0_0 + s1_0 * x1 + s2_0 * x2 AS eta FROM d, {last}), m{k} AS (SELECT *, {mu} AS mu FROM e{k}), z{k} AS (SELECT x1, x2, {weight} AS w, eta + (y - mu) / ({weight}) AS z FROM m{k}), g{k} AS (SELECT {products(cols, 'w')} FROM z{k}), {regression(f'i{k}_', f'g{k}', list(cols), ['one', 'x1', 'x2'], 'z')}")
    return ", ".join(out)


for _name, _y, _mu, _w in (("logistic", "hit", "1 / (1 + exp(-eta))", "mu * (1 - mu)"), ("poisson", "n", "exp(eta)", "mu")):
    query(f"glr_{_name}", lambda p, f=_name, y=_y: table(p, linear.generalized(plot(p), y, ["x1", "x2"], f), "term", "beta", "se"), "plots", sql=f"""
WITH {PLOT}, {irls(_y, _mu, _w)} {' UNION ALL '.join(f"SELECT '{n}' AS term, {R(f's{i}_0')} AS beta, {R(f'sqrt(s{i}_{i + 1})')} AS se FROM i11_3" for i, n in enumerate(('intercept', 'x1', 'x2')))}""")

# cross sections with spatial lags over points: y = v, regressors v2 and x in hundreds, no intercept
SECTION = f"{W}, s AS (SELECT id, v AS y, v2 AS a, x / 100 AS b FROM {{points}})"
section = lambda p: p.select("id", F.col("v").alias("y"), F.col("v2").alias("a"), (F.col("x") / 100).alias("b"))


def lag(out: str, source: str, columns: list[str], prefix: str, by: str = "", raw: bool = False, keep: str = "*") -> str:
    """A CTE with the lags of columns of the CTE ``source`` (id, ..) under W or, ``raw``, its weights as they are."""
    cells = ", ".join(f"coalesce(sum(w * q.{c}){'' if raw else ' / sum(w) FILTER (q.id IS NOT NULL)'}, 0) AS {prefix}{c}" for c in columns)
    match = "q.id = w.j" + (f" AND q.{by} = p.{by}" if by else "")
    group = f"p.id{f', p.{by}' if by else ''}"
    return f"{out}l AS (SELECT {group}, {cells} FROM {source} p LEFT JOIN w ON w.i = p.id LEFT JOIN {source} q ON {match} GROUP BY {group}), {out} AS (SELECT {source}.*, {', '.join(f'{out}l.{prefix}{c}' for c in columns)} FROM {source} JOIN {out}l USING (id{f', {by}' if by else ''}))"


def two_stages(name: str, source: str, zs: list[str], xs: list[str], y: str) -> str:
    """CTEs of y on xs with instruments zs; the last is {name}<k> with s<i>_0 and the inverse of the fitted products."""
    cols = {c: c for c in dict.fromkeys([*zs, *xs, y])}
    names = list(cols)
    first = eliminate(f"{name}a", f"{name}g", [[dot(names, a, b) for b in zs] for a in zs], [[dot(names, z, c) for c in [*xs, y]] for z in zs], [f"p_{a}_{b}" for i, a in enumerate(names) for b in names[i:]])
    inner = lambda x, m: " + ".join(f"{dot(names, x, z)} * s{k}_{m}" for k, z in enumerate(zs))
    matrix = [[inner(x, m) for m in range(len(xs))] for x in xs]
    rhs = [[inner(x, len(xs)), *("1.0::DOUBLE" if i == j else "0.0::DOUBLE" for j in range(len(xs)))] for i, x in enumerate(xs)]
    return f"{name}g AS (SELECT {products(cols)} FROM {source}), {first}, {eliminate(name, f'{name}a{len(zs)}', matrix, rhs)}"


LAGS = f"{SECTION}, {lag('r', 's', ['y', 'a', 'b'], 'w')}"
query("spatial_lag_model", lambda p: table(p, linear.spatial_lag_model(section(p), band(p), "y", ["a", "b"]), "term", "beta", "se"), "points", sql=f"""
WITH {LAGS}, {two_stages('k', 'r', ['a', 'b', 'wa', 'wb'], ['wy', 'a', 'b'], 'y')}, t AS (SELECT sum(pow(y - s0_0 * wy - s1_0 * a - s2_0 * b, 2)) / (count(*) - 3) AS s2 FROM r, k3)
{' UNION ALL '.join(f"SELECT '{n}' AS term, {R(f's{i}_0')} AS beta, {R(f'sqrt(s2 * s{i}_{i + 1})')} AS se FROM k3, t" for i, n in enumerate(('rho', 'a', 'b')))}""")
query("spatial_tobit_model", lambda p: linear.spatial_tobit_model(section(p), band(p), "y", ["a", "b"]).summary(p.sparkSession), "points", sql=f"""
WITH {LAGS}, {two_stages('k', 'r', ['a', 'b', 'wa', 'wb'], ['wy', 'a', 'b'], 'y')} SELECT 'pseudo_r2' AS figure, {R('1 - sum(pow(y - greatest(0, s0_0 * wy + s1_0 * a + s2_0 * b), 2)) / (var_pop(y) * count(*))')} AS value FROM r, k3""")
_ab = {"a": "a", "b": "b", "y": "y"}
query("spatial_error_model", lambda p: table(p, linear.spatial_error_model(section(p), band(p), "y", ["a", "b"])), "points", sql=f"""
WITH {LAGS}, g AS (SELECT {products(_ab)} FROM r), {regression('o', 'g', list(_ab), ['a', 'b'], 'y')}, e AS (SELECT r.*, y - s0_0 * a - s1_0 * b AS e, wy - s0_0 * wa - s1_0 * wb AS we FROM r, o2),
l AS (SELECT greatest(-0.99, least(0.99, sum(e * we) / sum(we * we))) AS lam FROM e), f AS (SELECT y - lam * wy AS y, a - lam * wa AS a, b - lam * wb AS b FROM r, l), h AS (SELECT {products(_ab)} FROM f), {regression('n', 'h', list(_ab), ['a', 'b'], 'y')}
SELECT 'lambda' AS term, {R('lam')} AS beta FROM l UNION ALL {terms(['a', 'b'], 'n2')}""")
_db = {c: c for c in ("a", "b", "wa", "wb", "wy", "y")}
query("spatial_durbin_model", lambda p: table(p, linear.spatial_durbin_model(section(p), band(p), "y", ["a", "b"])), "points", sql=f"""
WITH {LAGS}, g AS (SELECT {products(_db)} FROM r), {regression('o', 'g', list(_db), ['a', 'b', 'wa', 'wb', 'wy'], 'y')} {terms(['a', 'b', 'theta_a', 'theta_b', 'rho'], 'o5')}""")
_sa = {c: c for c in ("a", "b", "wy", "y")}
query("spatial_sarma_model", lambda p: table(p, linear.spatial_sarma_model(section(p), band(p), "y", ["a", "b"])), "points", sql=f"""
WITH {LAGS}, g AS (SELECT {products(_sa)} FROM r), {regression('o', 'g', list(_sa), ['a', 'b', 'wy'], 'y')}, e AS (SELECT id, y - s0_0 * a - s1_0 * b - s2_0 * wy AS e FROM r, o3), {lag('h', 'e', ['e'], 'w')}
{terms(['a', 'b', 'rho'], 'o3')} UNION ALL SELECT 'lambda', {R('sum(e * we) / greatest(1e-9, sum(we * we))')} FROM h""")
query("hedonic_prices", lambda p: table(p, linear.hedonic(section(p), "y", ["a", "b"], band(p))), "points", sql=f"""
WITH {LAGS}, {ols('e', 'r', ['a', 'b', 'wy'], 'y')} {terms(['intercept', 'a', 'b', 'rho'], 'e4')}""")
query("residual_autocorrelation", lambda p: linear.residual_autocorrelation(p.select("id", (F.col("v") - F.col("v2")).alias("residual")), band(p)), "points", sql=f"""
WITH {W}, e AS (SELECT id, v - v2 - avg(v - v2) OVER () AS e FROM {{points}}), c AS (SELECT sum(w * a.e * b.e) AS c, sum(w) AS s0 FROM w JOIN e a ON a.id = i JOIN e b ON b.id = j), q AS (SELECT sum(e * e) AS q, count(*)::DOUBLE AS n FROM e)
SELECT {R('n / s0 * c / q')} AS i, {R('-1 / (n - 1)')} AS expected, {R('(n / s0 * c / q + 1 / (n - 1)) * sqrt(n)')} AS z FROM c, q""")

# panels
PANEL = "w AS (SELECT * FROM {ring}), p0 AS (SELECT * FROM {panel})"
XS = ["x1", "x2"]
P1 = f"{PANEL}, {lag('p1', 'p0', ['y', 'x1', 'x2'], 'w1', 't', True)}"
P2 = f"{P1}, {lag('p2', 'p1', ['w1y', 'w1x1', 'w1x2'], 'w', 't', True)}"
P3 = f"{P2}, {lag('p3', 'p2', ['ww1y', 'ww1x1', 'ww1x2'], 'w', 't', True)}"
Z2 = ["x1", "x2", "w1x1", "w1x2", "ww1x1", "ww1x2"]


def fitted(name: str, source: str, zs: list[str], target: str, out: str) -> str:
    """CTEs that add to ``source`` what zs fit of a target; the rows are {name}."""
    cols = {c: c for c in [*zs, target]}
    return f"{name}g AS (SELECT {products(cols)} FROM {source}), {eliminate(f'{name}e', f'{name}g', [[dot(list(cols), a, b) for b in zs] for a in zs], [[dot(list(cols), z, target)] for z in zs])}, {name} AS (SELECT {source}.*, {' + '.join(f's{k}_0 * {z}' for k, z in enumerate(zs))} AS {out} FROM {source}, {name}e{len(zs)})"


def plain(name: str, source: str, xs: list[str], y: str) -> str:
    cols = {c: c for c in [*xs, y]}
    return f"{name}g AS (SELECT {products(cols)} FROM {source}), {regression(name, f'{name}g', list(cols), xs, y)}"


query("panel_lag", lambda p, w: table(p, panel.panel_lag(p, w, "y", XS), "term", "beta", "se"), "panel", "ring", sql=f"""
WITH {P2}, {fitted('f', 'p2', Z2, 'w1y', 'hat')}, {plain('k', 'f', ['x1', 'x2', 'hat'], 'y')}, t AS (SELECT sum(pow(y - s0_0 * x1 - s1_0 * x2 - s2_0 * w1y, 2)) / (count(*) - 3) AS s2 FROM f, k3)
{' UNION ALL '.join(f"SELECT '{n}' AS term, {R(f's{i}_0')} AS beta, {R(f'sqrt(s2 * s{i}_{i + 1})')} AS se FROM k3, t" for i, n in enumerate(('x1', 'x2', 'rho')))}""")
_err = f"{plain('o', 'p1', XS, 'y')}, e AS (SELECT sum((y - s0_0 * x1 - s1_0 * x2) * (w1y - s0_0 * w1x1 - s1_0 * w1x2)) / sum(pow(w1y - s0_0 * w1x1 - s1_0 * w1x2, 2)) AS lam FROM p1, o2), f AS (SELECT y - lam * w1y AS y, x1 - lam * w1x1 AS x1, x2 - lam * w1x2 AS x2 FROM p1, e)"
query("panel_error", lambda p, w: table(p, panel.panel_error(p, w, "y", XS)), "panel", "ring", sql=f"WITH {P1}, {_err}, {plain('k', 'f', XS, 'y')} {terms(XS, 'k2')} UNION ALL SELECT 'lambda', {R('lam')} FROM e")
_star = ", ".join(f"{c} - lam * {d} AS {o}" for o, c, d in (("y", "y", "w1y"), ("x1", "x1", "w1x1"), ("x2", "x2", "w1x2"), ("w1y", "w1y", "ww1y"), ("w1x1", "w1x1", "ww1x1"), ("w1x2", "w1x2", "ww1x2"), ("ww1x1", "ww1x1", "www1x1"), ("ww1x2", "ww1x2", "www1x2")))
query("panel_sarma", lambda p, w: table(p, panel.panel_sarma(p, w, "y", XS)), "panel", "ring", sql=f"""
WITH {P3}, {fitted('f', 'p3', Z2, 'w1y', 'hat')}, {plain('k', 'f', ['x1', 'x2', 'hat'], 'y')}, e AS (SELECT id, t, y - s2_0 * w1y - s0_0 * x1 - s1_0 * x2 AS e, w1y - s2_0 * ww1y - s0_0 * w1x1 - s1_0 * w1x2 AS we FROM p3, k3),
l AS (SELECT sum(e * we) / sum(we * we) AS lam FROM e), q AS (SELECT {_star} FROM p3, l), {fitted('h', 'q', Z2, 'w1y', 'hat')}, {plain('n', 'h', ['x1', 'x2', 'hat'], 'y')} {terms(['x1', 'x2', 'rho'], 'n3')} UNION ALL SELECT 'lambda', {R('lam')} FROM l""")
_lag1 = f"{P1}, {plain('k', 'p1', ['w1y', 'x1', 'x2'], 'y')}"
query("panel_tobit_lag", lambda p, w: table(p, panel.panel_tobit_lag(p, w, "y", XS)), "panel", "ring", sql=f"WITH {_lag1} {terms(['rho', 'x1', 'x2'], 'k3')}")
query("panel_tobit_lag_figures", lambda p, w: panel.panel_tobit_lag(p, w, "y", XS, 0.5).summary(p.sparkSession), "panel", "ring", sql=f"""
WITH {_lag1}, e AS (SELECT y, y - s0_0 * w1y - s1_0 * x1 - s2_0 * x2 AS e FROM p1, k3), t AS (SELECT var_pop(e) AS v, sum(e * e) AS sse, count(*)::DOUBLE AS n, avg((y <= 0.5)::INT) AS c FROM e)
SELECT 'sigma' AS figure, {R('sqrt(v)')} AS value FROM t UNION ALL SELECT 'censored_share', {R('c')} FROM t UNION ALL SELECT 'log_likelihood', {R('-0.5 * n * ln(2 * pi() * (v + 1e-12)) - sse / (2 * (v + 1e-12))')} FROM t""")
query("panel_sem", lambda p, w: table(p, panel.panel_sem(p, w, "y", XS, 0.2)), "panel", "ring", sql=f"WITH {P1}, f AS (SELECT y - 0.2 * w1y AS y, x1 - 0.2 * w1x1 AS x1, x2 - 0.2 * w1x2 AS x2 FROM p1), {plain('k', 'f', XS, 'y')} {terms(XS, 'k2')}")
query("panel_probit", lambda p, w: table(p, panel.panel_probit(p.withColumn("y", ((F.col("id") * 7 + F.col("t") * 3) % 5 < 2).cast("double")), w, "y", XS)), "panel", "ring")
query("panel_probit_lag", lambda p, w: table(p, panel.panel_probit_lag(p.withColumn("y", ((F.col("id") * 7 + F.col("t") * 3) % 5 < 2).cast("double")), w, "y", XS)), "panel", "ring", sql=f"""
WITH w AS (SELECT * FROM {{ring}}), p0 AS (SELECT id, t, x1, x2, CASE WHEN (id * 7 + t * 3) % 5 < 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM {{panel}}), {lag('p1', 'p0', ['y'], 'w1', 't', True)}, {plain('k', 'p1', ['w1y', 'x1', 'x2'], 'y')} {terms(['rho', 'x1', 'x2'], 'k3')}""")
query("panel_tobit", lambda p, w: table(p, panel.panel_tobit(p, w, "y", XS, 0.3)), "panel", "ring")
query("panel_quantile", lambda p, w: table(p, panel.panel_quantile(p, w, "y", XS, 0.5)), "panel", "ring")
counts = lambda p: p.withColumn("y", F.floor(F.col("y") * 4))
_cnt = f"w AS (SELECT * FROM {{ring}}), p0 AS (SELECT id, t, x1, x2, floor(y * 4) AS y FROM {{panel}}), {lag('p1', 'p0', ['y', 'x1', 'x2'], 'w1', 't', True)}, {lag('p2', 'p1', ['w1x1', 'w1x2'], 'w', 't', True)}, {fitted('f', 'p2', Z2, 'w1y', 'hat')}, a AS (SELECT x1, x2, hat, y, ln(greatest(y, 0.1)) AS l FROM f), {plain('b', 'a', ['x1', 'x2', 'hat'], 'l')}"
_steps, _last = [], "b3"
for _k in range(15):
    _c = {c: c for c in ("x1", "x2", "hat", "z")}
    _steps.append(f"m{_k} AS (SELECT x1, x2, hat, y, exp(s0_0 * x1 + s1_0 * x2 + s2_0 * hat) AS mu FROM a, {_last}), z{_k} AS (SELECT x1, x2, hat, mu AS w, ln(mu) + (y - mu) / mu AS z FROM m{_k}), g{_k} AS (SELECT {products(_c, 'w')} FROM z{_k}), {regression(f'i{_k}_', f'g{_k}', list(_c), ['x1', 'x2', 'hat'], 'z')}")
    _last = f"i{_k}_3"
query("panel_count", lambda p, w: table(p, panel.panel_count(counts(p), w, "y", XS)), "panel", "ring", sql=f"WITH {_cnt}, {', '.join(_steps)} {terms(['x1', 'x2', 'rho'], _last)}")
query("panel_count_negative_binomial", lambda p, w: table(p, panel.panel_count(counts(p), w, "y", XS, True)), "panel", "ring")
query("panel_zero_inflated", lambda p, w: table(p, panel.panel_zero_inflated(counts(p), w, "y", XS)), "panel", "ring")
_dyn = "SELECT id, t, y - lag(y) OVER o AS dy, lag(y) OVER o - lag(y, 2) OVER o AS dlag, w1y - lag(w1y) OVER o AS dwy, x1 - lag(x1) OVER o AS d1, x2 - lag(x2) OVER o AS d2, lag(y, 2) OVER o AS zy, lag(x1, 2) OVER o AS z1, lag(x2, 2) OVER o AS z2, lag(w1y, 2) OVER o AS zwy, lag(w1x1, 2) OVER o AS zw1, lag(w1x2, 2) OVER o AS zw2 FROM p1 WINDOW o AS (PARTITION BY id ORDER BY t)"
query("panel_dynamic", lambda p, w: table(p, panel.panel_dynamic(p, w, "y", XS)), "panel", "ring", sql=f"""
WITH {P1}, q AS (SELECT * FROM ({_dyn}) WHERE dlag IS NOT NULL), {two_stages('k', 'q', ['zy', 'z1', 'z2', 'zwy', 'zw1', 'zw2'], ['dlag', 'dwy', 'd1', 'd2'], 'dy')} {terms(['gamma', 'rho', 'x1', 'x2'], 'k4')}""")
_sur = f"{PANEL}, {lag('p1', 'p0', ['y', 'x1'], 'w1', 't', True)}, {plain('k', 'p1', ['w1y', 'x2'], 'y')}, {plain('n', 'p1', ['w1x1', 'x2'], 'x1')}, e AS (SELECT y, x1, y - k2.s0_0 * w1y - k2.s1_0 * x2 AS e1, x1 - n2.s0_0 * w1x1 - n2.s1_0 * x2 AS e2 FROM p1, k2, n2)"
query("panel_sur", lambda p, w: panel.panel_sur(p, w, {"y": ["x2"], "x1": ["x2"]}), "panel", "ring", sql=f"""
WITH {_sur} SELECT 'y' AS equation, 'rho' AS term, {R('s0_0')} AS value FROM k2 UNION ALL SELECT 'y', 'x2', {R('s1_0')} FROM k2 UNION ALL SELECT 'x1', 'rho', {R('s0_0')} FROM n2 UNION ALL SELECT 'x1', 'x2', {R('s1_0')} FROM n2
UNION ALL SELECT 'y', 'r2', {R('greatest(0, 1 - sum(e1 * e1) / (var_pop(y) * count(*)))')} FROM e UNION ALL SELECT 'x1', 'r2', {R('greatest(0, 1 - sum(e2 * e2) / (var_pop(x1) * count(*)))')} FROM e
UNION ALL SELECT 'y', 'cov_y', {R('avg(e1 * e1)')} FROM e UNION ALL SELECT 'y', 'cov_x1', {R('avg(e1 * e2)')} FROM e UNION ALL SELECT 'x1', 'cov_y', {R('avg(e1 * e2)')} FROM e UNION ALL SELECT 'x1', 'cov_x1', {R('avg(e2 * e2)')} FROM e""")
_rg = {"x1": "x1", "x2": "x2", "y": "y"}
_solve = lambda name, source, keep=None: f"{eliminate(name, source, [[dot(list(_rg), a, b) for b in XS] for a in XS], [[dot(list(_rg), a, 'y')] for a in XS], [*(keep or []), 'p_y_y', 'p_x1_y', 'p_x2_y', 'n'])}"
query("panel_regimes", lambda p: panel.panel_regimes(p.withColumn("g", F.col("id") % 2), "g", "y", XS).where("term <> 'chow_p'"), "panel", sql=f"""
WITH p0 AS (SELECT *, id % 2 AS g FROM {{panel}}), a AS (SELECT CAST(g AS VARCHAR) AS g, {products(_rg)}, count(*) AS n FROM p0 GROUP BY 1), b AS (SELECT {products(_rg)}, count(*) AS n FROM p0), {_solve('k', 'a', ['g'])}, {_solve('n', 'b')},
s AS (SELECT (SELECT p_y_y - s0_0 * p_x1_y - s1_0 * p_x2_y FROM n2) AS pooled, (SELECT sum(p_y_y - s0_0 * p_x1_y - s1_0 * p_x2_y) FROM k2) AS inside, (SELECT n FROM n2) AS n)
SELECT g AS regime, 'x1' AS term, {R('s0_0')} AS value FROM k2 UNION ALL SELECT g, 'x2', {R('s1_0')} FROM k2 UNION ALL SELECT NULL, 'chow_f', {R('(pooled - inside) / 2 / (inside / (n - 4) + 1e-12)')} FROM s UNION ALL SELECT NULL, 'sse', {R('inside')} FROM s""")
_pv = f"{PANEL}, {lag('p1', 'p0', ['y', 'x1'], 'w1', 't', True)}, q AS (SELECT * FROM (SELECT *, lag(y) OVER o AS ly, lag(x1) OVER o AS lx FROM p1 WINDOW o AS (PARTITION BY id ORDER BY t)) WHERE ly IS NOT NULL), {plain('k', 'q', ['w1y', 'ly', 'lx'], 'y')}, {plain('n', 'q', ['w1x1', 'ly', 'lx'], 'x1')}, e AS (SELECT y - k3.s0_0 * w1y - k3.s1_0 * ly - k3.s2_0 * lx AS e1, x1 - n3.s0_0 * w1x1 - n3.s1_0 * ly - n3.s2_0 * lx AS e2 FROM q, k3, n3)"
query("panel_pvar", lambda p, w: panel.panel_pvar(p, w, ["y", "x1"]), "panel", "ring", sql=f"""
WITH {_pv} {' UNION ALL '.join(f"SELECT '{v}' AS equation, '{t}' AS term, {R(f's{i}_0')} AS value FROM {c}3" for v, c in (('y', 'k'), ('x1', 'n')) for i, t in enumerate(('rho', 'l1_y', 'l1_x1')))}
UNION ALL SELECT 'y', 'cov_y', {R('avg(e1 * e1)')} FROM e UNION ALL SELECT 'y', 'cov_x1', {R('avg(e1 * e2)')} FROM e UNION ALL SELECT 'x1', 'cov_y', {R('avg(e1 * e2)')} FROM e UNION ALL SELECT 'x1', 'cov_x1', {R('avg(e2 * e2)')} FROM e""")

# local statistics
NEAR = f"SELECT a.id AS i, b.id AS j, pow(1 - pow({D} / 200, 2), 2) AS k, b.v AS v, b.v2 AS v2 FROM {{points}} a JOIN {{points}} b ON {D} < 200"
query("gwr", lambda p: local.gwr(p, "v", ["v2"], 200.0, "fixed_bisquare").select("id", "support", "fitted", "r2", "beta_intercept", "beta_v2"), "points", sql=f"""
WITH n AS ({NEAR}), s AS (SELECT i, count(*) FILTER (k > 1e-12) AS support, sum(k) AS w, sum(k * v2) AS sx, sum(k * v2 * v2) AS xx, sum(k * v) AS sy, sum(k * v2 * v) AS xy, sum(k * v * v) AS yy FROM n GROUP BY i),
b AS (SELECT *, CASE WHEN w * xx - sx * sx > 1e-12 THEN (w * xy - sx * sy) / (w * xx - sx * sx) END AS b1 FROM s), c AS (SELECT *, (sy - b1 * sx) / w AS b0 FROM b WHERE b1 IS NOT NULL AND support > 2)
SELECT c.i AS id, support, {R('b0 + b1 * p.v2')} AS fitted, {R('1 - (yy - b0 * sy - b1 * xy) / (yy - sy * sy / w)')} AS r2, {R('b0')} AS beta_intercept, {R('b1')} AS beta_v2 FROM c JOIN {{points}} p ON p.id = c.i""")
query("gwr_adaptive", lambda p: local.gwr_summary(local.gwr(p, "v", ["v2"], 40.0), 2).select("rss", "tss", "r2", "effective"), "points", sql=f"""
WITH d AS (SELECT a.id AS i, b.id AS j, b.v, b.v2, {D} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {D}, b.id) AS k FROM {{points}} a, {{points}} b), e AS (SELECT i, max(d) AS e FROM d WHERE k <= 40 GROUP BY i),
n AS (SELECT d.*, pow(1 - pow(d / e, 2), 2) AS w FROM d JOIN e USING (i) WHERE k <= 40 AND d < e), s AS (SELECT i, sum(w) AS w, sum(w * v2) AS sx, sum(w * v2 * v2) AS xx, sum(w * v) AS sy, sum(w * v2 * v) AS xy FROM n GROUP BY i),
b AS (SELECT *, (w * xy - sx * sy) / (w * xx - sx * sx) AS b1 FROM s), f AS (SELECT p.v, (sy - b1 * sx) / w + b1 * p.v2 AS f, (xx - 2 * sx * p.v2 + w * p.v2 * p.v2) / (w * xx - sx * sx) AS h FROM b JOIN {{points}} p ON p.id = i)
SELECT {R('sum(pow(v - f, 2))')} AS rss, {R('var_pop(v) * count(*)')} AS tss, {R('1 - sum(pow(v - f, 2)) / (var_pop(v) * count(*))')} AS r2, {R('sum(h)')} AS effective FROM f""")
query("gwss", lambda p: local.gwss(p, ["v"], 100.0, "fixed_gaussian"), "points", sql=f"""
WITH n AS (SELECT a.id AS i, exp(-0.5 * pow({D} / 100, 2)) AS k, b.v FROM {{points}} a, {{points}} b), m AS (SELECT i, sum(k * v) / sum(k) AS m FROM n GROUP BY i), s AS (SELECT i, max(m) AS m, sqrt(sum(k * pow(v - m, 2)) / sum(k)) AS sd, sum(k * pow(v - m, 3)) / sum(k) AS m3 FROM n JOIN m USING (i) GROUP BY i)
SELECT i AS id, {R('m')} AS mean_v, {R('sd')} AS std_v, {R('m3 / (sd * sd * sd)')} AS skew_v FROM s""")
query("gwpca", lambda p: local.gwpca(p, ["v", "v2"], 100.0).select("id", "total", "value_1", "value_2", "share_1"), "points", sql=f"""
WITH n AS (SELECT a.id AS i, exp(-0.5 * pow({D} / 100, 2)) AS k, b.v, b.v2 FROM {{points}} a, {{points}} b), m AS (SELECT i, sum(k * v) / sum(k) AS m1, sum(k * v2) / sum(k) AS m2 FROM n GROUP BY i),
c AS (SELECT i, sum(k * pow(v - m1, 2)) / sum(k) AS a, sum(k * pow(v2 - m2, 2)) / sum(k) AS c, sum(k * (v - m1) * (v2 - m2)) / sum(k) AS b FROM n JOIN m USING (i) GROUP BY i), e AS (SELECT i, a + c AS t, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS l1, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b) AS l2 FROM c)
SELECT i AS id, {R('t')} AS total, {R('l1')} AS value_1, {R('l2')} AS value_2, {R('100 * l1 / t')} AS share_1 FROM e""")
query("gwlr", lambda p: local.gwlr(p.withColumn("hit", (F.col("v") > 0).cast("double")), "hit", ["v2"], 150.0), "points")
query("space_time_ridge", lambda p: local.space_time_ridge(p.withColumn("t", F.col("id") % 12), "v", ["v2"], 100.0, 4.0).select("id", "beta_v2", "fitted"), "points", sql=f"""
WITH n AS (SELECT a.id AS i, a.v2 AS own, exp(-0.5 * pow({D} / 100, 2)) * exp(-0.5 * pow((a.id % 12 - b.id % 12) / 4.0, 2)) AS k, b.v, b.v2 FROM {{points}} a, {{points}} b), s AS (SELECT i, max(own) AS own, sum(k * v2 * v) / (sum(k * v2 * v2) + 0.1) AS b FROM n GROUP BY i) SELECT i AS id, {R('b')} AS beta_v2, {R('b * own')} AS fitted FROM s""")

# rearrangements, distance bands, groups
query("local_geary", lambda p: resampling.local_geary(p, band(p), 0).select("id", "c"), "points", sql=f"""
WITH {W}, z AS (SELECT id, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS z FROM {{points}}) SELECT a.id, {R('coalesce(sum(w * pow(a.z - b.z, 2)), 0)')} AS c FROM z a LEFT JOIN w ON w.i = a.id LEFT JOIN z b ON b.id = w.j GROUP BY a.id""")
query("local_geary_permutations", lambda p: resampling.local_geary(p.where("g < 4"), band(p.where("g < 4")), 49), "points")
GINI = f"y AS (SELECT id, v - (SELECT min(v) FROM {{points}}) AS y FROM {{points}}), near AS (SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM ({PAIRS})), k AS (SELECT abs(a.y - b.y) AS d, n.i IS NOT NULL AS near FROM y a JOIN y b ON a.id < b.id LEFT JOIN near n ON n.i = a.id AND n.j = b.id)"
from_zero = lambda p: p.crossJoin(p.agg(F.min("v").alias("_lo"))).select("id", (F.col("v") - F.col("_lo")).alias("v"))
query("spatial_gini", lambda p: resampling.spatial_gini(from_zero(p), band(p), 0), "points", sql=f"""
WITH {GINI}, t AS (SELECT sum(d) AS a, sum(d) FILTER (near) AS b, avg(d) FILTER (near) AS na, avg(d) FILTER (NOT near) AS fa FROM k), n AS (SELECT count(*)::DOUBLE AS n, count(*) * sum(y) AS base FROM y)
SELECT n, {R('a / base')} AS gini, {R('b / base')} AS neighbour_part, {R('(a - b) / base')} AS other_part, {R('b / a')} AS neighbour_share, {R('(a - b) / a')} AS spatial_gini, {R('na')} AS near_avg, {R('fa')} AS far_avg, {R('fa / na')} AS polarization FROM t, n""")
query("spatial_gini_permutations", lambda p: resampling.spatial_gini(from_zero(p), band(p), 19), "points")
query("moran_simulation", lambda p: resampling.moran_simulation(p, band(p), 49), "points")
_inc = "SELECT r AS distance, p.id, count(q.id) AS k, coalesce(sum(p.z * q.z), 0) AS c FROM z p CROSS JOIN (VALUES (20.0::DOUBLE), (40.0::DOUBLE), (60.0::DOUBLE)) t(r) LEFT JOIN z q ON q.id <> p.id AND sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) <= r GROUP BY r, p.id"
query("incremental_autocorrelation", lambda p: resampling.incremental_moran(p, [20.0, 40.0, 60.0]), "points", sql=f"""
WITH z AS (SELECT id, x, y, v - avg(v) OVER () AS z FROM {{points}}), b AS ({_inc}), m AS (SELECT sum(z * z) AS m2, sum(z * z * z * z) AS m4, count(*)::DOUBLE AS n FROM z),
s AS (SELECT distance, sum(k)::DOUBLE AS s0, 2 * sum(k)::DOUBLE AS s1, 4 * sum(k * k)::DOUBLE AS s2, sum(c) AS c, count(*) FILTER (k = 0) AS isolated, min(k) AS fewest, max(k) AS most, median(k)::DOUBLE AS median FROM b GROUP BY distance),
i AS (SELECT *, n / s0 * c / m2 AS i, -1 / (n - 1) AS e, n * m4 / (m2 * m2) AS d FROM s, m), v AS (SELECT *, (n * ((n*n - 3*n + 3) * s1 - n * s2 + 3 * s0*s0) - d * ((n*n - n) * s1 - 2 * n * s2 + 6 * s0*s0)) / ((n-1) * (n-2) * (n-3) * s0*s0) - e * e AS var FROM i)
SELECT distance, {R('i')} AS i, {R('e')} AS expected, {R('(i - e) / sqrt(var)')} AS z, isolated, fewest, most, median FROM v""")
_km = "z AS (SELECT id, (c1 - avg(c1) OVER ()) / stddev_pop(c1) OVER () AS a, (c2 - avg(c2) OVER ()) / stddev_pop(c2) OVER () AS b FROM {alternatives}), k0 AS (SELECT id - 1 AS c, a, b FROM z WHERE id IN (1, 2, 3))"
_rounds = ", ".join(f"l{r} AS (SELECT z.id, z.a, z.b, arg_min(k.c, (pow(z.a - k.a, 2) + pow(z.b - k.b, 2), k.c)) AS c FROM z, k{r} k GROUP BY z.id, z.a, z.b), k{r + 1} AS (SELECT c, avg(a) AS a, avg(b) AS b FROM l{r} GROUP BY c)" for r in range(6))
query("kmeans", lambda a: resampling.kmeans(a, ["c1", "c2"], 3, 6, 0.0, initial=[1, 2, 3])[0], "alternatives", sql=f"WITH {_km}, {_rounds} SELECT id, CAST(c AS INT) AS cluster FROM l5")
query("kmeans_plus_plus", lambda a: resampling.kmeans(a, ["c1", "c2", "c3"], 4)[0], "alternatives")
query("g_star", lambda p: resampling.g_star(p), "points", sql=f"SELECT id, {R('(v - avg(v) OVER ()) / stddev_pop(v) OVER ()')} AS z FROM {{points}}")
_sk = "e AS (SELECT row_number() OVER (ORDER BY sqrt(pow(a.v - b.v, 2) + pow((a.pop - b.pop) * 10, 2)), a.id, b.id) AS k, a.id AS u, b.id AS v FROM {areas} a JOIN {areas} b ON a.id < b.id AND abs(a.x - b.x) + abs(a.y - b.y) = 1)"
query("skater", lambda a: resampling.skater(a.withColumn("p", F.col("pop") * 10), a.alias("a").join(a.alias("b"), F.expr("abs(a.x - b.x) + abs(a.y - b.y) = 1")).select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), F.lit(1.0).alias("w")), ["v", "p"], 4).select(F.col("id").cast("long").alias("id"), F.col("cluster").cast("long").alias("cluster")), "areas", sql=f"""
WITH RECURSIVE {_sk}, r(k, n) AS (SELECT k, u FROM e UNION SELECT r.k, CASE WHEN f.u = r.n THEN f.v ELSE f.u END FROM r JOIN e f ON f.k < r.k AND (f.u = r.n OR f.v = r.n)),
m AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.k = e.k AND r.n = e.v)), t AS (SELECT * FROM m QUALIFY row_number() OVER (ORDER BY k DESC) > 3),
c(a, b) AS (SELECT id, id FROM {{areas}} UNION SELECT c.a, CASE WHEN t.u = c.b THEN t.v ELSE t.u END FROM c JOIN t ON t.u = c.b OR t.v = c.b) SELECT CAST(a AS BIGINT) AS id, CAST(min(b) AS BIGINT) AS cluster FROM c GROUP BY a""")
cells = lambda p: p.select("id", "t", F.col("y").alias("v"))
with_self = lambda w: w.unionByName(w.select("i", F.col("i").alias("j"), F.lit(1.0).alias("w")).distinct())
HOT = "w AS (SELECT * FROM {ring} UNION ALL SELECT DISTINCT i, i, 1.0::DOUBLE FROM {ring}), m AS (SELECT t, avg(y) AS m, stddev_pop(y) AS sd, count(*)::DOUBLE AS n FROM {panel} GROUP BY t), g AS (SELECT i AS id, t, sum(w) AS sw, sum(w * w) AS sww, sum(w * y) AS lag FROM w JOIN {panel} p ON p.id = j GROUP BY i, t), z AS (SELECT id, t, (lag - m * sw) / (sd * sqrt((n * sww - sw * sw) / (n - 1))) AS z FROM g JOIN m USING (t))"
query("hot_series", lambda p, w: resampling.hot_series(cells(p), with_self(w)), "panel", "ring", sql=f"WITH {HOT} SELECT id, t, {R('z')} AS z FROM z")
query("emerging_hotspots", lambda p, w: resampling.emerging_hotspots(cells(p), with_self(w), 0.3).select("id", "mk_z", "tau", "hot", "cold"), "panel", "ring", sql=f"""
WITH {HOT}, s AS (SELECT a.id, sum(sign(b.z - a.z)) AS s FROM z a JOIN z b ON a.id = b.id AND b.t > a.t GROUP BY a.id), h AS (SELECT id, count(*) FILTER (z > 1.0364333894937898) AS hot, count(*) FILTER (z < -1.0364333894937898) AS cold, count(*)::DOUBLE AS n FROM z GROUP BY id)
SELECT id, {R('(s - sign(s)) / sqrt(n * (n - 1) * (2 * n + 5) / 18)')} AS mk_z, {R('s / (n * (n - 1) / 2)')} AS tau, hot, cold FROM s JOIN h USING (id)""")
query("hotspot_patterns", lambda p, w: resampling.emerging_hotspots(cells(p), with_self(w), 0.3).select("id", "pattern"), "panel", "ring")
query("hotspot_codes", lambda p, w: resampling.hotspot_codes(resampling.hot_series(cells(p), with_self(w)), 0.3), "panel", "ring")

# kriging
near = lambda p: p.where("g = 1")
query("kriging", lambda p: interpolation.kriging(near(p), p.where("g = 2"), "exponential", 0.01, 1.0, 80.0), "points")
query("kriging_grid", lambda p: interpolation.kriging_grid(near(p), (-50.0, -50.0, 50.0, 50.0), 10.0, "spherical", 0.0, 1.0, 80.0), "points")
query("idw_grid", lambda p: interpolation.idw_grid(p.where("g < 5"), (-60.0, -40.0, 60.0, 40.0), 20.0), "points", sql=f"""
WITH c AS (SELECT i, j, -60 + (j + 0.5) * 20 AS x, 40 - (i + 0.5) * 20 AS y FROM range(4) a(i), range(6) b(j)), s AS (SELECT * FROM {{points}} WHERE g < 5), n AS (SELECT a.i, a.j, b.v, {D} AS d FROM c a, s b QUALIFY row_number() OVER (PARTITION BY a.i, a.j ORDER BY {D}, b.id) <= 12)
SELECT CAST(i AS INT) AS row, CAST(j AS INT) AS col, {R('sum(v / (d * d)) / sum(1 / (d * d))')} AS value FROM n GROUP BY i, j""")
