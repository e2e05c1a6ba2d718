"""Regression from sums of products: one aggregate over the rows, then small linear algebra on the driver.

A model's columns, their spatial lags and linear combinations of both are vectors over the base columns, so residuals,
filtered variables and instruments need no second pass: every inner product comes from the one matrix of sums.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.core.tables import stored


def normal_p(z: float) -> float:
    """Two-sided p of a normal score."""
    return math.erfc(abs(z) / math.sqrt(2)) if math.isfinite(z) else 0.0


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or 1e-300)
            c = (1 + step / c) or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def student_p(t: float, df: float) -> float:
    """Two-sided p of a Student t value."""
    return beta_share(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def f_tail(x: float, df1: float, df2: float) -> float:
    return 1 - beta_share(df1 / 2, df2 / 2, df1 * x / (df1 * x + df2)) if x > 0 else 1.0


def chi2_tail(x: float, df: int) -> float:
    """Exact for two degrees of freedom, else by Wilson and Hilferty's cube root."""
    if x <= 0:
        return 1.0
    if df == 2:
        return math.exp(-x / 2)
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return min(1.0, max(0.0, 0.5 * math.erfc(z / math.sqrt(2))))


def lagged(df: DataFrame, w: DataFrame, columns: list[str], order: int = 1, standardize: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` (id, ``by``, ...) with w1_c, w2_c .. for each column: weighted neighbour values of the same ``by``.

    Standardised lags are divided by the weights of the neighbours that exist; a unit without neighbours has lag 0.
    """
    for k in range(1, order + 1):
        names = columns if k == 1 else [f"w{k - 1}_{c}" for c in columns]
        right = df.select(F.col("id").alias("j"), *by, *(F.col(c).alias(f"_{i}") for i, c in enumerate(names)))
        sums = w.join(right, "j").groupBy(F.col("i").alias("id"), *by).agg(F.sum("w").alias("_w"), *(F.sum(F.col("w") * F.col(f"_{i}")).alias(f"_{i}") for i in range(len(names))))
        whole = lambda i: F.when(F.lit(standardize) & (F.col("_w") != 0), F.col(f"_{i}") / F.col("_w")).otherwise(F.col(f"_{i}"))
        sums = sums.select("id", *by, *(whole(i).alias(f"w{k}_{c}") for i, c in enumerate(columns)))
        df = df.join(sums, ["id", *by], "left").na.fill(0.0, [f"w{k}_{c}" for c in columns])
    return df


class Moments:
    """All sums of products of some columns (and a constant, ``1``), with vectors that stand for combinations of them."""

    def __init__(self, df: DataFrame, columns: dict[str, str | Column] | list[str], weight: Column | None = None):
        named = {c: F.col(c) for c in columns} if isinstance(columns, list) else {k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()}
        named = {"1": F.lit(1.0)} | named
        self.names = list(named)
        values = list(named.values())
        complete = reduce(lambda a, b: a & b, [v.isNotNull() for v in values])
        pairs = [(i, j) for i in range(len(values)) for j in range(i, len(values))]
        factor = F.lit(1.0) if weight is None else weight
        row = df.where(complete).agg(*(F.sum(factor * values[i] * values[j]).alias(f"p{i}_{j}") for i, j in pairs), F.count("*").alias("rows")).first()
        self.g = np.zeros((len(values), len(values)))
        for i, j in pairs:
            self.g[i, j] = self.g[j, i] = row[f"p{i}_{j}"] or 0.0
        self.n = row["rows"]

    def __getitem__(self, name: str) -> np.ndarray:
        out = np.zeros(len(self.names))
        out[self.names.index(name)] = 1.0
        return out

    def of(self, names: list[str]) -> np.ndarray:
        return np.array([self[n] for n in names]).reshape(len(names), len(self.names))

    def dot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a @ self.g @ np.asarray(b).T

    def fit(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Least squares coefficients of y on the rows of x."""
        return np.linalg.pinv(self.dot(x, x)) @ self.dot(x, y)

    def projected(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        """The rows of x as fitted by the instruments z."""
        return (np.linalg.pinv(self.dot(z, z)) @ self.dot(z, x)).T @ z

    def squares(self, e: np.ndarray) -> float:
        return max(0.0, float(self.dot(e, e)))

    def spread(self, y: np.ndarray) -> float:
        """Sum of squares about the mean."""
        one = self["1"]
        return max(0.0, float(self.dot(y, y) - self.dot(one, y) ** 2 / max(self.g[0, 0], 1e-300)))


@dataclass
class Fit:
    """Coefficients of a model, figures of it, and what its fitted value is over the columns of ``frame``."""

    terms: list[str]
    beta: np.ndarray
    se: np.ndarray | None = None
    df: float | None = None
    figures: dict[str, float] = field(default_factory=dict)
    frame: DataFrame | None = None
    fitted: Column | None = None

    def table(self, spark: SparkSession) -> DataFrame:
        """(term, beta[, se, z, p]); p is Student's where the model has degrees of freedom, else normal."""
        if self.se is None:
            return spark.createDataFrame([(t, float(b)) for t, b in zip(self.terms, self.beta)], "term string, beta double")
        rows = []
        for t, b, s in zip(self.terms, self.beta, self.se):
            z = float(b / s) if s > 0 else 0.0
            p = 1.0 if s <= 0 else (normal_p(z) if self.df is None else student_p(z, self.df))
            rows.append((t, float(b), float(s), z, p))
        return spark.createDataFrame(rows, "term string, beta double, se double, z double, p double")

    def summary(self, spark: SparkSession) -> DataFrame:
        """(figure, value)."""
        return spark.createDataFrame([(k, float(v)) for k, v in self.figures.items()], "figure string, value double")

    def residuals(self, y: str) -> DataFrame:
        """``frame`` with ``fitted`` and ``residual``."""
        return self.frame.withColumn("fitted", self.fitted).withColumn("residual", F.col(y) - F.col("fitted"))


def _deviations(cov: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, np.diagonal(cov)))


def combined(beta, columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(float(b)) * c for b, c in zip(beta, columns)])


def _likelihood(n: float, sse: float) -> float:
    return -0.5 * n * (math.log(2 * math.pi) + math.log(max(1e-9, sse / n)) + 1)


def ols_model(df: DataFrame, y: str, xs: list[str], w: DataFrame | None = None) -> Fit:
    """Least squares with an intercept: se, t, normal p; R2, Jarque-Bera, Breusch-Pagan and, with W, the residuals' Moran.

    Rows need an id where W is given. The tests need the residuals' higher moments, which are a second aggregate.
    """
    m = Moments(df, [y, *xs])
    n, k = m.n, len(xs)
    if n <= k + 1:
        raise ValueError(f"{n} rows are too few for {k} regressors and an intercept")
    x = m.of(["1", *xs])
    inverse = np.linalg.pinv(m.dot(x, x))
    beta = inverse @ m.dot(x, m[y])
    e = m[y] - beta @ x
    sse, sst = m.squares(e), m.spread(m[y])
    s2 = sse / (n - k - 1)
    r2 = 1 - sse / sst if sst > 0 else 0.0
    fit = Fit(["intercept", *xs], beta, _deviations(s2 * inverse), None, {"n": n, "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / (n - k - 1)}, df, combined(beta, [F.lit(1.0), *map(F.col, xs)]))
    rows = fit.residuals(y)
    e2 = F.col("residual") * F.col("residual")
    high = rows.agg(F.sum(e2 * F.col("residual")).alias("m3"), F.sum(e2 * e2).alias("m4")).first()
    jb, bp = 0.0, 0.0
    if sse / n > 0 and high["m3"] is not None:
        skew, kurt = high["m3"] / n / (sse / n) ** 1.5, high["m4"] / n / (sse / n) ** 2
        jb = n / 6 * (skew**2 + (kurt - 3) ** 2 / 4)
        g = Moments(rows.withColumn("_g", e2), ["_g", *xs])
        xg = g.of(["1", *xs])
        tot = g.spread(g["_g"])
        bp = n * (1 - g.squares(g["_g"] - g.fit(xg, g["_g"]) @ xg) / tot) if tot > 0 else 0.0
    fit.figures |= {"jarque_bera": jb, "jarque_bera_p": chi2_tail(jb, 2), "breusch_pagan": bp, "breusch_pagan_p": chi2_tail(bp, k)}
    if w is not None:
        e_lag = lagged(rows.select("id", "residual"), w, ["residual"], standardize=False)
        fit.figures["residual_moran"] = (e_lag.agg(F.sum(F.col("residual") * F.col("w1_residual")).alias("s")).first()["s"] or 0.0) / sse if sse > 0 else 0.0
    return fit


def exploratory(df: DataFrame, y: str, xs: list[str], max_vars: int | None = None) -> DataFrame:
    """(variables, n_vars, r2, adj_r2, aicc) of all subsets of at most ``max_vars`` (5) regressors, least AICc first.

    All models come from one matrix of sums.
    """
    m = Moments(df, [y, *xs])
    n, sst = m.n, m.spread(m[y])
    rows = []
    for k in range(1, min(max_vars or 5, len(xs)) + 1):
        for names in combinations(xs, k) if sst > 0 else ():
            if n - k - 1 <= 0:
                continue
            x = m.of(["1", *names])
            sse = m.squares(m[y] - m.fit(x, m[y]) @ x)
            r2 = 1 - sse / sst
            aicc = math.inf
            if sse > 0 and n - k - 3 > 0:
                aicc = n * (math.log(2 * math.pi * sse / n) + 1) + 2 * (k + 2) + 2 * (k + 2) * (k + 3) / (n - k - 3)
            rows.append((",".join(names), k, r2, 1 - (1 - r2) * (n - 1) / (n - k - 1), aicc))
    rows.sort(key=lambda r: (r[4], r[0]))
    return df.sparkSession.createDataFrame(rows, "variables string, n_vars int, r2 double, adj_r2 double, aicc double")


def generalized(df: DataFrame, y: str, xs: list[str], family: str = "gaussian", max_iter: int = 100, tol: float = 1e-6) -> Fit:
    """Gaussian (closed form), logistic or poisson regression with an intercept by reweighted least squares.

    A round is one aggregate over the rows; the coefficients alone are on the driver.
    """
    family = family.lower()
    names = ["1", *xs]
    if family == "gaussian":
        m = Moments(df, [y, *xs])
        n, k, x = m.n, len(xs), m.of(names)
        inverse = np.linalg.pinv(m.dot(x, x))
        beta = inverse @ m.dot(x, m[y])
        sse, sst = m.squares(m[y] - beta @ x), m.spread(m[y])
        ll = -n / 2 * (math.log(2 * math.pi * sse / n) + 1) if sse > 0 else 0.0
        se = _deviations(sse / (n - k - 1) * inverse) if n > k + 1 else np.zeros(k + 1)
        return Fit(["intercept", *xs], beta, se, None, {"n": n, "log_likelihood": ll, "aic": 2 * (k + 2) - 2 * ll, "r2": 1 - sse / sst if sst > 0 else 0.0, "iterations": 1}, df, combined(beta, [F.lit(1.0), *map(F.col, xs)]))
    if family not in ("logistic", "poisson"):
        raise ValueError("families are gaussian, logistic and poisson")
    limit = 35.0 if family == "logistic" else 30.0

    def parts(beta):
        raw = combined(beta, [F.lit(1.0), *map(F.col, xs)])
        eta = F.least(F.greatest(raw, F.lit(-limit)), F.lit(limit))
        if family == "logistic":
            mu = 1 / (1 + F.exp(-eta))
            return raw, mu, F.greatest(mu * (1 - mu), F.lit(1e-9))
        mu = F.greatest(F.exp(eta), F.lit(1e-9))
        return eta, mu, mu

    beta, done = np.zeros(len(names)), 0
    for done in range(1, max_iter + 1):
        eta, mu, weight = parts(beta)
        m = Moments(df, {x: x for x in xs} | {"_z": eta + (F.col(y) - mu) / weight}, weight)
        x = m.of(names)
        new = np.linalg.pinv(m.dot(x, x)) @ m.dot(x, m["_z"])
        moved = float(np.abs(new - beta).max())
        beta = new
        if moved < tol:
            break
    eta, mu, weight = parts(beta)
    m = Moments(df, xs, weight)
    x = m.of(names)
    if family == "logistic":
        ll = F.col(y) * F.ln(mu + 1e-12) + (1 - F.col(y)) * F.ln(1 - mu + 1e-12)
    else:
        ll = F.col(y) * F.ln(mu) - mu - F.ln(F.expr(f"aggregate(sequence(1, greatest(cast(`{y}` as int), 1)), 1D, (a, i) -> a * i)"))
        large = F.col(y) > 20  # beyond 20! the logarithms are summed instead
        ll = F.col(y) * F.ln(mu) - mu - F.when(large, F.expr(f"aggregate(sequence(1, greatest(cast(`{y}` as int), 1)), 0D, (a, i) -> a + ln(i))")).otherwise(F.ln(F.expr(f"aggregate(sequence(1, least(greatest(cast(`{y}` as int), 1), 20)), 1D, (a, i) -> a * i)")))
    total = df.agg(F.sum(ll).alias("s")).first()["s"] or 0.0
    return Fit(["intercept", *xs], beta, _deviations(np.linalg.pinv(m.dot(x, x))), None, {"n": m.n, "log_likelihood": total, "aic": 2 * len(names) - 2 * total, "iterations": done}, df, mu)


def hedonic(df: DataFrame, y: str, xs: list[str], w: DataFrame | None = None) -> Fit:
    """Price model with an intercept and, with W, the neighbours' standardised prices as one more regressor."""
    names = list(xs)
    if w is not None:
        df = stored(lagged(df, w, [y]), "lags")
        names = [*xs, f"w1_{y}"]
    m = Moments(df, [y, *names])
    n, x = m.n, m.of(["1", *names])
    beta = m.fit(x, m[y])
    e = m[y] - beta @ x
    sse, sst = m.squares(e), m.spread(m[y])
    r2 = 1 - sse / max(sst, 1e-12)
    frame = df
    fit = Fit(["intercept", *xs, *(["rho"] if w is not None else [])], beta, None, None, {"r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / max(n - len(beta), 1), "rmse": math.sqrt(sse / max(n, 1))}, frame, combined(beta, [F.lit(1.0), *map(F.col, names)]))
    fit.figures["mae"] = fit.residuals(y).agg(F.avg(F.abs("residual")).alias("m")).first()["m"] or 0.0
    return fit


# models with spatial lags; the regressors are taken as they are, without an intercept


def _with_lags(df: DataFrame, w: DataFrame, y: str, xs: list[str]) -> DataFrame:
    return stored(lagged(df.select("id", y, *xs), w, [y, *xs]), "lags")


def spatial_lag_model(df: DataFrame, w: DataFrame, y: str, xs: list[str]) -> Fit:
    """rho and the coefficients by two stages, with [X, WX] as instruments of [Wy, X]."""
    rows = _with_lags(df, w, y, xs)
    m = Moments(rows, [y, *xs, f"w1_{y}", *(f"w1_{x}" for x in xs)])
    n, k = m.n, len(xs)
    if n <= k + 1:
        raise ValueError(f"{n} rows are too few for {k} regressors and rho")
    x, z = m.of([f"w1_{y}", *xs]), m.of([*xs, *(f"w1_{c}" for c in xs)])
    hat = m.projected(x, z)
    inverse = np.linalg.pinv(m.dot(hat, hat))
    beta = inverse @ m.dot(hat, m[y])
    sse, sst = m.squares(m[y] - beta @ x), m.spread(m[y])
    ll = _likelihood(n, sse)
    figures = {"r2": 1 - sse / sst if sst > 0 else 0.0, "log_likelihood": ll, "aic": 2 * (k + 2) - 2 * ll}
    return Fit(["rho", *xs], beta, _deviations(sse / max(1, n - k - 1) * inverse), None, figures, rows, combined(beta, [F.col(f"w1_{y}"), *map(F.col, xs)]))


def spatial_error_model(df: DataFrame, w: DataFrame, y: str, xs: list[str]) -> Fit:
    """lambda from the least squares residuals and their lags, then least squares on the filtered variables."""
    rows = _with_lags(df, w, y, xs)
    m = Moments(rows, [y, *xs, f"w1_{y}", *(f"w1_{x}" for x in xs)])
    n, k = m.n, len(xs)
    x, wx, wy = m.of(xs), m.of([f"w1_{c}" for c in xs]), m[f"w1_{y}"]
    b = m.fit(x, m[y])
    e, we = m[y] - b @ x, wy - b @ wx
    lam = float(m.dot(e, we) / m.squares(we)) if m.squares(we) > 0 else 0.0
    lam = max(-0.99, min(0.99, lam))
    xs_, ys_ = x - lam * wx, m[y] - lam * wy
    inverse = np.linalg.pinv(m.dot(xs_, xs_))
    beta = inverse @ m.dot(xs_, ys_)
    sse, sst = m.squares(m[y] - beta @ x), m.spread(m[y])
    ll = _likelihood(n, sse)
    se = _deviations(sse / max(1, n - k) * inverse)
    return Fit(["lambda", *xs], np.concatenate([[lam], beta]), np.concatenate([[0.0], se]), None, {"r2": 1 - sse / sst if sst > 0 else 0.0, "log_likelihood": ll, "aic": 2 * (k + 1) - 2 * ll}, rows, combined(beta, [F.col(c) for c in xs]))


def spatial_durbin_model(df: DataFrame, w: DataFrame, y: str, xs: list[str]) -> Fit:
    """Least squares on X, WX (theta) and Wy (rho)."""
    rows = _with_lags(df, w, y, xs)
    names = [*xs, *(f"w1_{x}" for x in xs), f"w1_{y}"]
    m = Moments(rows, [y, *names])
    x = m.of(names)
    beta = m.fit(x, m[y])
    sse, sst = m.squares(m[y] - beta @ x), m.spread(m[y])
    return Fit([*xs, *(f"theta_{c}" for c in xs), "rho"], beta, None, None, {"r2": 1 - sse / max(sst, 1e-12)}, rows, combined(beta, [F.col(c) for c in names]))


def spatial_sarma_model(df: DataFrame, w: DataFrame, y: str, xs: list[str]) -> Fit:
    """Least squares on X and Wy, then lambda from the residuals' lags."""
    rows = stored(lagged(df.select("id", y, *xs), w, [y, *xs], 2), "lags")
    m = Moments(rows, [y, *xs, f"w1_{y}", f"w2_{y}", *(f"w1_{x}" for x in xs)])
    x = m.of([*xs, f"w1_{y}"])
    beta = m.fit(x, m[y])
    e = m[y] - beta @ x
    we = m[f"w1_{y}"] - beta @ m.of([*(f"w1_{c}" for c in xs), f"w2_{y}"])
    lam = float(m.dot(e, we)) / max(1e-9, m.squares(we))
    return Fit([*xs, "rho", "lambda"], np.concatenate([beta, [lam]]), None, None, {}, rows, combined(beta, [F.col(c) for c in [*xs, f"w1_{y}"]]))


def spatial_tobit_model(df: DataFrame, w: DataFrame, y: str, xs: list[str]) -> Fit:
    """The lag model by two stages; fitted values are cut at zero."""
    fit = spatial_lag_model(df, w, y, xs)
    fitted = F.greatest(fit.fitted, F.lit(0.0))
    e = F.col(y) - fitted
    t = fit.frame.agg(F.sum(e * e).alias("sse"), (F.var_pop(y) * F.count(y)).alias("sst"), F.count_if(F.col(y) > 0).alias("n")).first()
    if t["n"] < len(xs) + 1:
        raise ValueError("too few values above zero")
    return Fit(fit.terms, fit.beta, None, None, {"pseudo_r2": 1 - t["sse"] / t["sst"] if t["sst"] else 0.0}, fit.frame, fitted)


def residual_autocorrelation(residuals: DataFrame, w: DataFrame, e: str = "residual") -> DataFrame:
    """One row: Moran's I of residuals (id, e), its expectation and z = (I - E) sqrt(n)."""
    z = residuals.select("id", F.col(e).cast("double").alias("e")).crossJoin(F.broadcast(residuals.agg(F.avg(e).alias("_m"), F.count("*").cast("double").alias("_n"))))
    z = z.select("id", (F.col("e") - F.col("_m")).alias("z"), "_n")
    near = w.join(z.select(F.col("id").alias("i"), F.col("z").alias("zi")), "i").join(z.select(F.col("id").alias("j"), F.col("z").alias("zj")), "j")
    cross = near.agg(F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("c")).crossJoin(w.agg(F.sum("w").alias("s0"))).crossJoin(z.agg(F.sum(F.col("z") * F.col("z")).alias("q"), F.max("_n").alias("n")))
    out = cross.withColumn("i", F.col("n") / F.greatest("s0", F.lit(1e-12)) * F.coalesce("c", F.lit(0.0)) / F.greatest("q", F.lit(1e-12))).withColumn("expected", -1 / F.greatest(F.col("n") - 1, F.lit(1.0)))
    return out.select("i", "expected", ((F.col("i") - F.col("expected")) * F.sqrt("n")).alias("z"))
