"""Spatial panel models over rows (id, t, y, x1, ..) and weights W(i, j, w), which are used as they are.

Lags join neighbours of the same period. Linear models need one aggregate; reweighted ones need one a round. Nothing but
sums of products reaches the driver. Regressors are taken as they are, without an intercept.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from urbanloom.core.tables import stored
from urbanloom.operators.linear import Fit, Moments, _deviations, combined, f_tail, lagged

_ROOT = math.sqrt(2 * math.pi)


@pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    """The normal distribution function; neither engine's SQL has one."""
    return pd.Series([0.5 * math.erfc(-x / math.sqrt(2)) for x in z.to_numpy(float)], dtype=float)


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / _ROOT


def _checked(df: DataFrame, least: int = 2) -> int:
    n = df.agg(F.count_distinct("t").alias("t"), F.count_distinct("id").alias("n")).first()
    if n["t"] < least or n["n"] < 3:
        raise ValueError(f"a panel needs at least 3 units and {least} periods")
    return n["t"]


def _lags(df: DataFrame, w: DataFrame, y: str, xs: list[str], order: int = 2) -> DataFrame:
    """Lags 1 .. order of y and the regressors, written once."""
    return stored(lagged(df.select("id", "t", y, *xs), w, [y, *xs], order, False, ("t",)), "lags")


def _names(prefix: str, xs: list[str]) -> list[str]:
    return [f"{prefix}_{x}" for x in xs]


def _instrumented(m: Moments, x: np.ndarray, wy: np.ndarray, z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of [X, fitted Wy] and the rows they were fitted on."""
    stage = np.vstack([x, m.projected(wy[None, :], z)])
    return m.fit(stage, y), stage


def panel_lag(df: DataFrame, w: DataFrame, y: str, xs: list[str]) -> Fit:
    """rho by two stages with X, WX and WWX as instruments of Wy."""
    _checked(df)
    rows = _lags(df, w, y, xs)
    m = Moments(rows, [y, *xs, f"w1_{y}", *_names("w1", xs), *_names("w2", xs)])
    x, z, wy = m.of(xs), m.of([*xs, *_names("w1", xs), *_names("w2", xs)]), m[f"w1_{y}"]
    beta, stage = _instrumented(m, x, wy, z, m[y])
    sse, sst, free = m.squares(m[y] - beta @ np.vstack([x, wy])), m.spread(m[y]), m.n - len(xs) - 1
    se = _deviations(sse / free * np.linalg.pinv(m.dot(stage, stage)))
    return Fit([*xs, "rho"], beta, se, free, {"r2": 1 - sse / sst if sst > 0 else 0.0}, rows, combined(beta, [F.col(c) for c in [*xs, f"w1_{y}"]]))


def panel_error(df: DataFrame, w: DataFrame, y: str, xs: list[str]) -> Fit:
    """lambda from the residuals and their lags, then least squares on the filtered variables."""
    _checked(df)
    rows = _lags(df, w, y, xs, 1)
    m = Moments(rows, [y, *xs, f"w1_{y}", *_names("w1", xs)])
    x, wx, wy = m.of(xs), m.of(_names("w1", xs)), m[f"w1_{y}"]
    b = m.fit(x, m[y])
    e, we = m[y] - b @ x, wy - b @ wx
    lam = float(m.dot(e, we)) / max(m.squares(we), 1e-300)
    xs_, ys_ = x - lam * wx, m[y] - lam * wy
    beta = m.fit(xs_, ys_)
    sse, sst, free = m.squares(ys_ - beta @ xs_), m.spread(ys_), m.n - len(xs)
    se = _deviations(sse / free * np.linalg.pinv(m.dot(xs_, xs_)))
    return Fit([*xs, "lambda"], np.append(beta, lam), np.append(se, 0.0), free, {"r2": 1 - sse / sst if sst > 0 else 0.0}, rows, combined(beta, [F.col(c) for c in xs]))


def panel_sarma(df: DataFrame, w: DataFrame, y: str, xs: list[str]) -> Fit:
    """Two stages for rho, lambda from the residuals' lags, then two stages again on the filtered variables.

    Lags up to the third hold all filtered instruments: W^k (X - lambda WX) = W^k X - lambda W^(k+1) X.
    """
    _checked(df)
    rows = _lags(df, w, y, xs, 3)
    lag = lambda k: xs if k == 0 else _names(f"w{k}", xs)
    m = Moments(rows, [y, *(f"w{k}_{y}" for k in (1, 2)), *(c for k in range(4) for c in lag(k))])
    x = [m.of(lag(k)) for k in range(4)]
    wy = [m[y], m[f"w1_{y}"], m[f"w2_{y}"]]
    b, _ = _instrumented(m, x[0], wy[1], np.vstack(x[:3]), wy[0])
    e = wy[0] - b[-1] * wy[1] - b[:-1] @ x[0]
    we = wy[1] - b[-1] * wy[2] - b[:-1] @ x[1]
    lam = float(m.dot(e, we)) / max(m.squares(we), 1e-300)
    filtered = [x[k] - lam * x[k + 1] for k in range(3)]
    beta, stage = _instrumented(m, filtered[0], wy[1] - lam * wy[2], np.vstack(filtered), wy[0] - lam * wy[1])
    sse, sst, free = m.squares(wy[0] - beta[-1] * wy[1] - beta[:-1] @ x[0]), m.spread(wy[0]), m.n - len(xs) - 1
    se = np.sqrt(np.maximum(np.diagonal(sse / free * np.linalg.pinv(m.dot(stage, stage))), 1e-12))
    return Fit([*xs, "rho", "lambda"], np.append(beta, lam), np.append(se, 0.0), free, {"r2": 1 - sse / sst if sst > 0 else 0.0}, rows, combined(beta, [F.col(c) for c in [*xs, f"w1_{y}"]]))


def panel_tobit(df: DataFrame, w: DataFrame, y: str, xs: list[str], limit: float = 0.0) -> Fit:
    """Two stages on the uncensored rows; censored ones get their expected value below the limit (inverse Mills ratio);
    then two stages on all rows. Instruments are X and WX."""
    _checked(df)
    rows = _lags(df, w, y, xs, 1)
    free = rows.where(F.col(y) > limit)
    m = Moments(free, [y, *xs, f"w1_{y}", *_names("w1", xs)])
    if m.n < len(xs) + 1:
        raise ValueError("too few rows above the limit")

    def two_stages(m: Moments, y: str, wy: str) -> tuple[np.ndarray, np.ndarray]:
        x = m.of([wy, *xs])
        hat = m.projected(x, m.of([*xs, *_names("w1", xs)]))
        inverse = np.linalg.pinv(m.dot(hat, hat))
        return inverse @ m.dot(hat, m[y]), inverse

    first, _ = two_stages(m, y, f"w1_{y}")
    e = m[y] - first @ m.of([f"w1_{y}", *xs])
    sigma = math.sqrt(m.spread(e) / m.n)
    guess = combined(first, [F.col(c) for c in [f"w1_{y}", *xs]])
    star = F.col(y)
    if sigma > 0:
        a = (limit - guess) / sigma
        mills = normal_pdf(a) / F.greatest(normal_cdf(a), F.lit(1e-10))
        star = F.when(F.col(y) > limit, F.col(y)).otherwise(F.least(guess - sigma * mills, F.lit(float(limit))))
    filled = stored(rows.select("id", "t", star.alias("star"), *xs, *_names("w1", xs)), "filled")
    filled = stored(lagged(filled, w, ["star"], 1, False, ("t",)), "filled")
    m = Moments(filled, ["star", *xs, "w1_star", *_names("w1", xs)])
    beta, inverse = two_stages(m, "star", "w1_star")
    sse, sst, left = m.squares(m["star"] - beta @ m.of(["w1_star", *xs])), m.spread(m["star"]), m.n - len(xs) - 1
    se = _deviations((sse / left if left > 0 else 0.0) * inverse)
    censored = rows.where(F.col(y) <= limit).count()
    return Fit(["rho", *xs], beta, se, max(1, left), {"r2": 1 - sse / sst if sst > 0 else 0.0, "censored": censored, "uncensored": m.n - censored}, filled, combined(beta, [F.col(c) for c in ["w1_star", *xs]]))


def panel_probit(df: DataFrame, w: DataFrame, y: str, xs: list[str]) -> Fit:
    """Probit by reweighted least squares (10 rounds at most), then two stages on the latent variable."""
    _checked(df)
    rows = _lags(df, w, y, xs, 2)
    beta = np.zeros(len(xs))

    def latent(b: np.ndarray) -> tuple[Column, Column]:
        eta = combined(b, [F.col(c) for c in xs])
        mu = F.least(F.greatest(normal_cdf(eta), F.lit(1e-6)), F.lit(1 - 1e-6))
        phi = F.greatest(normal_pdf(eta), F.lit(1e-6))
        return eta + (F.col(y) - mu) / phi, phi * phi / (mu * (1 - mu))

    for _ in range(10):
        z, weight = latent(beta)
        # the columns are made before they are summed up, so that a row's distribution function is taken once
        m = Moments(rows.withColumn("_z", z).withColumn("_k", weight), [*xs, "_z"], F.col("_k"))
        new = m.fit(m.of(xs), m["_z"])
        moved, beta = float(np.abs(new - beta).max()), new
        if moved < 1e-5:
            break
    z, _ = latent(beta)
    made = stored(rows.withColumn("latent", z), "latent")
    made = stored(made.join(lagged(made.select("id", "t", "latent"), w, ["latent"], 1, False, ("t",)).select("id", "t", "w1_latent"), ["id", "t"]), "latent")
    m = Moments(made, ["latent", "w1_latent", *xs, *_names("w1", xs), *_names("w2", xs)])
    x = m.of(xs)
    b, stage = _instrumented(m, x, m["w1_latent"], m.of([*xs, *_names("w1", xs), *_names("w2", xs)]), m["latent"])
    sse, free = m.squares(m["latent"] - b @ np.vstack([x, m["w1_latent"]])), m.n - len(xs) - 1
    se = _deviations(sse / free * np.linalg.pinv(m.dot(stage, stage)))
    fitted = combined(b, [F.col(c) for c in [*xs, "w1_latent"]])
    p = F.least(F.greatest(normal_cdf(fitted), F.lit(1e-10)), F.lit(1 - 1e-10))
    ll = made.withColumn("_p", p).agg(F.sum(F.col(y) * F.ln("_p") + (1 - F.col(y)) * F.ln(1 - F.col("_p"))).alias("ll"), F.avg(y).alias("share"), F.avg(((F.col("_p") >= 0.5).cast("double") == F.col(y)).cast("double")).alias("right"), F.count("*").alias("n")).first()
    s = ll["share"]
    null = ll["n"] * (s * math.log(s) + (1 - s) * math.log(1 - s)) if 0 < s < 1 else ll["ll"]
    return Fit([*xs, "rho"], b, se, None, {"log_likelihood": ll["ll"], "pseudo_r2": 1 - ll["ll"] / null if null else 0.0, "accuracy": ll["right"]}, made, fitted)


def _augmented(df: DataFrame, w: DataFrame, y: str, xs: list[str]) -> tuple[DataFrame, list[str]]:
    """Rows with ``wy_hat``, Wy as fitted by X, WX and WWX."""
    rows = _lags(df, w, y, xs, 2)
    z = [*xs, *_names("w1", xs), *_names("w2", xs)]
    m = Moments(rows, [f"w1_{y}", *z])
    hat = combined(m.fit(m.of(z), m[f"w1_{y}"]), [F.col(c) for c in z])
    return stored(rows.withColumn("wy_hat", hat), "augmented"), [*xs, "wy_hat"]


def panel_quantile(df: DataFrame, w: DataFrame, y: str, xs: list[str], quantile: float = 0.5, rounds: int = 80) -> Fit:
    """Quantile regression on X and fitted Wy by majorising the pinball loss: each round is one weighted aggregate.

    Weights are 1 / (eps + |residual|) with a falling eps; the loss is within about 1e-6 of its least value.
    """
    if not 0 < quantile < 1:
        raise ValueError("the quantile must be between 0 and 1")
    _checked(df)
    rows, names = _augmented(df, w, y, xs)
    m = Moments(rows, [y, *names])
    beta, eps = m.fit(m.of(names), m[y]), math.sqrt(max(m.spread(m[y]) / max(m.n, 1), 1e-12)) * 0.1
    for _ in range(rounds):
        e = F.col(y) - combined(beta, [F.col(c) for c in names])
        weight = 1 / (F.lit(eps) + F.abs(e))
        m = Moments(rows, [y, *names], weight)
        tilt = Moments(rows, names)
        x = m.of(names)
        new = np.linalg.pinv(m.dot(x, x)) @ (m.dot(x, m[y]) + (2 * quantile - 1) * tilt.dot(tilt.of(names), tilt["1"]))
        moved, beta = float(np.abs(new - beta).max()), new
        if moved < 1e-9 and eps < 1e-8:
            break
        eps = max(eps * 0.7, 1e-9)
    loss = lambda e: F.sum(F.when(e >= 0, quantile * e).otherwise((quantile - 1) * e))
    fitted = combined(beta, [F.col(c) for c in names])
    level = rows.agg(F.percentile(y, F.lit(quantile)).alias("q")).first()["q"]
    t = rows.agg(loss(F.col(y) - fitted).alias("own"), loss(F.col(y) - level).alias("null")).first()
    return Fit([*xs, "rho"], beta, None, None, {"pinball_loss": t["own"], "pseudo_r2": 1 - t["own"] / t["null"] if t["null"] else 0.0}, rows, fitted)


def _factorial(y: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(y.cast("int"), F.lit(1))), F.lit(0.0), lambda a, i: a + F.ln(i))


def panel_count(df: DataFrame, w: DataFrame, y: str, xs: list[str], negative_binomial: bool = False, max_iter: int = 50, tol: float = 1e-6) -> Fit:
    """Poisson or negative binomial counts on X and fitted Wy by reweighted least squares from the logarithm's fit.

    The deviance and log-likelihood leave out the counts' factorials, as the null model does, for poisson.
    """
    _checked(df)
    rows, names = _augmented(df, w, y, xs)
    cols = [F.col(c) for c in names]
    m = Moments(rows, {n: n for n in names} | {"_l": F.ln(F.greatest(y, F.lit(0.1)))})
    beta, alpha = m.fit(m.of(names), m["_l"]), 0.5 if negative_binomial else 0.0
    for _ in range(max_iter):
        eta = F.least(F.greatest(combined(beta, cols), F.lit(-30.0)), F.lit(30.0))
        mu = F.greatest(F.exp(eta), F.lit(1e-10))
        if negative_binomial:
            pearson = rows.agg(F.sum((F.col(y) - mu) * (F.col(y) - mu) / (mu + alpha * mu * mu)).alias("p"), F.count("*").alias("n")).first()
            alpha = max(1e-4, alpha * pearson["p"] / max(pearson["n"] - len(names), 1))
        m = Moments(rows, {n: n for n in names} | {"_z": eta + (F.col(y) - mu) / mu}, F.greatest(mu * mu / (mu + alpha * mu * mu), F.lit(1e-10)))
        new = m.fit(m.of(names), m["_z"])
        moved, beta = float(np.abs(new - beta).max()), new
        if moved < tol:
            break
    mu = F.exp(F.least(F.greatest(combined(beta, cols), F.lit(-30.0)), F.lit(30.0)))
    v, safe = F.col(y), F.greatest(mu, F.lit(1e-10))
    mean = max(rows.agg(F.avg(y).alias("m")).first()["m"] or 0.0, 1e-10)
    if negative_binomial:
        r = 1 / alpha

        def chance(mean_: Column) -> Column:
            # log of gamma(k + r) / (gamma(r) k!) p^r (1 - p)^k, the first factor as a product of k terms
            k = F.floor(v)
            rising = F.aggregate(F.sequence(F.lit(0), F.greatest(k.cast("int") - 1, F.lit(0))), F.lit(0.0), lambda a, i: a + F.ln(i + r))
            return F.when(k > 0, rising).otherwise(F.lit(0.0)) - _factorial(k) + r * F.ln(r / (r + mean_)) + k * F.ln(mean_ / (r + mean_))

        ll, null = chance(safe), chance(F.lit(mean))
        deviance = 2 * ((v + r) * F.ln((v + r) / (mu + r)) - v * F.ln(F.greatest(v, F.lit(1e-10)) / mu))
    else:
        ll, null = v * F.ln(safe) - mu, v * math.log(mean) - mean
        deviance = 2 * F.when(v > 0, v * F.ln(v / safe) - (v - mu)).otherwise(mu)
    t = rows.agg(F.sum(ll).alias("ll"), F.sum(null).alias("null"), F.sum(deviance).alias("d")).first()
    figures = {"dispersion": alpha, "log_likelihood": t["ll"], "deviance": t["d"], "pseudo_r2": max(0.0, 1 - t["ll"] / t["null"]) if t["null"] else 0.0}
    return Fit([*xs, "rho"], beta, None, None, figures, rows, mu)


def panel_zero_inflated(df: DataFrame, w: DataFrame, y: str, xs: list[str], zero: list[str] | None = None, negative_binomial: bool = False, max_iter: int = 50, tol: float = 1e-6) -> Fit:
    """Counts with extra zeros: rounds of expected zero membership, one weighted fit of it (logit) and one of the counts."""
    _checked(df)
    zero = zero or xs
    rows, names = _augmented(df, w, y, sorted(set(xs) | set(zero), key=[*xs, *zero].index))
    names = [*xs, "wy_hat"]
    v, cols, gates = F.col(y), [F.col(c) for c in names], [F.col(c) for c in zero]
    m = Moments(rows, {n: n for n in names} | {"_l": F.ln(F.greatest(y, F.lit(0.1)))})
    beta, gamma = m.fit(m.of(names), m["_l"]), np.zeros(len(zero))
    r = 2.0
    clip = lambda c, a: F.least(F.greatest(c, F.lit(-a)), F.lit(a))

    def parts(b, g):
        logit = clip(combined(g, gates), 30.0)
        pi = 1 / (1 + F.exp(-logit))
        mu = F.greatest(F.exp(clip(combined(b, cols), 30.0)), F.lit(1e-10))
        none = F.pow(F.lit(r) / (F.lit(r) + mu), F.lit(r)) if negative_binomial else F.exp(-mu)
        return logit, pi, mu, none

    for _ in range(max_iter):
        logit, pi, mu, none = parts(beta, gamma)
        member = F.when(v == 0, pi / F.greatest(pi + (1 - pi) * none, F.lit(1e-12))).otherwise(F.lit(0.0))
        spread = F.least(F.greatest(pi, F.lit(1e-6)), F.lit(1 - 1e-6)) * (1 - F.least(F.greatest(pi, F.lit(1e-6)), F.lit(1 - 1e-6)))
        m = Moments(rows, {c: c for c in zero} | {"_z": logit + (member - pi) / F.greatest(spread, F.lit(1e-6))}, spread)
        g = m.fit(m.of(zero), m["_z"])
        m = Moments(rows, {c: c for c in names} | {"_z": F.ln(mu) + (v - mu) / F.greatest(mu, F.lit(1e-6))}, F.greatest((1 - member) * mu, F.lit(1e-10)))
        b = m.fit(m.of(names), m["_z"])
        moved = float(np.abs(b - beta).max() + np.abs(g - gamma).max())
        beta, gamma = b, g
        if moved < tol:
            break
    _, pi, mu, none = parts(beta, gamma)
    positive = F.ln(F.greatest(1 - pi, F.lit(1e-12))) + v * F.ln(mu) - mu
    ll = F.when(v == 0, F.ln(F.greatest(pi + (1 - pi) * none, F.lit(1e-12)))).otherwise(positive)
    mean = max(rows.agg(F.avg(y).alias("m")).first()["m"] or 0.0, 1e-10)
    t = rows.agg(F.sum(ll).alias("ll"), F.sum(v * math.log(mean) - mean).alias("null"), F.avg(pi).alias("pi")).first()
    figures = {"log_likelihood": t["ll"], "pseudo_r2": max(0.0, 1 - t["ll"] / t["null"]) if t["null"] else 0.0, "zero_share": t["pi"]}
    return Fit([*xs, "rho", *(f"zero_{c}" for c in zero)], np.concatenate([beta, gamma]), None, None, figures, rows, (1 - pi) * mu)


def panel_dynamic(df: DataFrame, w: DataFrame, y: str, xs: list[str]) -> Fit:
    """First differences on the lagged difference, its spatial lag and the regressors' differences, with levels two
    periods back (and their lags) as instruments."""
    _checked(df, 3)
    rows = stored(lagged(df.select("id", "t", y, *xs), w, [y, *xs], 1, False, ("t",)), "lags")
    by = Window.partitionBy("id").orderBy("t")
    back = lambda c, k: F.lag(c, k).over(by)
    parts = rows.select("id", "t", (F.col(y) - back(y, 1)).alias("dy"), (back(y, 1) - back(y, 2)).alias("dlag"), (F.col(f"w1_{y}") - back(f"w1_{y}", 1)).alias("dwy"), *((F.col(x) - back(x, 1)).alias(f"d_{x}") for x in xs), *(back(c, 2).alias(f"z_{c}") for c in [y, *xs, f"w1_{y}", *_names("w1", xs)]))
    parts = stored(parts.where("dlag is not null"), "differences")
    names, zs = ["dlag", "dwy", *(f"d_{x}" for x in xs)], [f"z_{c}" for c in [y, *xs, f"w1_{y}", *_names("w1", xs)]]
    m = Moments(parts, ["dy", *names, *zs])
    x, z = m.of(names), m.of(zs)
    hat = m.projected(x, z)
    bread = np.linalg.pinv(m.dot(hat, hat))
    beta = bread @ m.dot(hat, m["dy"])
    sse, sst = m.squares(m["dy"] - beta @ x), m.spread(m["dy"])
    se = np.sqrt(np.maximum(np.diagonal(sse / max(m.n - len(beta), 1) * bread), 1e-12))
    return Fit(["gamma", "rho", *xs], beta, se, None, {"r2": max(0.0, 1 - sse / max(sst, 1e-12))}, parts, combined(beta, [F.col(c) for c in names]))


def panel_sur(df: DataFrame, w: DataFrame, equations: dict[str, list[str]]) -> DataFrame:
    """(equation, term, value): least squares of each variable on its own lag (rho) and regressors, r2, and the
    covariances of the equations' residuals, all from one matrix of sums."""
    ys = list(equations)
    xs = sorted({x for cols in equations.values() for x in cols})
    rows = stored(lagged(df.select("id", "t", *sorted({*ys, *xs})), w, ys, 1, False, ("t",)), "lags")
    m = Moments(rows, sorted({*ys, *xs, *_names("w1", ys)}))
    out, residuals = [], {}
    for y, cols in equations.items():
        x = m.of([f"w1_{y}", *cols])
        beta = m.fit(x, m[y])
        residuals[y] = m[y] - beta @ x
        out += [(y, t, float(b)) for t, b in zip(["rho", *cols], beta)]
        out.append((y, "r2", max(0.0, 1 - m.squares(residuals[y]) / max(m.spread(m[y]), 1e-12))))
    out += [(a, f"cov_{b}", float(m.dot(residuals[a], residuals[b])) / m.n) for a in ys for b in ys]
    return df.sparkSession.createDataFrame(out, "equation string, term string, value double")


def _ols_on_lag(df: DataFrame, w: DataFrame, y: str, xs: list[str]) -> tuple[DataFrame, Moments, np.ndarray]:
    rows = stored(lagged(df.select("id", "t", y, *xs), w, [y], 1, False, ("t",)), "lags")
    m = Moments(rows, [y, *xs, f"w1_{y}"])
    return rows, m, m.fit(m.of([f"w1_{y}", *xs]), m[y])


def panel_tobit_lag(df: DataFrame, w: DataFrame, y: str, xs: list[str], bound: float = 0.0) -> Fit:
    """Least squares on Wy and X with the share at or below the bound and the normal log-likelihood."""
    _checked(df)
    rows, m, beta = _ols_on_lag(df, w, y, xs)
    e = m[y] - beta @ m.of([f"w1_{y}", *xs])
    sse, var = m.squares(e), m.spread(e) / m.n
    share = rows.agg(F.avg((F.col(y) <= bound).cast("double")).alias("s")).first()["s"]
    ll = -0.5 * m.n * math.log(2 * math.pi * (var + 1e-12)) - sse / (2 * (var + 1e-12))
    return Fit(["rho", *xs], beta, None, None, {"sigma": math.sqrt(var), "censored_share": share, "log_likelihood": ll}, rows, combined(beta, [F.col(c) for c in [f"w1_{y}", *xs]]))


def panel_probit_lag(df: DataFrame, w: DataFrame, y: str, xs: list[str]) -> Fit:
    """Linear probability on Wy and X; the log-likelihood and mean marginal effects of the probit on its prediction."""
    rows, m, beta = _ols_on_lag(df, w, y, xs)
    fitted = combined(beta, [F.col(c) for c in [f"w1_{y}", *xs]])
    made = rows.withColumn("_f", fitted).withColumn("_p", F.least(F.greatest(normal_cdf(F.col("_f")), F.lit(1e-6)), F.lit(1 - 1e-6)))
    t = made.agg(F.sum(F.col(y) * F.ln("_p") + (1 - F.col(y)) * F.ln(1 - F.col("_p"))).alias("ll"), F.avg(normal_pdf(F.col("_f"))).alias("d")).first()
    return Fit(["rho", *xs], beta, None, None, {"log_likelihood": t["ll"], **{f"effect_{x}": float(b) * t["d"] for x, b in zip(xs, beta[1:])}}, rows, fitted)


def panel_sem(df: DataFrame, w: DataFrame, y: str, xs: list[str], lam: float = 0.2) -> Fit:
    """Least squares after the filter I - lambda W with a given lambda; R2 on the unfiltered variables."""
    rows = _lags(df, w, y, xs, 1)
    m = Moments(rows, [y, *xs, f"w1_{y}", *_names("w1", xs)])
    x = m.of(xs)
    beta = m.fit(x - lam * m.of(_names("w1", xs)), m[y] - lam * m[f"w1_{y}"])
    return Fit(xs, beta, None, None, {"r2": max(0.0, 1 - m.squares(m[y] - beta @ x) / max(m.spread(m[y]), 1e-12))}, rows, combined(beta, [F.col(c) for c in xs]))


def panel_regimes(df: DataFrame, regime: str, y: str, xs: list[str]) -> DataFrame:
    """(regime, term, value): least squares in each regime; regime null: Chow's F, its p and the sum of squares.

    Regimes are few by nature; their sums of products are one grouped aggregate.
    """
    values = [F.col(c) for c in [y, *xs]]
    pairs = [(i, j) for i in range(len(values)) for j in range(i, len(values))]
    rows = df.groupBy(F.col(regime).cast("string").alias("g")).agg(*(F.sum(values[i] * values[j]).alias(f"p{i}_{j}") for i, j in pairs), F.count("*").alias("n")).limit(10_001).collect()
    if not 2 <= len(rows) <= 10_000:
        raise ValueError("between 2 and 10,000 regimes are needed")

    def solve(g: np.ndarray) -> tuple[np.ndarray, float]:
        beta = np.linalg.pinv(g[1:, 1:]) @ g[1:, 0]
        return beta, max(0.0, g[0, 0] - 2 * beta @ g[1:, 0] + beta @ g[1:, 1:] @ beta)

    out, total, within, n = [], np.zeros((len(values),) * 2), 0.0, 0
    for r in sorted(rows, key=lambda r: r["g"] or ""):
        g = np.zeros((len(values),) * 2)
        for i, j in pairs:
            g[i, j] = g[j, i] = r[f"p{i}_{j}"] or 0.0
        beta, sse = solve(g)
        out += [(r["g"], t, float(b)) for t, b in zip(xs, beta)]
        total, within, n = total + g, within + sse, n + r["n"]
    df1, df2 = len(xs) * (len(rows) - 1), max(n - len(xs) * len(rows), 1)
    f = (solve(total)[1] - within) / max(df1, 1) / (within / df2 + 1e-12)
    out += [(None, "chow_f", float(f)), (None, "chow_p", float(f_tail(f, df1, df2))), (None, "sse", float(within))]
    return df.sparkSession.createDataFrame(out, "regime string, term string, value double")


def panel_pvar(df: DataFrame, w: DataFrame, ys: list[str], order: int = 1) -> DataFrame:
    """(equation, term, value): each variable on its own spatial lag and ``order`` time lags of all; residual covariances."""
    rows = lagged(df.select("id", "t", *ys), w, ys, 1, False, ("t",))
    by = Window.partitionBy("id").orderBy("t")
    terms = [f"l{p}_{v}" for p in range(1, order + 1) for v in ys]
    rows = rows.select("*", *(F.lag(v, p).over(by).alias(f"l{p}_{v}") for p in range(1, order + 1) for v in ys), F.row_number().over(by).alias("_n")).where(F.col("_n") > order)
    m = Moments(stored(rows, "lags"), [*ys, *_names("w1", ys), *terms])
    out, residuals = [], {}
    for y in ys:
        x = m.of([f"w1_{y}", *terms])
        beta = m.fit(x, m[y])
        residuals[y] = m[y] - beta @ x
        out += [(y, t, float(b)) for t, b in zip(["rho", *terms], beta)]
    out += [(a, f"cov_{b}", float(m.dot(residuals[a], residuals[b])) / m.n) for a in ys for b in ys]
    return df.sparkSession.createDataFrame(out, "equation string, term string, value double")
