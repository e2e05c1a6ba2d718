"""Accessibility over a cost table od(o, d, cost), origins (o, pop) and destinations (d, supply). Unreachable pairs have no row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanloom.core.ordered import running
from urbanloom.core.tables import stored


def decay(cost: Column, method: str, beta: float, cutoff: float | None = None) -> Column:
    """The decay of a cost; 0 beyond the cutoff."""
    if method == "none":
        out = F.lit(1.0)
    elif method == "exponential":
        out = F.exp(-beta * cost)
    elif method == "power":
        out = F.pow(F.when(cost > 0, cost).otherwise(F.lit(1e-9)), F.lit(-beta))
    elif method == "gaussian":
        out = F.exp(-0.5 * (cost / beta) * (cost / beta)) if beta > 0 else F.lit(0.0)
    elif method == "linear":
        if not cutoff or cutoff <= 0:
            raise ValueError("linear decay needs a positive cutoff")
        out = F.least(F.greatest(1 - cost / cutoff, F.lit(0.0)), F.lit(1.0))
    else:
        raise ValueError(f"no decay method {method!r}")
    return F.when(cost <= cutoff, out).otherwise(F.lit(0.0)) if cutoff is not None else out


def kernel(cost: Column, name: str, cutoff: float) -> Column:
    u2 = (cost / cutoff) * (cost / cutoff)
    shapes = {"quartic": F.lit(15 / 16) * (1 - u2) * (1 - u2), "epanechnikov": 0.75 * (1 - u2), "gaussian": (F.exp(-0.5 * u2) - F.exp(F.lit(-0.5))) / (1 - F.exp(F.lit(-0.5)))}
    return F.when(cost <= cutoff, F.greatest(shapes[name], F.lit(0.0))).otherwise(F.lit(0.0))


def _per_origin(od: DataFrame, value: Column, name: str = "access") -> DataFrame:
    return od.groupBy("o").agg(F.sum(value).alias(name))


def gravity_accessibility(od: DataFrame, dest: DataFrame, method: str = "exponential", beta: float = 0.05, cutoff: float | None = None) -> DataFrame:
    return _per_origin(od.join(dest, "d"), F.col("supply") * decay(F.col("cost"), method, beta, cutoff))


def cumulative_opportunities(od: DataFrame, dest: DataFrame, cutoff: float) -> DataFrame:
    return _per_origin(od.join(dest, "d"), F.when(F.col("cost") <= cutoff, F.col("supply")).otherwise(F.lit(0.0)))


def floating_catchment(od: DataFrame, origins: DataFrame, dest: DataFrame, weight: Column, three_step: bool = False) -> DataFrame:
    """Supply over the demand that reaches it, summed over what an origin reaches. Three steps share each origin's
    demand among its destinations first."""
    rows = od.join(origins, "o").join(dest, "d").withColumn("w", weight)
    if three_step:
        total = F.sum("w").over(Window.partitionBy("o"))
        rows = rows.withColumn("w", F.when(total > 0, F.col("w") * F.col("w") / total).otherwise(F.lit(0.0)))
    demand = F.sum(F.col("w") * F.col("pop")).over(Window.partitionBy("d"))
    rows = rows.withColumn("ratio", F.when(demand > 0, F.col("supply") / demand).otherwise(F.lit(0.0)))
    return _per_origin(rows, F.col("w") * F.col("ratio"))


def enhanced_2sfca(od, origins, dest, cutoff: float, method: str = "none", beta: float = 1.0) -> DataFrame:
    return floating_catchment(od, origins, dest, decay(F.col("cost"), method, beta, cutoff))


def kernel_density_2sfca(od, origins, dest, cutoff: float, shape: str = "quartic") -> DataFrame:
    return floating_catchment(od, origins, dest, kernel(F.col("cost"), shape, cutoff))


def three_step_2sfca(od, origins, dest, cutoff: float, method: str = "none", beta: float = 1.0) -> DataFrame:
    return floating_catchment(od, origins, dest, decay(F.col("cost"), method, beta, cutoff), three_step=True)


def spatial_equity_gini(access: DataFrame, population: DataFrame) -> DataFrame:
    """Population-weighted Gini of access, from cumulated sums instead of all pairs."""
    rows = access.join(population, "o").groupBy("access").agg(F.sum("pop").alias("p"))
    rows = running(rows, [F.col("access")], {"pb": ("sum", F.col("p")), "sb": ("sum", F.col("p") * F.col("access"))}, inclusive=False).na.fill(0.0, ["pb", "sb"])
    out = rows.agg(F.sum(F.col("p") * (F.col("access") * F.col("pb") - F.col("sb"))).alias("a"), F.sum("p").alias("t"), F.sum(F.col("p") * F.col("access")).alias("s"))
    return out.select(F.when(F.col("s") > 0, F.col("a") / (F.col("t") * F.col("s"))).otherwise(F.lit(0.0)).alias("gini"))


def huff_gravity(od: DataFrame, dest: DataFrame, method: str = "power", beta: float = 2.0) -> DataFrame:
    """(o, d, p): the share of each destination in its origin's utility."""
    rows = od.join(dest, "d").withColumn("u", F.col("supply") * decay(F.col("cost"), method, beta))
    total = F.sum("u").over(Window.partitionBy("o"))
    return rows.select("o", "d", F.when(total > 0, F.col("u") / total).otherwise(F.lit(0.0)).alias("p"))


def huff_market_share(od: DataFrame, origins: DataFrame, dest: DataFrame, exponent: float = 2.0) -> DataFrame:
    """(d, captured, share, zones): people that each store draws, distances of at least 1, and zones it has half of."""
    near = od.withColumn("cost", F.greatest("cost", F.lit(1.0)))
    p = huff_gravity(near, dest, "power", exponent).join(origins, "o")
    by = p.groupBy("d").agg(F.sum(F.col("p") * F.col("pop")).alias("captured"), F.count_if(F.col("p") >= 0.5).alias("zones"))
    total = origins.agg(F.sum("pop").alias("_t"))
    return by.crossJoin(F.broadcast(total)).select("d", "captured", F.when(F.col("_t") > 0, F.col("captured") / F.col("_t")).otherwise(F.lit(0.0)).alias("share"), "zones")


def fifteen_minute_score(od: DataFrame, dest: DataFrame, weights: dict[str, float], limit: float = 1200.0) -> DataFrame:
    """(o, score): category weights, split over the category's amenities (d, category), of those within the limit."""
    total = sum(weights.values())
    share = F.coalesce(F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(v / total))))[F.col("category")], F.lit(0.0))
    parts = dest.withColumn("w", share / F.count("*").over(Window.partitionBy("category")))
    return od.join(parts, "d").groupBy("o").agg(F.least(F.greatest(100 * F.sum(F.when(F.col("cost") <= limit, F.col("w")).otherwise(F.lit(0.0))), F.lit(0.0)), F.lit(100.0)).alias("score"))


def parking_mismatch(od: DataFrame, origins: DataFrame, dest: DataFrame, limit: float) -> DataFrame:
    """(o, supply, ratio, deficit): capacity reachable on foot, discounted by the squared distance, against demand."""
    w = F.when(F.col("cost") <= limit, 1 - (F.col("cost") / limit) * (F.col("cost") / limit)).otherwise(F.lit(0.0))
    rows = od.join(dest, "d").withColumn("s", w * F.col("supply")).groupBy("o").agg(F.sum("s").alias("supply")).join(origins, "o")
    return rows.select("o", "supply", (F.col("supply") / F.greatest("pop", F.lit(1e-6))).alias("ratio"), F.greatest(F.col("pop") - F.col("supply"), F.lit(0.0)).alias("deficit"))


def transit_frequency(od: DataFrame, stops: DataFrame, radius: float, benchmark: float = 10.0, diversity: float = 0.3) -> DataFrame:
    """(o, access, stops, nearest, headway) from stops (d, headway, routes), gaussian weights of a third of the radius."""
    u = F.col("cost") / (radius / 3)
    rows = od.join(stops, "d").withColumn("w", F.when(F.col("cost") <= radius, F.exp(-0.5 * u * u)).otherwise(F.lit(0.0)))
    q = (1 - diversity) * F.least(F.lit(benchmark) / F.col("headway"), F.lit(1.0)) + diversity * (1 - F.exp(-F.col("routes") / 3))
    sums = rows.groupBy("o").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * q).alias("sq"), F.sum(F.col("w") * F.col("headway")).alias("sh"), F.count_if(F.col("cost") <= radius).alias("stops"), F.min("cost").alias("nearest"))
    return sums.select("o", F.when(F.col("sw") > 0, F.col("sq") / F.col("sw")).otherwise(F.lit(0.0)).alias("access"), "stops", "nearest", F.when(F.col("sw") > 0, F.col("sh") / F.col("sw")).alias("headway"))


def nearest_vehicle(od: DataFrame) -> DataFrame:
    """(o, d, cost): the destination of least cost for each origin, ties by id."""
    return od.groupBy("o").agg(F.min(F.struct("cost", "d")).alias("x")).select("o", "x.d", "x.cost")


def gravity_od(od: DataFrame, origins: DataFrame, dest: DataFrame, beta: float = 0.002) -> DataFrame:
    """(o, d, trips): gravity flows scaled so that all trips sum to the origins' people."""
    raw = od.join(origins, "o").join(dest, "d").withColumn("t", F.col("pop") * F.col("supply") * F.exp(-beta * F.col("cost")))
    scale = raw.agg(F.sum("t").alias("_s")).crossJoin(origins.agg(F.sum("pop").alias("_p")))
    return raw.crossJoin(F.broadcast(scale)).select("o", "d", F.when(F.col("_s") > 0, F.col("t") * F.col("_p") / F.col("_s")).otherwise(F.lit(0.0)).alias("trips"))


def furness(trips: DataFrame, rows: DataFrame, cols: DataFrame, iterations: int = 30) -> DataFrame:
    """Alternating scaling of (o, d, trips) to the totals rows (o, target) and cols (d, target).

    Only the factors of rows and columns change: a round is one aggregate over the same table for the rows and one for
    the columns, and the factors are written, so the plan of a round doesn't grow with their number. Rows and columns
    without a target drop out.
    """
    t = trips.select("o", "d", "trips").join(rows.select("o"), "o", "left_semi").join(cols.select("d"), "d", "left_semi")
    t = stored(t, "trips")
    a = rows.select("o", F.lit(1.0).alias("_a"))
    b = stored(cols.select("d", F.lit(1.0).alias("_b")), "factors")
    for _ in range(iterations):
        sums = t.join(b, "d").groupBy("o").agg(F.sum(F.col("trips") * F.col("_b")).alias("_s"))
        a = sums.join(rows, "o").select("o", F.when(F.col("_s") > 0, F.col("target") / F.col("_s")).otherwise(F.lit(0.0)).alias("_a"))
        a = stored(a, "factors")
        sums = t.join(a, "o").groupBy("d").agg(F.sum(F.col("trips") * F.col("_a")).alias("_s"))
        new = sums.join(cols, "d").select("d", F.when(F.col("_s") > 0, F.col("target") / F.col("_s")).otherwise(F.lit(0.0)).alias("_b"))
        b = stored(new, "factors")
    return t.join(a, "o").join(b, "d").select("o", "d", (F.col("trips") * F.col("_a") * F.col("_b")).alias("trips"))


def mode_split(costs: DataFrame, betas: dict[str, float], constants: dict[str, float]) -> DataFrame:
    """(o, d, mode, p): multinomial logit over (o, d, mode, time)."""
    pick = lambda m: F.create_map(*(x for k, v in m.items() for x in (F.lit(k), F.lit(float(v)))))[F.col("mode")]
    u = costs.withColumn("u", F.coalesce(pick(constants), F.lit(0.0)) + F.coalesce(pick(betas), F.lit(0.0)) * F.col("time"))
    w = Window.partitionBy("o", "d")
    e = F.exp(F.col("u") - F.col("_m"))
    return u.withColumn("_m", F.max("u").over(w)).withColumn("e", e).select("o", "d", "mode", (F.col("e") / F.sum("e").over(w)).alias("p"))
