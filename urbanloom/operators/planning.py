"""Planning tables: apportionment, exposure bands, sources and receivers, composite indices, scenarios, timetables, intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbanloom.core.ordered import numbered
from urbanloom.core.spatial_join import range_join


def largest_remainder(df: DataFrame, total: int, weight: str = "w", id_col: str = "id") -> DataFrame:
    """(id, n): whole shares of ``total`` by weight; what is left goes to the largest fractions, ties by id."""
    s = df.crossJoin(F.broadcast(df.agg(F.sum(weight).alias("_t")))).withColumn("_q", F.lit(float(total)) * F.col(weight) / F.col("_t")).withColumn("_f", F.floor("_q"))
    left = s.agg((F.lit(total) - F.sum("_f")).alias("_left"))
    out = numbered(s, [(F.col("_q") - F.col("_f")).desc(), F.col(id_col).asc()], "_r").crossJoin(F.broadcast(left))
    return out.select(id_col, (F.col("_f") + (F.col("_r") <= F.col("_left")).cast("long")).alias("n"))


def exposure_bands(df: DataFrame, level: str, weight: str, breaks: list[float]) -> DataFrame:
    """(band, weight, share): weight in each half-open band [lo, hi) between the breaks, open at both ends; empty bands stay."""
    band = F.size(F.filter(F.array(*map(F.lit, breaks)), lambda b: b <= F.col(level)))
    got = df.where(f"`{level}` is not null").groupBy(band.alias("band")).agg(F.sum(weight).alias("weight"))
    every = df.sparkSession.range(len(breaks) + 1).select(F.col("id").cast("int").alias("band"))
    rows = every.join(got, "band", "left").select("band", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    total = F.sum("weight").over(Window.partitionBy())
    return rows.select("band", "weight", F.when(total > 0, F.col("weight") / total).otherwise(F.lit(0.0)).alias("share"))


def receiver_levels(sources: DataFrame, receivers: DataFrame, cutoff: float, least: float = 1.0) -> DataFrame:
    """(id, level): energetic sum at receivers of sources (id, x, y, level) within the cutoff; null where none is heard."""
    near = range_join(receivers.select(F.col("id").alias("i"), "x", "y"), sources.select(F.col("id").alias("j"), "x", "y", "level"), cutoff, ["i"], ["j", "level"])
    own = F.col("level") - 20 * F.log10(F.greatest("d", F.lit(least)))
    out = near.groupBy("i").agg((10 * F.log10(F.sum(F.pow(F.lit(10.0), own / 10)))).alias("level"))
    return receivers.select("id").join(out, F.col("id") == F.col("i"), "left").select("id", "level")


def concentrations(sources: DataFrame, receivers: DataFrame, cutoff: float, wind: float, alpha: float = 1.0, d0: float = 1.0) -> DataFrame:
    """(id, c): sum of strength over wind and distance from sources (id, x, y, strength); 0 where none is near."""
    near = range_join(receivers.select(F.col("id").alias("i"), "x", "y"), sources.select(F.col("id").alias("j"), "x", "y", "strength"), cutoff, ["i"], ["j", "strength"])
    out = near.groupBy("i").agg(F.sum(F.col("strength") / (wind * F.pow(F.col("d") + d0, F.lit(alpha)))).alias("c"))
    return receivers.select("id").join(out, F.col("id") == F.col("i"), "left").select("id", F.coalesce("c", F.lit(0.0)).alias("c"))


def combine_components(df: DataFrame, columns: list[str], directions: list[int], weights: list[float], id_col: str = "id") -> DataFrame:
    """(id, score): components from 0 to 1, inverted if their direction is -1, missing ones at one half, weighted, in percent.

    A component that doesn't vary takes no part.
    """
    stats = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max)))).first()
    used = [(c, d, w) for c, d, w in zip(columns, directions, weights) if stats[f"hi_{c}"] is not None and stats[f"hi_{c}"] > stats[f"lo_{c}"]]
    if not used:
        return df.select(id_col, F.lit(0.0).alias("score"))
    total = sum(w for _, _, w in used)
    norm = lambda c, d: F.coalesce((F.col(c) - stats[f"lo_{c}"]) / (stats[f"hi_{c}"] - stats[f"lo_{c}"]) if d >= 0 else (stats[f"hi_{c}"] - F.col(c)) / (stats[f"hi_{c}"] - stats[f"lo_{c}"]), F.lit(0.5))
    return df.select(id_col, (100 * reduce(lambda a, b: a + b, [norm(c, d) * (w / total) for c, d, w in used])).alias("score"))


def shannon_mix(df: DataFrame, key: str, kind: str, amount: str) -> DataFrame:
    """(key, mix): entropy of the positive amounts over the logarithm of their number; 0 for one kind alone."""
    t = df.where(F.col(amount) > 0).groupBy(key, kind).agg(F.sum(amount).alias("a")).groupBy(key).agg(F.sum("a").alias("_s"), F.sum(F.col("a") * F.ln("a")).alias("_l"), F.count("*").alias("_n"))
    return t.select(key, F.when(F.col("_n") > 1, (F.ln("_s") - F.col("_l") / F.col("_s")) / F.ln(F.col("_n").cast("double"))).otherwise(F.lit(0.0)).alias("mix"))


def scenario_compare(a: DataFrame, b: DataFrame, directions: dict[str, int]) -> DataFrame:
    """(key, a, b, delta, pct, better) of metrics (key, value); 'n.a.' without a direction or a side."""
    sign = F.coalesce(F.create_map(*(x for k, d in directions.items() for x in (F.lit(k), F.lit(d))))[F.col("key")], F.lit(0))
    rows = a.select("key", F.col("value").alias("a")).join(b.select("key", F.col("value").alias("b")), "key", "full_outer").withColumn("delta", F.col("b") - F.col("a"))
    better = F.when(F.col("delta").isNull() | (sign == 0), "n.a.").when(F.abs("delta") < 1e-9, "tie").when(F.col("delta") * sign > 0, "B").otherwise("A")
    return rows.select("key", "a", "b", "delta", F.when(F.col("a") != 0, 100 * F.col("delta") / F.abs("a")).alias("pct"), better.alias("better"))


def scenario_rank(metrics: DataFrame, directions: dict[str, int]) -> DataFrame:
    """(scenario, score, rank) of (scenario, key, value): mean of the shared, varying, directed metrics from 0 to 1, in
    percent; equal scores share a rank."""
    n = metrics.agg(F.count_distinct("scenario").alias("_n"))
    sign = F.create_map(*(x for k, d in directions.items() for x in (F.lit(k), F.lit(d))))[F.col("key")]
    s = metrics.groupBy("key").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_distinct("scenario").alias("k"))
    rows = metrics.join(s, "key").crossJoin(F.broadcast(n)).where((F.col("k") == F.col("_n")) & (F.col("hi") > F.col("lo")) & (F.coalesce(sign, F.lit(0)) != 0))
    part = F.when(sign > 0, F.col("value") - F.col("lo")).otherwise(F.col("hi") - F.col("value")) / (F.col("hi") - F.col("lo"))
    scores = rows.groupBy("scenario").agg((100 * F.avg(part)).alias("score"))
    return scores.withColumn("rank", F.rank().over(Window.orderBy(F.round("score", 9).desc())))


def stop_frequencies(stop_times: DataFrame, lo: int, hi: int) -> DataFrame:
    """(stop, departures, per_hour, headway, routes) of (route, trip, stop, seq, dep) in [lo, hi) seconds; a trip's last stop has no departure."""
    last = F.max("seq").over(Window.partitionBy("trip"))
    rows = stop_times.withColumn("_last", last).where((F.col("seq") < F.col("_last")) & (F.col("dep") >= lo) & (F.col("dep") < hi))
    hours = (hi - lo) / 3600
    return rows.groupBy("stop").agg(F.count("*").alias("departures"), F.count_distinct("route").alias("routes")).select("stop", "departures", (F.col("departures") / hours).alias("per_hour"), (hours * 60 / F.col("departures")).alias("headway"), "routes")


def merge_intervals(df: DataFrame, key: str, eps: float = 1e-9) -> DataFrame:
    """(key, lo, hi): the union of intervals (key, lo, hi), clipped to [0, 1]."""
    rows = df.select(key, F.greatest("lo", F.lit(0.0)).alias("lo"), F.least("hi", F.lit(1.0)).alias("hi")).where(F.col("hi") > F.col("lo"))
    order = Window.partitionBy(key).orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(before.isNull() | (F.col("lo") > before + eps), 1).otherwise(0)).withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "_g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_g")


def balance_rows(areas: DataFrame, population: float, standards: dict[str, float]) -> DataFrame:
    """(category, area, per_capita, required, balance, status): areas against square metres a head; the first standard
    whose word is part of the category counts."""
    need = F.coalesce(*(F.when(F.lower("category").contains(k.lower()), F.lit(float(v))) for k, v in standards.items()))
    rows = areas.withColumn("_s", need)
    required = F.col("_s") * population
    status = F.when(F.col("_s").isNull(), "No standard").when(F.col("area") >= required, "Meets standard").otherwise("Deficit")
    return rows.select("category", "area", (F.col("area") / population).alias("per_capita"), required.alias("required"), (F.col("area") - required).alias("balance"), status.alias("status"))


def social_vulnerability_index(df: DataFrame, columns: list[str], weights: list[float], id_col: str = "id") -> DataFrame:
    """(id, svi, class): indicators from 0 to 100 (constant ones are 0), weighted mean over positive weights."""
    stats = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    used = [(c, w) for c, w in zip(columns, weights) if w > 0]
    total = sum(w for _, w in used)
    part = lambda c: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), 100 * (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).otherwise(F.lit(0.0))
    svi = reduce(lambda a, b: a + b, [part(c) * w for c, w in used]) / total
    out = df.crossJoin(F.broadcast(stats)).select(id_col, svi.alias("svi"))
    return out.withColumn("class", F.when(F.col("svi") >= 75, "Very High").when(F.col("svi") >= 55, "High").when(F.col("svi") >= 35, "Moderate").otherwise("Low"))
