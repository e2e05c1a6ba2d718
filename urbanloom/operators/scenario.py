"""Plans in figures: summaries of accessibility, standards, adequacy and density, snapshots of them, and who leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.core.ordered import quantiles

#: Names of the metrics and which way is better (1 more, -1 less, 0 neither).
METRICS = {
    "plan_performance_index": ("Plan Performance Index", 1),
    "access_mean": ("Accessibility score (mean)", 1),
    "access_median": ("Accessibility score (median)", 1),
    "access_share_full": ("Share reaching every category (%)", 1),
    "access_share_low": ("Share scoring below 50 (%)", -1),
    "origins": ("Scored origins", 0),
    "standards_compliance_pct": ("Standards compliance (%)", 1),
    "standards_deficits": ("Categories in deficit", -1),
    "standards_categories": ("Categories with a standard", 0),
    "covered_share": ("Population covered (%)", 1),
    "covered_pop": ("Covered population", 1),
    "total_pop": ("Total population", 0),
    "facilities": ("Facilities", 0),
    "facilities_overloaded": ("Overloaded facilities", -1),
    "facilities_unused": ("Unused facilities", -1),
    "mean_utilization": ("Mean facility utilization", 0),
    "walk_score_mean": ("Walkability score (mean)", 1),
    "walk_low_share": ("Streets below 50 walk score (pct)", -1),
    "green_coverage_worst": ("Green coverage, weakest class (pct)", 1),
    "access_gini": ("Access inequality (Gini)", -1),
    "density_mean": ("Density mean (/ha)", 0),
    "density_max": ("Density max (/ha)", 0),
    "density_cells": ("Occupied density cells", 0),
}
KIND, VERSION = "scenario-snapshot", 1


def _table(k: int) -> Column:
    return F.create_map(*(x for key, v in METRICS.items() for x in (F.lit(key), F.lit(v[k]))))


def label_of(key: Column) -> Column:
    """A metric's name; others get their key in words."""
    return F.coalesce(_table(0)[key], F.initcap(F.replace(key, F.lit("_"), F.lit(" "))))


def direction_of(key: Column) -> Column:
    return F.coalesce(_table(1)[key], F.lit(0))


# summaries, one row each


def access_summary(scores: DataFrame) -> DataFrame:
    """(n, mean, median, share_full, share_low) of (score) from 0 to 100."""
    t = scores.agg(F.count("score").alias("n"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean"), F.count_if(F.col("score") >= 100 - 1e-9).alias("f"), F.count_if(F.col("score") < 50).alias("l"))
    mid = quantiles(scores, F.col("score"), [0.5]).agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("median"))
    pct = lambda c: F.coalesce(100 * F.try_divide(c, "n"), F.lit(0.0))
    return t.crossJoin(mid).select("n", "mean", "median", pct("f").alias("share_full"), pct("l").alias("share_low"))


def balance_summary(rows: DataFrame) -> DataFrame:
    """(n_categories, n_with_standard, n_deficit, compliance_pct, worst_category, worst_deficit_m2) of (category, balance_m2, status)."""
    has, low = F.col("status") != "No standard", F.col("status") == "Deficit"
    worst = F.min(F.when(low, F.struct("balance_m2", "category")))
    t = rows.agg(F.count("*").alias("n_categories"), F.count_if(has).alias("n_with_standard"), F.count_if(low).alias("n_deficit"), worst.alias("w"))
    return t.select("n_categories", "n_with_standard", "n_deficit", (100 * F.try_divide(F.col("n_with_standard") - F.col("n_deficit"), "n_with_standard")).alias("compliance_pct"), F.coalesce("w.category", F.lit("")).alias("worst_category"), F.coalesce("w.balance_m2", F.lit(0.0)).alias("worst_deficit_m2"))


def adequacy_summary(facilities: DataFrame, demand: DataFrame) -> DataFrame:
    """(n_facilities, n_overloaded, n_unused, mean_utilization, covered_pop, total_pop, covered_share) of facilities (utilization, status) and demand (pop,
    covered); people below 0 or unknown count as none."""
    used = F.when(F.col("status") != "Unused", F.col("utilization"))
    f = facilities.agg(F.count("*").alias("n_facilities"), F.count_if(F.col("status") == "Overloaded").alias("n_overloaded"), F.count_if(F.col("status") == "Unused").alias("n_unused"), F.coalesce(F.avg(used), F.lit(0.0)).alias("mean_utilization"))
    pop = F.greatest(F.coalesce(F.col("pop").cast("double"), F.lit(0.0)), F.lit(0.0))
    d = demand.agg(F.coalesce(F.sum(F.when(F.coalesce(F.col("covered").cast("int"), F.lit(0)) != 0, pop)), F.lit(0.0)).alias("covered_pop"), F.coalesce(F.sum(pop), F.lit(0.0)).alias("total_pop"))
    return f.crossJoin(d).withColumn("covered_share", 100 * F.try_divide("covered_pop", "total_pop"))


def density_summary(values: DataFrame) -> DataFrame:
    """(n_cells, mean, max) of (value)."""
    return values.agg(F.count("value").alias("n_cells"), F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"), F.coalesce(F.max("value"), F.lit(0.0)).alias("max"))


def overall_score(access: DataFrame | None = None, balance: DataFrame | None = None, adequacy: DataFrame | None = None) -> DataFrame:
    """(overall): mean of the scores that there are; null without any."""
    parts = [df.select(c.cast("double").alias("v")) for df, c in ((access, F.when(F.col("n") > 0, F.col("mean"))), (balance, F.col("compliance_pct")), (adequacy, F.col("covered_share"))) if df is not None]
    if not parts:
        raise ValueError("no summary")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(F.avg("v").alias("overall"))


# snapshots


def metrics_of(access: DataFrame | None = None, balance: DataFrame | None = None, adequacy: DataFrame | None = None, density: DataFrame | None = None, overall: DataFrame | None = None) -> DataFrame:
    """(metric, value) of the summaries; empty parts and unknown values are left out."""
    parts = [
        (overall, None, {"plan_performance_index": "overall"}),
        (access, "n", {"access_mean": "mean", "access_median": "median", "access_share_full": "share_full", "access_share_low": "share_low", "origins": "n"}),
        (balance, None, {"standards_compliance_pct": "compliance_pct", "standards_deficits": "n_deficit", "standards_categories": "n_with_standard"}),
        (adequacy, None, {"covered_share": "covered_share", "covered_pop": "covered_pop", "total_pop": "total_pop", "facilities": "n_facilities", "facilities_overloaded": "n_overloaded", "facilities_unused": "n_unused", "mean_utilization": "mean_utilization"}),
        (density, "n_cells", {"density_mean": "mean", "density_max": "max", "density_cells": "n_cells"}),
    ]
    out = None
    for df, some, columns in parts:
        if df is None:
            continue
        pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(c).cast("double").alias("value")) for k, c in columns.items())))
        rows = (df.where(F.col(some) > 0) if some else df).select(pairs.alias("p")).select("p.metric", "p.value").where("value is not null")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no summary")
    return out


def snapshot(metrics: DataFrame, name: str, generated: str) -> DataFrame:
    """(name, generated, metric, value) of (metric, value); values that are no numbers are left out."""
    value = F.col("value").cast("string").try_cast("double")
    return metrics.select(F.lit(name or "Scenario").alias("name"), F.lit(generated).alias("generated"), "metric", value.alias("value")).where("value is not null and not isnan(value)")


def to_json(snapshots: DataFrame) -> DataFrame:
    """(name, json): one object a snapshot, keys in order."""
    metrics = F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value"))))
    rows = snapshots.groupBy("name", "generated").agg(metrics.alias("metrics"))
    return rows.select("name", F.to_json(F.struct("generated", F.lit(KIND).alias("kind"), "metrics", "name", F.lit(VERSION).alias("version"))).alias("json"))


def from_json(texts: DataFrame, column: str = "json") -> DataFrame:
    """(name, version, generated, metric, value) of snapshots as text; text without an object of metrics is an error, values that are no
    numbers are left out."""
    read = F.from_json(F.col(column), "name string, version int, generated string, metrics map<string,string>")
    rows = texts.select(read.alias("j"), F.col(column).alias("text")).select("text", F.coalesce("j.name", F.lit("Scenario")).alias("name"), F.coalesce("j.version", F.lit(1)).alias("version"), F.coalesce("j.generated", F.lit("")).alias("generated"), F.col("j.metrics").alias("m"))
    checked = F.when(F.col("m").isNull(), F.raise_error(F.concat(F.lit("no snapshot: "), F.substring("text", 1, 80))).cast("map<string,string>")).otherwise(F.col("m"))
    out = rows.select("name", "version", "generated", F.explode(checked).alias("metric", "v")).select("name", "version", "generated", "metric", F.col("v").try_cast("double").alias("value"))
    return out.where("value is not null")


def score_line(rows: DataFrame, a: str = "A", b: str = "B") -> DataFrame:
    """(line): who wins how many of the compared metrics (better: A, B, tie or n/a)."""
    n = lambda v: F.count_if(F.col("better") == v)
    t = rows.agg(n("A").alias("a"), n("B").alias("b"), n("tie").alias("t"), F.count("*").alias("n"))
    head = F.when(F.col("a") == F.col("b"), F.lit("Even result")).when(F.col("b") > F.col("a"), F.lit(f"'{b}' leads")).otherwise(F.lit(f"'{a}' leads"))
    return t.select(F.concat(head, F.lit(f": {b} wins "), F.col("b"), F.lit(f", {a} wins "), F.col("a"), F.lit(", "), F.col("t"), F.lit(" tied, over "), F.col("n"), F.lit(" compared metrics.")).alias("line"))
