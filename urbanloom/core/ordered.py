"""Running aggregates and order statistics over a whole table without sending it to one task.

The rows are dealt by ranges of the order and written with the number of their range; each range is scanned by itself, and
what all ranges before it add up to comes from one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanloom.core.tables import stored

_PART = "_range_"
_AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min}


def _joined(kind: str, before: Column, own: Column) -> Column:
    if kind == "sum":
        return F.when(before.isNull(), own).when(own.isNull(), before).otherwise(before + own)
    return F.greatest(before, own) if kind == "max" else F.least(before, own)


def running(df: DataFrame, order: list[Column], columns: dict[str, tuple[str, Column]], by: list[str] | None = None, inclusive: bool = True) -> DataFrame:
    """``df`` with a running aggregate (kind, value) for each name, kinds sum, max and min, within ``by`` if given.

    Inclusive ones cover all rows up to the row's own peers (equal order keys), as a window ordered by them does; the
    others cover the rows before it, null for the first one, so their order should be unique. Null groups are groups.
    """
    keys = list(by or [])
    tagged = df.repartitionByRange(*(F.col(f"`{k}`").asc() for k in keys), *order).withColumn(_PART, F.spark_partition_id())
    tagged = stored(tagged, "ordered")
    own = Window.partitionBy(*keys, _PART).orderBy(*order)
    if not inclusive:
        own = own.rowsBetween(Window.unboundedPreceding, -1)
    totals = tagged.groupBy(*keys, _PART).agg(*(_AGGREGATES[kind](value).alias(f"_all_{name}") for name, (kind, value) in columns.items()))
    # one row a range and group: the only window that isn't dealt by a range
    earlier = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*(F.col(k).alias(f"_by_{i}") for i, k in enumerate(keys)), F.col(_PART).alias("_of_"), *(_AGGREGATES[kind](f"_all_{name}").over(earlier).alias(f"_before_{name}") for name, (kind, _) in columns.items()))
    local = tagged.select("*", *(_AGGREGATES[kind](value).over(own).alias(f"_own_{name}") for name, (kind, value) in columns.items()))
    same = F.col(_PART) == F.col("_of_")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_by_{i}"))
    out = local.join(offsets if keys else F.broadcast(offsets), same, "left")
    added = [_joined(kind, F.col(f"_before_{name}"), F.col(f"_own_{name}")).alias(name) for name, (kind, _) in columns.items()]
    return out.select(*(f"`{c}`" for c in df.columns), *added)


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with the place of each row in a unique order, from 1, as an int."""
    out = running(df, order, {"_n_": ("sum", F.lit(1))})
    return out.withColumn(name, F.col("_n_").cast("int")).drop("_n_")


def quantiles(df: DataFrame, value: Column, shares: list[float]) -> DataFrame:
    """(q, value): quantiles by linear interpolation between order statistics; no rows where there are no values.

    Distinct values are counted and the counts summed up in order, so no task holds all values.
    """
    counts = df.select(value.cast("double").alias("_v")).where("_v is not null").groupBy("_v").agg(F.count("*").alias("_c"))
    rows = running(counts, [F.col("_v")], {"_upto": ("sum", F.col("_c"))})
    n = counts.agg(F.sum("_c").alias("_n")).where("_n > 0")
    asked = df.sparkSession.createDataFrame([(float(q),) for q in shares], "q double").crossJoin(F.broadcast(n))
    at = asked.select("q", (F.col("q") * (F.col("_n") - 1)).alias("_h"))
    at = at.select("q", "_h", F.explode(F.array(F.floor("_h"), F.ceil("_h"))).alias("_i")).distinct()
    found = rows.join(F.broadcast(at), (F.col("_i") < F.col("_upto")) & (F.col("_i") >= F.col("_upto") - F.col("_c")))
    ends = found.groupBy("q", "_h").agg(F.min_by("_v", "_i").alias("lo"), F.max_by("_v", "_i").alias("hi"))
    return ends.select("q", (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("_h") - F.floor("_h"))).alias("value"))
