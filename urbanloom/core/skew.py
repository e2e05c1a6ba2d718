"""Joins with a table of one row a key, where a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.core.tables import stored

#: A key with more than this fraction of the rows is heavy, so there are fewer than HEAVY of them at any size.
HEAVY = 1000


def spread_join(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame, how: str = "left") -> DataFrame:
    """``rows`` joined with ``table`` (unique in ``key``); ``counts`` has ``key`` and ``n``, how many rows bear it.

    The entries of heavy keys, fewer than HEAVY, are broadcast, so their rows stay where they are; the others are dealt
    by key. Rows of a null key are not moved either: they get nulls (``how`` = left) or drop out (inner).
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = stored(counts.where(F.col("n") > max(total // HEAVY, 1)).select(key), "heavy")
    few = F.broadcast(heavy)
    hot = rows.join(few, key, "left_semi").join(F.broadcast(table.join(few, key, "left_semi")), key, how)
    rest = rows.where(F.col(key).isNotNull()).join(few, key, "left_anti").join(table, key, how)
    out = hot.unionByName(rest)
    if how == "left":
        added = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name != key]
        out = out.unionByName(rows.where(F.col(key).isNull()).select("*", *added))
    return out
