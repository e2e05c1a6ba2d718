"""Methods that weigh every row against every other: rows go in blocks, and a task holds two blocks and no pairs of rows."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.core.tables import stored
from urbanloom.session import ship

#: Rows of a block, about; a task works on arrays of SIZE by SIZE.
SIZE = 1024


def blocks(df: DataFrame, key: str) -> DataFrame:
    """(block, rows): the rows of ``df`` in blocks of about SIZE, dealt by a hash of ``key``, which is unique."""
    n = max(1, math.ceil(df.count() / SIZE))
    names = [key, *(c for c in df.columns if c != key)]
    return stored(df.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias("block")).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("rows")), "blocks")


def over_pairs(a: DataFrame, b: DataFrame, kernel: Callable[[dict, dict], pd.DataFrame], schema: str) -> DataFrame:
    """``kernel`` over all pairs of a block of ``a`` and one of ``b`` (from ``blocks``), as arrays by column."""
    spark = a.sparkSession
    ship(spark)
    parts = lambda df, s: [F.col(f"rows.{f.name}").alias(f"{s}{f.name}") for f in df.schema["rows"].dataType.elementType.fields]
    left, right = a.select(*parts(a, "a_")), b.select(*parts(b, "b_"))
    pairs = left.crossJoin(right).repartition(max(1, min(a.count() * b.count(), 4 * spark.sparkContext.defaultParallelism)))

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                sides = {s: {k[2:]: np.asarray(v) for k, v in zip(pdf.columns, row) if k.startswith(s)} for s in ("a_", "b_")}
                yield kernel(sides["a_"], sides["b_"])

    return pairs.mapInPandas(run, schema)
