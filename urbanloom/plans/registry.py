"""Where families register their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.session import ship
from urbanloom.sources.derived import oracle, relation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, build: Callable, *relations: str, sql: str | None = None) -> None:
    """``build`` gets the named relations as DataFrames. Doubles of the result are rounded to six places."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)  # some columns and groups run Python on the executors
        return rounded(build(*(relation(spark, sf_dir, r) for r in relations)))

    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = oracle(sql)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*((F.round(F.col(f"`{c}`"), 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))
