"""Relations that queries run on, derived from the driver's tables by SQL that Spark and DuckDB both read.

``{e0}``.. stand for the first components of an embedding, as the engines count lists from different numbers.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from urbanloom.session import load

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

RELATIONS = {
    # attribute vectors with weights and groups
    "values": "SELECT c_custkey AS id, greatest(c_acctbal, CAST(0 AS DOUBLE)) AS x, CAST(1 + c_custkey % 5 AS DOUBLE) AS w, c_mktsegment AS g FROM {customer}",
    # points with two attributes
    "points": "SELECT vec_id AS id, CAST({e0} AS DOUBLE) * 1000 AS x, CAST({e1} AS DOUBLE) * 1000 AS y, CAST({e2} AS DOUBLE) AS v, CAST({e3} AS DOUBLE) AS v2, label AS g FROM {embeddings}",
    # 25 areas on a 5 x 5 grid
    "areas": "SELECT n_nationkey AS id, CAST(n_nationkey % 5 AS DOUBLE) AS x, CAST(floor(n_nationkey / 5) AS DOUBLE) AS y, avg(c_acctbal) AS v, CAST(count(*) AS DOUBLE) AS pop, CAST(n_regionkey AS STRING) AS g FROM {nation} JOIN {customer} ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey",
    "facilities": "SELECT s_nationkey AS id, CAST(s_nationkey % 5 AS DOUBLE) AS x, CAST(floor(s_nationkey / 5) AS DOUBLE) AS y, CAST(count(*) AS DOUBLE) AS supply, avg(s_acctbal) AS bal FROM {supplier} GROUP BY s_nationkey",
    # alternatives by five criteria
    "alternatives": "SELECT l_suppkey AS id, avg(l_extendedprice) AS c1, avg(l_quantity) AS c2, 1 + avg(l_discount) AS c3, 1 + avg(l_tax) AS c4, CAST(count(*) AS DOUBLE) AS c5 FROM {lineitem} GROUP BY l_suppkey",
    # a daily series for each event type
    "series": "SELECT event_type AS k, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS t, sum(value) AS v FROM {events} GROUP BY 1, 2",
    # a street grid of 25 nodes with uneven costs and stress classes
    "nodes": "SELECT CAST(n_nationkey AS BIGINT) AS node, CAST(10 + n_nationkey % 7 AS DOUBLE) AS pop, CAST(1 + n_nationkey % 3 AS DOUBLE) AS w FROM {nation}",
    "edges": "SELECT CAST(a.n_nationkey AS BIGINT) AS src, CAST(b.n_nationkey AS BIGINT) AS dst, CAST(1 + (a.n_nationkey * 7 + b.n_nationkey * 3) % 5 AS DOUBLE) AS cost, CAST(1 + (a.n_nationkey + b.n_nationkey * 2) % 4 AS INT) AS lts FROM {nation} a JOIN {nation} b ON (b.n_nationkey = a.n_nationkey + 1 AND a.n_nationkey % 5 < 4) OR b.n_nationkey = a.n_nationkey + 5",
    # plots with attributes spread over fixed ranges
    "plots": "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS s, p_retailprice AS price, CAST(p_partkey % 97 AS DOUBLE) / 97 AS u, CAST(p_partkey % 89 AS DOUBLE) / 89 AS v, CAST(p_partkey % 83 AS DOUBLE) / 83 AS w, CAST(p_partkey % 79 AS DOUBLE) / 79 AS q FROM {part}",
    # ten units over ten periods, and the ring that they make
    "panel": "SELECT user_id % 10 AS id, CAST(floor(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 3) AS INT) AS t, sum(value) / 1000 AS y, avg(value) / 100 AS x1, CAST(count(*) AS DOUBLE) / 10 AS x2 FROM {events} GROUP BY 1, 2",
    "ring": "SELECT CAST(a.n_nationkey AS BIGINT) AS i, CAST(b.n_nationkey AS BIGINT) AS j, CAST(1 AS DOUBLE) / 2 AS w FROM {nation} a JOIN {nation} b ON a.n_nationkey < 10 AND b.n_nationkey < 10 AND ((a.n_nationkey + 1) % 10 = b.n_nationkey OR (b.n_nationkey + 1) % 10 = a.n_nationkey)",
    # judgements of five criteria, not quite consistent
    "judgements": "SELECT CAST(a.n_nationkey AS INT) AS i, CAST(b.n_nationkey AS INT) AS j, CAST(1 + a.n_nationkey AS DOUBLE) / (1 + b.n_nationkey) * CASE WHEN (a.n_nationkey + b.n_nationkey) % 2 = 0 THEN CAST(1 AS DOUBLE) WHEN a.n_nationkey < b.n_nationkey THEN CAST(5 AS DOUBLE) / 4 ELSE CAST(4 AS DOUBLE) / 5 END AS value FROM {nation} a JOIN {nation} b ON a.n_nationkey < 5 AND b.n_nationkey < 5",
    # street grids of 5 x 5 nodes, as many as there are parts for, and their edges
    "block_nodes": "SELECT p_partkey AS node, CAST(p_partkey % 5 AS DOUBLE) + 10 * floor(p_partkey / 25) AS x, CAST(floor((p_partkey % 25) / 5) AS DOUBLE) AS y, CAST(1 + p_partkey % 9 AS DOUBLE) AS pop FROM {part}",
    "block_edges": "SELECT 2 * a.p_partkey + CASE WHEN b.p_partkey = a.p_partkey + 1 THEN 0 ELSE 1 END AS edge, a.p_partkey AS src, b.p_partkey AS dst, CAST(1 + (a.p_partkey * 7 + b.p_partkey * 3) % 5 AS DOUBLE) AS cost, CAST(1 + (a.p_partkey + b.p_partkey * 2) % 4 AS INT) AS lts, CAST(a.p_partkey % 7 AS DOUBLE) / 7 AS shade, CAST(20 + b.p_partkey % 20 AS DOUBLE) AS lst, CAST(10 + a.p_partkey % 30 AS DOUBLE) AS capacity FROM {part} a JOIN {part} b ON floor(a.p_partkey / 25) = floor(b.p_partkey / 25) AND ((b.p_partkey = a.p_partkey + 1 AND a.p_partkey % 5 < 4) OR b.p_partkey = a.p_partkey + 5)",
    # quadrilaterals, a vertex a row
    "corners": "SELECT CAST(floor(p_partkey / 4) AS BIGINT) AS id, CAST(p_partkey % 4 AS INT) AS seq, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 6 WHEN 2 THEN 7 ELSE 1 END + CAST(p_partkey % 13 AS DOUBLE) / 13 AS x, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 5 ELSE 4 END + CAST(p_partkey % 11 AS DOUBLE) / 11 AS y FROM {part}",
    # raster cells, 40 columns wide
    "cells": "SELECT CAST(floor((p_partkey - 1) / 40) AS INT) AS r, CAST((p_partkey - 1) % 40 AS INT) AS c, p_retailprice AS z, CAST(p_size AS DOUBLE) AS a, CAST(p_partkey % 7 AS DOUBLE) / 7 AS b FROM {part}",
}


def exact_mean(x: str) -> str:
    """Spark SQL of a mean whose last bits don't hang on the order of rows, so that equal groups tie: decimals of up to
    eight places are summed as such, other values as doubles."""
    d = f"try_cast({x} AS DECIMAL(28, 8))"
    return f"CASE WHEN count({x}) = count_if(CAST({d} AS DOUBLE) = {x}) THEN CAST(try_sum({d}) AS DOUBLE) / count({x}) ELSE avg({x}) END"


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of RELATIONS in Spark."""
    sql = RELATIONS[name]
    if name == "alternatives":  # compared with >= and ranked
        sql = re.sub(r"avg\((\w+)\)", lambda m: exact_mean(m[1]), sql)
    for i in range(4):
        sql = sql.replace(f"{{e{i}}}", f"embedding[{i}]")
    sql = sql.replace("datediff('day', DATE '2024-01-01', CAST(ts AS DATE))", "datediff(CAST(ts AS DATE), DATE '2024-01-01')")
    used = {t: load(spark, sf_dir, t) for t in re.findall(r"\{(\w+)\}", sql)}
    return spark.sql(sql, **used)


def oracle(sql: str) -> str:
    """SQL for DuckDB in which {name} stands for a relation (or a table)."""
    for name, text in RELATIONS.items():
        for i in range(4):
            text = text.replace(f"{{e{i}}}", f"embedding[{i + 1}]")
        for t in TABLES:
            text = text.replace(f"{{{t}}}", t)
        sql = sql.replace(f"{{{name}}}", f"({text})")
    for t in TABLES:
        sql = sql.replace(f"{{{t}}}", t)
    return sql
