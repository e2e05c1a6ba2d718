"""Columns of text that stand for numbers: street widths, road classes, times of timetables, matched keywords."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Widths in metres by road class.
ROAD_WIDTHS = {
    "motorway": 25.0,
    "trunk": 25.0,
    "primary": 18.0,
    "secondary": 14.0,
    "tertiary": 10.0,
    "residential": 8.0,
    "unclassified": 8.0,
    "road": 8.0,
    "service": 5.0,
    "living_street": 5.0,
    "track": 4.0,
    "pedestrian": 3.0,
    "footway": 3.0,
    "cycleway": 3.0,
    "path": 3.0,
    "steps": 2.0,
}


def width_m(c: Column) -> Column:
    """Metres of "7.5", "7,5 m" or "12 metres"; null for other texts, null and widths that aren't above 0."""
    bare = F.regexp_replace(F.lower(F.trim(c.cast("string"))), r"\s*(meters|metres|meter|metre|m)$", "")
    number = F.regexp_replace(bare, ",", ".").try_cast("double")
    return F.when((number > 0) & (number < float("inf")), number)


def road_width_m(c: Column, fallback: float) -> Column:
    """The usual width of a road class (links like their road), ``fallback`` for other classes and null."""
    key = F.regexp_replace(F.lower(F.trim(c)), "_link$", "")
    table = F.create_map(*(x for k, v in ROAD_WIDTHS.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(table[key], F.lit(float(fallback)))


def seconds(c: Column) -> Column:
    """Seconds since midnight of h:mm:ss, where hours may go beyond 24; other texts are an error, null stays null."""
    part = lambda k: F.regexp_extract(c, r"^\s*(\d+)\s*:\s*(\d+)\s*:\s*(\d+)\s*$", k).try_cast("int")
    good = (part(2) < 60) & (part(3) < 60)
    return F.when(c.isNull(), F.lit(None)).when(good, part(1) * 3600 + part(2) * 60 + part(3)).otherwise(F.raise_error(F.concat(F.lit("not a time: "), c))).cast("int")


def matched(category: Column, standards: list[tuple[str, float]]) -> Column:
    """struct<key, per_capita> of the first keyword that the category holds; null if none does."""
    low = F.lower(category)
    options = [F.when(F.contains(low, F.lit(k)), F.struct(F.lit(k).alias("key"), F.lit(float(v)).alias("per_capita"))) for k, v in standards]
    return reduce(lambda a, b: F.coalesce(a, b), options)
