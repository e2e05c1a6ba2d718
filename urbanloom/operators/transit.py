"""Service days and journeys of timetables: which services run, trips by pattern, earliest arrivals by rounds of rides."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbanloom.core.ordered import numbered
from urbanloom.core.tables import drop, stored


def active_services(calendar: DataFrame, dates: DataFrame, day: str) -> DataFrame:
    """(service) that run on a day (YYYYMMDD): by weekday and period of calendar (service, days, start, end), then by
    exceptions (service, date, exception, n), 1 for added and 2 for taken away; the last exception of a service counts."""
    try:
        weekday = datetime.date(int(day[:4]), int(day[4:6]), int(day[6:8])).weekday()
    except ValueError as e:
        raise ValueError(f"not a date: {day!r}") from e
    regular = calendar.where(F.col("days")[weekday] & (F.col("start") <= day) & (F.col("end") >= day)).select("service").distinct()
    changed = dates.where(F.col("date") == day).groupBy("service").agg(F.max_by("exception", "n").alias("x"))
    return regular.join(changed.where("x = 2"), "service", "left_anti").unionByName(changed.where("x = 1").select("service")).distinct()


def first_service_day(calendar: DataFrame, dates: DataFrame) -> str:
    """The first day (YYYYMMDD) on which a service of the calendar runs, or else the first one that is added."""
    days = calendar.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn("d", F.date_add(F.try_to_date("start", "yyyyMMdd"), F.col("k")))
    runs = F.get("days", F.pmod(F.dayofweek("d") + 5, F.lit(7)))
    text = F.date_format("d", "yyyyMMdd")
    first = days.where(F.col("d").isNotNull() & runs & (text <= F.col("end"))).agg(F.min(text).alias("d")).first()["d"]
    first = first or dates.where("exception = 1").agg(F.min("date").alias("d")).first()["d"]
    if first is None:
        raise ValueError("no service ever runs")
    return first


def compile_day(trips: DataFrame, stop_times: DataFrame, services: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pattern, route, stops, trips) and (pattern, run, trip, pos, stop, arr, dep) of the services' trips (trip, route, service)
    with two stop times (trip, seq, stop, arr, dep) at least: trips of one route over the same stops share a pattern, runs count
    by first departure."""
    order = [F.col("seq"), *([F.col("n")] if "n" in stop_times.columns else [])]
    times = stop_times.withColumn("pos", (F.row_number().over(Window.partitionBy("trip").orderBy(*order)) - 1).cast("int"))
    # a trip is a bounded list of stops
    whole = times.groupBy("trip").agg(F.array_sort(F.collect_list(F.struct("pos", "stop"))).alias("s"), F.min_by("dep", "pos").alias("first")).where("size(s) > 1")
    whole = stored(trips.join(services, "service", "left_semi").join(whole, "trip").select("trip", "route", "first", F.col("s.stop").alias("stops")), "trips")
    patterns = numbered(whole.groupBy("route", "stops").agg(F.count("*").alias("trips")), [F.col("route"), F.col("stops")], "pattern")
    patterns = stored(patterns.select((F.col("pattern") - 1).alias("pattern"), "route", "stops", "trips"), "patterns")
    runs = whole.join(patterns.select("pattern", "route", "stops"), ["route", "stops"]).select("pattern", "trip", (F.row_number().over(Window.partitionBy("pattern").orderBy("first", "trip")) - 1).alias("run"))
    return patterns, runs.join(times.select("trip", "pos", "stop", "arr", "dep"), "trip").select("pattern", "run", "trip", "pos", "stop", "arr", "dep")


def earliest_arrival(runs: DataFrame, access: DataFrame, max_transfers: int = 2) -> DataFrame:
    """(stop, t): the earliest arrival at each stop that is reached from access (stop, t) with so many changes at most.

    A round is a ride: where a trip can be boarded first, all its later stops are reached. Changes are at the same stop.
    """
    runs = stored(runs.select("trip", "pos", "stop", "arr", "dep"), "runs")
    best = stored(access.groupBy("stop").agg(F.min(F.col("t").cast("double")).alias("t")).where("t is not null"), "arrivals")
    for _ in range(max_transfers + 1):
        on = runs.join(best, "stop").where("t <= dep").groupBy("trip").agg(F.min("pos").alias("on"))
        got = runs.join(on, "trip").where("pos > on").select("stop", F.col("arr").cast("double").alias("t"))
        new = stored(best.unionByName(got).groupBy("stop").agg(F.min("t").alias("t")), "arrivals")
        changed = not new.join(best, ["stop", "t"], "left_anti").isEmpty()
        drop(best)
        best = new
        if not changed:
            break
    return best
