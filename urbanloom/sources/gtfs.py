"""Timetable feeds: zip files of comma-separated tables, read by the executors, a file a task."""

from __future__ import annotations

import csv
import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.core.tables import stored
from urbanloom.functions.text import seconds
from urbanloom.session import ship

NEEDED = ("stops.txt", "routes.txt", "trips.txt", "stop_times.txt")
CALENDARS = ("calendar.txt", "calendar_dates.txt")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
#: Rows that a reader hands over at a time.
BATCH = 20_000


def _rows(feed: str, content: bytes):
    """(file, n, row) of a feed's tables; n = 0 stands for the table itself, so that empty ones are known to be there."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise ValueError(f"{feed} is no zip file") from e
    with archive:
        for name in archive.namelist():
            file = name.rsplit("/", 1)[-1]
            if file in NEEDED + CALENDARS:
                yield file, 0, []
                with archive.open(name) as f:
                    for n, row in enumerate(csv.DictReader(io.TextIOWrapper(f, "utf-8-sig", newline="")), 1):
                        yield file, n, [(k.strip(), (v or "").strip()) for k, v in row.items() if k is not None and not isinstance(v, list)]


def read_gtfs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables stops, routes, trips, stop_times, calendar and calendar_dates of the feeds (zip files) at ``path``.

    A feed without a needed table, without both calendars or without stops is an error; so are coordinates and times that
    can't be read. Rows without their id are left out, as are stop times of unknown trips and stops or without any time;
    of rows that repeat an id the last one counts. A table may be empty.
    """
    ship(spark)

    def run(batches):
        for batch in batches:
            for feed, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                held: list[tuple] = []
                for row in _rows(feed, content.as_buffer().to_pybytes()):
                    held.append(row)
                    if len(held) >= BATCH:
                        yield _batch(feed, held)
                        held = []
                if held:
                    yield _batch(feed, held)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    rows = stored(files.mapInArrow(run, "feed string, file string, n long, row map<string,string>"), "gtfs")
    for r in rows.where("n = 0").groupBy("feed").agg(F.collect_set("file").alias("files")).collect():
        missing = [f for f in NEEDED if f not in r["files"]]
        if missing or not set(CALENDARS) & set(r["files"]):
            raise ValueError(f"{r['feed']} lacks {', '.join(missing or [' or '.join(CALENDARS)])}")
    rows = rows.where("n > 0")

    def cell(name: str, other: Column | None = None) -> Column:
        value = F.col("row")[name]
        value = F.when(F.length(value) > 0, value)
        return value if other is None else F.coalesce(value, other)

    def table(file: str, key: str | None, *columns: Column) -> DataFrame:
        own = rows.where(F.col("file") == file)
        if key is None:
            return own.select("feed", "n", *columns)
        own = own.where(cell(key).isNotNull()).groupBy("feed", cell(key).alias("_key")).agg(F.max_by("row", "n").alias("row"))
        return own.select("feed", *columns)

    coordinate = lambda c: F.coalesce(cell(c).cast("double"), F.lit(float("nan")))
    stops = table("stops.txt", "stop_id", F.col("_key").alias("stop"), cell("stop_name", F.col("_key")).alias("name"), coordinate("stop_lat").alias("lat"), coordinate("stop_lon").alias("lon"))
    if stops.isEmpty():
        raise ValueError("the feeds have no stops")
    routes = table("routes.txt", "route_id", F.col("_key").alias("route"), F.col("row")["route_short_name"].alias("short"), F.col("row")["route_long_name"].alias("long"), F.coalesce(cell("route_type").try_cast("int"), F.lit(-1)).alias("type"))
    trips = table("trips.txt", "trip_id", F.col("_key").alias("trip"), cell("route_id", F.lit("")).alias("route"), cell("service_id", F.lit("")).alias("service"))
    arrival = cell("arrival_time", cell("departure_time"))
    times = table("stop_times.txt", None, cell("trip_id").alias("trip"), cell("stop_id").alias("stop"), F.coalesce(cell("stop_sequence").cast("int"), F.lit(0)).alias("seq"), arrival.alias("a"), cell("departure_time", arrival).alias("d")).where("a is not null")
    times = times.join(trips.select("feed", "trip"), ["feed", "trip"], "left_semi").join(stops.select("feed", "stop"), ["feed", "stop"], "left_semi")
    times = times.select("feed", "trip", "seq", "n", "stop", seconds(F.col("a")).alias("arr"), seconds(F.col("d")).alias("dep"))
    days = F.array(*(F.coalesce(cell(d) == "1", F.lit(False)) for d in WEEKDAYS))
    calendar = table("calendar.txt", "service_id", F.col("_key").alias("service"), days.alias("days"), cell("start_date", F.lit("00000000")).alias("start"), cell("end_date", F.lit("99999999")).alias("end"))
    dates = table("calendar_dates.txt", None, cell("service_id").alias("service"), cell("date").alias("date"), cell("exception_type").try_cast("int").alias("exception"))
    return {"stops": stops, "routes": routes, "trips": trips, "stop_times": times, "calendar": calendar, "calendar_dates": dates.where("service is not null and date is not null and exception in (1, 2)")}


def _batch(feed: str, rows: list[tuple]) -> pa.RecordBatch:
    file, n, row = zip(*rows)
    return pa.record_batch([pa.array([feed] * len(rows)), pa.array(file), pa.array(n, pa.int64()), pa.array(row, pa.map_(pa.string(), pa.string()))], names=["feed", "file", "n", "row"])
