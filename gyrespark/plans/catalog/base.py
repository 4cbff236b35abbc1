"""Registry of the catalogue queries and the tables they derive.

A query is a function of (session, folder) with the equivalent SQL next to it.
Track points are read from ``events``: a user is a track, ``value`` the
criterion and its whole part the column index, the number in ``props`` the row
index.  Hourly positions give two track sets to match.  Gridded slices come
from ``lineitem``: a supplier is a slice, quantity and line number are the cell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gyrespark.functions import geo
from gyrespark.operators import ordered

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Builder, str | None]] = {}

NX, NY = 50, 7


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def wrap(build: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = (build, sql)
        return build
    return wrap


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(column) -> Column:
    return F.round(geo._c(column).cast("double"), 6)


def points(spark: SparkSession, folder: str) -> DataFrame:
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    e = load(spark, folder, "events")
    return e.select(
        "event_id", F.col("user_id").alias("track_id"), F.col("ts").alias("time"), F.col("value").alias("crit"),
        F.col("event_type").alias("label"), F.floor("value").cast("int").alias("x"), k.alias("y"),
        (F.floor("value") * 0.5 - 120.0).alias("lon"), (k * 0.5 + 20.0).alias("lat"))


PTS = """pts AS (SELECT event_id, user_id AS track_id, ts AS time, value AS crit, event_type AS label,
  CAST(floor(value) AS INTEGER) AS x, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS y,
  floor(value) * 0.5 - 120.0 AS lon, CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) * 0.5 + 20.0 AS lat
  FROM events)"""

def chunk() -> Column:
    return ordered.time_chunk("time", "7 days")


TIE = ["event_id"]

REF_LABELS = ["click", "view"]


def hourly(spark: SparkSession, folder: str, reference: bool | None = None) -> DataFrame:
    """Hourly positions (track_id, time, x, y, lon, lat) of one of the two track sets, or of all points."""
    p = points(spark, folder)
    if reference is not None:
        p = p.where(F.col("label").isin(REF_LABELS) if reference else ~F.col("label").isin(REF_LABELS))
    g = p.groupBy("track_id", F.date_trunc("hour", "time").cast("timestamp_ntz").alias("time")).agg(
        F.min("x").alias("x"), F.max("y").alias("y"))
    return g.withColumns({"lon": F.col("x") * 0.5 - 120.0, "lat": F.col("y") * 0.5 + 20.0})


HOURLY = """href AS (SELECT track_id, date_trunc('hour', time) AS time, min(x) AS x, max(y) AS y,
    CAST(min(x) AS DOUBLE) * 0.5 - 120.0 AS lon, CAST(max(y) AS DOUBLE) * 0.5 + 20.0 AS lat FROM pts WHERE label IN ('click', 'view') GROUP BY 1, 2),
  hown AS (SELECT track_id, date_trunc('hour', time) AS time, min(x) AS x, max(y) AS y,
    CAST(min(x) AS DOUBLE) * 0.5 - 120.0 AS lon, CAST(max(y) AS DOUBLE) * 0.5 + 20.0 AS lat FROM pts WHERE label NOT IN ('click', 'view') GROUP BY 1, 2)"""


def hav(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """SQL great-circle distance in km."""
    return (f"2 * 6371.0 * asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) "
            f"* cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))")


def sparse_field(spark: SparkSession, folder: str) -> DataFrame:
    """Signed integer fields on the cells of each slice that have rows."""
    li = load(spark, folder, "lineitem")
    return li.groupBy(
        F.col("l_suppkey").alias("slice"), (F.col("l_linenumber") - 1).alias("y"), (F.col("l_quantity").cast("int") - 1).alias("x")
    ).agg(F.sum(F.round(F.col("l_discount") * 100, 0).cast("long") - 5).alias("u"),
          F.sum(F.round(F.col("l_tax") * 100, 0).cast("long") - 4).alias("v"),
          F.count(F.lit(1)).alias("n"))


CELLS = """cells AS (SELECT l_suppkey AS slice, l_linenumber - 1 AS y, CAST(l_quantity AS INTEGER) - 1 AS x,
  CAST(sum(CAST(round(l_discount * 100) AS BIGINT) - 5) AS BIGINT) AS u,
  CAST(sum(CAST(round(l_tax * 100) AS BIGINT) - 4) AS BIGINT) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)"""


def field(spark: SparkSession, folder: str) -> DataFrame:
    """The same fields on every cell of the grid, absent cells being 0."""
    from gyrespark.operators.grid import densify

    return densify(sparse_field(spark, folder), ["slice"], NX, NY, ["u", "v"], fill=0)


FIELD = CELLS + """, field AS (SELECT s.slice, gy.y, gx.x, coalesce(c.u, 0) AS u, coalesce(c.v, 0) AS v
  FROM (SELECT DISTINCT slice FROM cells) s, (SELECT unnest(range(0, 7)) AS y) gy, (SELECT unnest(range(0, 50)) AS x) gx
  LEFT JOIN cells c ON c.slice = s.slice AND c.y = gy.y AND c.x = gx.x)"""
