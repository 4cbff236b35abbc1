"""Readers and writers of the node and track text layouts.

Both layouts are positional: a header line applies to the lines after it.
Large files are split by Spark, so the position of a line is its split offset
plus the row order inside the split; headers are carried across splits with
the chunked scans of :mod:`gyrespark.operators.ordered`, where one chunk is one
file split.  No file is ever read whole by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gyrespark.operators import ordered
from gyrespark.session import cut_lineage


def _stripped() -> Column:
    """Line without surrounding blanks and tabs."""
    return F.btrim(F.col("value"), F.lit(" \t"))


def read_lines(spark: SparkSession, path) -> DataFrame:
    """Lines with (file, block, line): order inside a file is (block, line)."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    # line numbers depend on task placement, so they are fixed before being used twice
    return cut_lineage(lines.where(_stripped() != ""))


def read_nodes(spark: SparkSession, path, dense_ids: bool = False) -> DataFrame:
    """Node text: ``year month day n hour`` headers over tab-indented points."""
    lines = read_lines(spark, path)
    is_header = ~F.startswith(F.col("value"), F.lit("\t"))
    parts = F.split(_stripped(), r"\s+")
    head = F.when(is_header, F.make_timestamp_ntz(*[parts[i].cast("int") for i in (0, 1, 2, 4)], F.lit(0), F.lit(0)))
    marked = lines.withColumn("_h", head)
    timed = ordered.carry(marked, ["file"], ["block", "line"], ["_h"], F.col("block"), forward=True, suffix="time")
    names = ["lon_idx", "lat_idx", "lon", "lat", "rad", "crit", "wspd"]
    types = ["int", "int"] + ["double"] * 5
    points = timed.where(F.startswith(F.col("value"), F.lit("\t")))
    cells = F.split(_stripped(), "\t")
    out = points.select(F.col("_h_time").alias("time"), *[cells[i].cast(t).alias(n) for i, (n, t) in enumerate(zip(names, types))],
                        "file_name", "file", "block", "line")
    if dense_ids:
        # a running count over the splits of all files in path order, from zero
        span = out.withColumn("_all", F.lit(0)).withColumn("_split", F.struct("file", "block"))
        out = ordered.running(span, ["_all"], ["_split", "line"], F.col("_split"), number="_no").withColumn(
            "point_id", F.col("_no") - 1).drop("_all", "_split", "_no")
    return out.drop("file", "block", "line")


def node_headers(spark: SparkSession, path) -> DataFrame:
    """Header lines with their announced and actual number of points."""
    lines = read_lines(spark, path)
    is_header = ~F.startswith(F.col("value"), F.lit("\t"))
    counted = ordered.running(lines.withColumn("_one", F.when(is_header, 1).otherwise(0).cast("long")), ["file"],
                              ["block", "line"], F.col("block"), sums={"_no": F.col("_one")})
    parts = F.split(_stripped(), r"\s+")
    g = counted.groupBy("file_name", "file", "_no").agg(
        F.max(F.when(F.col("_one") == 1, F.make_timestamp_ntz(*[parts[i].cast("int") for i in (0, 1, 2, 4)], F.lit(0), F.lit(0)))).alias("time"),
        F.max(F.when(F.col("_one") == 1, parts[3].cast("int"))).alias("announced"),
        F.count_if(F.col("_one") == 0).alias("found"))
    return g.drop("file", "_no")


TRACK_COLUMNS = [("i", "int"), ("j", "int"), ("lon", "double"), ("lat", "double"), ("rad", "double"), ("r2d", "double"),
                 ("wspd", "double"), ("year", "int"), ("month", "int"), ("day", "int"), ("hour", "int")]
TRACK_COLUMNS_SHORT = [("i", "int"), ("j", "int"), ("lon", "double"), ("lat", "double"), ("r2d", "double"), ("wind", "double"),
                       ("year", "int"), ("month", "int"), ("day", "int"), ("hour", "int")]


def read_tracks(spark: SparkSession, path, columns: list[tuple[str, str]] | None = None) -> DataFrame:
    """Track text: a ``start`` line begins each track.

    Files are ordered by path and their tracks numbered through, so ids from
    different files never meet; longitudes above 180 are folded.
    """
    columns = columns or TRACK_COLUMNS
    lines = read_lines(spark, path)
    is_start = F.startswith(F.col("value"), F.lit("start"))
    marked = lines.withColumn("_s", F.when(is_start, 1).otherwise(0).cast("long"))
    local = ordered.running(marked, ["file"], ["block", "line"], F.col("block"), sums={"_no": F.col("_s")})
    # one row per file: the id offset of a file is the number of tracks before it
    per_file = marked.groupBy("file").agg(F.sum("_s").alias("_t"))
    offset = ordered.sum_before(per_file, "file", "_o", F.col("_t")).drop("_t")
    points = local.where("_s = 0").join(offset, "file")
    cells = F.split(_stripped(), "\t")
    out = points.select((F.col("_o") + F.col("_no") - 1).alias("track_id"),
                        *[cells[i].cast(t).alias(n) for i, (n, t) in enumerate(columns)], F.col("file_name").alias("source_file"))
    return out.select(
        "track_id", *[F.when(F.col(n) > 180.0, F.col(n) - 360.0).otherwise(F.col(n)).alias(n) if n == "lon" else F.col(n)
                      for n, _ in columns if n not in ("year", "month", "day", "hour")],
        F.make_timestamp_ntz("year", "month", "day", "hour", F.lit(0), F.lit(0)).alias("time"), "source_file")


def count_tracks(spark: SparkSession, path) -> DataFrame:
    """Number of ``start`` lines per file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file_name"), "value")
    return lines.groupBy("file_name").agg(F.count_if(F.startswith(F.col("value"), F.lit("start"))).alias("n_tracks"))


def season_tracks(spark: SparkSession, path, start: tuple[int, int], end: tuple[int, int], min_points: int = 3,
                  columns: list[tuple[str, str]] | None = None) -> DataFrame:
    """Tracks inside a month-day window that have more than ``min_points`` points there."""
    from gyrespark.operators.filters import long_tracks, season_window

    inside = season_window(read_tracks(spark, path, columns), "time", start, end)
    return long_tracks(inside, "track_id", min_points, strict=True)


def _number(c: str) -> Column:
    return F.format_string("%.6f", F.col(c).cast("double"))


def _exponent(c: str) -> Column:
    return F.format_string("%.6e", F.col(c).cast("double"))


def _date_parts(c: str) -> list[Column]:
    return [f(c).cast("string") for f in (F.year, F.month, F.day, F.hour)]


def track_lines(tracks: DataFrame, track: str = "track_id", time: str = "time") -> DataFrame:
    """Track text lines with their order key (track, seq); seq 0 is the header."""
    head = tracks.groupBy(track).agg(F.count(F.lit(1)).alias("_n"), F.min(time).alias("_t"))
    head = head.select(track, F.lit(None).cast("timestamp_ntz").alias("at"),
                       F.concat_ws("\t", F.lit("start"), F.col("_n").cast("string"), *_date_parts("_t")).alias("value"))
    cols = [F.col("x").cast("string"), F.col("y").cast("string"), _number("lon"), _number("lat"), _exponent("crit"),
            _exponent("rad"), F.floor("track_len").cast("string"), *_date_parts(time)]
    body = tracks.select(track, F.col(time).alias("at"), F.concat(F.lit("\t"), F.concat_ws("\t", *cols)).alias("value"))
    return head.unionByName(body)


def write_track_text(tracks: DataFrame, path: str, track: str = "track_id", time: str = "time", mode: str = "errorifexists") -> None:
    """Write track text; each output file holds whole tracks of one year and month.

    Lines are range-partitioned by (month, track, time): neighbouring tracks
    share a file and a long track may continue in the next file of its month,
    whose name sorts after it.
    """
    lines = track_lines(tracks, track, time)
    first = tracks.groupBy(track).agg(F.date_format(F.min(time), "yyyy-MM").alias("month"))
    keyed = lines.join(first, track)
    laid = keyed.repartitionByRange("month", track, F.col("at").asc_nulls_first()).sortWithinPartitions(
        F.col("month"), F.col(track), F.col("at").asc_nulls_first())
    laid.select("month", "value").write.mode(mode).partitionBy("month").text(path)


def node_lines(nodes: DataFrame, time: str = "time") -> DataFrame:
    """Node text lines with their order key (time, seq)."""
    head = nodes.groupBy(time).agg(F.count("lon_idx").alias("_n")).select(
        F.col(time).alias("at"), F.lit(0).cast("int").alias("_y"), F.lit(0).cast("int").alias("_x"), F.lit(0).alias("seq"),
        F.concat_ws("\t", F.year(time).cast("string"), F.month(time).cast("string"), F.day(time).cast("string"),
                    F.col("_n").cast("string"), F.hour(time).cast("string")).alias("value"))
    cols = [F.col("lon_idx").cast("string"), F.col("lat_idx").cast("string"), _number("lon"), _number("lat"),
            _exponent("rad"), _exponent("crit"), _exponent("wspd")]
    body = nodes.where(F.col("lon_idx").isNotNull()).select(
        F.col(time).alias("at"), F.col("lat_idx").alias("_y"), F.col("lon_idx").alias("_x"), F.lit(1).alias("seq"),
        F.concat(F.lit("\t"), F.concat_ws("\t", *cols)).alias("value"))
    return head.unionByName(body)


def write_node_text(nodes: DataFrame, path: str, time: str = "time", mode: str = "errorifexists") -> None:
    """Write node text by month; hours without nodes are rows with a null ``lon_idx``."""
    lines = node_lines(nodes, time).withColumn("month", F.date_format("at", "yyyy-MM"))
    # an hour stays in one file: the range is cut on the hour only
    lines.repartitionByRange("month", "at").sortWithinPartitions("month", "at", "seq", "_y", "_x").select(
        "month", "value").write.mode(mode).partitionBy("month").text(path)
