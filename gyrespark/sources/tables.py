"""Table readers: per-track CSV folders, catalogues, run logs, configuration."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gyrespark import schemas
from gyrespark.functions import geo, text
from gyrespark.operators import filters, ordered

# Accepted coordinate and time column names, in order.
LAT_NAMES = ["lat", "latitude", "LAT"]
LON_NAMES = ["lon", "longitude", "LON"]
TIME_NAMES = ["datetime", "time", "ISOTIME"]


def read_field(spark: SparkSession, path, level: int | None = None, columns: list[str] | None = None,
               data: str | None = None) -> DataFrame:
    """Gridded field in long form; level and columns are pushed into the scan."""
    df = spark.read.parquet(path) if isinstance(path, str) else spark.read.parquet(*path)
    if data:
        df = schemas.to_canonical_field(df, schemas.dialect(data))
    if level is not None:
        df = df.where(F.col("level") == level)
    return df.select(*columns) if columns else df


def canonical_tracks(df: DataFrame, track: str, time: str, lon: str, lat: str, extra: list[str] | None = None) -> DataFrame:
    """Any point table as (track_id, time, lon, lat, extra...)."""
    return df.select(F.col(track).alias("track_id"), F.col(time).alias("time"), F.col(lon).alias("lon"), F.col(lat).alias("lat"),
                     *(extra or []))


def with_date_parts(df: DataFrame, time: str = "time") -> DataFrame:
    return df.withColumns({"year": F.year(time), "month": F.month(time), "day": F.day(time), "hour": F.hour(time)})


def read_csv(spark: SparkSession, path, schema=None, recursive: bool = False) -> DataFrame:
    """CSV files with a ``source_file`` column; columns are matched by header name."""
    reader = spark.read.option("header", True).option("recursiveFileLookup", recursive).option("enforceSchema", False)
    reader = reader.schema(schema) if schema is not None else reader
    df = reader.csv(path)
    return df.withColumn("source_file", F.col("_metadata.file_name"))


def read_track_folder(spark: SparkSession, path, schema, time: str = "datetime", min_points: int = 3,
                      drop_incomplete: bool = True) -> DataFrame:
    """One CSV per track; short tracks go first, incomplete rows after that."""
    df = read_csv(spark, path, schema)
    kept = filters.long_tracks(df, "source_file", min_points, strict=True)
    names = [f.name for f in schema.fields] if isinstance(schema, T.StructType) else None
    kept = kept.dropna(how="any", subset=names) if drop_incomplete else kept
    return kept.withColumn("month", F.month(time))


def read_manual_tracks(spark: SparkSession, path, schema=None) -> DataFrame:
    """Hand-drawn tracks, one file each: canonical names, id by file order."""
    df = read_csv(spark, path, schema or schemas.MANUAL_TRACKS)
    df = df.withColumnsRenamed({"time": "datetime", "pxc_ind": "x", "pyc_ind": "y"})
    return with_file_ids(df)


def with_file_ids(df: DataFrame, name: str = "track_id") -> DataFrame:
    """Number the source files in name order, from zero."""
    return df.join(ordered.sum_before(df.select("source_file").distinct(), "source_file", name), "source_file")


def resolve_track_columns(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Pick latitude, longitude and time from their usual names and drop incomplete rows."""
    picked = {}
    for name, options in (("time", TIME_NAMES), ("lat", LAT_NAMES), ("lon", LON_NAMES)):
        found = next((c for c in options if c in df.columns), None)
        if found is None:
            raise ValueError(f"none of {options} among {df.columns}")
        picked[name] = F.col(found).alias(name)
    rest = [c for c in (extra or []) if c in df.columns]
    ids = [c for c in ("track_id", "source_file") if c in df.columns]
    return df.select(*ids, *picked.values(), *rest).dropna(subset=["lat", "lon", "time"])


def read_storm_catalogue(spark: SparkSession, path, min_points: int = 3) -> DataFrame:
    """Best-track CSV with hemisphere-suffixed coordinates."""
    df = read_csv(spark, path, schemas.STORM_CATALOGUE)
    df = df.withColumns({"lat": geo.parse_coordinate("lat"), "lon": geo.parse_coordinate("lon")})
    return filters.long_tracks(df, "Id", min_points, strict=True)


def basin(df: DataFrame, column: str, wanted: str) -> DataFrame:
    return df.where(F.col(column) == wanted)


def read_catalogue(spark: SparkSession, path, year: int, lon_range: tuple[float, float], lat_range: tuple[float, float],
                   columns: list[str] | None = None) -> DataFrame:
    """Typed catalogue: columns, year and box are all pushed to parquet.

    Latitude and year become range predicates on the stored columns; longitude
    is stored in [0, 360) and its window may wrap.
    """
    columns = columns or [f.name for f in schemas.CATALOGUE.fields]
    first, last = f"{year}-01-01 00:00:00", f"{year + 1}-01-01 00:00:00"
    lo, hi = lon_range[0] % 360.0, lon_range[1] % 360.0
    df = spark.read.parquet(path).select(*columns)
    return df.where((F.col("ISOTIME") >= F.lit(first).cast("timestamp_ntz")) & (F.col("ISOTIME") < F.lit(last).cast("timestamp_ntz"))
                    & F.col("LAT").between(*lat_range) & geo.lon_in_range("LON", lo, hi))


def newest_per_key(df: DataFrame, key: str, modified: str) -> DataFrame:
    """Rows of the most recently modified file of each key value."""
    files = df.select(key, modified, "source_file").distinct()
    newest = ordered.best_row(files, [key], [-text.micros(modified), F.col("source_file")], ["source_file"])
    return df.join(newest, [key, "source_file"], "left_semi")


def read_catalogue_csv(spark: SparkSession, path, schema, year_pattern: str = r"(\d{4})") -> DataFrame:
    """Per-type catalogue CSVs; of several files for one year the newest is used."""
    df = spark.read.option("header", True).schema(schema).csv(path).select(
        "*", F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("modified"))
    df = df.withColumn("file_year", F.regexp_extract("source_file", year_pattern, 1).cast("int"))
    return newest_per_key(df, "file_year", "modified").withColumn("LON", geo.lon_180("LON")).drop("modified")


def read_run_log(spark: SparkSession, path) -> DataFrame:
    """Run log with typed columns and ``prioritize`` as boolean."""
    df = spark.read.option("header", True).schema(schemas.RUN_LOG).csv(path)
    return df.withColumn("prioritize", text.text_is_true("prioritize"))


def read_merged_tracks(spark: SparkSession, path) -> DataFrame:
    return read_csv(spark, path).withColumn("datetime", text.parse_time("datetime"))


def read_monthly_peaks(spark: SparkSession, path, months: list[int], schema=None, time: str = "datetime") -> DataFrame:
    return filters.months(read_csv(spark, path, schema), time, months)


def load_config(path: str) -> dict:
    """Small JSON configuration as a driver-side dictionary."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)
