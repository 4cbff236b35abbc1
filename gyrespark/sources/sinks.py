"""Writers: partitioned tables, checkpoints by month, append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def write_tracks(tracks: DataFrame, path: str, time: str = "time", track: str = "track_id", mode: str = "overwrite",
                 fmt: str = "parquet") -> None:
    """Track table partitioned by year and month of the first point.

    Only the partitions present in the data are replaced (dynamic overwrite);
    the output committer publishes files atomically.
    """
    first = tracks.groupBy(track).agg(F.year(F.min(time)).alias("year"), F.month(F.min(time)).alias("month"))
    out = tracks.join(first, track)
    writer = out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("year", "month")
    (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(path)


def write_per_track_csv(tracks: DataFrame, path: str, track: str = "track_id", mode: str = "errorifexists") -> None:
    """One folder with one file per track, for consumers that expect single files."""
    tracks.repartition(track).sortWithinPartitions(track).write.mode(mode).option("header", True).partitionBy(track).csv(path)


def publish(df: DataFrame, path: str, if_exists: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Publish a folder once: ``ignore`` skips an existing one."""
    writer = df.write.mode(if_exists)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_months(df: DataFrame, path: str, time: str = "time") -> None:
    """Replace exactly the months present in ``df``."""
    out = df.withColumns({"year": F.year(time), "month": F.month(time)})
    out.repartition("year", "month", F.pmod(F.xxhash64(time), F.lit(16))).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(path)


def done_months(spark: SparkSession, path: str) -> DataFrame:
    """Months already written; empty when the folder is missing."""
    try:
        return spark.read.parquet(path).select("year", "month").distinct()
    except AnalysisException:
        return spark.createDataFrame([], "year int, month int")


def resume_months(df: DataFrame, path: str, time: str = "time") -> DataFrame:
    """Rows of months that are not in ``path`` yet."""
    keyed = df.withColumns({"year": F.year(time), "month": F.month(time)})
    return keyed.join(done_months(df.sparkSession, path), ["year", "month"], "left_anti").drop("year", "month")


def append_log(rows: DataFrame, path: str) -> None:
    """Append rows to a CSV log; nothing already there is rewritten."""
    rows.write.mode("append").option("header", True).csv(path)


def write_catalogue_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Replace a table that ``df`` itself may read: write beside it, then swap by renames.

    Between the two renames the table is absent for a moment.  If the second
    fails, the first is undone; the old table is deleted only once the new one
    is in place.  What a crashed run left beside the table is put back or removed.
    """
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fresh, old, final = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + end) for end in (".new", ".old", ""))
    fs = final.getFileSystem(conf)
    if fs.exists(old):
        if fs.exists(final):
            fs.delete(old, True)
        elif not fs.rename(old, final):
            raise OSError(f"{path}.old cannot be put back")
    df.write.mode("overwrite").parquet(path + ".new")
    had = fs.exists(final)
    if had and not fs.rename(final, old):
        raise OSError(f"{path} cannot be moved aside")
    if not fs.rename(fresh, final):
        if had:
            fs.rename(old, final)
        raise OSError(f"{path}.new cannot be moved into place; the old table is kept")
    if had:
        fs.delete(old, True)


def compact_months(spark: SparkSession, source: str, target: str, time: str = "time", rows_per_file: int = 5_000_000) -> None:
    """Daily files to monthly ones, with a bounded number of rows per file."""
    df = spark.read.parquet(source).withColumns({"year": F.year(time), "month": F.month(time)})
    df.repartitionByRange("year", "month", time).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(
        "year", "month").parquet(target)
