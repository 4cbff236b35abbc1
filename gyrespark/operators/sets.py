"""Set operations and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrespark.operators import ordered

# Identity of a configuration row and the columns whose presence
# makes one version of it more complete than another.
COMBO_KEYS = ["eps", "size_filter", "extr_type", "maxgap", "mintime", "prioritize", "search_range", "years"]
COMPLETENESS = ["n_own_tracks", "POD", "median_overlap_percent", "median_overlap_percent_1to1"]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def upsert_most_complete(old: DataFrame, new: DataFrame, keys: list[str], completeness: list[str]) -> DataFrame:
    """Merge two versions of a table: the fuller row wins, the newer on a tie."""
    both = union_all([old.withColumn("_new", F.lit(0)), new.withColumn("_new", F.lit(1))])
    filled = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in completeness if c in both.columns), F.lit(0))
    both = both.withColumn("_full", filled)
    rest = [c for c in both.columns if c not in keys and c not in ("_new", "_full")]
    return ordered.best_row(both, keys, [-F.col("_full"), -F.col("_new")], rest)


def replace_slice(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Drop the old rows of every key value present in the new table and append it."""
    return union_all([old.join(new.select(key).distinct(), key, "left_anti"), new])


def common_times(left: DataFrame, right: DataFrame, time: str) -> DataFrame:
    return left.select(time).intersect(right.select(time))


def distinct_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).dropDuplicates()


def missing_days(expected: DataFrame, found: DataFrame, day: str) -> DataFrame:
    return expected.select(day).distinct().join(found.select(day).distinct(), day, "left_anti")


def unequal_tracks(left: DataFrame, right: DataFrame, track: str, columns: list[str]) -> DataFrame:
    """Points of left tracks for which no right track has the same points.

    A track is identified by its number of points and an order-free digest of
    them, so whole tracks are compared without collecting either.
    """
    def digest(df: DataFrame) -> DataFrame:
        h1 = F.xxhash64(*columns)
        h2 = F.xxhash64(F.lit(17), *columns)
        return df.groupBy(track).agg(
            F.count(F.lit(1)).alias("_n"), F.bit_xor(h1).alias("_h1"),
            F.sum(F.shiftrightunsigned(h2, 16).cast("decimal(38,0)")).alias("_h2"))

    same = digest(left).join(digest(right).drop(track).distinct(), ["_n", "_h1", "_h2"], "left_semi")
    return left.join(same.select(track), track, "left_anti")
