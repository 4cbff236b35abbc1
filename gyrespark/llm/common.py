"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gyrespark.session import cut_lineage

# Characters that separate words: blank and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
SLICE_BYTES = 4 << 20  # text handled at once inside a task


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only, a null text as the empty one; other columns cannot clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def without(text: Column, chars: str, to: str = "") -> Column:
    """Replace each of a few characters; plain searches are far cheaper than ``translate``."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(to))
    return text


def words_of(text: Column) -> Column:
    """Words of a text as a native array, without a regular expression."""
    return F.array_remove(F.split(without(text, SPACES[1:], " "), " "), "")


def id_class(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id is in class -1."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(-1)).cast("int")


def total_bytes(frame: DataFrame, column: str = "text") -> int:
    """Bytes of a text column, to size partitions by the input."""
    return int(frame.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def parts_for(spark: SparkSession, size: float, per_part: float) -> int:
    """Partitions so that each holds about ``per_part``; at least the session's default."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / per_part), 1)


def slices(batches: Iterable[pa.RecordBatch], text_column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows with about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text_column)
        size = np.cumsum(np.array([len(x.as_buffer()) if x.is_valid else 0 for x in column], dtype=np.int64))
        first = 0
        while first < batch.num_rows:
            base = size[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(size, base + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


def per_batch(frame: DataFrame, schema: str, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], text_column: int = 1) -> DataFrame:
    """Map ``kernel`` over bounded slices of a frame."""
    def run(batches):
        for part in slices(batches, text_column):
            out = kernel(part)
            if out is not None:
                yield out
    return frame.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system, so that an idle Python worker does not sit on it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def persisted(frame: DataFrame) -> DataFrame:
    """Write a frame that several jobs read to the shared folder."""
    return cut_lineage(frame)


def global_rank(frame: DataFrame, column: str, name: str) -> DataFrame:
    """Number the rows from 0 in order of ``column`` (nulls last) without a single-task window.

    Rows are range-partitioned; only the number of rows of each partition is
    summed up for the offsets.
    """
    key = F.col(column).asc_nulls_last()
    dealt = persisted(frame.repartitionByRange(key).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id()))
    from pyspark.sql import Window

    offsets = {r["_p"]: r["n"] for r in dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, starts = 0, {}
    for p in sorted(offsets):
        starts[p], before = before, before + offsets[p]
    start = F.create_map(*[F.lit(x) for p, s in starts.items() for x in (p, s)]) if starts else None
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    offset = F.element_at(start, F.col("_p")).cast("long") if starts else F.lit(0).cast("long")
    return dealt.withColumn(name, rank + offset).drop("_p")
