"""Language-model scores by deleted interpolation.

The probability of a token after its predecessor mixes three estimates: uniform
over the vocabulary and one unknown token, the token's relative frequency, and
its relative frequency after that predecessor.  The weights depend on the bucket
of the predecessor's count and are learned by expectation-maximisation: training
documents are split, the larger part gives the counts, and the tokens of the
other, deleted part are the events whose likelihood the weights maximise.  The
final scores use the counts of both parts.

Texts are cut into blocks of 16 MB (a longer text is a block of its own and bounds
a task's memory), coded once and written to the shared folder.  Every block sends
each distinct token and pair once, as a 56-bit hash in a sorted array with its
counts, to a bucket that owns a range of the hashes; the bucket sums and answers
each block in the order of its question.  So a frequent word costs one entry a
block, and no task holds more than one block or a few buckets.  The deleted texts
have blocks of their own, so a block counts for one part only, and only they are
told the counts of the larger part.  The events are summed up in a table of
(bucket, frequency, conditional frequency) classes with their means, whose size
does not depend on the input; only this table reaches the driver.

Cases: a null text counts as empty and has the end token only; a null id is in
training; without training tokens every token has probability one, without
deleted events the weights are equal.  Repeated rows count repeatedly.  An empty
table gives an empty one.  Only the id, the text and the role are read, so other
columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrespark.llm.blobs import bucket_bounds, mix, pack, pack_sorted, unpack, unpack_sorted
from gyrespark.llm.common import id_class, parts_for, persisted, slices

HELD_OUT = 2        # class of the id, modulo 7, that is not learned from
DELETED = 10        # one training document of so many gives the events for the weights
CONTEXTS = 25       # buckets of log2 of the predecessor's count
CLASSES = 64        # classes of a frequency's logarithm, and one for zero
ROUNDS = 60
LEAST_WEIGHT = 1e-4
FIT, EVENTS, TEST = 0, 1, 2
BLOCK_BYTES = 16 << 20  # text of a block: the longer, the more often its pairs repeat in it
HASH_BITS = 56
TOKENS_PER_BUCKET = 750_000
BUCKETS_PER_TASK = 4  # several small ones even out what a task gets
BLOCKS = "block bigint, kind int, ids array<{id}>, roles binary, lengths binary, tokens binary, words binary, n_tokens bigint"


def _blocks(batches):
    """Blocks of coded documents; the deleted ones apart from the others."""
    import xxhash

    part, made = TaskContext.get().partitionId(), 0
    for rows in slices(batches, 1, BLOCK_BYTES):
        roles = rows.column(2).to_numpy()
        for kind in (0, 1):
            chosen = rows.filter(pa.array((roles == EVENTS) == bool(kind)))
            if not chosen.num_rows:
                continue
            code: dict[bytes, int] = {b"": 0}  # the end token is the empty word
            coded = []
            for raw in pc.cast(chosen.column(1), pa.binary()).to_pylist():
                words = raw.lower().split()
                for w in set(words).difference(code):
                    code[w] = len(code)
                coded.append(np.fromiter(map(code.__getitem__, words + [b""]), dtype=np.uint32, count=len(words) + 1))
            hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in code], dtype=np.uint64) >> np.uint64(64 - HASH_BITS)
            lengths = np.array([len(c) for c in coded], dtype=np.int64)
            tokens = np.concatenate(coded)
            yield pa.RecordBatch.from_arrays([
                pa.array([part << 32 | made], pa.int64()), pa.array([kind], pa.int32()), pa.array([chosen.column(0).to_pylist()], pa.list_(rows.schema[0].type)),
                pa.array([pack(chosen.column(2).to_numpy().astype(np.uint8))], pa.binary()), pa.array([pack(lengths)], pa.binary()),
                pa.array([pack(tokens)], pa.binary()), pa.array([pack(hashes)], pa.binary()), pa.array([len(tokens)], pa.int64()),
            ], ["block", "kind", "ids", "roles", "lengths", "tokens", "words", "n_tokens"])
            made += 1


class _Block:
    """Tokens of a block, their pairs, and the sorted hashes of both."""

    def __init__(self, row: dict):
        self.roles, self.lengths = unpack(row["roles"], np.uint8), unpack(row["lengths"], np.int64)
        self.tokens = unpack(row["tokens"], np.uint32).astype(np.int64)
        words = unpack(row["words"], np.uint64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.before = np.r_[0, self.tokens[:-1]]  # the end token is number 0 and begins each text too
        self.before[self.starts] = 0
        pairs, self.pair = np.unique(self.before * len(words) + self.tokens, return_inverse=True)
        first, second = pairs // len(words), pairs % len(words)
        one, none, shift = np.uint64(1), ~np.uint64(1), np.uint64(64 - HASH_BITS)
        keys = np.r_[mix(words) >> shift | one, mix(mix(words[first]) + words[second] * np.uint64(0x9E3779B97F4A7C15)) >> shift & none]
        self.order = np.argsort(keys)
        self.keys, self.n_words = keys[self.order], len(words)

    def counts(self, role: int) -> np.ndarray:
        """Occurrences of each key in the documents of a role."""
        own = np.repeat(self.roles, self.lengths) == role
        n = np.r_[np.bincount(self.tokens[own], minlength=self.n_words), np.bincount(self.pair[own], minlength=len(self.keys) - self.n_words)]
        return n[self.order]

    def spread(self, answer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of each token, of its predecessor and of the pair, from counts in key order."""
        n = np.empty(len(answer), dtype=np.int64)
        n[self.order] = answer
        return n[self.tokens], n[self.before], n[self.n_words:][self.pair]


def _asker(buckets: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row)
                n = b.counts(EVENTS if row["kind"] else FIT).astype(np.uint32)
                ends = bucket_bounds(b.keys, buckets, HASH_BITS)
                used = np.flatnonzero(np.diff(ends))
                cut = [slice(ends[i], ends[i + 1]) for i in used]
                yield pa.RecordBatch.from_arrays([
                    pa.array(used, pa.int32()), pa.array([row["block"]] * len(used), pa.int64()), pa.array([row["kind"]] * len(used), pa.int32()),
                    pa.array([pack_sorted(b.keys[c]) for c in cut], pa.binary()), pa.array([pack(n[c]) for c in cut], pa.binary()),
                ], ["bucket", "block", "kind", "keys", "n"])
    return run


def _answer(table: pa.Table) -> pa.Table:
    """Sum the counts of one bucket and answer every block; one more row has the bucket's totals."""
    keys = [unpack_sorted(k) for k in table["keys"].to_pylist()]
    kinds = table["kind"].to_pylist()
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    ends = np.cumsum([0] + [len(k) for k in keys])
    fit, both = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
    for i, (kind, cell) in enumerate(zip(kinds, table["n"].to_pylist())):
        n, own = unpack(cell, np.uint32), at[ends[i]:ends[i + 1]]  # the keys of a block are distinct
        both[own] += n
        if not kind:
            fit[own] += n
    words = (every & np.uint64(1)).astype(bool)
    totals = [int(both[words].sum()), int((both[words] > 0).sum()), int(fit[words].sum()), int((fit[words] > 0).sum())]
    none, size = [None], len(keys)
    told = [pack(both[at[ends[i]:ends[i + 1]]].astype(np.uint32)) for i in range(size)]
    told_fit = [pack(fit[at[ends[i]:ends[i + 1]]].astype(np.uint32)) if kinds[i] else None for i in range(size)]
    return pa.table({
        "block": pa.array(table["block"].to_pylist() + none, pa.int64()), "kind": pa.array(kinds + none, pa.int32()),
        "bucket": pa.array(table["bucket"].to_pylist() + none, pa.int32()),
        "fit": pa.array(told_fit + none, pa.binary()), "n": pa.array(told + none, pa.binary()),
        "totals": pa.array([None] * size + [totals], pa.list_(pa.int64()))})


def _answers(right: pa.Table, column: str) -> np.ndarray:
    """Counts for a block in key order."""
    rows = sorted(right.select(["bucket", column]).to_pylist(), key=lambda r: r["bucket"])
    return np.concatenate([unpack(r[column], np.uint32) for r in rows]).astype(np.int64)


def _context(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(n + 1.0)).astype(np.int64), CONTEXTS - 1)


def _frequencies(tokens, before, pairs, n: int) -> tuple[np.ndarray, np.ndarray]:
    return tokens / max(n, 1), np.where(before > 0, pairs / np.maximum(before, 1), 0.0)


def _event_classes(n_fit: int):
    """Sums of the deleted events of one block by class."""
    def classes(f):
        return np.where(f > 0, np.clip(CLASSES - 1 + np.floor(2 * np.log2(np.maximum(f, 1e-300))), 0, CLASSES - 1), CLASSES).astype(np.int64)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["context", "one", "two", "n", "sum_one", "sum_two"]
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.float64() if c.startswith("sum") else pa.int64()) for c in names})
        b = _Block(left.to_pylist()[0])
        t, c, p = b.spread(_answers(right, "fit"))
        one, two = _frequencies(t, c, p, n_fit)
        key = (_context(c) * (CLASSES + 1) + classes(one)) * (CLASSES + 1) + classes(two)
        every, at = np.unique(key, return_inverse=True)
        columns = [every // (CLASSES + 1) ** 2, every // (CLASSES + 1) % (CLASSES + 1), every % (CLASSES + 1), np.bincount(at), np.bincount(at, one), np.bincount(at, two)]
        return pa.table({c: pa.array(x) for c, x in zip(names, columns)})
    return run


def learn_weights(context, n, one, two, uniform: float, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (uniform, frequency, conditional) per context bucket by expectation-maximisation.

    Arguments are the classes of held-out events with their counts and mean
    estimates.  A bucket without events takes the weights of the one below.
    """
    weights = np.full((CONTEXTS, 3), 1 / 3)
    last = weights[0]
    for c in range(CONTEXTS):
        own = context == c
        if own.any():
            w = np.full(3, 1 / 3)
            f, k = np.stack([np.full(own.sum(), uniform), one[own], two[own]]), n[own]
            for _ in range(rounds):
                share = w[:, None] * f
                share /= np.maximum(share.sum(axis=0), 1e-300)
                w = (share * k).sum(axis=1) / k.sum()
            last = w
        weights[c] = last
    weights = np.maximum(weights, LEAST_WEIGHT)
    weights[0, 2] = 0.0  # an unseen predecessor has no pairs
    return weights / weights.sum(axis=1, keepdims=True)


def _scorer(weights: np.ndarray, n: int, v: int, id_type: pa.DataType):
    names = ["doc_id", "role", "n_tokens", "n_known", "base_score", "score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(names, [id_type, pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()])})
        row = left.to_pylist()[0]
        b = _Block(row)
        t, c, p = b.spread(_answers(right, "n"))
        base = np.log10((t + 1) / (n + (v + 1)))
        one, two = _frequencies(t, c, p, n)
        w = weights[_context(c)]
        score = np.log10(w[:, 0] / (v + 1) + w[:, 1] * one + w[:, 2] * two) if n else np.zeros(len(t))
        per_doc = lambda x: np.add.reduceat(x, b.starts)
        return pa.table({
            "doc_id": pa.array(row["ids"], id_type), "role": pa.array(b.roles, pa.int32()), "n_tokens": pa.array(b.lengths),
            "n_known": pa.array(per_doc((t > 0).astype(np.int64))), "base_score": pa.array(per_doc(base)), "score": pa.array(per_doc(score))})
    return run


def score_texts(docs: DataFrame, role, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, role, n_tokens, n_known, train_tokens, base_score, score) of every text.

    ``role`` is a column: 0 counts, 1 events for the weights, 2 not learned from.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), role.cast("int").alias("role"))
    id_sql = dict(rows.dtypes)["doc_id"]
    blocks = persisted(rows.mapInArrow(_blocks, BLOCKS.format(id=id_sql)))
    n_tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    parts = parts_for(spark, n_tokens, TOKENS_PER_BUCKET * BUCKETS_PER_TASK)
    buckets = parts * BUCKETS_PER_TASK
    asked = blocks.mapInArrow(_asker(buckets), "bucket int, block bigint, kind int, keys binary, n binary")
    answers = persisted(asked.repartition(parts, "bucket").groupBy("bucket").applyInArrow(
        _answer, "block bigint, kind int, bucket int, fit binary, n binary, totals array<bigint>"))
    totals = answers.agg(*[F.sum(F.get("totals", F.lit(i))) for i in range(4)]).first()
    n, v, n_fit, v_fit = (int(x or 0) for x in totals)
    told = answers.where("block IS NOT NULL")

    def together(left: DataFrame, right: DataFrame, run, schema: str) -> DataFrame:
        return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(run, schema)

    events = together(blocks.where("kind = 1"), told.where("kind = 1").select("block", "bucket", "fit"), _event_classes(n_fit),
                      "context bigint, one bigint, two bigint, n bigint, sum_one double, sum_two double")
    table = events.groupBy("context", "one", "two").agg(F.sum("n").alias("n"), F.sum("sum_one").alias("sum_one"), F.sum("sum_two").alias("sum_two")).toPandas()
    k = table["n"].to_numpy(dtype=float)
    weights = learn_weights(table["context"].to_numpy(), k, table["sum_one"].to_numpy() / k, table["sum_two"].to_numpy() / k, 1 / (v_fit + 1))
    out = together(blocks, told.select("block", "bucket", "n"), _scorer(weights, n, v, pa.array([], blocks_id(rows)).type),
                   f"doc_id {id_sql}, role int, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(n).cast("long"))


def blocks_id(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["doc_id"].dataType)


def op1(docs: DataFrame) -> DataFrame:
    held = id_class("doc_id", 7) == HELD_OUT
    deleted = F.coalesce(F.floor(F.crc32(F.col("doc_id").cast("string")) / 7) % DELETED == 0, F.lit(False))
    role = F.when(held, TEST).when(deleted, EVENTS).otherwise(FIT)
    return score_texts(docs, role).select(
        "doc_id", (F.col("role") == TEST).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
