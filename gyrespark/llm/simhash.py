"""Near-duplicate groups by SimHash fingerprints and pigeonring filtering.

A fingerprint of 64 bits is a ring of 16 segments.  If two of them differ in at
most 3 bits, some segment starts a chain in which every run of l segments has at
most floor(3 l / 16) differences.  So the first 5 segments (20 bits) are equal,
and of the next 20 bits one half is equal too, as they hold one difference at
most.  Each fingerprint is filed under these 30 bits for every start and half;
pairs that meet are pruned by the budgets of the longer chains before the full
distance decides.

Cases: a null text counts as empty; texts without words share the fingerprint
zero, which is linked like any other.  Equal fingerprints are one node whatever
the number of rows.  A null id never names a component; a component of null ids
only has a null id.  Repeated rows repeat their result; an empty table gives an
empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrespark.llm.common import parts_for, per_batch, persisted, texts
from gyrespark.llm.components import connected

SEED = 42
SHINGLE = 3
MAX_BITS = 3
SEGMENT = 4                      # bits
SEGMENTS = 64 // SEGMENT
# last chain length for each number of differences it may hold, as bits
BUDGETS = [(SEGMENT * (((d + 1) * SEGMENTS - 1) // MAX_BITS), d) for d in range(MAX_BITS)] + [(64, MAX_BITS)]
SMALL_RUN = 16


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles of a UTF-8 text, as a signed 64-bit number."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, seed) for g in grams], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 15):
        part = h[i:i + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of a frame (doc_id, text); columns after these two go along."""
    more = [(c, t) for c, t in docs.dtypes if c not in ("doc_id", "text")]
    id_type = dict(docs.dtypes)["doc_id"]

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        raw = pc.cast(part.column(1), pa.binary()).to_pylist()
        prints = pa.array([fingerprint(t, shingle, seed) for t in raw], pa.int64())
        return pa.RecordBatch.from_arrays([part.column(0), prints, *part.columns[2:]], ["doc_id", "fp", *(c for c, _ in more)])

    return per_batch(docs, ", ".join([f"doc_id {id_type}, fp bigint", *(f"{c} {t}" for c, t in more)]), kernel)


def _rotate(x: np.ndarray, bits) -> np.ndarray:
    bits = np.asarray(bits, dtype=np.uint64)
    return (x << bits) | (x >> ((np.uint64(64) - bits) & np.uint64(63)))


def ring_keys(fp: np.ndarray) -> np.ndarray:
    """Keys (start, half, 30 bits) of fingerprints: an array (n, 32)."""
    fp = fp.view(np.uint64)
    exact, loose = BUDGETS[0][0], BUDGETS[1][0]
    half = (loose - exact) // 2
    out = np.empty((len(fp), 2 * SEGMENTS), dtype=np.int64)
    for start in range(SEGMENTS):
        turned = _rotate(fp, SEGMENT * start)
        head = turned >> np.uint64(64 - exact)
        tail = turned >> np.uint64(64 - loose)
        upper, lower = (tail >> np.uint64(loose - exact - half)) & np.uint64((1 << half) - 1), tail & np.uint64((1 << (loose - exact - half)) - 1)
        for side, bits in ((0, upper), (1, lower)):
            out[:, 2 * start + side] = (np.uint64((2 * start + side) << 40) | (head << np.uint64(12)) | bits).view(np.int64)
    return out


def _close(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which pairs keep all chain budgets from their key's start, the last being the full distance."""
    turned = _rotate(a.view(np.uint64) ^ b.view(np.uint64), (key >> 41) * SEGMENT)
    keep = np.arange(len(a))
    for bits, most in BUDGETS:
        keep = keep[np.bitwise_count(turned[keep] >> np.uint64(64 - bits)) <= most]
    return keep


def _links_of_runs(key: np.ndarray, fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join all close fingerprints with an equal key; ``key`` is sorted."""
    found = []
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    small = np.repeat(size <= SMALL_RUN, size)
    k, f = key[small], fp[small]
    for step in range(1, SMALL_RUN):
        at = np.flatnonzero(k[step:] == k[:-step]) if len(k) > step else np.empty(0, int)
        if not len(at):
            break
        at = at[_close(f[at], f[at + step], k[at])]
        found.append((f[at], f[at + step]))
    for s, n in zip(first[size > SMALL_RUN], size[size > SMALL_RUN]):
        # a large run: search from found ones among those not yet reached, so each is linked once
        rest, k0 = fp[s:s + n], key[s:s + 1]
        while len(rest):
            todo, rest = [rest[:1]], rest[1:]
            while todo and len(rest):
                c = np.broadcast_to(todo.pop(), rest.shape)
                near = _close(c, rest, np.broadcast_to(k0, rest.shape))
                if len(near):
                    found.append((c[near], rest[near]))
                    todo += [rest[i:i + 1] for i in near]
                    rest = np.delete(rest, near)
    return found


def _links(batches):
    key = fp = np.empty(0, dtype=np.int64)

    def out(k, f):
        pairs = _links_of_runs(k, f) if len(k) > 1 else []
        if pairs:
            a, b = (np.concatenate(x) for x in zip(*pairs))
            pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.concatenate([key, batch.column(0).to_numpy()])
        fp = np.concatenate([fp, batch.column(1).to_numpy()])
        cut = int(np.searchsorted(key, key[-1]))  # the last run may go on
        yield from out(key[:cut], fp[:cut])
        key, fp = key[cut:], fp[cut:]
    yield from out(key, fp)


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that join all within 3 bits."""
    def keys(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for i in range(0, len(fp), 4096):
                part = fp[i:i + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(ring_keys(part).ravel()), pa.array(np.repeat(part, 2 * SEGMENTS))], ["key", "fp"])

    spark = prints.sparkSession
    parts = parts_for(spark, prints.count() * 2 * SEGMENTS, 4_000_000)
    dealt = prints.select("fp").mapInArrow(keys, "key bigint, fp bigint").repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_links, "a bigint, b bigint").distinct()


def _roots(prints: DataFrame) -> DataFrame:
    """(fp, root) of every distinct fingerprint of ``prints``; one without links is its own root."""
    group = connected(links(prints)).withColumnRenamed("node", "fp")
    return prints.select("fp").join(group, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): fingerprint and smallest id reachable over links of 3 bits or fewer."""
    marked = persisted(fingerprints(texts(docs, id_col, text_col)))
    prints = persisted(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    group = connected(links(prints)).withColumnRenamed("node", "fp")
    linked = group.join(prints, "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "root").select("fp", "component_id")
    named = persisted(prints.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group: the smallest id, nulls last, then the smallest hash of the text.

    Rows are told apart by id and text, so rows of one id, or without an id, stay
    if their texts are in different groups; of equal rows one stays.  Other columns
    pass through under any name.
    """
    text = F.coalesce("text", F.lit(""))
    hashes = {"_h": F.xxhash64(text), "_g": F.xxhash64(F.lit(1), text)}  # 128 bits
    marked = fingerprints(texts(docs).withColumns(hashes))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h", "_g")
    prints = persisted(marked.groupBy("fp").agg(F.min(row).alias("least")))
    least = prints.join(_roots(prints), "fp").groupBy("root").agg(F.min("least").alias("k"))
    kept = least.select(F.col("k.doc_id").alias("_kept"), F.col("k._h").alias("_kh"), F.col("k._g").alias("_kg"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*own).alias("_row"), F.col("doc_id").alias("_id"), *[h.alias(name) for name, h in hashes.items()])
    same = rows["_id"].eqNullSafe(kept["_kept"]) & (rows["_h"] == kept["_kh"]) & (rows["_g"] == kept["_kg"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["_id", "_h", "_g"]).select("_row.*")


def op8(docs: DataFrame) -> DataFrame:
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
