"""Jaccard join of word n-gram sets over prefixes of token combinations.

A set of n shingles can miss at most ``n - ceil(t n)`` of them in a partner of
similarity t, so the first few in a fixed global order (rare before frequent) must
hold something in common.  Tokens fall into classes by document frequency: class
k (k = 1 for rare ones) is indexed by combinations of k tokens, and the prefix is
extended until its classes, each less k - 1 tokens, cover one token more than may
be missed; two similar sets then share a whole combination.  Frequent classes are
divided by hash so that combinations stay few, by a rule that depends on the size
band only; each set is filed under its own band and the one below.

1. Blocks of text exchange half of their tokens (those with an even hash) with
   hash buckets.  A document in which more tokens occur nowhere else than may be
   missed has no partner and needs no index.
2. Of the rest, each distinct set is kept once.  Its tokens' frequencies come from
   a second exchange, its prefix gives the signatures.
3. Sets that share signatures form pools, and a pool is verified as a whole: found
   sets are compared with those not yet reached, by size, by a parity bitmap
   (which only rejects) and then exactly.  No pairs of a signature are written out.
   A pool above ``POOL`` tokens is verified in random blocks; then all sets outside
   its largest class are compared with all sets of the pool, block by block.

Links join sets, not rows, so copies cost nothing.  Components come from random
contraction, or from one task where there are at most ``FEW_LINKS`` links.

Cases.  A null or blank text has the empty set and is its own component.  With
fewer words than a shingle the whole sequence is the only token.  Texts of any
length are handled whole; a single text bounds a task's memory.  Null ids take
part, but a component is named by its smallest id that is not null.  Repeated rows
repeat their result.  Ties do not arise.  Sets are told apart by 128 bits, tokens
by 64.  Other columns are dropped at once.  An empty table gives an empty one.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrespark.llm.blobs import bucket_bounds, mix, pack, pack_sorted, unpack, unpack_sorted
from gyrespark.llm.common import give_back, parts_for, persisted, slices, texts, total_bytes
from gyrespark.llm.components import connected

SHINGLE = 4
PERCENT = 85
MANY = 65_535            # owner of a token that several documents of a block have
BUCKET_TOKENS = 2_000_000
BLOCK_TOKENS = 500_000
POOL = 2_000_000         # tokens verified by one task at once
FEW_LINKS = 1_000_000    # links (16 MB) that one task joins; beyond them, rounds of joins
ROUNDS = 3               # random blockings of a larger pool
CLASS_BITS, MOST = 5, 4  # a class spans 5 doublings of the frequency; classes end at 4
COMBINED_FROM = 60       # smallest size with combinations
TOGETHER = 4             # covered tokens of a frequent class that share a division
BITMAP = 1_024
SALT = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a UTF-8 text's word shingles."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(w) - shingle + 1
    h = mix(w[:n])
    for i in range(1, shingle):
        h = mix(h * SALT + w[i:n + i])
    return np.unique(h)


def allowed(n):
    """Tokens that a set of n may miss in a partner."""
    return n - (PERCENT * n + 99) // 100


def similar(common, a, b):
    return 100 * common >= PERCENT * (a + b - common)


def set_key(h: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    a, b = mix(h), mix(h ^ SALT)
    return int(a.sum(dtype=np.uint64).view(np.int64)), int(b.sum(dtype=np.uint64).view(np.int64))


def key_bits(tokens: float, spare: int) -> int:
    return int(min(64, max(24, np.ceil(np.log2(max(tokens, 2))) + spare)))


def measured(frame: DataFrame) -> DataFrame:
    """Persist a frame and forget the sizes its plan was estimated at.

    A checkpoint keeps them, and every join multiplies them; after two chains of
    contraction rounds they are numbers of many kilobytes each.
    """
    frame, spark = persisted(frame), frame.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(frame._jdf.toJavaRDD(), frame._jdf.schema()), spark)


def _roots(batches):
    """(node, root) of a link table that fits one task: hook to smaller roots, then jump, until nothing changes."""
    pairs = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if not pairs:
        return
    a, b = (np.concatenate(x) for x in zip(*pairs))
    nodes, index = np.unique(np.r_[a, b], return_inverse=True)
    a, b, root = index[:len(a)], index[len(a):], np.arange(len(nodes))
    while (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != root[root]).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def grouped(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(node, root) as of :func:`connected`; up to ``few`` distinct links are joined by one task, more by contraction rounds."""
    links = measured(links.where("a <> b").distinct())
    if links.count() > few:
        return measured(connected(links))
    return measured(links.coalesce(1).mapInArrow(_roots, "node bigint, root bigint"))


# ---- 1: documents that may have a partner

def _ask(bits: int, buckets: int, id_type: str):
    """Kernel: a row for every document, and the tokens of every block dealt to buckets."""
    def run(batches):
        number = 0
        for part in slices(batches, 1):
            number += 1
            hashes = [shingle_hashes(t) for t in pc.cast(part.column(1), pa.binary()).to_pylist()]
            keys = [set_key(h) for h in hashes]
            n = len(hashes)
            none = lambda kind, m=n: pa.nulls(m, kind)
            names = ["slice", "ord", "id", "th", "s1", "s2", "n", "bucket", "keys", "owners"]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, number, np.int64)), pa.array(np.arange(n, dtype=np.int32)), part.column(0), part.column(2),
                pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([len(h) for h in hashes], pa.int64()),
                none(pa.int32()), none(pa.binary()), none(pa.binary())], names)
            half = [h[h & np.uint64(1) == 0] >> np.uint64(64 - bits) for h in hashes]
            token = np.concatenate(half)
            owner = np.repeat(np.arange(n), [len(h) for h in half])
            token, first, count = np.unique(token, return_index=True, return_counts=True)
            owner = np.where(count > 1, MANY, owner[first]).astype(np.uint16)
            bound = bucket_bounds(token, buckets, bits)
            cells = [(b, pack_sorted(token[s:e]), pack(owner[s:e])) for b, (s, e) in enumerate(zip(bound[:-1], bound[1:])) if e > s]
            m = len(cells)
            if not m:
                continue
            none = lambda kind, m=m: pa.nulls(m, kind)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(m, number, np.int64)), none(pa.int32()), none(part.column(0).type), none(pa.int64()), none(pa.int64()),
                none(pa.int64()), none(pa.int64()), pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.binary()),
                pa.array([c[2] for c in cells], pa.binary())], names)
        give_back()
    return run, f"slice bigint, ord int, id {id_type}, th bigint, s1 bigint, s2 bigint, n bigint, bucket int, keys binary, owners binary"


def _alone(table: pa.Table) -> pa.Table:
    """For a bucket: how many tokens of each document occur nowhere else, by block."""
    keys = [unpack_sorted(c) for c in table.column("keys").to_pylist()]
    owners = [unpack(c, np.uint16) for c in table.column("owners").to_pylist()]
    _, inverse, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    single, at, out = count[inverse] == 1, 0, []
    for k, o in zip(keys, owners):
        own = o[single[at:at + len(k)] & (o != MANY)]
        at += len(k)
        out.append(pack(np.bincount(own).astype(np.uint32)))
    give_back()
    return pa.table({"block": table.column("block"), "alone": pa.array(out, pa.binary())})


def _sum_alone(table: pa.Table) -> pa.Table:
    arrays = [unpack(c, np.uint32) for c in table.column("alone").to_pylist()]
    total = np.zeros(max(map(len, arrays)), dtype=np.int64)
    for a in arrays:
        total[:len(a)] += a
    block = table.column("block")[0].as_py()
    return pa.table({"block": pa.array(np.full(len(total), block, np.int64)), "ord": pa.array(np.arange(len(total), dtype=np.int32)),
                     "alone": pa.array(total)})


def with_candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marks (id, th, s1, s2, n) of all documents of a frame (doc_id, text), and those of them that may have a partner in another set."""
    spark, id_type = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    size = total_bytes(docs)
    tokens = size / 6
    buckets = parts_for(spark, tokens / 2, BUCKET_TOKENS)
    kernel, schema = _ask(key_bits(tokens, 4), buckets, id_type)
    asked = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(kernel, schema)
    asked = persisted(asked.withColumn("block", F.shiftleft(F.spark_partition_id().cast("long"), 32) + F.col("slice")).drop("slice"))
    marks = asked.where("bucket IS NULL").select("block", "ord", "id", "th", "s1", "s2", "n")
    cells = asked.where("bucket IS NOT NULL").select("bucket", "block", "keys", "owners").repartition(buckets, "bucket")
    alone = cells.groupBy("bucket").applyInArrow(_alone, "block bigint, alone binary")
    alone = alone.groupBy("block").applyInArrow(_sum_alone, "block bigint, ord int, alone bigint")
    limit = F.col("n") - F.expr(f"({PERCENT} * n + 99) div 100")
    open_ones = marks.join(alone, ["block", "ord"], "left").where((F.col("n") > 5) & (F.coalesce("alone", F.lit(0)) <= limit))
    return marks.drop("block", "ord"), open_ones.drop("block", "ord", "alone")


def distinct_sets(docs: DataFrame, open_ones: DataFrame) -> DataFrame:
    """(node, s1, s2, n, tokens) of each distinct set among the candidates."""
    chosen = open_ones.groupBy("s1", "s2").agg(F.min(F.struct("id", "th")).alias("r")).select(F.col("r.id").alias("_id"), F.col("r.th").alias("_th"))
    rows = docs.withColumn("th", F.xxhash64("text"))
    rows = rows.join(chosen, rows["th"].eqNullSafe(chosen["_th"]) & rows["doc_id"].eqNullSafe(chosen["_id"]), "left_semi").select("th", "text")

    def kernel(batches):
        for part in slices(batches, 1):
            hashes = [shingle_hashes(t) for t in pc.cast(part.column(1), pa.binary()).to_pylist()]
            keys = [set_key(h) for h in hashes]
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([len(h) for h in hashes], pa.int64()),
                pa.array([h.tobytes() for h in hashes], pa.binary())], ["s1", "s2", "n", "tokens"])
        give_back()
    sets = rows.mapInArrow(kernel, "s1 bigint, s2 bigint, n bigint, tokens binary").dropDuplicates(["s1", "s2"])
    return persisted(sets.withColumn("node", F.monotonically_increasing_id()))


# ---- 2: signatures

def _packed(table: pa.Table) -> pa.Table:
    tokens = b"".join(table.column("tokens").to_pylist())
    return pa.table({"block": table.column("block")[:1], "nodes": pa.array([table.column("node").to_pylist()], pa.list_(pa.int64())),
                     "sizes": pa.array([table.column("n").to_pylist()], pa.list_(pa.int64())), "tokens": pa.array([tokens], pa.binary())})


def _block_keys(tokens: bytes, bits: int):
    return np.unique(np.frombuffer(tokens, dtype=np.uint64) >> np.uint64(64 - bits), return_counts=True, return_inverse=True)


def _ask_frequency(bits: int, buckets: int):
    def run(batches):
        for batch in batches:
            for block, tokens in zip(batch.column("block").to_pylist(), batch.column("tokens").to_pylist()):
                keys, _, count = _block_keys(tokens, bits)
                bound = bucket_bounds(keys, buckets, bits)
                cells = [(b, pack_sorted(keys[s:e]), pack(np.minimum(count[s:e], MANY).astype(np.uint16)))
                         for b, (s, e) in enumerate(zip(bound[:-1], bound[1:])) if e > s]
                yield pa.RecordBatch.from_arrays([
                    pa.array([block] * len(cells), pa.int64()), pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.binary()),
                    pa.array([c[2] for c in cells], pa.binary())], ["block", "bucket", "keys", "counts"])
    return run


def _levels(table: pa.Table) -> pa.Table:
    """For a bucket: the doublings of the frequency of every block's tokens."""
    keys = [unpack_sorted(c) for c in table.column("keys").to_pylist()]
    counts = np.concatenate([unpack(c, np.uint16) for c in table.column("counts").to_pylist()])
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    level = np.ceil(np.log2(np.bincount(inverse, weights=counts)))[inverse].astype(np.uint8)
    ends = np.cumsum([len(k) for k in keys])
    cells = [pack(level[e - len(k):e]) for k, e in zip(keys, ends)]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "levels": pa.array(cells, pa.binary())})


def size_bands(largest: int) -> np.ndarray:
    """First sizes of bands; partners lie in the same band or in adjacent ones."""
    edges = [1, 2]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, (edges[-1] - 1) * 100 // PERCENT + 1))
    return np.array(edges, dtype=np.int64)


def class_of(level: np.ndarray) -> np.ndarray:
    """Tokens in a combination: 0 for tokens of one set, which need no index."""
    return np.where(level == 0, 0, np.minimum(1 + (np.maximum(level, 1).astype(np.int64) - 1) // CLASS_BITS, MOST))


def signatures(tokens: np.ndarray, level: np.ndarray, band: int, edges: np.ndarray) -> np.ndarray:
    """Signatures of a set (sorted tokens and their levels) in one band."""
    order = np.lexsort((tokens, level))
    token, k = tokens[order], class_of(level[order])
    need = int(allowed(len(token))) + 1
    if edges[band] < COMBINED_FROM:
        k = np.minimum(k, 1)
    division = np.zeros(len(token), dtype=np.int64)
    often = np.flatnonzero(k > 1)
    covers = np.ones(len(token), dtype=np.int64)
    if len(often):
        parts = max((int(allowed(edges[band + 2] - 1)) + 1) // TOGETHER, 1)
        division[often] = ((mix(token[often]) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64) * (MOST + 1) + k[often]
        by = often[np.argsort(division[often], kind="stable")]
        d = division[by]
        first = np.r_[True, d[1:] != d[:-1]]
        rank = np.arange(len(by)) - np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
        covers[by] = rank >= k[by] - 1
    end = int(np.searchsorted(np.cumsum(covers), need)) + 1
    token, k, division = token[:end], k[:end], division[:end]
    scheme = mix(np.array([band + 1], dtype=np.uint64) * SALT + np.arange(MOST + 1, dtype=np.uint64))
    found = [mix(mix(token[k == 1]) + scheme[1])]
    often = np.flatnonzero(k > 1)
    if len(often):
        hashed = mix(token)
        for d in np.unique(division[often]):
            own = often[division[often] == d]
            size = int(k[own[0]])
            if len(own) >= size:
                picks = np.array(list(combinations(own.tolist(), size)))
                found.append(mix(hashed[picks].sum(axis=1, dtype=np.uint64) + scheme[size]))
    return np.concatenate(found)


def _sign(bits: int):
    """Kernel of a block with its tokens' levels: (sig, node)."""
    def run(sets: pa.Table, answers: pa.Table) -> pa.Table:
        sig, nodes_out = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        if sets.num_rows:
            row = sets.to_pylist()[0]
            _, inverse, _ = _block_keys(row["tokens"], bits)
            answers = answers.sort_by("bucket")
            level = np.concatenate([unpack(c, np.uint8) for c in answers.column("levels").to_pylist()])[inverse]
            tokens = np.frombuffer(row["tokens"], dtype=np.uint64)
            edges, at = size_bands(2 * max(row["sizes"]) + 8), 0
            for node, n in zip(row["nodes"], row["sizes"]):
                own = int(np.searchsorted(edges, n, side="right")) - 1
                for band in {own, max(own - 1, 0)}:
                    s = signatures(tokens[at:at + n], level[at:at + n], band, edges)
                    sig.append(s)
                    nodes_out.append(np.full(len(s), node, np.int64))
                at += n
        return pa.table({"sig": pa.array(np.concatenate(sig).view(np.int64)), "node": pa.array(np.concatenate(nodes_out))})
    return run


def signature_rows(sets: DataFrame) -> DataFrame:
    spark = sets.sparkSession
    total = sets.agg(F.sum("n")).first()[0] or 0
    blocks, buckets, bits = parts_for(spark, total, BLOCK_TOKENS), parts_for(spark, total, BUCKET_TOKENS), key_bits(total, 6)
    dealt = sets.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("long"))
    packed = persisted(dealt.repartition(blocks, "block").groupBy("block").applyInArrow(
        _packed, "block bigint, nodes array<bigint>, sizes array<bigint>, tokens binary"))
    cells = packed.select("block", "tokens").mapInArrow(_ask_frequency(bits, buckets), "block bigint, bucket int, keys binary, counts binary")
    levels = cells.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_levels, "block bigint, bucket int, levels binary")
    return packed.groupBy("block").cogroup(levels.groupBy("block")).applyInArrow(_sign(bits), "sig bigint, node bigint")


# ---- 3: verification

class Pool:
    """Sets side by side, for comparing one with many."""

    def __init__(self, tokens: list[np.ndarray]):
        self.tokens = tokens
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.bits = np.stack([parity(t) for t in tokens]) if tokens else np.empty((0, BITMAP // 64), np.uint64)

    def near(self, x: np.ndarray, bits: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Which of the sets ``among`` are similar to ``x``."""
        n, size = len(x), self.size[among]
        fits = (PERCENT * np.maximum(size, n) <= 100 * np.minimum(size, n))
        among, size = among[fits], size[fits]
        apart = np.bitwise_count(self.bits[among] ^ bits).sum(axis=1, dtype=np.int64)
        least = -(-PERCENT * (size + n) // (100 + PERCENT))
        fits = apart <= size + n - 2 * least
        among, size = among[fits], size[fits]
        out = np.zeros(len(among), dtype=bool)
        step, start = 1 << 20, 0
        ends = np.cumsum(size)
        while start < len(among):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + step, side="right")))
            flat = np.concatenate([self.tokens[i] for i in among[start:stop]])
            at = np.minimum(np.searchsorted(x, flat), n - 1)
            common = np.add.reduceat((x[at] == flat).astype(np.int64), np.r_[0, np.cumsum(size[start:stop])[:-1]])
            out[start:stop] = similar(common, n, size[start:stop])
            start = stop
        return among[out]


def parity(tokens: np.ndarray) -> np.ndarray:
    """Bitmap whose bits tell whether an even or odd number of tokens falls on them; it differs in no more bits than sets do in tokens."""
    odd = (np.bincount((mix(tokens) % np.uint64(BITMAP)).astype(np.int64), minlength=BITMAP) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def _tie_all(nodes: np.ndarray, tokens: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join all similar sets of a pool: found ones are compared with those not yet reached."""
    pool, rest, links = Pool(tokens), np.arange(len(nodes)), []
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = pool.near(tokens[x], pool.bits[x], rest)
            if len(near):
                links += [(int(nodes[x]), int(nodes[y])) for y in near]
                todo += near.tolist()
                rest = rest[~np.isin(rest, near, assume_unique=True)]
    return links


def _links_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])


def _verify(batches):
    """Kernel over rows (key, node, tokens) sorted by key."""
    key, nodes, tokens = None, [], []
    for batch in batches:
        for k, node, t in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "tokens"))):
            if k != key:
                if len(nodes) > 1 and (links := _tie_all(np.array(nodes), tokens)):
                    yield _links_batch(links)
                key, nodes, tokens = k, [], []
            nodes.append(node)
            tokens.append(np.frombuffer(t, dtype=np.uint64))
    if len(nodes) > 1 and (links := _tie_all(np.array(nodes), tokens)):
        yield _links_batch(links)
    give_back()


def _verify_asked(batches):
    """Kernel over rows (key, asked, node, label, tokens) sorted by key, asked sets first: links between sets of different labels."""
    key, asked, pool, linked = None, [], None, set()
    for batch in batches:
        links = []
        for k, kind, node, label, t in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "node", "label", "tokens"))):
            if k != key:
                key, asked, pool, linked = k, [], None, set()
            t = np.frombuffer(t, dtype=np.uint64)
            if kind == 0:
                asked.append((node, label, t))
                continue
            if pool is None:
                pool, labels = Pool([a[2] for a in asked]), np.array([a[1] for a in asked])
            others = np.flatnonzero(labels != label)
            for y in pool.near(t, parity(t), others) if len(others) else ():
                if (label, labels[y]) not in linked:
                    linked.add((label, labels[y]))
                    links.append((asked[y][0], node))
        if links:
            yield _links_batch(links)
    give_back()


def links_between(sets: DataFrame, signs: DataFrame, pool: int = POOL) -> DataFrame:
    """Links (a, b) between nodes that join all similar sets."""
    spark = sets.sparkSession
    signs = persisted(signs.distinct())
    lead = signs.groupBy("sig").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    pools = grouped(signs.join(lead, "sig").where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")))
    placed = persisted(sets.select("node", "n", "tokens").join(pools.withColumnRenamed("root", "pool"), "node"))
    weight = persisted(placed.groupBy("pool").agg(F.sum("n").alias("weight")))
    parts = parts_for(spark, placed.agg(F.sum("n")).first()[0] or 0, BLOCK_TOKENS)
    large = weight.where(F.col("weight") > pool)
    if large.isEmpty():
        small, big = placed, None
    else:
        small, big = placed.join(large, "pool", "left_anti"), placed.join(large, "pool")

    def verified(keyed):
        return keyed.repartition(parts, "key").sortWithinPartitions("key").select("key", "node", "tokens").mapInArrow(_verify, "a bigint, b bigint")

    links = verified(small.withColumn("key", F.struct("pool", F.lit(0).alias("turn"), F.lit(0).cast("long").alias("block"))))
    if big is None:
        return links
    share = F.ceil(2 * F.col("weight") / pool)
    blocks = [big.withColumn("key", F.struct("pool", F.lit(turn).alias("turn"), F.pmod(F.xxhash64("node", F.lit(turn)), share).alias("block")))
              for turn in range(1, ROUNDS + 1)]
    first = blocks[0]
    for b in blocks[1:]:
        first = first.unionByName(b)
    links = persisted(links.unionByName(verified(first)))
    label = grouped(links).withColumnRenamed("root", "label")
    big = persisted(big.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")))
    main = big.groupBy("pool", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("pool").agg(F.max_by("label", F.struct("m", "label")).alias("main"))
    big = big.join(main, "pool")
    asked = persisted(big.where("label <> main"))
    load = asked.groupBy("pool").agg(F.ceil(2 * F.sum("n") / pool).alias("asks"))
    spread = F.ceil(F.col("weight") / pool)
    left = asked.join(load, "pool").withColumn("ask", F.pmod(F.xxhash64("node"), F.col("asks"))).withColumn(
        "share", F.explode(F.sequence(F.lit(0).cast("long"), spread - 1))).withColumn("kind", F.lit(0))
    right = big.join(load, "pool").withColumn("share", F.pmod(F.xxhash64("node", F.lit(7)), spread)).withColumn(
        "ask", F.explode(F.sequence(F.lit(0).cast("long"), F.col("asks") - 1))).withColumn("kind", F.lit(1))
    columns = [F.struct("pool", "ask", "share").alias("key"), "kind", "node", "label", "tokens"]
    cells = left.select(columns).unionByName(right.select(columns)).repartition(parts, "key").sortWithinPartitions("key", "kind")
    return links.unionByName(cells.mapInArrow(_verify_asked, "a bigint, b bigint"))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pool: int = POOL) -> DataFrame:
    """(doc_id, n_shingles, component_id): set size and smallest id reachable over links of the documents."""
    docs = texts(docs, id_col, text_col)
    marks, open_ones = with_candidates(docs)
    sets = distinct_sets(docs, open_ones)
    group = grouped(links_between(sets, signature_rows(sets), pool))
    keyed = measured(group.join(sets.select("node", "s1", "s2"), "node").select("s1", "s2", "root"))
    least = persisted(marks.groupBy("s1", "s2").agg(F.min("id").alias("least")))
    linked = least.join(keyed, ["s1", "s2"])
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("s1", "s2", "component_id")
    named = persisted(least.join(named, ["s1", "s2"], "left").select("s1", "s2", F.coalesce("component_id", "least").alias("component_id")))
    own = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return marks.join(named, ["s1", "s2"]).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id"))


def op11(docs: DataFrame) -> DataFrame:
    return jaccard_groups(docs)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM g),
t AS (SELECT doc_id, hash(unnest(s)) AS h FROM g),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON r.a = e.a WHERE r.root < e.b)
SELECT n.doc_id, n.n AS n_shingles, m.component_id FROM n JOIN (SELECT a, min(root) AS component_id FROM r GROUP BY 1) m ON m.a = n.doc_id
"""
