"""Hard negatives by exact integer scores from subset-sum tables (the Four-Russians way).

Components become integers; a candidate is stored as bit planes: for each bit of
its two's complement components, eight dimensions make one byte.  For an anchor,
every group of eight dimensions has a table of the 256 sums of subsets of its
components.  A score is then built from the highest plane down: double what there
is and add the table entries that the plane's bytes name (the sign's plane counts
negative).  Tables of several anchors lie side by side, so one byte looks up the
entries of all of them.

All anchors are scored against all candidates, so the pairs are dealt as a grid:
candidates in as many shares as there are partitions, anchors in blocks of
``ANCHORS``.  A cell streams its candidates past its anchors and keeps the best
few of each anchor; candidates travel once for each block of anchors, which is
little beside the scores they take part in there.  First the positives are found,
then, with their scores as bounds, the negatives.  Anchors grow with the table and
are never broadcast or collected.

Cases.  Rows with a null label or vector, or with a null or non-finite component,
take no part.  Vectors may differ in length: missing last components count as
zero.  A null id is never an anchor and comes last among ties; rows that share an
anchor's id are not its partners.  Repeated rows (id and score alike) fill one
place; anchors repeated with label and vector are one.  Scores are 64-bit
integers; components beyond 2^62 are taken as 2^62, and sums wrap beyond 64 bits.
Other columns are dropped at once.  An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyrespark.llm.common import parts_for, persisted

ANCHORS = 4_096      # anchors of a grid cell
LANES = 64           # anchors whose tables lie side by side
CHUNK = 4_096        # candidates scored at once
POSITIVES, NEGATIVES = 5, 10
SCALE = 256
LOW, HIGH, OF = 30, 90, 100  # a negative's score lies within these hundredths of the positive's
NO_ID = np.iinfo(np.int64).max


def planes_of(x: np.ndarray) -> np.ndarray:
    """Bit planes of integer rows (n, d): bytes (n, planes, groups), the sign's plane last."""
    n, d = x.shape
    groups = max(-(-d // 8), 1)
    wide = np.zeros((n, groups * 8), dtype=np.int64)
    wide[:, :d] = x
    top = max(int(np.where(wide < 0, ~wide, wide).max(initial=0)).bit_length() + 1, 1)
    return np.stack([np.packbits(((wide >> b) & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(top)], axis=1)


def integers_of(planes: np.ndarray) -> np.ndarray:
    """The integer rows behind bit planes."""
    bits = np.unpackbits(planes, axis=2, bitorder="little").astype(np.int64)
    weight = np.int64(1) << np.arange(bits.shape[1], dtype=np.int64)
    weight[-1] = -weight[-1]
    return (bits * weight[None, :, None]).sum(axis=1)


def tables_of(anchors: np.ndarray) -> np.ndarray:
    """Subset sums of anchors (m, 8 g): (g, 256, m)."""
    m, d = anchors.shape
    parts = anchors.reshape(m, d // 8, 8).transpose(1, 2, 0)
    out = np.zeros((d // 8, 256, m), dtype=np.int64)
    for i in range(8):
        out[:, 1 << i:2 << i] = out[:, :1 << i] + parts[:, i:i + 1]
    return out


def scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Scores (n, m) of candidates' planes with the anchors of the tables, by shift and add."""
    n, top, groups = planes.shape
    groups = min(groups, tables.shape[0])
    # the largest absolute sum decides the width of the sums
    reach = int(np.abs(tables).max(initial=0)) * groups << top
    tables = tables.astype(np.int32) if reach < 2**31 else tables
    total = np.zeros((n, tables.shape[2]), dtype=tables.dtype)
    for b in range(top - 1, -1, -1):
        if b < top - 1:
            total += total
        for g in range(groups):
            entries = tables[g].take(planes[:, b, g], axis=0)
            if b == top - 1:
                total -= entries
            else:
                total += entries
    return total


class _Best:
    """The first ``k`` (score descending, id ascending) of many lists, fed in chunks."""

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def floor(self) -> int:
        return int(self.score[-1]) if len(self.score) >= self.k else np.iinfo(np.int64).min

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.r_[self.score, score], np.r_[self.ids, ids]
        order = np.lexsort((i, ~s))
        s, i = s[order], i[order]
        fresh = np.r_[True, (s[1:] != s[:-1]) | (i[1:] != i[:-1])] if len(s) else np.empty(0, bool)
        self.score, self.ids = s[fresh][:self.k], i[fresh][:self.k]


def prepared(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, planes) of the rows that take part; ``planes`` starts with the number of planes."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), x.alias("x"))
    rows = rows.where(F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall(
        "x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))

    def kernel(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                packed = [None] * part.num_rows
                lists = part.column(2)
                length = np.diff(lists.offsets.to_numpy())
                values = np.clip(np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False)), -2.0**62, 2.0**62).astype(np.int64)
                start = np.cumsum(length) - length
                for d in np.unique(length):
                    rows_of = np.flatnonzero(length == d)
                    planes = planes_of(values[start[rows_of][:, None] + np.arange(d)])
                    head = bytes([planes.shape[1]])
                    for r, p in zip(rows_of, planes):
                        packed[r] = head + p.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, pa.binary())], ["id", "label", "planes"])
    return rows.mapInArrow(kernel, "id bigint, label bigint, planes binary")


def _stacked(cells: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Cells of equal shape as arrays: (row numbers, planes)."""
    shapes: dict[tuple[int, int], list[int]] = {}
    for r, c in enumerate(cells):
        shapes.setdefault((c[0], len(c)), []).append(r)
    return [(np.array(rows), np.frombuffer(b"".join(cells[r][1:] for r in rows), dtype=np.uint8).reshape(len(rows), top, -1))
            for (top, _), rows in shapes.items()]


def _kernel(k: int, with_bounds: bool, lanes: int):
    """Kernel over sorted rows (cell, candidate, id, label, planes, anchor, low, high): anchors come first in every cell."""
    def run(batches):
        cell, anchors, ready, held, held_rows = None, [], None, [], 0

        def prepare():
            """Anchors in lanes of one label each for positives, of any label for negatives."""
            if not with_bounds:
                anchors.sort(key=lambda a: a["label"])
            vectors = np.zeros((len(anchors), 0), dtype=np.int64)
            for rows, planes in _stacked([a["planes"] for a in anchors]):
                x = integers_of(planes)
                if x.shape[1] > vectors.shape[1]:
                    vectors = np.pad(vectors, ((0, 0), (0, x.shape[1] - vectors.shape[1])))
                vectors[rows, :x.shape[1]] = x
            label = np.array([a["label"] for a in anchors])
            out, at = [], 0
            while at < len(anchors):
                end = min(at + lanes, len(anchors))
                if not with_bounds:
                    end = min(end, int(np.searchsorted(label, label[at], side="right")))
                best = [[_Best(k) for _ in (a["low"] if with_bounds else [0])] for a in anchors[at:end]]
                out.append((anchors[at:end], tables_of(vectors[at:end]), best))
                at = end
            return out

        def score():
            nonlocal held, held_rows
            if not held:
                return
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, held_rows = [], 0
            ids = rows.column("id").fill_null(NO_ID).to_numpy()
            labels = rows.column("label").to_numpy()
            for which, planes in _stacked(rows.column("planes").to_pylist()):
                for at in range(0, len(which), CHUNK):
                    feed(ids[which[at:at + CHUNK]], labels[which[at:at + CHUNK]], planes[at:at + CHUNK])

        def feed(ids, labels, planes):
            for group, tables, best in ready:
                if not with_bounds:
                    same = np.flatnonzero(labels == group[0]["label"])
                    if not len(same):
                        continue
                    own_ids, own_labels, own = ids[same], labels[same], planes[same]
                else:
                    own_ids, own_labels, own = ids, labels, planes
                table = scores(own, tables)
                for lane, anchor in enumerate(group):
                    s = table[:, lane]
                    other = own_labels != anchor["label"] if with_bounds else own_ids != anchor["id"]
                    if with_bounds:
                        bounds = list(zip(anchor["low"], anchor["high"], best[lane]))
                        reach = (s >= min(max(low, b.floor) for low, _, b in bounds)) & (s <= max(high for _, high, _ in bounds)) & other
                        near = np.flatnonzero(reach)
                        if not len(near):
                            continue
                        sn, idn = s[near].astype(np.int64), own_ids[near]
                        for low, high, b in bounds:
                            take = np.flatnonzero((sn >= max(low, b.floor)) & (sn <= high))
                            if len(take):
                                b.add(sn[take], idn[take])
                    else:
                        take = np.flatnonzero((s >= best[lane][0].floor) & other)
                        if len(take):
                            best[lane][0].add(s[take].astype(np.int64), own_ids[take])

        def result():
            number, of, ids, points = [], [], [], []
            for group, _, best in ready:
                for anchor, lists in zip(group, best):
                    for i, b in enumerate(lists):
                        number += [anchor["anchor"]] * len(b.ids)
                        of += [i] * len(b.ids)
                        ids += [None if x == NO_ID else x for x in b.ids.tolist()]
                        points += b.score.tolist()
            if number:
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(of, pa.int32()), pa.array(ids, pa.int64()),
                                                  pa.array(points, pa.int64())], ["anchor", "nth", "id", "score"])

        for batch in batches:
            cells = batch.column("cell").to_numpy()
            for start, end in _runs(cells):
                part = batch.slice(start, end - start)
                if cell != cells[start]:
                    if cell is not None:
                        if ready is None:
                            ready = prepare()
                        score()
                        yield from result()
                    cell, anchors, ready = cells[start], [], None
                kind = part.column("candidate").to_numpy(zero_copy_only=False)
                first = int(np.searchsorted(kind, 1))
                anchors += part.slice(0, first).to_pylist()
                if first < part.num_rows:
                    if ready is None:
                        ready = prepare()
                    held.append(part.slice(first).select(["id", "label", "planes"]))
                    held_rows += part.num_rows - first
                    if held_rows >= CHUNK:
                        score()
        if cell is not None:
            if ready is None:
                ready = prepare()
            score()
            yield from result()
    return run


def _runs(values: np.ndarray):
    edges = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True]) if len(values) else np.zeros(1, int)
    return zip(edges[:-1], edges[1:])


def best_scores(candidates: DataFrame, anchors: DataFrame, shares: int, blocks: int, k: int, with_bounds: bool, lanes: int = LANES) -> DataFrame:
    """(anchor, nth, id, score): the first ``k`` candidates of every anchor, or of each of its ranges of scores."""
    empty = F.lit(None).cast("array<bigint>")
    bounds = ["low", "high"] if with_bounds else [empty.alias("low"), empty.alias("high")]
    share, block = F.pmod(F.xxhash64("id", "planes"), F.lit(shares)), F.pmod(F.col("anchor"), F.lit(blocks))
    left = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), block.alias("block"), F.lit(0).alias("candidate"),
                          "id", "label", "planes", "anchor", *bounds)
    right = candidates.select(share.alias("share"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("candidate"),
                              "id", "label", "planes", F.lit(None).cast("bigint").alias("anchor"), empty.alias("low"), empty.alias("high"))
    cell = (F.col("share") * blocks + F.col("block")).cast("int")
    grid = left.unionByName(right).withColumn("cell", cell).drop("share", "block")
    dealt = grid.repartitionById(shares * blocks, F.col("cell")).sortWithinPartitions("cell", "candidate")
    partial = dealt.mapInArrow(_kernel(k, with_bounds, lanes), "anchor bigint, nth int, id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("anchor", "nth").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    return partial.distinct().withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor_rows, positives: int = POSITIVES, negatives: int = NEGATIVES, share_rows: int = 65_536,
                   block: int = ANCHORS) -> DataFrame:
    """Hard negatives of the anchors among prepared rows (id, label, planes).

    ``anchor_rows`` is the condition that makes a row an anchor.  Returns
    (anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score).
    """
    spark = rows.sparkSession
    rows = persisted(rows)
    anchors = persisted(rows.where(anchor_rows).distinct().withColumn("anchor", F.monotonically_increasing_id()))
    shares = parts_for(spark, rows.count(), share_rows)
    blocks = max(-(-anchors.count() // block), 1)
    chosen = persisted(best_scores(rows, anchors, shares, blocks, positives, False).withColumnsRenamed({"id": "positive_id", "score": "positive_score"}))
    low = F.when(F.col("positive_score") >= 0, F.expr(f"({LOW} * positive_score + {OF - 1}) div {OF}")).otherwise(1)
    high = F.when(F.col("positive_score") >= 0, F.expr(f"({HIGH} * positive_score) div {OF}")).otherwise(0)
    bounds = chosen.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", low.alias("low"), high.alias("high")))).alias("b"))
    limited = anchors.join(bounds, "anchor").select("id", "label", "planes", "anchor", F.col("b.low").alias("low"), F.col("b.high").alias("high"))
    found = best_scores(rows, limited, shares, blocks, negatives, True).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    chosen = chosen.select("anchor", (F.col("rank") - 1).alias("nth"), "positive_id", "positive_score")
    return found.join(chosen, ["anchor", "nth"]).join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor").select(
        "anchor_id", "positive_id", (F.col("nth") + 1).alias("positive_rank"), F.col("rank").cast("int").alias("rank"), "negative_id",
        "positive_score", "negative_score")


def op12(embeddings: DataFrame) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives(prepared(rows), F.col("id") % 100 == 0).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 10
"""
