"""Removal of byte strings that repeat across documents, by deep-shallow suffix sorting.

A document loses each byte covered by a string of ``LENGTH`` bytes that also
starts in a document with a smaller id.

Every string owns one anchor: the 16-byte gram of least hash inside it, so equal
strings own equal anchors, and about one position in 18 is an anchor.  Documents
are dealt to blocks by id.  A block sends each distinct anchor once (48 hash
bits, sorted) to the bucket of its hash range; buckets answer which anchors occur
in two documents.  Only around those does a block send text: the bytes of all
strings an anchor owns, each distinct piece once with its smallest id.  A bucket
sorts the strings of its pieces (multikey quicksort by eight-byte characters to
the shallow depth, blind tries below) and answers with the smallest id of each
group of equal strings.  The block marks its documents.  A passage that millions
of documents share travels once a block, and no task holds more than one block
or bucket; hash collisions only add pieces, never links.

Cases: a null text counts as empty; matches never cross documents; a null id
counts as greater than all others; rows of equal id never remove from each
other.  Texts shorter than ``LENGTH`` are unchanged.  An empty table gives an
empty one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from gyrespark.llm.blobs import bucket_bounds, expand, mix, pack, pack_sorted, squeeze, unpack, unpack_sorted
from gyrespark.llm.common import give_back, parts_for

LENGTH = 50
GRAM = 16
SHALLOW = 24
KEY_BITS = 48
BLOCK_BYTES = 4 << 20
SEGMENT = 1 << 20        # strings of a long text handled at once
CHUNK_BYTES = 1 << 20    # text whose anchors are found at once
SORTED = 400_000         # strings sorted at once
BUCKET_BYTES = 4 << 20   # text per bucket
BUCKETS_PER_TASK = 4
NO_ID = np.iinfo(np.int64).max
POSITION = np.uint64((1 << 31) - 1)


def words_at(text: np.ndarray, dtype: str) -> np.ndarray:
    """The eight bytes at every position as one number; ``text`` ends with eight spare bytes."""
    return np.ndarray(shape=(len(text) - 8,), dtype=dtype, buffer=text, strides=(1,))


def deep_shallow(text: np.ndarray, start: np.ndarray, depth: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sort strings of ``depth`` bytes; returns their order and the class of equal ones of each place.

    ``text`` has eight spare bytes at its end.  Multikey quicksort with
    eight-byte characters down to ``shallow``; then groups that are still equal
    are ordered by a blind trie: members are compared with one leader only, and
    the branching depth and byte file them, until every branch is one string.
    """
    word = words_at(text, ">u8")
    order = np.arange(len(start))
    head = np.zeros(len(start), dtype=bool)
    head[:1] = True
    done = np.zeros(len(start), dtype=bool)

    def open_places():
        """Places in groups of several members that are not known to be equal, and their groups."""
        group = np.cumsum(head) - 1
        size = np.bincount(group, minlength=1)
        at = np.flatnonzero((size[group] > 1) & ~done)
        return at, group[at]

    def split(at, group, key):
        by = np.lexsort((key, group))
        order[at] = order[at][by]
        key = key[by]
        head[at[1:]] |= (key[1:] != key[:-1]) & (group[1:] == group[:-1])
        return key

    for offset in range(0, shallow, 8):
        at, group = open_places()
        if not len(at):
            break
        split(at, group, word[start[order[at]] + offset].astype(np.uint64))
    steps = [*range(shallow, depth - 7, 8)]
    steps += [depth - 8] if not steps or steps[-1] < depth - 8 else []
    while True:
        at, group = open_places()
        if not len(at):
            break
        first = np.r_[True, group[1:] != group[:-1]]
        own = start[order[at]]
        leader = own[first][np.cumsum(first) - 1]
        common = np.full(len(at), depth)
        for offset in reversed(steps):
            x = (word[own + offset] ^ word[leader + offset]).astype(np.uint64)
            zero_bytes = sum((x < np.uint64(1) << np.uint64(8 * i)).astype(np.int64) for i in range(1, 8))
            common = np.where(x != 0, offset + zero_bytes, common)
        branch = common < depth
        mine, theirs = text[own + np.where(branch, common, 0)].astype(np.int64), text[leader + np.where(branch, common, 0)]
        key = np.where(branch, np.where(mine < theirs, common - depth, depth - common) * 256 + mine, 0)
        key = split(at, group, key)
        done[at[key == 0]] = True
    return order, np.cumsum(head) - 1


class Anchors:
    """Anchors of a list of texts: which strings they own, and their hashes."""

    def __init__(self, texts: list[bytes], length: int = LENGTH):
        parts = []
        chunk, size = [], 0
        for row, text in enumerate(texts):
            for at in range(0, len(text) - length + 1, SEGMENT):
                piece = text[at:at + SEGMENT + length - 1]
                chunk.append((row, at, piece))
                size += len(piece)
                if size > CHUNK_BYTES:
                    parts.append(self._of(chunk, length))
                    chunk, size = [], 0
        if chunk:
            parts.append(self._of(chunk, length))
        # row, first and last string, anchor hash
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)]
        self.row, self.first, self.last, self.key = columns

    @staticmethod
    def _of(chunk, length):
        sizes = np.array([len(p) for _, _, p in chunk])
        begin = np.cumsum(sizes) - sizes
        text = np.frombuffer(b"".join(p for _, _, p in chunk) + bytes(GRAM + 8), dtype=np.uint8)
        word = words_at(text, "<u8")
        n = int(sizes.sum())
        gram = mix(word[:n] * np.uint64(0x9E3779B97F4A7C15) ^ mix(word[8:n + 8] + np.uint64(1)))
        least = (gram & ~POSITION) | np.arange(n, dtype=np.uint64)
        width, reach = 1, length - GRAM + 1
        while width < reach:
            step = min(width, reach - width)
            least = np.minimum(least[:-step], least[step:]) if len(least) > step else least
            width += step
        strings = sizes - length + 1
        at = np.arange(int(strings.sum())) + np.repeat(begin - (np.cumsum(strings) - strings), strings)
        owner = (least[at] & POSITION).astype(np.int64)
        new = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        last = np.r_[new[1:], len(at)] - 1
        segment = np.searchsorted(begin, at[new], side="right") - 1
        shift = np.array([a for _, a, _ in chunk])[segment] - begin[segment]
        rows = np.array([r for r, _, _ in chunk])[segment]
        return rows, at[new] + shift, at[last] + shift, mix(gram[owner[new]]) >> np.uint64(64 - KEY_BITS)  # least hashes are small: scrambled again


def _in_order(table: pa.Table) -> pa.Table:
    """Rows of a block in an order that does not depend on how they arrived."""
    rows = sorted(range(table.num_rows), key=list(zip(_ids(table).tolist(), table["text"].to_pylist())).__getitem__)
    return table.take(pa.array(rows, pa.int64()))


def _ids(table: pa.Table) -> np.ndarray:
    return pc.fill_null(table["doc_id"], int(NO_ID)).to_numpy().astype(np.int64)


def _asked_anchors(buckets: int, length: int):
    def run(table: pa.Table) -> pa.Table:
        anchors = Anchors(table["text"].to_pylist(), length)
        ids = _ids(table)[anchors.row] if len(anchors.row) else np.empty(0, np.int64)
        order = np.argsort(anchors.key, kind="stable")
        key, ids = anchors.key[order], ids[order]
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        several = np.minimum.reduceat(ids, head) != np.maximum.reduceat(ids, head) if len(head) else np.empty(0, bool)
        key = key[head]
        ends = bucket_bounds(key, buckets, KEY_BITS)
        used = np.flatnonzero(np.diff(ends))
        return pa.table({
            "bucket": pa.array(used, pa.int32()), "block": pa.array([table["block"][0].as_py()] * len(used), pa.int64()),
            "keys": pa.array([pack_sorted(key[ends[i]:ends[i + 1]]) for i in used], pa.binary()),
            "several": pa.array([np.packbits(several[ends[i]:ends[i + 1]]).tobytes() for i in used], pa.binary())})
    return run


def _shared_anchors(table: pa.Table) -> pa.Table:
    """Which anchors of one bucket occur in more than one document, for every block."""
    keys = [unpack_sorted(k) for k in table["keys"].to_pylist()]
    bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(k)) for b, k in zip(table["several"].to_pylist(), keys)]
    _, at, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    shared = (n > 1) | (np.bincount(at, weights=np.concatenate(bits)) > 0)
    ends = np.cumsum([0] + [len(k) for k in keys])
    cells = [squeeze(np.packbits(shared[at[a:b]]).tobytes()) for a, b in zip(ends, ends[1:])]
    return pa.table({"block": table["block"], "bucket": table["bucket"], "kind": pa.array([0] * len(cells), pa.int32()),
                     "cell": pa.array(cells, pa.binary()), "runs": pa.array([None] * len(cells), pa.binary())})


PIECES = "bucket int, block bigint, kind int, pieces binary, lengths binary, least binary"
ANSWER = "block bigint, bucket int, kind int, cell binary, runs binary"
SHARED, LEAST, USES = 0, 1, 2  # kinds of rows


def _cells(rows: list[tuple], schema: str) -> pa.Table:
    types = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.table({name: pa.array(c, types[kind]) for (name, kind), c in zip(fields, columns)})


def _asked_pieces(buckets: int, length: int):
    """Distinct pieces of text around a block's shared anchors, in order of (hash, text), and where they are used."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _cells([], PIECES)
        left = _in_order(left)
        texts, ids, block = left["text"].to_pylist(), _ids(left), left["block"][0].as_py()
        anchors = Anchors(texts, length)
        every = np.unique(anchors.key)
        ends = bucket_bounds(every, buckets, KEY_BITS)
        shared = np.zeros(len(every), dtype=bool)
        for r in right.to_pylist():
            a, b = ends[r["bucket"]], ends[r["bucket"] + 1]
            shared[a:b] = np.unpackbits(np.frombuffer(expand(r["cell"]), np.uint8), count=b - a)
        use = np.flatnonzero(shared[np.searchsorted(every, anchors.key)])
        row, first, last = anchors.row[use], anchors.first[use], anchors.last[use]
        found: dict[tuple[int, bytes], int] = {}
        number = np.array([found.setdefault((k, texts[r][a:b + length]), len(found))
                           for k, r, a, b in zip(anchors.key[use].tolist(), row.tolist(), first.tolist(), last.tolist())], dtype=np.int64)
        names = sorted(found)
        rank = np.empty(len(found), dtype=np.int64)
        rank[[found[n] for n in names]] = np.arange(len(names))
        number, pieces = rank[number], [p for _, p in names]
        least = np.full(len(names), NO_ID)
        np.minimum.at(least, number, ids[row])
        size = np.array([len(p) for p in pieces], dtype=np.uint8)
        ends = bucket_bounds(np.array([k for k, _ in names], dtype=np.uint64), buckets, KEY_BITS)
        out = [(i, block, LEAST, squeeze(b"".join(pieces[a:b])), pack(size[a:b]), pack(least[a:b]))
               for i, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())) if a < b]
        del found, names
        give_back()
        # the block's own table of uses takes the way of one of its questions and comes back with the answer
        uses = [pack(x.astype(np.int64)) for x in (np.diff(row, prepend=0), first - np.r_[0, first[:-1]], number)]
        return _cells([*out, (block % buckets, block, USES, uses[2], pack(size), _joined(uses[0], uses[1]))] if len(use) else out, PIECES)
    return run


def _joined(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(8, "little") + a + b


def _parted(cell: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(cell[:8], "little")
    return cell[8:8 + n], cell[8 + n:]


def _least_ids(length: int):
    """The smallest id of every string of a bucket's pieces, as runs, for every block."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = [(r["block"], r["bucket"], USES, r["pieces"], _joined(r["lengths"], r["least"])) for r in rows if r["kind"] == USES]
        rows = [r for r in rows if r["kind"] == LEAST]
        sizes = [unpack(r["lengths"], np.uint8).astype(np.int64) for r in rows]
        found: dict[bytes, int] = {}
        numbers = []
        for r, size in zip(rows, sizes):
            raw, end = expand(r["pieces"]), np.cumsum(size)
            numbers.append(np.array([found.setdefault(raw[a:b], len(found)) for a, b in zip((end - size).tolist(), end.tolist())], dtype=np.int64))
        if not rows:
            return _cells(out, ANSWER)
        # equal pieces of several blocks are sorted once, with their smallest id
        id_of = np.full(len(found), NO_ID)
        for r, number in zip(rows, numbers):
            np.minimum.at(id_of, number, unpack(r["least"], np.int64))
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        text = np.frombuffer(b"".join(found) + bytes(8), dtype=np.uint8)
        strings = size - length + 1
        begin, offset = np.cumsum(size) - size, np.cumsum(strings) - strings
        start = np.arange(int(strings.sum())) + np.repeat(begin - offset, strings)
        ids = np.repeat(id_of, strings)
        # equal strings begin alike: a hash of their first bytes deals them to sorts of bounded size
        lots = math.ceil(len(start) / SORTED)
        lot = (mix(words_at(text, "<u8")[start]) % np.uint64(lots)).astype(np.int32)
        least = np.empty(len(start), dtype=np.int64)
        for i in range(lots):
            some = np.flatnonzero(lot == i)
            if len(some):
                order, group = deep_shallow(text, start[some], length)
                own = ids[some][order]
                least[some[order]] = np.minimum.reduceat(own, np.flatnonzero(np.r_[True, group[1:] != group[:-1]]))[group]
        del found, text, start, ids, lot
        give_back()
        for r, number in zip(rows, numbers):
            n = strings[number]
            part = least[np.arange(int(n.sum())) + np.repeat(offset[number] - (np.cumsum(n) - n), n)]
            new = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            out.append((r["block"], r["bucket"], LEAST, pack(part[new]), pack(np.diff(np.r_[new, len(part)]).astype(np.uint32))))
        return _cells(out, ANSWER)
    return run


def _marked(length: int, schema: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        left = _in_order(left)
        texts, ids = left["text"].to_pylist(), _ids(left)
        answers = sorted(right.to_pylist(), key=lambda r: r["bucket"])
        told = [np.repeat(unpack(r["cell"], np.int64), unpack(r["runs"], np.uint32).astype(np.int64)) for r in answers if r["kind"] == LEAST]
        told = np.concatenate(told) if told else np.empty(0, np.int64)
        row = first = number = strings = np.empty(0, np.int64)
        for r in answers:
            if r["kind"] == USES:
                sizes, places = _parted(r["runs"])
                row, first = (np.cumsum(unpack(x, np.int64)) for x in _parted(places))
                number, strings = unpack(r["cell"], np.int64), unpack(sizes, np.uint8).astype(np.int64) - length + 1
        offset = np.cumsum(strings) - strings
        bounds = np.searchsorted(row, np.arange(len(texts) + 1))
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for i, text in enumerate(texts):
            # the strings of every piece in this text, and the smallest id that has each
            own = number[bounds[i]:bounds[i + 1]]
            n = strings[own]
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            starts = (np.repeat(first[bounds[i]:bounds[i + 1]], n) + inside)[told[np.repeat(offset[own], n) + inside] < ids[i]]
            removed, kept, spans = 0, text, 0
            if len(starts):
                new = np.flatnonzero(np.r_[True, starts[1:] > starts[:-1] + length])
                begin, end = starts[new], np.r_[starts[new[1:] - 1], starts[-1]] + length
                spans, removed = len(new), int((end - begin).sum())
                kept = b"".join(text[a:b] for a, b in zip(np.r_[0, end].tolist(), np.r_[begin, len(text)].tolist()))
            for name, value in zip(out, (len(text), removed, spans, kept)):
                out[name].append(value)
        out["kept_text"] = [x.decode("utf-8", "ignore") for x in out["kept"]] if "kept_text" in schema.names else []
        columns = [left[c] if c in left.column_names else pa.array(out[c], schema.field(c).type) for c in schema.names]
        done = pa.table(columns, schema=schema)
        del texts, told, number, row, first, answers, out, columns
        give_back()
        return done
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, carry: list[str] | None = None,
                   as_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row; ``carry`` columns go along as struct ``row``.

    ``as_text`` gives ``kept_text`` instead of the bytes ``kept``: characters cut in two by a removal go with it.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *([F.struct(*carry).alias("row")] if carry else []))
    size = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    n_blocks = max(1, math.ceil(size / BLOCK_BYTES))
    parts = parts_for(spark, size, BUCKET_BYTES * BUCKETS_PER_TASK)
    buckets = parts * BUCKETS_PER_TASK
    block = F.pmod(F.coalesce(F.xxhash64("doc_id"), F.lit(0)) + F.when(F.col("doc_id").isNull(), F.xxhash64("text") % 65536).otherwise(0), F.lit(n_blocks))
    dealt = rows.withColumn("block", block).repartition(parts_for(spark, n_blocks, 1), "block")

    def grouped(frame: DataFrame):
        return frame.groupBy("block")

    def to_buckets(frame: DataFrame, run, schema: str) -> DataFrame:
        return frame.repartition(parts, "bucket").groupBy("bucket").applyInArrow(run, schema)

    asked = grouped(dealt).applyInArrow(_asked_anchors(buckets, length), "bucket int, block bigint, keys binary, several binary")
    shared = to_buckets(asked, _shared_anchors, ANSWER)
    pieces = grouped(dealt).cogroup(grouped(shared)).applyInArrow(_asked_pieces(buckets, length), PIECES)
    least = to_buckets(pieces, _least_ids(length), ANSWER)
    fields = [f for f in dealt.schema.fields if f.name in ("doc_id", "row")]
    schema = StructType([*fields, *(StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")), StructField("kept_text", StringType()) if as_text else StructField("kept", BinaryType())])
    return grouped(dealt).cogroup(grouped(least)).applyInArrow(_marked(length, to_arrow_schema(schema)), schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated strings removed; characters cut in two by a removal go with it."""
    out = remove_repeats(docs, carry=docs.columns, as_text=True).select("row", F.col("kept_text").alias("text"))
    return out.select(*[F.when(F.col("row.text").isNotNull(), F.col("text")).alias(c) if c == "text"
                        else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op5(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
