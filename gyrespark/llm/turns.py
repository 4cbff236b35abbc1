"""Conversation structure repair by a square-root checkpointed dynamic programme.

A conversation should read ``(s?(ua)+)?`` in role initials.  Four states describe
what has been written: nothing (0), a system turn (1), an open user turn (2), a
closed pair (3).  Going backward, a vector holds for each state the cheapest cost
of repairing the rest.  Only every ``sqrt(n)``-th vector of a block is kept; going
forward, the vectors between two of them are computed again while the walk takes
the ASCII-least edit that still reaches the cheapest cost.

Rows are range-partitioned by (conversation, order), so a conversation of any
size is spread over many tasks.  One that lies inside a partition is finished
there.  One that is cut continues as blocks of bounded size: each block's
4 x 4 cost matrix is computed on its own, the vectors at the block ends come from
one pass over the small matrices, and every block is then repaired on its own.
Only the SHA-256 of a cut conversation, which is sequential by definition, runs
over its finished blocks one after the other, holding one at a time.

Cases.  Nulls in any column count as one blank in texts and in the damage's key;
a null turn sorts first and leaves no gap; a null ``conv_id`` is a conversation.
Ties: rows of equal turn are ordered by role, then text, by code point.  Repeated
rows are damaged alike and are duplicates of each other.  Rows are told apart by
128 bits of their role and text.  Empty and very long texts are handled whole; a
single text bounds a task's memory.  Roles other than the three are never kept,
only given another role or deleted; an empty role has no initial.  Other columns
are dropped at once, so their names cannot clash.  An empty table gives an empty
one.
"""

from __future__ import annotations

import hashlib
from itertools import count
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrespark.llm.common import parts_for, persisted, total_bytes, without

PART_BYTES = 32 << 20
BLOCK_ROWS = 16_384
BLOCK_BYTES = 1 << 20
INF = 1 << 40
AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}  # state after a role, by state
NEXT = (2, 2, 3, 2)             # state after the user or assistant turn that may follow
GIVEN = ("user", "user", "assistant", "user")
END = (0, 6, 3, 0)              # cost of ending, by state
DELETE, REROLE, INSERT, CUT_OFF = 4, 3, 3, 3
# A row's code: 0 to 3 for role s, u, a or other, plus one fault.
ROLES, TRUNCATED, REMOVED = "sua", 4, 8
RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _steps() -> list[tuple]:
    """For every code: what keeping costs (None: impossible) and the state after it, by state."""
    out = []
    for code in range(12):
        after = AFTER[ROLES[code % 4]] if code % 4 < 3 and code < REMOVED else (None,) * 4
        out.append((CUT_OFF if code & TRUNCATED else 0, after, code >= REMOVED))
    return out


STEPS = _steps()


def before_row(code: int, v: tuple) -> tuple:
    """Cost vector before a row from the vector after it."""
    extra, after, must_go = STEPS[code]
    best = []
    for s in range(4):
        c = DELETE + v[s]
        if not must_go:
            c = min(c, REROLE + extra + v[NEXT[s]])
            if after[s] is not None:
                c = min(c, extra + v[after[s]])
        best.append(c)
    user, pair = min(best[2], INSERT + best[3]), min(best[3], INSERT + best[2])
    return min(best[0], INSERT + user), min(best[1], INSERT + user), user, pair


def backward(codes: bytes, v: tuple) -> tuple:
    for code in reversed(codes):
        v = before_row(code, v)
    return v


def matrix_of(codes: bytes) -> list[int]:
    """Costs from every state before the rows to every state after them, row by row."""
    ends = [backward(codes, tuple(0 if s == e else INF for s in range(4))) for e in range(4)]
    return [min(ends[e][s], INF) for s in range(4) for e in range(4)]


def through(matrix: list[int], v: tuple) -> tuple:
    return tuple(min(min(matrix[4 * s + e] + v[e] for e in range(4)), INF) for s in range(4))


def walk(codes: bytes, end: tuple, state: int) -> tuple[str, int]:
    """ASCII-least cheapest edits of the rows from ``state``, and the state after them."""
    step = isqrt(len(codes)) + 1
    kept, v = {len(codes): end}, end
    for at in range((len(codes) - 1) // step * step, -1, -step):
        v = kept[at] = backward(codes[at:at + step], v)
    edits = []
    for at in range(0, len(codes), step):
        block = codes[at:at + step]
        vectors = [kept[at + len(block)]]
        for code in reversed(block):
            vectors.append(before_row(code, vectors[-1]))
        for i, code in enumerate(block):
            now, then = vectors[len(block) - i], vectors[len(block) - i - 1]
            extra, after, _ = STEPS[code]
            while True:
                if DELETE + then[state] == now[state]:
                    edits.append("D")
                elif INSERT + now[NEXT[state]] == now[state]:
                    edits.append("I")
                    state = NEXT[state]
                    continue
                elif after[state] is not None and extra + then[after[state]] == now[state]:
                    edits.append("K")
                    state = after[state]
                else:
                    edits.append("R")
                    state = NEXT[state]
                break
    return "".join(edits), state


def ending(state: int) -> str:
    return "I" * (END[state] // INSERT)


def repaired(edits: str, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """Lines ``role:text`` that edits write, from ``state`` on."""
    lines, row = [], 0
    for edit in edits:
        if edit == "I":
            lines.append(f"{GIVEN[state]}:")
            state = NEXT[state]
            continue
        role, text = (roles[row], texts[row]) if row < len(roles) else ("", "")
        row += 1
        if edit == "K":
            lines.append(f"{role}:{text}")
            state = AFTER[role[0]][state]
        elif edit == "R":
            lines.append(f"{GIVEN[state]}:{text}")
            state = NEXT[state]
    return lines


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) after the damage; dropped rows stay as ``gone`` without text."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    role, text = F.when(fault == 4, "user").otherwise(blank("role")), blank("text")
    text = F.when(fault == 1, "").when(fault == 2, without(text, ".!?")).otherwise(text)
    gone = fault == 0
    copies = F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", F.when(~gone, F.col("turn").cast("long")).alias("turn"), F.when(gone, "").otherwise(role).alias("role"),
                       F.when(gone, "").otherwise(text).alias("text"), gone.alias("gone"), copies.alias("_copy")).drop("_copy")


class _Open:
    """Rows of one conversation that are not written yet."""

    def __init__(self, conv):
        self.conv, self.cut = conv, False
        self.clear()

    def clear(self):
        self.turns, self.roles, self.texts, self.size = [], [], [], 0


def _codes(roles: list[str], texts: list[str]) -> tuple[bytearray, list[int], list[bytes]]:
    """Codes of the rows, indexes of first sights among the rows that are not blank, and their keys."""
    import xxhash

    codes, firsts, keys, seen = bytearray(), [], [], set()
    for i, (role, text) in enumerate(zip(roles, texts)):
        initial = ROLES.find(role[0]) if role else -1
        code = initial if initial >= 0 else 3
        end = text.rstrip(" \t\n\x0b\x0c\r")
        if not end:
            code += REMOVED
        else:
            key = xxhash.xxh3_128_digest(f"{len(role)}:{role}{text}".encode())
            if key in seen:
                code += REMOVED
            else:
                seen.add(key)
                firsts.append(i)
                keys.append(key)
                if end[-1] not in ".!?":
                    code += TRUNCATED
        codes.append(code)
    return codes, firsts, keys


def faults_of(codes: bytes, texts: list[str]) -> tuple[int, int, int]:
    blank = sum(1 for t in texts if not t.strip(" \t\n\x0b\x0c\r"))
    removed = sum(1 for c in codes if c >= REMOVED)
    return blank, removed - blank, sum(1 for c in codes if TRUNCATED <= c < REMOVED)


def bad_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def turn_range(turns: list) -> tuple:
    """Least, greatest and number of distinct turns without nulls; turns are sorted."""
    known = [t for t in turns if t is not None]
    return (known[0], known[-1], len(set(known))) if known else (None, None, 0)


def digest(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def _whole(o: _Open) -> dict:
    codes, _, _ = _codes(o.roles, o.texts)
    codes = bytes(codes)
    blank, duplicate, truncated = faults_of(codes, o.texts)
    low, high, distinct = turn_range(o.turns)
    edits, state = walk(codes, END, 0)
    edits += ending(state)
    return {"conv_id": o.conv, "gaps": high - low + 1 - distinct if distinct else 0, "blank": blank, "duplicate": duplicate,
            "truncated": truncated, "illegal": bad_pairs([r[:1] for r in o.roles]), "cost": backward(codes, END)[0], "audit": edits,
            "repaired_sha256": digest(repaired(edits, 0, o.roles, o.texts))}


BLOCK = ("number bigint, codes binary, firsts array<int>, keys array<binary>, roles array<string>, texts array<string>, "
         "low bigint, high bigint, n_turns bigint, initials array<string>, pairs bigint")


def _block(o: _Open, number: int) -> dict:
    codes, firsts, keys = _codes(o.roles, o.texts)
    low, high, distinct = turn_range(o.turns)
    initials = [r[:1] for r in o.roles]
    out = {"conv_id": o.conv, "number": number, "codes": bytes(codes), "firsts": firsts, "keys": keys, "roles": o.roles, "texts": o.texts,
           "low": low, "high": high, "n_turns": distinct, "initials": initials[:1] + initials[-1:], "pairs": bad_pairs(initials)}
    o.cut = True
    o.clear()
    return out


def _emitter(schema: pa.Schema, limit: int = 1024):
    rows = []

    def out(new=None):
        if new is not None:
            rows.append(new)
        if rows and (new is None or len(rows) >= limit or len(new.get("codes") or b"")):
            batch = pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in schema} for r in rows], schema)
            rows.clear()
            return [batch]
        return []
    return out


def _arrow(ddl: str) -> pa.Schema:
    """Arrow form of the simple column lists of this module."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()),
             "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary()), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[t]) for n, t in (c.split(" ") for c in ddl.split(", "))])


def _first_pass(block_rows: int, block_bytes: int):
    """Kernel over sorted rows: results of conversations that lie inside the partition, blocks of the others."""
    rest = _arrow(f"{RESULT}, {BLOCK}")

    def run(batches):
        opened, first, ready, numbers = None, True, None, count()

        def close(last: bool):
            if not opened.cut and not first and not last:
                return ready(_whole(opened))
            return ready(_block(opened, next(numbers)))

        for batch in batches:
            if ready is None:
                ready = _emitter(pa.schema([batch.schema.field(0), *rest]))
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for conv, turn, role, text, gone in zip(*columns):
                if opened is None or conv != opened.conv:
                    if opened is not None:
                        yield from close(False)
                        first = False
                    opened = _Open(conv)
                if gone:
                    continue
                opened.turns.append(turn)
                opened.roles.append(role)
                opened.texts.append(text)
                opened.size += len(text)
                if len(opened.roles) >= block_rows or opened.size >= block_bytes:
                    yield from ready(_block(opened, next(numbers)))
        if opened is not None:
            yield from close(True)
            yield from ready()
    return run


def _stream(rows: DataFrame, order: list, schema: str, step, parts: int) -> DataFrame:
    """Fold the rows of every conversation in order; ``step(rows of a batch as dicts)`` is a generator function with its own state."""
    key = F.struct(F.col("conv_id").isNull(), "conv_id")
    dealt = rows.withColumn("_k", F.xxhash64(key)).repartition(parts, "_k").sortWithinPartitions("_k", "conv_id", *order).drop("_k")
    return dealt.mapInArrow(step, schema)


def _ends(batches):
    """Vectors at the end of every block, from the last block to the first."""
    conv, v, begun = None, END, False
    for batch in batches:
        rows = batch.to_pylist()
        out = []
        for r in rows:
            if not begun or r["conv_id"] != conv:
                conv, v, begun = r["conv_id"], END, True
            out.append(list(v))
            v = through(r["matrix"], v)
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("number"), pa.array(out, pa.list_(pa.int64()))],
                                         ["part", "number", "ends"])


def _starts(batches):
    """State before every block, from the first block to the last."""
    conv, state, begun = None, 0, False
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if not begun or r["conv_id"] != conv:
                conv, state, begun = r["conv_id"], 0, True
            out.append(state)
            state = r["exits"][state]
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("number"), pa.array(out, pa.int32())], ["part", "number", "start"])


def _matrices(batches):
    for batch in batches:
        m = [matrix_of(c) for c in batch.column("codes").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), batch.column("number"), pa.array(m, pa.list_(pa.int64()))],
                                         ["conv_id", "part", "number", "matrix"])


def _exits(batches):
    for batch in batches:
        out = []
        for codes, ends in zip(batch.column("codes").to_pylist(), batch.column("ends").to_pylist()):
            cost = backward(codes, tuple(ends))
            out.append([walk(codes, tuple(ends), s)[1] if cost[s] < INF else 0 for s in range(4)])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), batch.column("number"), pa.array(out, pa.list_(pa.int32()))],
                                         ["conv_id", "part", "number", "exits"])


FINISHED = ("part int, number bigint, blank bigint, duplicate bigint, truncated bigint, pairs bigint, initials array<string>, "
            "low bigint, high bigint, n_turns bigint, cost bigint, state int, audit string, lines string, n_lines bigint")


def _finish(batches):
    """Edits and repaired lines of every block on its own."""
    schema = _arrow(FINISHED)
    for batch in batches:
        for r in batch.to_pylist():
            codes, ends, start = r["codes"], tuple(r["ends"]), r["start"]
            audit, state = walk(codes, ends, start)
            lines = repaired(audit, start, r["roles"], r["texts"])
            blank, duplicate, truncated = faults_of(codes, r["texts"])
            row = {"part": r["part"], "number": r["number"], "blank": blank, "duplicate": duplicate, "truncated": truncated, "pairs": r["pairs"],
                   "initials": r["initials"], "low": r["low"], "high": r["high"], "n_turns": r["n_turns"], "cost": backward(codes, ends)[start],
                   "state": state, "audit": audit, "lines": "\n".join(lines), "n_lines": len(lines)}
            rest = pa.RecordBatch.from_pylist([row], schema)
            conv = pa.array([r["conv_id"]], batch.schema.field("conv_id").type)
            yield pa.RecordBatch.from_arrays([conv, *rest.columns], ["conv_id", *schema.names])


def _join_blocks(batches):
    """One result of every cut conversation from its finished blocks in order; one block is held at a time."""
    schema, conv_type = _arrow(RESULT), None
    total = None

    def result():
        audit = "".join(total["audit"]) + ending(total["state"])
        for line in repaired(ending(total["state"]), total["state"], [], []):
            write(line)
        gaps = total["high"] - total["low"] + 1 - total["n_turns"] if total["n_turns"] else 0
        row = {"gaps": gaps, "blank": total["blank"], "duplicate": total["duplicate"], "truncated": total["truncated"],
               "illegal": total["pairs"], "cost": total["cost"], "audit": audit, "repaired_sha256": total["sha"].hexdigest()}
        out = pa.RecordBatch.from_pylist([row], schema)
        return pa.RecordBatch.from_arrays([pa.array([total["conv_id"]], conv_type), *out.columns], ["conv_id", *schema.names])

    def write(lines):
        total["sha"].update((("\n" if total["begun"] else "") + lines).encode())
        total["begun"] = True

    for batch in batches:
        conv_type = batch.schema.field("conv_id").type
        for r in batch.to_pylist():
            if total is None or r["conv_id"] != total["conv_id"]:
                if total is not None:
                    yield result()
                total = {"conv_id": r["conv_id"], "low": None, "high": None, "n_turns": 0, "blank": 0, "duplicate": 0, "truncated": 0,
                         "pairs": 0, "cost": r["cost"], "state": 0, "audit": [], "last": None, "sha": hashlib.sha256(), "begun": False}
            for c in ("blank", "duplicate", "truncated", "pairs"):
                total[c] += r[c]
            if r["n_turns"]:
                total["n_turns"] += r["n_turns"] - (r["low"] == total["high"])
                total["low"] = r["low"] if total["low"] is None else total["low"]
                total["high"] = r["high"]
            if r["initials"]:
                if total["last"] is not None:
                    total["pairs"] += bad_pairs([total["last"], r["initials"][0]])
                total["last"] = r["initials"][-1]
            total["audit"].append(r["audit"])
            total["state"] = r["state"]
            if r["n_lines"]:
                write(r["lines"])
    if total is not None:
        yield result()


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Faults, cheapest edits and repaired digest of every conversation of a frame (conv_id, turn, role, text, gone).

    Returns (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).
    """
    spark, conv_type = rows.sparkSession, dict(rows.dtypes)["conv_id"]
    parts = parts_for(spark, total_bytes(rows), PART_BYTES)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), ]
    dealt = rows.repartitionByRange(parts, *order, F.substring("text", 1, 64), F.xxhash64("text")).sortWithinPartitions(*order, "text")
    dealt = dealt.select("conv_id", "turn", "role", "text", "gone")
    schema = f"conv_id {conv_type}, {RESULT}, {BLOCK}"
    done = persisted(dealt.mapInArrow(_first_pass(block_rows, block_bytes), schema).withColumn("part", F.spark_partition_id()))
    result = ["conv_id", *(c.split(" ")[0] for c in RESULT.split(", "))]
    whole = done.where("codes IS NULL").select(*result)
    blocks = done.where("codes IS NOT NULL")

    # a row seen in an earlier block is a duplicate in the later one
    sight = blocks.select("conv_id", "part", "number", F.explode(F.arrays_zip("firsts", "keys")).alias("s"))
    sight = sight.select(F.struct("conv_id", "s.keys").alias("k"), F.struct("part", "number").alias("b"), F.col("s.firsts").alias("at"))
    early = sight.groupBy("k").agg(F.min("b").alias("e")).withColumnRenamed("k", "ek")
    late = sight.join(early, F.col("k").eqNullSafe(F.col("ek"))).where("b <> e")
    late = late.groupBy("b.part", "b.number").agg(F.collect_list("at").alias("late"))
    light = blocks.select("conv_id", "part", "number", "codes").join(late, ["part", "number"], "left")
    light = persisted(light.mapInArrow(_patched, f"conv_id {conv_type}, part int, number bigint, codes binary"))

    keyed = f"conv_id {conv_type}, part int, number bigint, "
    small = parts_for(spark, light.count(), 100_000)
    matrices = light.mapInArrow(_matrices, keyed + "matrix array<bigint>")
    ends = _stream(matrices, [F.col("part").desc(), F.col("number").desc()], "part int, number bigint, ends array<bigint>", _ends, small)
    led = persisted(light.join(ends, ["part", "number"]).select("conv_id", "part", "number", "codes", "ends"))
    exits = led.mapInArrow(_exits, keyed + "exits array<int>")
    starts = _stream(exits, ["part", "number"], "part int, number bigint, start int", _starts, small)
    ready = led.join(starts, ["part", "number"]).join(blocks.drop("conv_id", "codes", "firsts", "keys"), ["part", "number"])
    finished = ready.mapInArrow(_finish, f"conv_id {conv_type}, {FINISHED}")
    cut = _stream(finished, ["part", "number"], f"conv_id {conv_type}, {RESULT}", _join_blocks, small)
    return whole.unionByName(cut)


def _patched(batches):
    for batch in batches:
        codes = []
        for c, late in zip(batch.column("codes").to_pylist(), batch.column("late").to_pylist()):
            c = np.frombuffer(c, dtype=np.uint8).copy()
            if late:
                c[late] = c[late] % 4 + REMOVED
            codes.append(c.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), batch.column("number"), pa.array(codes, pa.binary())],
                                         ["conv_id", "part", "number", "codes"])


def op13(conversations: DataFrame) -> DataFrame:
    return repair(damaged(conversations))


def _sql() -> str:
    def plus(v: str, cost: str, edit: str, line: str | None = None) -> str:
        lines = f"list_append({v}.r, {line})" if line else f"{v}.r"
        return f"{{'c': {v}.c + {cost}, 'a': {v}.a || '{edit}', 'r': {lines}}}"

    def keep(v: str, initial: str) -> str:
        return plus(v, f"CASE WHEN NOT must_go AND left(role, 1) = '{initial}' THEN extra ELSE 1000000000 END", "K", "role || ':' || text")

    def given(v: str, role: str) -> str:
        return plus(v, "CASE WHEN NOT must_go THEN extra + 3 ELSE 1000000000 END", "R", f"'{role}:' || text")

    inserted = lambda v, role: plus(v, "3", "I", f"'{role}:'")
    dropped = lambda v: plus(v, "4", "D")
    open_pair = f"least(v2, {inserted('v0', 'user')}, {inserted('v1', 'user')}, {inserted('v3', 'user')})"
    return rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda s, b: list_reduce(list_prepend(xor(s, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
        lambda z, i: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END)), 4294967295) % 20 AS fault FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, (SELECT unnest([1, 2]) AS copy) WHERE fault <> 0 AND (copy = 1 OR fault = 3)),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS sight, rtrim(text, E' \t\n\x0b\f\r') AS body FROM p),
f AS (SELECT *, body = '' AS blank, body <> '' AND sight > 1 AS duplicate,
    body <> '' AND sight = 1 AND right(body, 1) NOT IN ('.', '!', '?') AS truncated,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM n),
t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate,
    count_if(truncated) AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY 1),
o AS (SELECT DISTINCT k.conv_id, gaps, blank, duplicate, truncated, illegal, coalesce(n, 0) AS n FROM k LEFT JOIN t ON k.conv_id IS NOT DISTINCT FROM t.conv_id),
w AS (SELECT conv_id, 0 AS i, {{'c': 0, 'a': '', 'r': CAST([] AS VARCHAR[])}} AS v0, {{'c': 1000000000, 'a': '', 'r': CAST([] AS VARCHAR[])}} AS v1,
    {open_pair.replace('v0', "{'c': 0, 'a': '', 'r': CAST([] AS VARCHAR[])}").replace('v1', "{'c': 1000000000, 'a': '', 'r': CAST([] AS VARCHAR[])}").replace('v2', "{'c': 1000000000, 'a': '', 'r': CAST([] AS VARCHAR[])}").replace('v3', "{'c': 1000000000, 'a': '', 'r': CAST([] AS VARCHAR[])}")} AS v2,
    {{'c': 6, 'a': 'II', 'r': ['user:', 'assistant:']}} AS v3 FROM o
  UNION ALL
  SELECT conv_id, i, v0, v1, {open_pair} AS v2, least(v3, {inserted(open_pair, 'assistant')}) AS v3 FROM (
    SELECT w.conv_id, w.i + 1 AS i, {dropped('v0')} AS v0, least({dropped('v1')}, {keep('v0', 's')}) AS v1,
      least({dropped('v2')}, {', '.join(keep(v, 'u') + ', ' + given(v, 'user') for v in ('v0', 'v1', 'v3'))}) AS v2,
      least({dropped('v3')}, {keep('v2', 'a')}, {given('v2', 'assistant')}) AS v3
    FROM w JOIN (SELECT *, blank OR duplicate AS must_go, CASE WHEN truncated THEN 3 ELSE 0 END AS extra FROM f) g
      ON w.conv_id IS NOT DISTINCT FROM g.conv_id AND g.i = w.i + 1)),
e AS (SELECT conv_id, i, least(v0, v3) AS v FROM w)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(v.c AS BIGINT) AS cost, v.a AS audit,
  sha256(array_to_string(v.r, chr(10))) AS repaired_sha256
FROM o JOIN e ON o.conv_id IS NOT DISTINCT FROM e.conv_id AND o.n = e.i
"""


SQL = _sql()
