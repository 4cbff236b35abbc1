"""Suffix sorting and repeat removal against plain Python."""

import hashlib
import random

import numpy as np
import pytest

from gyrespark.llm import suffixes


def plain(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        key = suffixes.NO_ID if i is None else i
        for p in range(len(b) - length + 1):
            s = b[p:p + length]
            first[s] = min(first.get(s, key), key)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        key = suffixes.NO_ID if i is None else i
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < key:
                gone[p:p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefgh"])
def test_sorts_strings(letters):
    rng = random.Random(len(letters))
    text = bytearray("".join(rng.choice(letters) for _ in range(4000)).encode())
    text[1000:1200] = text[2000:2200]
    raw = np.frombuffer(bytes(text) + bytes(58), dtype=np.uint8)
    start = np.array(rng.sample(range(4000), 1500))
    for depth, shallow in ((50, 24), (50, 8), (33, 24), (25, 24)):
        order, group = suffixes.deep_shallow(raw, start, depth, shallow)
        strings = [raw[s:s + depth].tobytes() for s in start[order]]
        assert strings == sorted(strings)
        assert [a == b for a, b in zip(strings, strings[1:])] == [a == b for a, b in zip(group.tolist(), group[1:].tolist())]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7)))
    shared = [" ".join(word() for _ in range(20)) for _ in range(5)]
    rows = [(None, shared[0]), (None, shared[0]), (7, None), (8, ""), (9, "x" * 49), (10, "x" * 50), (11, "x" * 200), (5, "x" * 51), (5, "x" * 51), (6, shared[1][:49])]
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(30))) for _ in range(3)]
        rows.append((100 - i, (" ".join([parts[0], rng.choice(shared), parts[1], rng.choice(shared)[5:], parts[2]]))))
    rows += [(200 + i, rows[20][1]) for i in range(10)]
    return rows


def test_equals_plain(spark, monkeypatch):
    rows = corpus(3)
    frame = spark.createDataFrame([(i, t, b"k") for i, t in rows], "doc_id bigint, text string, kept binary")
    assert sorted(map(tuple, suffixes.op5(frame).collect()), key=str) == plain(rows, 50)
    short = suffixes.remove_repeats(frame, length=32).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)")
    assert sorted(map(tuple, short.collect()), key=str) == plain(rows, 32)


def test_blocks_and_segments(monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 70)
    cut = suffixes.Anchors([t.encode() for _, t in corpus(4) if t])
    monkeypatch.undo()
    whole = suffixes.Anchors([t.encode() for _, t in corpus(4) if t])
    # the same strings have the same anchors wherever a text is cut
    spread = lambda a: {(r, s): k for r, f, e, k in zip(a.row, a.first, a.last, a.key) for s in range(f, e + 1)}
    assert spread(cut) == spread(whole)


def test_small_blocks_and_documents(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 2000)
    rows = corpus(5)
    frame = spark.createDataFrame([(i, t, "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, source string, n_chars bigint")
    assert sorted(map(tuple, suffixes.op5(frame).collect()), key=str) == plain(rows, 50)
    clean = suffixes.without_repeats(frame)
    assert clean.columns == frame.columns and clean.count() == len(rows)
    assert clean.where("text IS NULL").count() == 1 and clean.where("n_chars <> length(text)").count() == 0
    assert suffixes.op5(frame.limit(0)).count() == 0
