"""SimHash groups against brute force over all pairs."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from gyrespark.llm import simhash
from gyrespark.llm.components import connected

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for x in ids:
        for y in ids:
            if x < y and (prints[x] ^ prints[y]).bit_count() <= 3:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", "one", "ONE", "two words", " \n"]
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([40, 300, 900]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy).upper())
    return list(enumerate(texts))


def test_groups_equal_brute_force(spark):
    rows = corpus()
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(7, rows[7][1], "x")], "doc_id bigint, text string, fp string")
    got = simhash.op8(frame).collect()
    prints = {i: plain_print(t) for i, t in rows}
    groups = plain_groups(prints)
    assert len(got) == len(rows) + 1
    for r in got:
        assert int(r.fingerprint, 16) == prints[r.doc_id] and len(r.fingerprint) == 16
        assert r.component_id == groups[r.doc_id]


def test_links_join_all_close_prints(spark):
    rng = random.Random(1)
    centre = [rng.getrandbits(64) for _ in range(20)]
    prints = set(centre)
    for c in centre:
        for _ in range(40):
            x = c
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << b
            prints.add(x)
    signed = {p: int(np.uint64(p).view(np.int64)) for p in prints}
    frame = spark.createDataFrame([(s,) for s in signed.values()], "fp bigint")
    found = simhash.links(frame)
    for a, b in found.collect():
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 3
    label = {r.node: r.root for r in connected(found).collect()}
    want = plain_groups({p: p for p in prints})
    classes, got = {}, {}
    for p in prints:
        classes.setdefault(want[p], set()).add(p)
        got.setdefault(label.get(signed[p], signed[p]), set()).add(p)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, got.values()))


def test_one_of_each_and_edge_tables(spark):
    frame = spark.createDataFrame([(3, "a b c d e"), (1, "A b c d e"), (1, "A b c d e"), (None, "a b c d e"), (9, "other words are here now")], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(frame).collect()) == [1, 9]
    empty = frame.limit(0)
    assert simhash.op8(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def test_chain_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (500, 501), (None, 5)], "a bigint, b bigint")
    got = {r.node: r.root for r in connected(links).collect()}
    assert got == {i: 0 for i in range(301)} | {500: 500, 501: 500}


def test_one_of_each_decides_by_row(spark):
    unlike = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdefgh"]
    rows = [(None, t) for t in unlike[:5]] + [(None, unlike[0])]  # unlike texts without an id, one twice
    rows += [(7, unlike[4]), (7, unlike[5]), (7, unlike[6]), (9, unlike[6]), (2, unlike[7]), (None, unlike[7])]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = simhash.one_of_each(frame).collect()
    assert frame.columns == simhash.one_of_each(frame).columns
    want = [(None, t) for t in unlike[:4]] + [(7, t) for t in unlike[4:7]] + [(2, unlike[7])]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_one_of_each_keeps_columns_of_any_name(spark):
    names = ["_h", "_g", "_id", "_row", "_kept", "_kh", "fp", "root", "a.b"]
    frame = spark.createDataFrame([(1, "a b c d e"), (2, "A b c d e"), (3, "other words are here now")], "doc_id bigint, text string")
    for i, name in enumerate(names):
        frame = frame.withColumn(name, F.col("doc_id") * 100 + i)
    got = simhash.one_of_each(frame)
    assert got.columns == frame.columns
    rows = sorted(tuple(r) for r in got.collect())
    assert [r[0] for r in rows] == [1, 3] and all(r[2:] == tuple(r[0] * 100 + i for i in range(len(names))) for r in rows)
