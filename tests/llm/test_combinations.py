"""Jaccard groups against all pairs, and the prefixes against their promise."""

import random
import re

import numpy as np
import pytest

from gyrespark.llm import combinations as jc


def expected(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc))
    return sorted(out, key=str)


def found(spark, rows, **more):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    return sorted((tuple(r) for r in jc.jaccard_groups(frame, **more).collect()), key=str)


def corpus(seed, families, copies, words, edits):
    rng = random.Random(seed)
    rows, lines = [], [" ".join(f"l{i}w{j}" for j in range(12)) for i in range(6)]
    for f in range(families):
        base = [f"f{f}w{rng.randrange(400)}" for _ in range(rng.randrange(1, words))]
        for _ in range(rng.randrange(1, copies)):
            w = list(base)
            for _ in range(rng.randrange(edits)):
                w[rng.randrange(len(w))] = f"x{rng.random()}"
            rows.append(" ".join(w + rng.sample(lines, rng.randrange(3))))
    rows += [None, "", " \n", "a b c", "A b  c", "one", "one two three four", "É é É é", "é é é é"] + [rng.choice(lines).upper() for _ in range(5)]
    rows += rng.sample(rows, 10)
    rng.shuffle(rows)
    return [(None if rng.random() < 0.05 else i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,pool", [(1, 2_000_000), (2, 600)])
def test_against_all_pairs(spark, seed, pool):
    rows = corpus(seed, 25, 9, 160, 4)
    assert found(spark, rows, pool=pool) == expected(rows)


def test_one_large_group_in_small_pools(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(120):  # a chain: neighbours are similar, far ones are not
        w = list(base)
        for j in range(i // 4):
            w[j * 4] = f"y{j}"
        if rng.random() < 0.3:
            w[-1] = f"z{i}"
        rows.append((i, " ".join(w)))
    assert found(spark, rows, pool=900) == expected(rows)


def test_long_text_and_clashing_columns(spark):
    long = " ".join(f"v{i % 70_001}" for i in range(150_000))
    rows = [(1, long), (2, long + " end"), (3, "short one here now ok yes and so on")]
    frame = spark.createDataFrame([(*r, 1, 2, 3, "k") for r in rows], "doc_id bigint, text string, n int, node int, s1 int, key string")
    assert {r.doc_id: r.component_id for r in jc.op11(frame).collect()} == {1: 1, 2: 1, 3: 3}


def test_empty_table(spark):
    assert found(spark, []) == []


def test_similar_sets_share_a_signature():
    """For any frequencies and sizes, with tokens of all classes."""
    rng = np.random.default_rng(3)
    for n in (6, 7, 20, 59, 60, 61, 90, 400, 1500):
        for _ in range(40):
            miss = int(jc.allowed(n))
            size = n + int(rng.integers(0, miss + 1))
            tokens = rng.integers(0, 2**64, size + 300, dtype=np.uint64)
            level = rng.choice([0, 1, 4, 6, 9, 11, 14, 17, 30] if rng.random() < 0.7 else [6, 11, 17], len(tokens)).astype(np.uint8)
            least = -(-85 * (n + size) // 185)
            a = np.arange(n)
            b = np.r_[rng.choice(n, least, replace=False), n + np.arange(size - least)]
            level[np.setdiff1d(a, b)] = level[np.setdiff1d(b, a)] = 0
            level[np.intersect1d(a, b)] = np.maximum(level[np.intersect1d(a, b)], 1)
            edges = jc.size_bands(10_000)
            signed = []
            for own in (a, b):
                own = own[np.argsort(tokens[own])]
                band = int(np.searchsorted(edges, len(own), side="right")) - 1
                signed.append(set().union(*(jc.signatures(tokens[own], level[own], x, edges).tolist() for x in {band, max(band - 1, 0)})))
            assert signed[0] & signed[1]
            assert len(signed[0]) < 40 * n


def test_bitmaps_only_reject():
    rng = np.random.default_rng(1)
    for _ in range(100):
        both, a, b = (rng.integers(0, 2**64, int(rng.integers(1, 300)), dtype=np.uint64) for _ in range(3))
        differ = np.bitwise_count(jc.parity(np.r_[both, a]) ^ jc.parity(np.r_[both, b])).sum()
        assert differ <= len(a) + len(b)


def test_groups_alike_at_both_sizes(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(5, 5)]
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    assert sorted(map(tuple, jc.grouped(frame).collect())) == sorted(map(tuple, jc.grouped(frame, 10).collect()))
