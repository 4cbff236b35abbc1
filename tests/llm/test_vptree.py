"""Vantage-point search against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from gyrespark.llm import vptree

SCHEMA = "vec_id bigint, embedding array<double>, score int"


def brute(rows, k, modulus):
    usable = {}
    for i, v, _ in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        usable[i] = min(usable.get(i, v), v)
    size = max(map(len, usable.values()))
    usable = {i: np.array(v) for i, v in usable.items() if len(v) == size}
    out = []
    for q in sorted(usable):
        if q % modulus == 0:
            ids = [i for i in usable if i != q]
            score = vptree.cosine(np.repeat(usable[q][None], len(ids), 0), np.stack([usable[i] for i in ids]))
            best = sorted(zip(-score, ids))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def table(n, dims, seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, dims))
    rows = [(i, (centre[i % 12] + 0.3 * rng.normal(size=dims)).tolist(), 1) for i in range(n)]
    rows += [(n + i, rows[7][1], 1) for i in range(200)]  # one very common vector
    rows += [(n + 300, None, 1), (n + 301, [], 1), (n + 302, [0.0] * dims, 1), (n + 303, [math.nan] * dims, 1), (n + 304, [math.inf] * dims, 1),
             (n + 305, [None] * dims, 1), (None, rows[0][1], 1), (n + 306, [1.0], 1), (3, rows[3][1], 1), (50, rows[9][1], 1)]
    return rows


def test_equals_brute_force(spark):
    rows = table(900, 8, 1)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = vptree.nearest(frame, F.col("vec_id") % 20 == 0, shard=100, query_block=16)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 20)
    assert sorted(map(tuple, vptree.op9(frame).collect())) == brute(rows, 5, 50)


def test_relaxed_factor_keeps_recall(spark):
    rows = table(1500, 8, 2)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {(r.query_id, r.vec_id) for r in vptree.nearest(frame, F.col("vec_id") % 20 == 0, factor=1.5, shard=200).collect()}
    want = {(q, i) for q, _, i, _ in brute(rows, 5, 20)}
    assert len(got & want) / len(want) > 0.9


def test_pruning_skips_leaves():
    rng = np.random.default_rng(3)
    points = vptree.unit(rng.normal(size=(20, 6))[rng.integers(0, 20, 4000)] + 0.05 * rng.normal(size=(4000, 6)))
    tree = vptree.Tree(points)
    reached = [sum(len(at) for _, at in tree.reach(points[:50], np.full(50, 0.1), f)) for f in (1.0, 4.0)]
    assert reached[1] <= reached[0] < 50 * len(tree.leaf_nodes) / 3


def test_small_tables(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0], 1), (7, [1.0, 1.0], 1)], SCHEMA)
    assert [(r.query_id, r.rank, r.vec_id) for r in vptree.op9(frame).collect()] == [(0, 1, 7)]
    assert vptree.op9(frame.limit(1)).count() == 0 and vptree.op9(frame.limit(0)).count() == 0
    assert vptree.op9(frame.where("vec_id = 7")).count() == 0
    tiny = spark.createDataFrame([(0, [1e-200, 0.0], 1), (1, [1e200, 1e200], 1)], SCHEMA)
    assert abs(vptree.op9(tiny).first().score - math.sqrt(0.5)) < 1e-12


def test_radius_covers_rounded_cosines():
    best = vptree.Best(1, 1, np.array([np.inf]))
    near = 1 - 4e-13  # rounds to 1, though about 9e-7 away
    best.offer(np.array([0]), np.array([[near]]), np.array([5]), np.array([0]), np.array([-1]))
    assert best.radius(np.array([0]))[0] >= vptree.apart(np.array([near]))[0] > 1e-7
