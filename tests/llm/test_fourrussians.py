"""Hard negatives against plain sums, and the tables against plain products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gyrespark.llm import fourrussians as fr

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def expected(rows, anchor):
    fine = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows
            if v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda t: (-t[1], t[0] is None, t[0] or 0)
    out = set()
    for a, v, y in {(i, tuple(v), y) for i, v, y in fine if i is not None and i % anchor == 0}:
        score = lambda w: sum(p * q for p, q in zip(v, w))  # noqa: B023,E731
        near = sorted({(i, score(w)) for i, w, z in fine if z == y and i != a}, key=key)[:5]
        for p, ps in near:
            far = sorted({(i, score(w)) for i, w, z in fine if z != y and 30 * ps <= 100 * score(w) <= 90 * ps}, key=key)[:10]
            out |= {(a, p, r + 1, i, ps, s) for r, (i, s) in enumerate(far)}
    return out


def found(spark, rows, anchor, **more):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = fr.hard_negatives(fr.prepared(frame), F.col("id") % anchor == 0, **more)
    return {tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()}


def vectors(seed, n, d, values):
    rng = random.Random(seed)
    return [(i, [rng.choice(values) if rng.random() < 0.3 else rng.gauss(0.05, 0.2) for _ in range(d)], rng.choice([0, 0, 0, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("d,lanes_block", [(64, 4_096), (13, 3), (1, 2)])
def test_against_plain_sums(spark, d, lanes_block):
    rows = vectors(d, 150, d, [0.0, 0.5, -1.0, 1.0])
    assert found(spark, rows, 10, share_rows=40, block=lanes_block) == expected(rows, 10)


def test_odd_rows(spark):
    rows = vectors(3, 60, 6, [0.0, 7.5, -300.25])
    rows += [(None, [0.5] * 6, 0), (70, None, 1), (80, [0.1] * 6, None), (90, [float("nan")] * 6, 0), (100, [float("inf")] * 6, 0), (110, [None] * 6, 0),
             (120, [], 1), (130, [0.3, 0.4], 1), (140, [1e6] * 6, 2), (10, rows[10][1], rows[10][2]), (11, rows[11][1], rows[11][2]), (12, rows[12][1], 1)]
    assert found(spark, rows, 10) == expected(rows, 10)


def test_ties_by_id(spark):
    rows = [(i, [1.0, 0.5], 0) for i in range(20)] + [(i, [0.5, 0.25], 1) for i in range(20, 60)]
    assert found(spark, rows, 20, share_rows=5) == expected(rows, 20)


def test_clashing_columns_and_empty_table(spark):
    frame = spark.createDataFrame([(i, [0.1 * i], i % 2, i, i, i, i) for i in range(300)], SCHEMA + ", id int, x int, anchor int, cell int")
    assert fr.op12(frame).count() > 0
    assert fr.op12(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tables():
    rng = np.random.default_rng(1)
    for top in (3, 300, 2**40):
        x, a = rng.integers(-top, top, (40, 24)), rng.integers(-top, top, (7, 24))
        with np.errstate(over="ignore"):
            assert (fr.scores(fr.planes_of(x), fr.tables_of(a)) == x @ a.T).all()
        assert (fr.integers_of(fr.planes_of(x)) == x).all()
