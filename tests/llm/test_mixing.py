"""Water-filling targets and taken words against plain Python and SQL."""

import duckdb
import pytest

from gyrespark.llm import mixing


def fill(sizes, weights, budget, most):
    target, capped = {}, set()
    while True:
        rest = budget - sum(most * sizes[s] for s in capped)
        total = sum(weights[s] for s in sizes if s not in capped)
        target = {s: most * sizes[s] if s in capped else rest * weights[s] / total for s in sizes}
        over = {s for s in sizes if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def frame_of(spark):
    rows = [(i, " ".join(["w"] * (i % 37 + 1)), ["b", "a", None, "c", "é", "zz"][i % 6 if i % 3 else 0], 5) for i in range(900)]
    rows += [(None, "x y", "a", 1), (5, None, "d", 1), (7, rows[7][1], rows[7][2], 5), (8, "", "d", 2)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, source string, target int")


def test_targets_and_taken(spark):
    rows, frame = frame_of(spark)
    got = mixing.op6(frame).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(s for s in sizes if s is not None) + [None]
    weights = {s: [3, 1, 2][i % 3] for i, s in enumerate(order)}
    want = fill(sizes, weights, 1.5 * sum(sizes.values()), 2)
    by_size = {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        by_size.setdefault((r.source_size, r.target), []).append(r)
    assert sorted(by_size) == sorted((sizes[s], pytest.approx(want[s])) for s in sizes)
    for (_, target), docs in by_size.items():
        assert abs(sum(r.taken for r in docs) - target) <= 37
    assert sorted(map(str, got)) == sorted(map(str, mixing.op6(frame).collect()))


def test_equals_sql(spark, tmp_path):
    _, frame = frame_of(spark)
    frame.toPandas().to_parquet(tmp_path / "d.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source FROM '{tmp_path}/d.parquet'")
    assert sorted(map(str, map(tuple, mixing.op6(frame).collect()))) == sorted(map(str, con.execute(mixing.SQL).fetchall()))


def test_mixture_repeats_rows(spark):
    rows, frame = frame_of(spark)
    mixed = mixing.mixture(frame)
    assert mixed.columns == frame.columns
    words = sum(len((r.text or "").split()) for r in mixed.collect())
    assert words == sum(r.taken for r in mixing.op6(frame).collect())
    empty = frame.limit(0)
    assert mixing.op6(empty).count() == 0 and mixing.mixture(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id bigint, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.op6(blank).collect()] == [(0, 0.0, 0)] * 2
