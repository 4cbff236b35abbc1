"""Tiled labelling against a plain DBSCAN."""

import numpy as np
import pyarrow as pa
import pytest

from gyrespark.operators import labelling
from gyrespark.operators.labelling import label_cells
from gyrespark.plans import sweep


def brute(cells, eps, min_samples, size_filter):
    out = {}
    for sign in (1, -1):
        pts = sorted((y, x) for (y, x), v in cells.items() if np.sign(v) == sign)
        arr = np.array(pts, dtype=float).reshape(-1, 2)
        near = [np.flatnonzero(((arr - p) ** 2).sum(axis=1) <= eps * eps) for p in arr]
        core = [len(n) >= min_samples for n in near]
        label = [-1] * len(pts)
        k = 0
        for i in range(len(pts)):
            if label[i] != -1 or not core[i]:
                continue
            stack = [i]
            while stack:
                j = stack.pop()
                if label[j] != -1:
                    continue
                label[j] = k
                if core[j]:
                    stack += [n for n in near[j] if label[n] == -1]
            k += 1
        sizes = {c: label.count(c) for c in set(label) if c >= 0}
        order = {}
        for i, c in enumerate(label):
            if c >= 0 and sizes[c] >= size_filter:
                order.setdefault(c, len(order) + 1)
                out[pts[i]] = sign * order[c]
    return out


@pytest.mark.parametrize("eps,min_samples,density,tile", [(1.0, 3, 0.5, 8), (1.5, 4, 0.45, 5), (2.0, 5, 0.4, 64), (3.0, 8, 0.3, 7)])
def test_matches_plain_dbscan(spark, eps, min_samples, density, tile):
    rng = np.random.default_rng(int(eps * 10) + tile)
    rows, want = [], {}
    for s in range(3):
        field = np.where(rng.random((25, 30)) < density, rng.choice([-2.0, 1.0, 3.0], (25, 30)), 0.0)
        cells = {(y, x): field[y, x] for y in range(25) for x in range(30) if field[y, x] != 0}
        rows += [(s, y, x, float(v)) for (y, x), v in cells.items()]
        for at, c in brute(cells, eps, min_samples, 4).items():
            want[(s, *at)] = c
    df = spark.createDataFrame(rows, "slice int, y int, x int, crit double")
    got = {(r["slice"], r["y"], r["x"]): r["cluster"] for r in label_cells(df, ["slice"], "crit", eps, min_samples, 4, tile).collect()}
    assert got == want


def test_a_tile_returns_a_row_per_component():
    at = [(y, x) for y in range(7) for x in range(20) if x != 10]
    table = pa.table({"slice": [1] * len(at), "_sign": pa.array([1] * len(at), pa.int32()), "y": pa.array([y for y, _ in at], pa.int32()),
                      "x": pa.array([x for _, x in at], pa.int32()), "crit": [1.0] * len(at), "_ty": [0] * len(at), "_tx": [0] * len(at)})
    out = pa.Table.from_batches(labelling._label_part(iter(table.to_batches()), ["slice"], 1.0, 3, 64, -2)).to_pylist()
    assert [(r["kind"], r["comp"], r["first"], len(r["cells"])) for r in out] == [(0, 0, 0, 70), (0, 11, 11, 63)]


@pytest.mark.parametrize("tile", [2, 3, 64])
def test_any_tiles_give_the_same_labels(spark, tile):
    rng = np.random.default_rng(7)
    cells = {(y, x): float(rng.choice((-1, 2))) for y in range(-9, 9) for x in range(18) if rng.random() < 0.6}
    rows = [(s, y, x, v) for s in (4, None) for (y, x), v in cells.items()] + [(4, None, 1, 1.0), (4, 0, None, 1.0)]
    df = spark.createDataFrame(rows, "slice int, y int, x int, crit double")
    got = label_cells(df, ["slice"], "crit", 1.0, 3, 1, tile, "n").collect()
    want = brute(cells, 1.0, 3, 1)
    assert len(got) == len(want) and {(r["y"], r["x"]): r["cluster"] for r in got} == want
    sizes = list(want.values())
    assert all(r["slice"] == 4 and r["crit"] == cells[r["y"], r["x"]] and r["n"] == sizes.count(r["cluster"]) for r in got)


def test_counted_cells_are_tagged_where_they_are(spark):
    rows = [(1, 0, x, c, n) for c, n in ((1, 4), (2, 9), (-1, 2)) for x in range(n)]
    df = spark.createDataFrame(rows, "slice int, y int, x int, cluster int, n long")
    tagged = sweep.size_variants(df, ["slice"], [3, 8], "n")
    assert "Exchange" not in tagged._jdf.queryExecution().executedPlan().toString()
    plain = sweep.size_variants(df.drop("n"), ["slice"], [3, 8])
    assert set(tagged.columns) == set(plain.columns)
    assert sorted(map(tuple, tagged.select(plain.columns).collect())) == sorted(map(tuple, plain.collect())) != []
