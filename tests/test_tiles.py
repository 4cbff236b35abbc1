"""Tiled labelling, maxima and radii: what must not be done, and results against plain loops."""

import numpy as np
import pandas as pd
import pytest

from gyrespark.operators import grid, labelling, nodes


def test_one_tile_needs_no_graph(spark, monkeypatch):
    """Halo tiles without own cells must not send a grid that lies in one tile through the component graph."""
    def unwanted(*_):
        raise AssertionError("no component crosses a border")

    monkeypatch.setattr(labelling, "connected_labels", unwanted)
    rows = [(s, y, x, 1.0) for s in (1, 2) for y in range(7) for x in range(50) if x % 10 < 6]
    df = spark.createDataFrame(rows, "slice int, y int, x int, crit double")
    got = labelling.label_cells(df, ["slice"], "crit", 1.0, 3, 4).collect()
    assert {(r["slice"], r["y"], r["x"]): r["cluster"] for r in got} == {(s, y, x): x // 10 + 1 for s, y, x, _ in rows}


def plain_maxima(cells, d):
    """Cells (slice, y, x) -> value that no cell of their sign beats within d."""
    out = set()
    for (s, y, x), v in cells.items():
        mine = (abs(v), -y, -x)
        near = [((s, y + j, x + i), j, i) for j in range(-d, d + 1) for i in range(-d, d + 1)]
        others = [(abs(cells[k]), -k[1], -k[2]) for k, _, _ in near if k in cells and np.sign(cells[k]) == np.sign(v)]
        if max(others) == mine:
            out.add((s, y, x, v))
    return out


@pytest.mark.parametrize("d", [1, 2, 9])
def test_maxima_across_tiles(spark, d):
    rng = np.random.default_rng(d)
    cells = {(s, y, x): int(rng.integers(-3, 4)) for s in (None, 1, 2) for y in range(-3, 12) for x in range(55, 150)}
    cells = {k: v for k, v in cells.items() if v}
    df = spark.createDataFrame([(*k, v, f"c{v}") for k, v in cells.items()], "slice int, y int, x int, u long, name string")
    found = grid.local_maxima(df, ["slice"], "u", d, ["name"])
    got = found.collect()
    assert found.columns == ["slice", "y", "x", "u", "name"] and all(r["name"] == f"c{r['u']}" for r in got)
    assert len(got) == len(set(got)) and {tuple(r)[:4] for r in got} == plain_maxima(cells, d)


def test_maxima_keep_no_copy_of_a_row_per_neighbour(spark):
    df = spark.range(10).selectExpr("id AS slice", "1 AS y", "CAST(id AS INT) AS x", "1.0 AS crit")
    plan = grid.local_maxima(df, ["slice"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Exchange") == 1


def test_maxima_of_repeated_cells(spark):
    rows = [(1, 0, 0, 2.0, 1), (1, 0, 0, 3.0, 2), (1, 0, 0, 3.0, 1), (1, 0, 1, 2.5, 7), (1, None, 5, 4.0, 8), (1, 0, None, 1.0, 9)]
    df = spark.createDataFrame(rows, "slice int, y int, x int, crit double, cluster int")
    got = {tuple(r) for r in grid.local_maxima(df, ["slice"], payload=["cluster"]).collect()}
    assert got == {(1, 0, 0, 3.0, 2), (1, None, 5, 4.0, 8), (1, 0, None, 1.0, 9)}


def test_radii_of_many_clusters_as_one_by_one():
    rng = np.random.default_rng(3)
    cells = pd.DataFrame([(s, c, y, x, float(rng.integers(1, 9))) for s in (1, 2) for c in (1, 2) for y in range(6) for x in range(5)],
                         columns=["site_slice", "site_cluster", "site_y", "site_x", "site_crit"])
    picked = cells.sample(16, random_state=1)
    peaks = pd.DataFrame({"slice": picked.site_slice, "cluster": picked.site_cluster, "y": picked.site_y, "x": picked.site_x,
                          "crit": picked.site_crit, "rad_eff": 3.0})
    many = nodes._radii_of_many(peaks, cells, ["slice", "cluster"], 100).set_index(["slice", "cluster", "y", "x"])["rad_eff"]
    for (s, c), p in peaks.groupby(["slice", "cluster"]):
        of = cells[(cells.site_slice == s) & (cells.site_cluster == c)].sort_values(["site_y", "site_x"])
        at, site = p[["x", "y"]].to_numpy(float), of[["site_x", "site_y"]].to_numpy(float)
        strongest = p.sort_values(["y", "x"])["crit"].idxmax()
        for i, (k, row) in enumerate(p.iterrows()):
            d = [(np.hypot(*(q - at[i])), q[1], q[0]) for q in at if (q != at[i]).any()]
            want = 3.0
            if d and k != strongest:
                _, ty, tx = min(d)
                path = np.linspace(at[i], (tx, ty), 100)
                weak = [of["site_crit"].to_numpy()[((site - b) ** 2).sum(axis=1).argmin()] for b in path]
                want = max(1.0, np.hypot(*(at[i] - path[int(np.argmin(weak))])))
            assert many[(s, c, row["y"], row["x"])] == pytest.approx(want)
