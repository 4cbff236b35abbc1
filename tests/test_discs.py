"""Percentiles of discs, taken tile by tile, against plain loops and the join."""

import numpy as np
import pytest

from gyrespark.operators import aggregate

CONFIG = {"low": ("u", "p5"), "mid": ("u", "median"), "range": ("u", "delta"), "mean": ("u", "mean"), "least": ("u", "min"), "most": ("u", "max"),
          "total": ("u", "sum"), "n": ("u", "count"), "std": ("u", "std"), "spread": ("v", "std_pop")}


def tables(spark):
    rng = np.random.default_rng(8)
    grid = [(s, y, x, None if rng.random() < 0.05 else float(rng.integers(-4, 5)), float(rng.normal()))
            for s in (1, 2, None) for y in range(-3, 9) for x in range(40, 150) if rng.random() < 0.9]
    grid += [(1, None, 60, 1.0, 1.0), (1, 2, 60, float("nan"), float("inf")), (1, 3, 61, 5.0, 5.0)]
    places = [(s, y + 0.5 * (x % 2), float(x), float(x % 4)) for s in (1, 2, 3, None) for y in (-3, 2, 8) for x in range(35, 155, 7)]
    places += [(1, None, 60.0, 2.0), (1, 2.0, 60.0, None), (1, 2.0, 900.0, 2.0), (1, 2.0, 60.0, -1.0)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(places)] + [(None, 1, 2.0, 60.0, 2.0)], "pid long, slice int, y double, x double, rad double")
    return points, spark.createDataFrame(grid, "slice int, gy int, gx int, u double, v double")


def run(points, grid, config):
    return aggregate.disc_aggregate(points, grid, ["slice"], "pid", "x", "y", "rad", "gx", "gy", config, 4.0, vectors={"w": ("u", "v")})


def test_discs_equal_the_join(spark, monkeypatch):
    points, grid = tables(spark)
    found = run(points, grid, CONFIG)
    monkeypatch.setattr(aggregate, "DISC_CELLS", 50)
    small = run(points, grid, CONFIG)
    monkeypatch.setattr(aggregate, "MOMENTS", ())
    plain = run(points, grid, CONFIG)
    assert found.columns == plain.columns and [f.dataType for f in found.schema] == [f.dataType for f in plain.schema]
    key = lambda r: (r["pid"] is None, r["pid"] or 0)
    wanted = sorted(plain.collect(), key=key)
    for out in (found, small):
        rows = sorted(out.collect(), key=key)
        assert len(rows) == len(wanted)
        for a, b in zip(rows, wanted):
            assert [v is None for v in a] == [v is None for v in b]
            assert [v for v in a if v is not None] == pytest.approx([v for v in b if v is not None], abs=1e-9)


def test_cells_of_discs_are_not_shuffled(spark):
    points, grid = tables(spark)
    plan = run(points, grid, CONFIG)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "percentile" not in plan


def test_repeated_points_share_their_discs(spark):
    points, grid = tables(spark)
    twice = points.where("pid IN (10, 30)").selectExpr("1L AS pid", "slice", "y", "x", "rad")
    rows = run(twice, grid, {"mid": ("u", "median")}).collect()
    assert len(rows) == 2 and rows[0]["n_cells"] == rows[1]["n_cells"] and rows[0]["mid"] == rows[1]["mid"]
