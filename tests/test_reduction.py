"""Pairs left out where only a selection is asked for, joins whose copies must not be broadcast, distances by a product."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_pairs import ARGS, frame, tracks

from gyrespark.operators import grid, joins, linking, pairs, quality, ranking, skill


@pytest.fixture(scope="module")
def sets(spark):
    ref, own = tracks(7, 60, 0), tracks(8, 70, 0)
    ref += [(None, t, x, y) for k, t, x, y in ref if k == 3]
    return frame(spark, ref), frame(spark, own)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_spans_reach_pairs_without_a_shuffle_of_pairs(spark, sets):
    a, b = sets
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        matches = skill.catalogue_match(a, b, *ARGS, 700.0, 600.0, 1, spans=True)
        for made in (skill.common_time_distance(a, b, *ARGS), skill.interval_matches(a, b, *ARGS, 2.0, 10.0),
                     skill.duration_ratios(matches, a, b, *ARGS[:3])):
            assert "Exchange" not in plan(made).split("FlatMapGroupsInArrow")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plain = skill.duration_ratios(skill.catalogue_match(a, b, *ARGS, 700.0, 600.0, 1), a, b, *ARGS[:3])
    found = skill.duration_ratios(matches, a, b, *ARGS[:3])
    columns = ["id_ref", "id_own", "duration_ratio"]
    assert rows(found, *columns) == rows(plain, *columns) != []


@pytest.mark.parametrize("sizes", [{}, {"SMALL": 20, "GRID": 5, "STRIP": 64}, {"BLOCK_POINTS": 3}])
def test_left_out_pairs_are_not_missed(sets, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(pairs, name, value)
    a, b = sets
    bounds = (*ARGS, 1500.0, 1200.0, 1)
    whole = skill.catalogue_match(a, b, *bounds).cache()
    steps, some = (skill.catalogue_match(a, b, *bounds, best=k).cache() for k in ("steps", "some"))
    if "BLOCK_POINTS" not in sizes:  # where tracks are cut in time all pairs are made
        assert steps.count() < whole.count() and some.count() < whole.count()
    columns = ["id_ref", "id_own", "temp"]
    assert rows(ranking.best_matches(steps, "id_ref", "id_own"), *columns) == rows(ranking.best_matches(whole, "id_ref", "id_own"), *columns) != []
    for key in ("id_ref", "id_own"):
        assert rows(some.select(key).distinct(), key) == rows(whole.select(key).distinct(), key)
    columns = ["id_ref", "n_matches", "matched"]
    want = rows(skill.matches_per_reference(a, whole, "track"), *columns) if "track" in a.columns else rows(skill.matches_per_reference(a, whole, ARGS[0]), *columns)
    assert rows(skill.matches_per_reference(a, steps, ARGS[0]), *columns) == rows(skill.matches_per_reference(a, some, ARGS[0]), *columns) == want
    near = [skill.common_time_distance(a, b, *ARGS, closest=k) for k in (None, (40.0, 2))]
    near = [rows(ranking.closest_partner(m, "id_ref", "id_own", "n_common", "avg_dist", 40.0, 2), "id_ref", "id_own", "n_common") for m in near]
    assert near[0] == near[1] != []


def test_copies_of_nodes_are_not_broadcast(spark, monkeypatch):
    nodes = spark.createDataFrame([(k, f"2020-01-01 0{k % 4}:00:00", float(k % 5), 1.0 + k % 3) for k in range(40)], "node_id long, time string, lon double, lat double")
    seen, match = [], linking.dominant_matching
    monkeypatch.setattr(linking, "dominant_matching", lambda edges: (seen.append(plan(edges)), match(edges))[1])
    linking.stitch_nodes(nodes, [], "time", "lon", "lat", 3.0, 1.0, 2.0)
    assert seen and "Broadcast" not in seen[0]


def test_points_are_not_copied_for_the_nearest_cell(spark, monkeypatch):
    points = spark.range(500).select("id", (F.rand(1) * 360).alias("lon"), (F.rand(2) * 100 - 50).alias("lat"))
    points = spark.createDataFrame(points.toPandas())
    cells = spark.createDataFrame([(y, x, float(x * 9 + y), y * 7.0) for y in range(-4, 5) for x in range(40)], "y int, x int, glon double, glat double")
    seen, cut = [], grid.cut_lineage
    monkeypatch.setattr(grid, "cut_lineage", lambda df: (seen.append(plan(df)), cut(df))[1])
    got = {r.id: (r.y, r.x) for r in grid.nearest_grid_cell(points, cells, "id", "lon", "lat", "glon", "glat", 4.0).collect()}
    c, want = cells.toPandas(), {}
    for r in points.collect():
        gap = (c.glon - r.lon + 180) % 360 - 180
        best = c.assign(d=np.round(np.hypot(gap, c.glat - r.lat), 9)).sort_values(["d", "y", "x"]).iloc[0]
        want[r.id] = (best.y, best.x)
    assert got == want
    searches = [p for p in seen if "min_by" in p]
    assert searches and not any("BroadcastHashJoin" in p for p in searches)


def test_distances_by_a_product():
    rng = np.random.default_rng(3)
    f = rng.normal(size=(2048, 64)) + 1000.0
    f[100:200] = f[:100]
    f[200:300] = f[:100] + 1e-7
    one = pd.DataFrame({"id": np.arange(len(f)), "label": np.arange(len(f)) % 4, "f": list(f)})
    tracemalloc.start()
    d = quality._distances(one, one)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6  # the table of differences took 268 MB twice
    want = np.array([np.sqrt(((f - x) ** 2).sum(axis=1)) for x in f])
    np.testing.assert_allclose(d, want, rtol=1e-9, atol=0)
    near = quality._nearest(one.iloc[:400], one.sample(frac=1.0, random_state=1), 3)
    np.fill_diagonal(want, np.inf)
    order = np.argsort(want[:400], axis=1, kind="stable")[:, :3]
    assert near["other"].tolist() == order.ravel().tolist()
    assert near["dist"].tolist() == want[np.arange(400)[:, None], order].ravel().tolist()


def test_points_of_one_place_meet_once(spark):
    rng = np.random.default_rng(5)
    made = [[(k, f"2020-01-01 0{int(t)}:00:00", float(x), float(y)) for k, (t, x, y) in enumerate(rng.integers(0, 4, size=(n, 3)))] for n in (200, 300)]
    ref, own = (spark.createDataFrame(m + [(None, "2020-01-01 00:00:00", None, 1.0)], "track long, time string, lon double, lat double") for m in made)
    plain = joins.geo_time_pairs(ref, own, "track", "track", "time", "lon", "lat", 250.0)
    places = [joins.counted_positions(df, "time", "lon", "lat") for df in (ref, own)]
    near = joins.geo_time_pairs(*places, "n_points", "n_points", "time", "lon", "lat", 250.0).withColumn("n_pairs", F.col("id_ref") * F.col("id_own"))
    assert near.count() <= 4 * 16 * 16 < plain.count()
    got, want = skill.distance_report(near, weight="n_pairs").first(), skill.distance_report(plain).first()
    assert got.asDict() == pytest.approx(want.asDict())
    assert skill.distance_report(near.where("false"), weight="n_pairs").first().n_pairs == 0


def test_numbers_of_pairs_do_not_overflow(spark, monkeypatch):
    df = spark.createDataFrame([(k, k % 2, [float(k), 1.0]) for k in range(6)], "id long, label int, f array<double>")

    def many(key, a, b):  # as 100,000 rows return them
        return pd.DataFrame({"n": [5_000_000_000], "sd": [7.5e9], "sdd": [1.4e10], "sm": [4_500_000_000], "sdm": [7.0e9]})

    monkeypatch.setattr(quality, "_pair_sums", many)
    n, sd, sdd, sm, sdm = 5e9, 7.5e9, 1.4e10, 4.5e9, 7.0e9
    want = (n * sdm - sd * sm) / np.sqrt((n * sdd - sd * sd) * (n * sm - sm * sm))
    assert quality.hubert_gamma(df, "id", "label", "f").first().hubert_gamma == pytest.approx(want)


def test_rows_are_copied_for_blocks_not_for_tiles(spark):
    rng = np.random.default_rng(11)
    rows = [(int(k), int(rng.integers(0, 3)), [float(v) for v in rng.integers(0, 6, 3)]) for k in range(150)]
    df = spark.createDataFrame(rows, "id long, label int, f array<float>").cache()
    args = ("id", "label", "f")
    whole = [quality.silhouette(df, *args).first()[0], quality.connectivity(df, *args, 5).first()[0], quality.hubert_gamma(df, *args).first()[0]]
    tiled = [quality.silhouette(df, *args, 2).first()[0], quality.connectivity(df, *args, 5, 2).first()[0], quality.hubert_gamma(df, *args, 2).first()[0]]
    assert tiled == pytest.approx(whole)
    seen = quality._tiled(df, *args, lambda a, b: pd.DataFrame({"id": [len(a)], "n": [len(b)]}), "id long, n long", False, 2)
    assert seen.count() > 2_000 and "sequence(cast(0 as bigint), cast(9 as bigint)" in seen._jdf.queryExecution().analyzed().toString()  # 10 blocks of 75 tiles
