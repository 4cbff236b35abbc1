"""Pair search of two track sets against loops over all pairs, and its join keys."""

import math
import re
from datetime import datetime, timedelta

import numpy as np
import pytest

from gyrespark.operators import joins, pairs, skill

START = datetime(2020, 1, 1)


def tracks(seed, n, minutes):
    """(track, time, lon, lat) of walks near the date line and a pole; some positions are missing."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        lon, lat = (rng.uniform(170, 190), rng.uniform(-10, 10)) if k % 3 else (rng.uniform(0, 360), rng.uniform(80, 89))
        at = START + timedelta(hours=int(rng.integers(0, 24)))
        for i in range(int(rng.integers(3, 9))):
            where = (None, None) if rng.random() < 0.03 else (float((lon + 180) % 360 - 180), float(min(lat, 90.0)))
            rows.append((k, at + timedelta(hours=i, minutes=int(rng.integers(0, minutes + 1))), *where))
            lon, lat = lon + rng.normal(0, 0.7), lat + rng.normal(0, 0.7)
    return rows


def km(a, b):
    if None in (*a, *b):
        return math.inf
    (x, y), (u, v) = a, b
    h = math.sin(math.radians(v - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(v)) * math.sin(math.radians(u - x) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def flat(a, b):
    return math.inf if None in (*a, *b) else math.hypot(a[0] - b[0], a[1] - b[1])


def nearest(ref, own, tolerance):
    """{(ref track, own track): positions of each reference point and its nearest in time}"""
    out = {}
    for k, t, *p in ref:
        best = {}
        for j, u, *q in own:
            gap = abs((t - u).total_seconds())
            if gap <= tolerance * 3600 and (j not in best or (gap, u) < best[j][0]):
                best[j] = ((gap, u), q)
        for j, (_, q) in best.items():
            out.setdefault((k, j), []).append((p, q))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "track int, time timestamp_ntz, lon double, lat double")


@pytest.fixture(scope="module")
def sets(spark):
    ref, own = tracks(1, 40, 40), tracks(2, 50, 40)
    return ref, own, frame(spark, ref), frame(spark, own)


ARGS = ("track", "track", "time", "lon", "lat")


def test_nearest_points_equal_a_loop(sets):
    ref, own, a, b = sets
    got = {(r.id_ref, r.id_own): (r.n_steps, r.avg_dist) for r in skill.nearest_point_matches(a, b, *ARGS, 3.0, 1.5, 2).collect()}
    want = {}
    for pair, points in nearest(ref, own, 1.5).items():
        d = [flat(p, q) for p, q in points if flat(p, q) <= 3.0]
        if len(d) >= 2:
            want[pair] = (len(d), pytest.approx(sum(d) / len(d)))
    assert want and got == want


def test_all_points_close_equals_a_loop(sets):
    ref, own, a, b = sets
    got = {(r.id_ref, r.id_own): r.n_steps for r in skill.all_points_close(a, b, *ARGS, 700.0, 1.5, 2).collect()}
    want = {pair: len(points) for pair, points in nearest(ref, own, 1.5).items()
            if len(points) >= 2 and all(km(p, q) <= 700.0 for p, q in points)}
    assert want and got == want
    assert any({ref_lon > 0 for ref_lon in (p[0], q[0])} == {True, False} for pair in want for p, q in nearest(ref, own, 1.5)[pair])  # over the date line


def test_interval_and_reduced_distances_equal_a_loop(spark):
    ref, own = tracks(3, 40, 0), tracks(4, 50, 0)
    a, b = frame(spark, ref), frame(spark, own)
    common = {}
    for k, t, *p in ref:
        for j, u, *q in own:
            if t == u and None not in (*p, *q):
                common.setdefault((k, j), []).append((p, q))
    mean = {pair: sum(flat(p, q) for p, q in pts) / len(pts) for pair, pts in common.items()}
    got = {(r.id_ref, r.id_own): r.avg_dist for r in skill.interval_matches(a, b, *ARGS, 2.0, 10.0).collect()}
    assert got == {pair: pytest.approx(2 * m) for pair, m in mean.items() if 2 * m <= 10.0} and got

    def reduced(points):
        d = np.array([km(p, q) for p, q in points])
        return d[d <= d.mean() + 2 * d.std() + 1e-9].mean()

    want = {pair: pytest.approx(reduced(pts)) for pair, pts in common.items() if reduced(pts) <= 500.0}
    got = {(r.id_ref, r.id_own): r.rmcpd for r in skill.reduced_mean_distance(a, b, *ARGS, max_km=500.0).collect()}
    assert want and got == want
    asked = spark.createDataFrame([*list(want)[:3], (0, 999)], "id_ref int, id_own int")
    some = {(r.id_ref, r.id_own): r.rmcpd for r in skill.reduced_mean_distance(a, b, *ARGS, wanted=asked).collect()}
    assert some == {**{p: want[p] for p in list(want)[:3]}, (0, 999): math.inf}


def test_limits_are_inclusive_and_tables_may_be_empty(spark):
    row = lambda k, x, y: (k, START, float(x), float(y))
    a, b = frame(spark, [row(0, 0, 0), row(1, -7, -7)]), frame(spark, [row(5, 3, 4), row(5, 3, 4), row(6, -10, -3), row(7, 0, 0)])
    pairs = lambda d: {tuple(r) for r in joins.close_tracks(a, b, *ARGS, d).collect()}
    assert pairs(5.0) == {(0, 5), (0, 7), (1, 6)} and pairs(4.999) == {(0, 7)} and pairs(0.0) == {(0, 7)}
    assert joins.close_tracks(a.limit(0), b, *ARGS, 5.0).count() == 0
    assert skill.all_points_close(a, b.limit(0), *ARGS, 700.0, 1.0, 1).count() == 0


def test_no_join_on_time_alone(sets):
    _, _, a, b = sets
    frames = [skill.nearest_point_matches(a, b, *ARGS, 3.0, 1.5, 2), skill.all_points_close(a, b, *ARGS, 700.0, 1.5, 2),
              skill.interval_matches(a, b, *ARGS), skill.reduced_mean_distance(a, b, *ARGS, max_km=500.0)]
    for made in frames:
        plan = made._jdf.queryExecution().executedPlan().toString()
        keys = [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Join \[([^\]]*)\]", plan)]
        assert keys and not any(k in ("_b", "t", "t_ref", "time") for k in keys), keys
        assert any("_cell" in k for k in keys)


def test_distance_of_a_missing_position_is_null(spark):
    from gyrespark.functions import geo

    rows = [(0.0, 0.0, 0.0, 0.0), (None, 0.0, 0.0, 0.0), (0.0, 0.0, 5.0, None), (0.0, 0.0, 180.0, 0.0)]
    got = spark.createDataFrame(rows, "a double, b double, c double, d double").select(geo.haversine_km("a", "b", "c", "d").alias("km")).collect()
    assert [r.km for r in got] == [0.0, None, None, pytest.approx(math.pi * 6371.0)]


def test_resampled_paths_equal_a_loop_and_copy_no_points(spark, monkeypatch):
    ref, own = tracks(5, 30, 0), tracks(6, 35, 0)
    ref += [(90, START, 171.0, 1.0)]  # one point
    ref, own = ([(k, t, None if n % 11 == 3 else x, None if n % 13 == 5 else y) for n, (k, t, x, y) in enumerate(rows)] for rows in (ref, own))
    a, b = frame(spark, ref), frame(spark, own)
    matches = skill.interval_matches(a, b, *ARGS, 2.0, 30.0).cache()
    monkeypatch.setattr(pairs, "WHOLE_TRACKS", 8)
    monkeypatch.setattr(pairs, "PAIRS", 100)
    made = skill.path_similarity(matches, a, b, *ARGS, length=5)
    got = {(r.id_ref, r.id_own): r.path_score for r in made.collect()}

    def path(points, key, low, high):
        inside = sorted((t, *p) for k, t, *p in points if k == key and low <= t <= high)
        out = []
        for s in range(5):
            at, part = divmod(s * (len(inside) - 1), 4)
            p, q = inside[at][1:], inside[at + 1][1:] if part else inside[at][1:]
            out.append(None if None in p else tuple(u if v is None else u + (v - u) * part / 4 for u, v in zip(p, q)))
        return out

    def cosine(p, q, r, s):
        if None in (p, q, r, s):
            return 0.0
        u, v = (q[0] - p[0], q[1] - p[1]), (s[0] - r[0], s[1] - r[1])
        size = math.hypot(*u) * math.hypot(*v)
        return (u[0] * v[0] + u[1] * v[1]) / size if size else 0.0

    want = {}
    for m in matches.collect():
        low, high = max(m.ref_start, m.own_start), min(m.ref_end, m.own_end)
        u, v = path(ref, m.id_ref, low, high), path(own, m.id_own, low, high)
        want[m.id_ref, m.id_own] = pytest.approx(sum(cosine(u[k], u[k + 1], v[k], v[k + 1]) for k in range(4)) / 8 + 0.5)
    assert len(want) > 50 and got == want
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Window" not in plan


def test_the_best_composite_partner_is_chosen_in_the_blocks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "SMALL", 40)
    a, b = frame(spark, tracks(7, 50, 0)), frame(spark, tracks(8, 60, 0))
    whole = skill.interval_matches(a, b, *ARGS, 2.0, 30.0)
    few = skill.interval_matches(a, b, *ARGS, 2.0, 30.0, (25.0, 6.0))
    assert few.columns == whole.columns and few.count() < whole.count()
    best = [{r.id_ref: (r.id_own, r.n_common, r.composite_score) for r in skill.best_composite_match(m, 25.0, 6.0).collect()} for m in (whole, few)]
    assert best[0] == best[1] != {}


def test_points_near_references_are_counted_without_copies(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(None if k == 5 else k, None if rng.random() < 0.02 else START + timedelta(hours=int(h))) for k in range(30) for h in rng.integers(0, 400, 12)]
    points = spark.createDataFrame(rows, "track int, time timestamp_ntz")
    refs = [(100 + k, START + timedelta(hours=int(h)), START + timedelta(hours=int(h + n))) for k, (h, n) in enumerate(rng.integers(0, 300, (20, 2)))]
    refs += [(None, START, START), (300, START + timedelta(days=900), START + timedelta(days=901)), (301, None, START)]
    spans = spark.createDataFrame(refs, "track int, a timestamp_ntz, b timestamp_ntz")
    want, day = {}, timedelta(days=1)
    for key, low, high in refs:
        inside = [k for k, t in rows if low is not None and t is not None and low - day <= t <= high + day]
        if inside:
            want[key] = (len(inside), len(set(inside) - {None}))
    for blocks in (1, 7):
        monkeypatch.setattr(joins, "COUNT_BLOCKS", blocks)
        monkeypatch.setattr(joins, "COUNT_POINTS", 360 // blocks)
        monkeypatch.setattr(joins, "COUNT_SPANS", 24 // min(blocks, 3))
        near = joins.tracks_near(points, spans, "time", "a", "b", "track", 1.0, counted=True)
        assert {r.id_ref: (r.n_points, r.n_tracks) for r in near.collect()} == want
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
