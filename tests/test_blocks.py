"""Pair statistics dealt over blocks: results against loops, and no shuffle of pair rows."""

import math

import pytest
from test_pairs import ARGS, flat, frame, km, nearest, tracks

from gyrespark.operators import pairs, skill


@pytest.fixture(scope="module")
def sets(spark):
    ref, own = tracks(7, 60, 0), tracks(8, 70, 0)
    ref += [(None, t, x, y) for k, t, x, y in ref if k == 3]  # a track without a number is a track
    return ref, own, frame(spark, ref), frame(spark, own)


def common(ref, own):
    out = {}
    for k, t, *p in ref:
        for j, u, *q in own:
            if t == u:
                out.setdefault((k, j), []).append((p, q))
    return out


def test_pair_rows_are_not_shuffled(sets):
    _, _, a, b = sets
    for made in (skill.catalogue_match(a, b, *ARGS, 700.0, 600.0, 1), skill.common_time_distance(a, b, *ARGS),
                 skill.reduced_mean_distance(a, b, *ARGS), skill.nearest_point_matches(a, b, *ARGS, 3.0, 1.5, 2),
                 skill.all_points_close(a, b, *ARGS, 700.0, 1.5, 2), skill.interval_matches(a, b, *ARGS, 2.0, 10.0)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan
        assert not [s for s in plan.split("\n") if "hashpartitioning(id_ref" in s and "id_own" in s]


@pytest.mark.parametrize("sizes", [{}, {"SMALL": 20, "GRID": 5}, {"SMALL": 20, "GRID": 3, "BLOCK_POINTS": 3}, {"BLOCK_TRACKS": 9, "BLOCK_MATCHES": 40}])
def test_any_blocks_equal_a_loop(sets, monkeypatch, sizes):
    ref, own, a, b = sets
    for name, value in sizes.items():
        monkeypatch.setattr(pairs, name, value)
    got = {(r.id_ref, r.id_own): (r.temp, r.dist) for r in skill.catalogue_match(a, b, *ARGS, 700.0, 600.0, 2).collect()}
    want = {}
    for pair, points in common(ref, own).items():
        d = [km(p, q) for p, q in points if km(p, q) <= 700.0]
        if len(d) >= 2 and sum(d) / len(d) <= 600.0:
            want[pair] = (len(d), pytest.approx(sum(d) / len(d)))
    assert got == want and any(k is None for k, _ in want)

    got = {(r.id_ref, r.id_own): (r.n_common, r.avg_dist) for r in skill.common_time_distance(a, b, *ARGS).collect() if r.id_ref is not None}
    want = {}
    for (k, j), points in common(ref, own).items():
        d = [x for x in (flat(p, q) for p, q in points) if x < math.inf]
        if k is not None:
            want[k, j] = (len(points), pytest.approx(sum(d) / len(d)) if d else None)
    assert got == want

    got = {(r.id_ref, r.id_own): (r.n_steps, r.median_km) for r in skill.all_points_close(a, b, *ARGS, 900.0, 1.5, 2).collect()}
    want = {}
    for pair, points in nearest(ref, own, 1.5).items():
        d = sorted(km(p, q) for p, q in points)
        if pair[0] is not None and len(d) >= 2 and d[-1] <= 900.0:  # points of no track match none
            want[pair] = (len(d), pytest.approx((d[(len(d) - 1) // 2] + d[len(d) // 2]) / 2))
    assert got == want


def test_several_limits_and_points_of_one_time(spark, sets):
    ref, own, *_ = sets
    ref, own = [r for r in ref if r[0] is not None] * 2, own + own[:50]
    got = {(r.which, r.id_ref, r.id_own): (r.n, r.avg_dist)
           for r in pairs.common_time(frame(spark, ref), frame(spark, own), *ARGS, [300.0, 900.0], sphere=True).collect()}
    want = {}
    for which, limit in enumerate((300.0, 900.0)):
        for (k, j), points in common(ref, own).items():
            d = [x for x in (km(p, q) for p, q in points) if x <= limit]
            if d:
                want[which, k, j] = (len(d), pytest.approx(sum(d) / len(d)))
    assert want and got == want
