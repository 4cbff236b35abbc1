"""Steps that work on many groups at once: labels of tiles, overlaps of intervals, lifted parcels, radii."""

import math
import random
from datetime import datetime, timedelta

import pyarrow as pa
import pytest

from gyrespark.functions import thermo
from gyrespark.operators import joins, labelling, nodes

START = datetime(2020, 1, 1)


def test_tiles_are_labelled_the_same_in_any_batches(monkeypatch):
    rng = random.Random(3)
    rows = sorted({(s, ty, tx, rng.choice((-1, 1)), 8 * ty + rng.randrange(-2, 10), 8 * tx + rng.randrange(-2, 10))
                   for s in (None, 1, 2) for ty in (0, 1) for tx in (0, 1) for _ in range(70)}, key=lambda r: (r[0] or 0, *r[1:]))
    table = pa.table({"slice": pa.array([r[0] for r in rows], pa.int64()), "_sign": pa.array([r[3] for r in rows], pa.int32()),
                      "y": pa.array([r[4] for r in rows], pa.int32()), "x": pa.array([r[5] for r in rows], pa.int32()),
                      "crit": pa.array([float(r[3]) for r in rows]), "_ty": pa.array([r[1] for r in rows]), "_tx": pa.array([r[2] for r in rows])})

    def labels(batch, together):
        monkeypatch.setattr(labelling, "TILE_ROWS", together)
        out = list(labelling._label_part(iter(table.to_batches(max_chunksize=batch)), ["slice"], 1.0, 3, 8))
        return sorted((tuple(r.values()) for r in pa.Table.from_batches(out).to_pylist()), key=str)

    whole = labels(10_000, 10_000)
    assert whole and {r[0] for r in whole} == {None, 1, 2}
    assert labels(7, 20) == whole and labels(1, 1) == whole


def test_overlaps_equal_a_loop_and_are_dealt(spark):
    rng = random.Random(4)

    def spans(n):
        return [(k, at := START + timedelta(hours=rng.randrange(0, 300)), at + timedelta(hours=rng.choice((0, 1, 30, 400)))) for k in range(n)]

    a, b = spans(40), spans(50)
    frames = [spark.createDataFrame(r, "id int, start timestamp_ntz, end timestamp_ntz") for r in (a, b)]
    made = joins.interval_overlap(*frames, "id", "id", "start", "end", 24.0)
    got = sorted((r.id_ref, r.id_own, r.overlap_start, r.overlap_end) for r in made.collect())
    assert got == sorted((k, j, max(s, t), min(e, f)) for k, s, e in a for j, t, f in b if s <= f and t <= e)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "_i#" in plan and "_j#" in plan  # not joined on the bucket alone


def test_lifted_parcels_equal_a_loop_and_use_no_lambda(spark):
    rows = [(25.0, 20.0, 1000.0), (2.0, -3.0, 980.0), (30.0, -40.0, 990.0), (-20.0, -25.0, 1010.0)]
    made = spark.createDataFrame(rows, "t double, td double, p double").select("t", thermo.lifted_parcel_temperature("t", "td", "p").alias("k"))
    assert "lambdafunction" not in made._jdf.queryExecution().optimizedPlan().toString()

    def saturation(c):
        return 6.112 * math.exp(17.67 * c / (c + 243.5))

    def theta(k, k_l, p, e):
        r = 0.622 * e / (p - e)
        return k * (1000.0 / (p - e)) ** 0.2854 * (k / k_l) ** (0.28 * r) * math.exp((3036.0 / k_l - 1.78) * r * (1 + 0.448 * r))

    for (t, td, p), got in zip(rows, made.collect()):
        k, d = t + 273.15, td + 273.15
        k_l = 1 / (1 / (d - 56) + math.log(k / d) / 800) + 56
        wanted = theta(k, k_l, p, saturation(td))
        if p * (k_l / k) ** (1 / 0.2854) <= 500:
            want = k * (500 / p) ** 0.2854
        else:
            lo, hi = 150.0, 300.0
            for _ in range(60):
                mid = (lo + hi) / 2
                lo, hi = (lo, mid) if theta(mid, mid, 500.0, saturation(mid - 273.15)) > wanted else (mid, hi)
            want = lo
        assert got.k == pytest.approx(want, abs=1e-4)


def test_radii_of_clusters_are_the_same_in_any_groups(spark, monkeypatch):
    rng = random.Random(5)
    cells = [(s, y, x, rng.uniform(1, 9), c) for s in (1, 2) for c in (1, 2, 3) for y in range(5) for x in range(10 * c, 10 * c + 6)]
    peaks = [(s, y, 10 * c + x, 9.0 + y, c, 3.0) for s in (1, 2) for c in (1, 2, 3) for y, x in ((0, 0), (2, 5), (4, 1))[:c]]
    cells = spark.createDataFrame(cells, "slice int, y int, x int, crit double, cluster int")
    peaks = spark.createDataFrame(peaks, "slice int, y int, x int, crit double, cluster int, rad_eff double")
    found = []
    for size in (1, 20, 50_000):
        monkeypatch.setattr(nodes, "CELLS_TOGETHER", size)
        found.append(sorted(tuple(r) for r in nodes.reestimate_radii(peaks, cells, ["slice"]).collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) == 12
