"""Many partitions at once: fits against their definition, agreements and scores against plain loops."""

import inspect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gyrespark.operators import clustering, partitions, quality
from gyrespark.operators.partitions import Run
from gyrespark.plans import climatology
from gyrespark.plans.catalog import partitions as catalog


def plain_rand(a, b, w):
    pairs = lambda v: v * (v - 1) / 2.0
    cells, rows, cols = {}, {}, {}
    for x, y, n in zip(a, b, w):
        cells[x, y] = cells.get((x, y), 0) + n
        rows[x] = rows.get(x, 0) + n
        cols[y] = cols.get(y, 0) + n
    s, ra, rb = (sum(map(pairs, t.values())) for t in (cells, rows, cols))
    e = ra * rb / pairs(sum(w))
    return (s - e) / ((ra + rb) / 2 - e)


def table(spark, seed, n=120, parts=3):
    rng = random.Random(seed)
    rows = [(i, rng.choice("abc"), rng.choice(["w", "s"]), rng.gauss(4 * (i % 3), 1.5), rng.gauss(i % 2, 1.0), rng.random()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id bigint, label string, season string, x double, y double, z double").repartition(parts)


FEATURES = ["x", "y", "z"]
RUNS = [Run(3, 1), Run(3, 2), Run(2, 3, sample="poisson", share=0.8, sample_seed=5), Run(4, 4, sample="half", share=0.5, sample_seed=6),
        Run(3, 5, data=1), Run(2, 6, group="w"), Run(3, 7, data=2, sample="half", share=0.5, sample_seed=9)]


def in_memory(fitted):
    """Rows, hashes and weights as one task sees them."""
    rows = fitted.rows.collect()
    h = np.array([r.h for r in rows], dtype=np.int64).view(np.uint64)
    return rows, h, np.array([r.f for r in rows]), np.array([r.g for r in rows], dtype=object)


def test_fits_are_fixed_points(spark):
    _, df = table(spark, 1)
    fitted = partitions.Runs(df, "id", FEATURES, RUNS, "label", "season", partitions.moments_of(df, FEATURES)).fit(rounds=60, tolerance=1e-9)
    _, h, x, g = in_memory(fitted)
    for run, fit in zip(RUNS, fitted.fits):
        rows = x if run.data == 0 else partitions.noise_rows(h, run.data, *fitted.moments)
        w = partitions.weights(run, h, g)
        far = ((rows[:, None] - fit.centres) ** 2).sum(axis=2)
        near = far.argmin(axis=1)
        assert len(fit.centres) == run.k and fit.rows == w.sum()
        assert fit.inertia == pytest.approx((far.min(axis=1) * w).sum())
        for c in range(run.k):
            if w[near == c].sum():
                assert np.average(rows[near == c], axis=0, weights=w[near == c]) == pytest.approx(fit.centres[c], abs=1e-6)
    assert fitted.fits[0].inertia < ((x - x.mean(axis=0)) ** 2).sum() / 2


def test_same_result_however_rows_are_dealt(spark):
    _, df = table(spark, 2)
    moments = partitions.moments_of(df, FEATURES)
    a, b = (partitions.Runs(d, "id", FEATURES, RUNS, "label", "season", moments).fit() for d in (df.coalesce(1), df.repartition(7)))
    for x, y in zip(a.fits, b.fits):
        assert x.centres == pytest.approx(y.centres)


def test_agreements_against_plain_loops(spark):
    _, df = table(spark, 3)
    fitted = partitions.Runs(df, "id", FEATURES, RUNS, "label", "season", partitions.moments_of(df, FEATURES)).fit()
    rows, h, x, g = in_memory(fitted)

    def labels(r):
        own = x if RUNS[r].data == 0 else partitions.noise_rows(h, RUNS[r].data, *fitted.moments)
        return ((own[:, None] - fitted.fits[r].centres) ** 2).sum(axis=2).argmin(axis=1)
    pairs = [(0, 0, 1), (1, None, 2), (2, 0, 3), (3, 0, 5), (4, 4, 6)]
    got = {r.pair: r.ari for r in fitted.agreements(pairs).collect()}
    for pair, a, b in pairs:
        first = [r.label for r in rows] if a is None else labels(a)
        assert got[pair] == pytest.approx(plain_rand(first, labels(b), partitions.weights(RUNS[b], h, g)))


def test_samples_and_noise(spark):
    _, df = table(spark, 4, 4_000)
    mean, root = partitions.moments_of(df, FEATURES)
    x = np.array(df.select(FEATURES).collect())
    assert mean == pytest.approx(x.mean(axis=0)) and root @ root.T == pytest.approx(np.cov(x, rowvar=False))
    h = np.arange(20_000, dtype=np.uint64) * np.uint64(7_919)
    noise = partitions.noise_rows(h, 3, mean, root)
    assert noise.mean(axis=0) == pytest.approx(mean, abs=0.1) and np.cov(noise, rowvar=False) == pytest.approx(root @ root.T, abs=0.25)
    drawn = partitions.weights(Run(2, 1, sample="poisson", share=0.8), h, h)
    assert drawn.mean() == pytest.approx(0.8, abs=0.03) and drawn.var() == pytest.approx(0.8, abs=0.05)
    assert partitions.weights(Run(2, 1, sample="half", share=0.5), h, h).mean() == pytest.approx(0.5, abs=0.02)


def test_scores_of_clear_groups(spark):
    rng = random.Random(5)
    rows = [(i, i % 2, 20.0 * (i % 2) + rng.random(), rng.random(), "ab"[i % 4 // 2]) for i in range(80)]
    frame = spark.createDataFrame(rows, "vec_id int, label int, x double, y double, season string")
    metrics = ["stability", "classifiability", "reproducibility"]
    got = partitions.partition_scores(frame, "vec_id", ["x", "y"], [2], "label", metrics, n_noise=4, runs=4, repeats=3, tries=2,
                                      group="season", groups=["a", "b", None]).collect()
    assert len(got) == 9 and all(r.value == 1.0 for r in got)
    assert all((r.p_value is None) == (r.metric == "stability") and (r.p_value is None or r.p_value <= 0.5) for r in got)


def test_scores_of_many_partitions_equal_single_ones(spark):
    rng = random.Random(6)
    rows = [(i, [rng.randrange(3), rng.randrange(2), i % 4], [rng.random(), rng.random()]) for i in range(70)]
    frame = spark.createDataFrame(rows, "id bigint, labels array<int>, f array<double>")
    got = {(r.which, r.metric): r.value for r in quality.scores_of_partitions(frame, "id", "labels", "f", 5, 16).collect()}
    for which in range(3):
        one = frame.select("id", "f", F.col("labels")[which].alias("label"))
        want = quality.all_metrics(one, "id", "label", "f", 5).first().asDict()
        assert {m: v for (w, m), v in got.items() if w == which} == {m: pytest.approx(v) for m, v in want.items()}


def test_rand_of_constant_labels(spark):
    frame = spark.createDataFrame([(1, 1)] * 5, "a int, b int")
    assert clustering.adjusted_rand(frame, "a", "b") == 1.0


def test_registered_over_full_repetitions(spark, monkeypatch):
    """The queries pass no fewer repetitions than the defaults: 20, 20, 20 x 10, 50 x 20, k from 2 to 15 with 10 tries."""
    calls = []
    for owner, name in ((partitions, "partition_scores"), (climatology, "sweep_clusters")):
        signature = inspect.signature(getattr(owner, name))

        def stub(*args, signature=signature, **options):
            bound = signature.bind(*args, **options)
            bound.apply_defaults()
            calls.append(bound.arguments)
        monkeypatch.setattr(owner, name, stub)
    folder = "/root/testdata/sf0.001"
    for build in (catalog.partition_stability, catalog.partition_noise_level, catalog.cluster_number_sweep):
        build(spark, folder)
    stable, noise, sweep = calls
    assert (stable["runs"], stable["repeats"], stable["tries"]) == (20, 20, 10)
    assert list(stable["metrics"]) == ["stability", "classifiability", "reproducibility"]
    assert (noise["runs"], noise["n_noise"]) == (20, 50)
    assert sweep["ks"] == list(range(2, 16)) and sweep["tries"] == 10


def test_sweep_by_season(spark):
    _, df = table(spark, 7, 90)
    got = climatology.sweep_clusters(df, "id", FEATURES, [2, 3], season="season", seasons=["w", "s"], tries=2, agreement=()).collect()
    value = {(r.season, r.k, r.metric): r.value for r in got}
    assert len(value) == len(got) == 2 * 2 * 7
    assert all(value[s, 3, "within_ss"] < value[s, 2, "within_ss"] for s in "ws")
    scaled = clustering.scale(df, FEATURES)
    n = df.where("season = 'w'").count()
    total = scaled.where("season = 'w'").agg(*[(F.var_pop(f"{c}_z") * n).alias(c) for c in FEATURES]).first()
    assert value["w", 2, "within_ss"] + value["w", 2, "between_ss"] == pytest.approx(sum(total))
