"""Criteria, radii and node parameters against numpy."""

import numpy as np
from pyspark.sql import functions as F

from gyrespark.functions import thermo, vortex
from gyrespark.operators import aggregate, grid, nodes

NAMES = vortex.TENSOR_3D


def test_solid_body_rotation(spark):
    rows = [(0, y, x, -float(y), float(x)) for y in range(8) for x in range(8)]
    f = spark.createDataFrame(rows, "s int, y int, x int, u double, v double")
    g = grid.gradients(f, ["s"], ["u", "v"], 1.0, 1.0)
    out = g.select(vortex.rortex_2d("u_dx", "u_dy", "v_dx", "v_dy").alias("r")).distinct().collect()
    assert len(out) == 1 and abs(out[0]["r"] - 2.0) < 1e-7


def test_lambda2_and_swirl_match_numpy(spark):
    rng = np.random.default_rng(0)
    t = rng.normal(size=(60, 3, 3))
    df = spark.createDataFrame([(i, *map(float, m.ravel())) for i, m in enumerate(t)], "i int, " + ", ".join(f"{n} double" for n in NAMES))
    g = {n: n for n in NAMES}
    out = vortex.rortex_3d(df.withColumn("l2", vortex.lambda2_3d(g)).withColumn("q", vortex.q_3d(g)), g).orderBy("i").collect()
    for row, m in zip(out, t):
        s, a = (m + m.T) / 2, (m - m.T) / 2
        assert abs(row["l2"] + np.linalg.eigvalsh(s @ s + a @ a)[1]) < 1e-9
        values, vectors = np.linalg.eig(m)
        if np.abs(values.imag).max() > 0:
            assert abs(row["r3d_swirl"] - np.abs(values.imag).max()) < 1e-9
            axis = np.real(vectors[:, np.abs(values.imag).argmin()])
            got = np.array([row[f"r3d_axis_{k}"] for k in "xyz"])
            assert min(np.abs(got - axis).max(), np.abs(got + axis).max()) < 1e-7
        else:
            assert row["r3d"] is None


def test_radii_reach_the_weakest_point_between_maxima(spark):
    crit = [9.0, 6.0, 3.0, 1.0, 4.0, 7.0, 8.0]
    cells = spark.createDataFrame([(0, 1, 0, x, c) for x, c in enumerate(crit)], "s int, cluster int, y int, x int, crit double")
    peaks = spark.createDataFrame([(0, 1, 0, 0, 9.0, 2.5), (0, 1, 0, 6, 8.0, 2.5)], "s int, cluster int, y int, x int, crit double, rad_eff double")
    got = {r["x"]: r["rad_eff"] for r in nodes.reestimate_radii(peaks, cells, ["s"]).collect()}
    assert got[0] == 2.5  # the strongest keeps the cluster radius
    path = np.linspace(6.0, 0.0, 100)
    near = [int(min(range(7), key=lambda k: (abs(k - p), k))) for p in path]
    want = 6.0 - path[[i for i, n in enumerate(near) if n == 3][0]]
    assert abs(got[6] - want) < 1e-9


def test_node_parameters(spark):
    rng = np.random.default_rng(1)
    names = ["mslp", "u10", "v10", "u850", "v850", "u500", "v500", "pv850", "t2", "t850", "r850", "w850", "blh", "precip"]
    lats, lons = np.arange(40.0, 50.0, 1.0), np.arange(0.0, 360.0, 5.0)
    data = {n: rng.normal(10.0, 2.0, (len(lats), len(lons))) for n in names}
    rows = [(0, float(a), float(o), *[float(data[n][i, j]) for n in names]) for i, a in enumerate(lats) for j, o in enumerate(lons)]
    field = spark.createDataFrame(rows, "t int, lat double, lon double, " + ", ".join(f"{n} double" for n in names))
    trop = field.select("t", "lat", "lon", (F.col("blh") * 3.0).alias("trop_z"))
    pts = spark.createDataFrame([(7, 0, 358.0, 45.2, 2.0)], "pid int, t int, lon double, lat double, rad double")
    row = aggregate.node_parameters(pts, field, trop, ["t"], "pid", 20.0).collect()[0]
    dlon = (lons - 358.0 + 180.0) % 360.0 - 180.0
    dist = np.sqrt((lats - 45.2)[:, None] ** 2 + (dlon * np.cos(np.radians(45.2)))[None, :] ** 2)
    m = (dist <= 8.0) & (np.abs(dlon) <= 8.0)[None, :] & (np.abs(lats - 45.2) <= 8.0)[:, None]
    pick = {n: data[n][m] for n in names}
    assert abs(row["T850_disp"] - pick["t850"].std(ddof=1)) < 1e-9
    assert abs(row["RAIN_HOURLY_sum"] - pick["precip"].sum()) < 1e-9
    assert abs(row["w_850"] - np.percentile(pick["w850"], 95)) < 1e-9
    assert abs(row["U10_mean"] - np.median(np.hypot(pick["u10"], pick["v10"]))) < 1e-9
    assert abs(row["U500_minus_U850"] - np.hypot((pick["u500"] - pick["u850"]).mean(), (pick["v500"] - pick["v850"]).mean())) < 1e-9
    assert abs(row["pbl_trop_frac"] - 1000.0 / 3.0) < 1e-9
    i, j = np.abs(lats - 45.2).argmin(), np.abs(dlon).argmin()
    assert abs(row["SLP_diff_cent_95"] - 0.01 * (np.percentile(pick["mslp"], 95) - data["mslp"][i, j])) < 1e-9


def test_lifted_parcel_conserves_equivalent_potential_temperature(spark):
    df = spark.createDataFrame([(20.0, 15.0, 1000.0), (5.0, 2.0, 980.0)], "t double, td double, p double")
    out = df.withColumn("k", thermo.lifted_parcel_temperature("t", "td", "p")).withColumn("te", thermo.equivalent_potential_temperature("t", "td", "p"))
    lifted = out.withColumn("again", thermo.equivalent_potential_temperature(F.col("k") - 273.15, F.col("k") - 273.15, F.lit(500.0))).collect()
    for r in lifted:
        assert abs(r["again"] - r["te"]) < 0.05


def test_gaussian_smoothing_keeps_constants(spark):
    f = spark.createDataFrame([(0, y, x, 3.0) for y in range(5) for x in range(9)], "s int, y int, x int, u double")
    out = [r["u"] for r in grid.gaussian_smooth(f, ["s"], ["u"], 2.0, 9, 5).collect()]
    assert len(out) == 45 and max(abs(v - 3.0) for v in out) < 1e-12
