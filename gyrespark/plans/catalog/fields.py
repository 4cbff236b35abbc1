"""Gridded-field queries: gradients, criteria, smoothing, extrema, profiles."""

from pyspark.sql import functions as F

from gyrespark.functions import geo, vortex
from gyrespark.operators import grid
from gyrespark.plans.catalog.base import CELLS, FIELD, NX, NY, PTS, field, load, points, query, r6, sparse_field

# central inside, one-sided at the edges of the 50 x 7 grid
GRAD = FIELD + """, g AS (SELECT slice, y, x, u, v,
  CASE WHEN x = 0 THEN lead(u) OVER wx - u WHEN x = 49 THEN u - lag(u) OVER wx ELSE (lead(u) OVER wx - lag(u) OVER wx) / 2.0 END / 2.0 AS ux,
  CASE WHEN y = 0 THEN lead(u) OVER wy - u WHEN y = 6 THEN u - lag(u) OVER wy ELSE (lead(u) OVER wy - lag(u) OVER wy) / 2.0 END / 2.0 AS uy,
  CASE WHEN x = 0 THEN lead(v) OVER wx - v WHEN x = 49 THEN v - lag(v) OVER wx ELSE (lead(v) OVER wx - lag(v) OVER wx) / 2.0 END / 2.0 AS vx,
  CASE WHEN y = 0 THEN lead(v) OVER wy - v WHEN y = 6 THEN v - lag(v) OVER wy ELSE (lead(v) OVER wy - lag(v) OVER wy) / 2.0 END / 2.0 AS vy
  FROM field WINDOW wx AS (PARTITION BY slice, y ORDER BY x), wy AS (PARTITION BY slice, x ORDER BY y)),
d AS (SELECT slice, y, x, CAST(ux AS DOUBLE) AS ux, CAST(uy AS DOUBLE) AS uy, CAST(vx AS DOUBLE) AS vx, CAST(vy AS DOUBLE) AS vy FROM g)"""


def gradients(spark, folder):
    g = grid.gradients(field(spark, folder), ["slice"], ["u", "v"], 2.0, 2.0)
    return g.select("slice", "y", "x", F.col("u_dx").alias("ux"), F.col("u_dy").alias("uy"), F.col("v_dx").alias("vx"), F.col("v_dy").alias("vy"))


G = ("ux", "uy", "vx", "vy")
SW = "CASE WHEN 4 * (ux * vy - uy * vx) - pow(ux + vy, 2) > 0 THEN sqrt(4 * (ux * vy - uy * vx) - pow(ux + vy, 2)) / 2 END"


@query("densified_field", f"WITH {FIELD} SELECT slice, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, u, v FROM field")
def densified_field(spark, folder):
    return field(spark, folder).select("slice", "y", "x", "u", "v")


@query("velocity_gradients", f"WITH {GRAD} SELECT slice, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, ux, uy, vx, vy FROM d")
def velocity_gradients(spark, folder):
    return gradients(spark, folder)


@query("velocity_gradients_latlon", f"""WITH {GRAD} SELECT slice, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(ux * 2.0 / (6371000.0 * radians(0.25) * cos(radians(y + 40.0))) * 1e6, 6) AS ux, round(uy * 2.0 / (6371000.0 * radians(0.25)) * 1e6, 6) AS uy FROM d""")
def velocity_gradients_latlon(spark, folder):
    dx, dy = geo.grid_step_m(F.col("y") + 40.0, 0.25)
    g = grid.gradients(field(spark, folder), ["slice"], ["u"], dx, dy)
    return g.select("slice", "y", "x", r6(F.col("u_dx") * 1e6).alias("ux"), r6(F.col("u_dy") * 1e6).alias("uy"))


@query("vorticity2d", f"WITH {GRAD} SELECT slice, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, vx - uy AS omega FROM d")
def vorticity2d(spark, folder):
    return gradients(spark, folder).select("slice", "y", "x", vortex.vorticity_2d("uy", "vx").alias("omega"))


@query("strain_rotation2d", f"WITH {GRAD} SELECT slice, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, ux AS s11, 0.5 * (uy + vx) AS s12, vy AS s22, 0.5 * (uy - vx) AS a12 FROM d")
def strain_rotation2d(spark, folder):
    return gradients(spark, folder).select("slice", "y", "x", *[c.alias(k) for k, c in vortex.strain_rotation_2d(*G).items()])


@query("q_criterion2d", f"WITH {GRAD} SELECT slice, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(0.5 * (2 * pow(0.5 * (uy - vx), 2) - (ux * ux + vy * vy + 2 * pow(0.5 * (uy + vx), 2))), 6) AS q FROM d")
def q_criterion2d(spark, folder):
    return gradients(spark, folder).select("slice", "y", "x", r6(vortex.q_2d(*G)).alias("q"))


@query("delta_criterion2d", f"""WITH {GRAD}, c AS (SELECT *, 0.5 * (2 * pow(0.5 * (uy - vx), 2) - (ux * ux + vy * vy + 2 * pow(0.5 * (uy + vx), 2))) AS q, ux * vy - vx * uy AS r FROM d)
SELECT slice, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round((q / 3) * (q / 3) * (q / 3) + (0.5 * r) * (0.5 * r), 6) AS delta FROM c""")
def delta_criterion2d(spark, folder):
    return gradients(spark, folder).select("slice", "y", "x", r6(vortex.delta_2d(*G)).alias("delta"))


@query("lambda2_criterion2d", f"""WITH {GRAD}, p AS (SELECT *, 0.5 * (uy + vx) AS s12, 0.5 * (uy - vx) AS a12 FROM d), m AS (SELECT *, ux * ux + s12 * s12 - a12 * a12 AS m11, vy * vy + s12 * s12 - a12 * a12 AS m22, s12 * (ux + vy) AS m12 FROM p)
SELECT slice, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(-((m11 + m22) / 2 + sqrt(pow((m11 - m22) / 2, 2) + m12 * m12)), 6) AS lambda2 FROM m""")
def lambda2_criterion2d(spark, folder):
    return gradients(spark, folder).select("slice", "y", "x", r6(vortex.lambda2_2d(*G)).alias("lambda2"))


@query("swirling_strength2d", f"WITH {GRAD} SELECT slice, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round({SW}, 6) AS swirl FROM d")
def swirling_strength2d(spark, folder):
    return gradients(spark, folder).select("slice", "y", "x", r6(vortex.swirling_strength_2d(*G)).alias("swirl"))


R2D = f"r AS (SELECT slice, y, x, CASE WHEN abs(vx - uy) > 1e-8 AND {SW} IS NOT NULL THEN (1 - sqrt(greatest(1 - 4 * pow({SW}, 2) / (pow(vx - uy, 2) + 1e-16), 0))) * (vx - uy) END AS r2d FROM d)"


@query("rortex2d", f"WITH {GRAD}, {R2D} SELECT slice, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(r2d, 6) AS r2d FROM r")
def rortex2d(spark, folder):
    return gradients(spark, folder).select("slice", "y", "x", r6(vortex.rortex_2d(*G)).alias("r2d"))


RAW = f"w AS (SELECT *, {SW} AS sw, vx - uy AS om FROM d), q AS (SELECT *, CASE WHEN om <> 0 THEN 1 - 4 * sw * sw / (om * om) END AS ratio FROM w)"


@query("rortex2d_unguarded", f"WITH {GRAD}, {RAW} SELECT slice, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(CASE WHEN ratio >= 0 THEN (1 - sqrt(ratio)) * om END, 5) AS r2d FROM q")
def rortex2d_unguarded(spark, folder):
    g = gradients(spark, folder).withColumn("r2d", vortex.rortex_2d_raw(vortex.swirling_strength_2d(*G), vortex.vorticity_2d("uy", "vx")))
    return g.select("slice", "y", "x", F.round("r2d", 5).alias("r2d"))


def _tensor(spark, folder):
    """3-D tensor: the plane gradients plus vertical parts derived from them."""
    g = gradients(spark, folder)
    return g.withColumns({"uz": F.col("vy") - F.col("ux"), "vz": F.col("ux") + F.col("uy"), "wx": F.col("vx") * 0.5, "wy": F.col("uy") - F.col("vy"), "wz": -F.col("ux") - F.col("vy")})


TEN = GRAD + ", t AS (SELECT *, vy - ux AS uz, ux + uy AS vz, vx * 0.5 AS wx, uy - vy AS wy, -ux - vy AS wz FROM d)"
NAMES = {k: k for k in vortex.TENSOR_3D}
Q3 = "0.5 * (2 * (pow(0.5 * (uy - vx), 2) + pow(0.5 * (uz - wx), 2) + pow(0.5 * (vz - wy), 2)) - (ux * ux + vy * vy + wz * wz + 2 * (pow(0.5 * (uy + vx), 2) + pow(0.5 * (uz + wx), 2) + pow(0.5 * (vz + wy), 2))))"
D3 = "ux * (vy * wz - vz * wy) - uy * (vx * wz - vz * wx) + uz * (vx * wy - vy * wx)"


@query("criteria3d", f"""WITH {TEN} SELECT slice, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, wy - vz AS omega_x, uz - wx AS omega_y, vx - uy AS omega_z, round({Q3}, 6) AS q, round({D3}, 6) AS det, round(pow(({Q3}) / 3, 3) + pow(0.5 * ({D3}), 2), 4) AS delta FROM t""")
def criteria3d(spark, folder):
    ox, oy, oz = vortex.vorticity_3d(NAMES)
    return _tensor(spark, folder).select("slice", "y", "x", ox.alias("omega_x"), oy.alias("omega_y"), oz.alias("omega_z"), r6(vortex.q_3d(NAMES)).alias("q"),
                                         r6(vortex.det_3d(NAMES)).alias("det"), F.round(vortex.delta_3d(NAMES), 4).alias("delta"))


@query("lambda2_criterion3d", None)
def lambda2_criterion3d(spark, folder):
    return _tensor(spark, folder).select("slice", "y", "x", F.round(vortex.lambda2_3d(NAMES), 4).alias("lambda2"))


@query("rortex3d", None)
def rortex3d(spark, folder):
    out = vortex.rortex_3d(_tensor(spark, folder), NAMES)
    return out.select("slice", "y", "x", *[F.round(c, 4).alias(c) for c in ("r3d", "r3d_swirl", "r3d_axis_x", "r3d_axis_y", "r3d_axis_z")])


@query("log_normalised_criterion", f"""WITH {CELLS}, l AS (SELECT slice, y, x, CASE WHEN u > 0 THEN log10(u) END AS l FROM cells), s AS (SELECT slice, min(l) AS lo, max(l) AS hi FROM l GROUP BY 1)
SELECT l.slice, y, x, round(CASE WHEN hi > lo THEN (l - lo) / (hi - lo) END, 6) AS u_log FROM l JOIN s USING (slice)""")
def log_normalised_criterion(spark, folder):
    out = grid.log_normalise(sparse_field(spark, folder), ["slice"], "u", "u_log")
    return out.select("slice", "y", "x", r6("u_log").alias("u_log"))


@query("standardised_criterion", f"""WITH {CELLS}, s AS (SELECT slice, avg(u) AS m, stddev_pop(u) AS s FROM cells GROUP BY 1) SELECT c.slice, y, x, CASE WHEN s > 0 THEN round((u - m) / s, 6) END AS u_std FROM cells c JOIN s USING (slice)""")
def standardised_criterion(spark, folder):
    out = grid.standardise(sparse_field(spark, folder), ["slice"], "u", "u_std")
    return out.select("slice", "y", "x", r6("u_std").alias("u_std"))


@query("local_maxima", f"""WITH {CELLS}, c AS (SELECT slice, y, x, u FROM cells WHERE u <> 0)
SELECT a.slice, a.y, a.x, a.u FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.slice = a.slice AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1 AND sign(b.u) = sign(a.u)
 AND (abs(b.u) > abs(a.u) OR (abs(b.u) = abs(a.u) AND (b.y < a.y OR (b.y = a.y AND b.x < a.x)))))""")
def local_maxima(spark, folder):
    return grid.local_maxima(sparse_field(spark, folder), ["slice"], "u", 1).select("slice", "y", "x", "u")


def _smooth_sql(sigma: float) -> str:
    w = grid.gaussian_weights(sigma)
    r = len(w) // 2
    values = ", ".join(f"({k - r}, CAST({v!r} AS DOUBLE))" for k, v in enumerate(w))

    def mirror(axis: str, n: int) -> str:
        p = f"((({axis} + k.o) % {2 * n}) + {2 * n}) % {2 * n}"
        return f"CASE WHEN {p} < {n} THEN {p} ELSE {2 * n - 1} - {p} END"

    return f"""k(o, w) AS (VALUES {values}),
sx AS (SELECT f.slice, f.y, f.x, sum(k.w * g.u) AS u FROM field f CROSS JOIN k JOIN field g ON g.slice = f.slice AND g.y = f.y AND g.x = {mirror('f.x', NX)} GROUP BY 1, 2, 3),
sy AS (SELECT f.slice, f.y, f.x, sum(k.w * g.u) AS u FROM sx f CROSS JOIN k JOIN sx g ON g.slice = f.slice AND g.x = f.x AND g.y = {mirror('f.y', NY)} GROUP BY 1, 2, 3)"""


@query("gaussian_smoothing", f"WITH {FIELD}, {_smooth_sql(1.0)} SELECT slice, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(u, 6) AS u FROM sy")
def gaussian_smoothing(spark, folder):
    out = grid.gaussian_smooth(field(spark, folder), ["slice"], ["u"], 1.0, NX, NY)
    return out.select("slice", "y", "x", r6("u").alias("u"))


PROFILE = f"""{PTS}, prof AS (SELECT track_id AS c, CAST(x AS DOUBLE) AS h, max(y) * 0.05 AS pv FROM pts GROUP BY 1, 2)"""


def _profile(spark, folder):
    return points(spark, folder).groupBy(F.col("track_id").alias("c"), F.col("x").cast("double").alias("h")).agg((F.max("y") * 0.05).alias("pv"))


@query("vertical_interpolation", f"""WITH {PROFILE}, s AS (SELECT *, lead(h) OVER w AS h1, lead(pv) OVER w AS pv1 FROM prof WINDOW w AS (PARTITION BY c ORDER BY h)), t AS (SELECT unnest([5.5, 20.25, 77.0, 140.5]) AS target), k AS (SELECT DISTINCT c FROM prof)
SELECT k.c, CAST(t.target AS DOUBLE) AS target, round(CASE WHEN s.h1 IS NOT NULL AND t.target > s.h THEN s.pv + (s.pv1 - s.pv) * (t.target - s.h) / (s.h1 - s.h) ELSE s.pv END, 6) AS pv FROM k CROSS JOIN t LEFT JOIN s ON s.c = k.c AND (s.h = t.target OR (t.target > s.h AND t.target < s.h1))""")
def vertical_interpolation(spark, folder):
    out = grid.interpolate_levels(_profile(spark, folder), ["c"], "h", "pv", [5.5, 20.25, 77.0, 140.5])
    return out.select("c", "target", r6("pv").alias("pv"))


@query("tropopause_height", f"""WITH {PROFILE}, s AS (SELECT *, lag(h) OVER w AS h0, lag(pv) OVER w AS p0 FROM prof WHERE h >= 30 WINDOW w AS (PARTITION BY c ORDER BY h)), x AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY h) AS rn FROM s WHERE pv >= 4)
SELECT k.c, round(CASE WHEN h0 IS NULL THEN h WHEN pv = p0 THEN h0 ELSE h0 + (4 - p0) / (pv - p0) * (h - h0) END, 6) AS tropopause_z FROM (SELECT DISTINCT c FROM prof) k LEFT JOIN x ON x.c = k.c AND rn = 1""")
def tropopause_height(spark, folder):
    out = grid.tropopause_height(_profile(spark, folder), ["c"], "h", "pv", 4.0, 30.0)
    return out.withColumn("tropopause_z", r6("tropopause_z"))


@query("vertical_gradient", f"""WITH {PROFILE}, s AS (SELECT *, lag(pv) OVER w AS vb, lead(pv) OVER w AS va, h - lag(h) OVER w AS hb, lead(h) OVER w - h AS ha FROM prof WINDOW w AS (PARTITION BY c ORDER BY h))
SELECT c, h, round(CASE WHEN hb IS NULL THEN (va - pv) / ha WHEN ha IS NULL THEN (pv - vb) / hb ELSE (hb * hb * va + (ha * ha - hb * hb) * pv - ha * ha * vb) / (hb * ha * (hb + ha)) END, 6) AS pv_dz FROM s""")
def vertical_gradient(spark, folder):
    out = grid.vertical_gradient(_profile(spark, folder), ["c"], "pv", "h", "pv_dz")
    return out.select("c", "h", r6("pv_dz").alias("pv_dz"))


@query("vapour_transport", f"""WITH {PTS}, prof AS (SELECT track_id AS c, 1000.0 - x * 1.5 AS p, max(y) * 0.0002 AS q, CAST(max(y) AS DOUBLE) AS u, CAST(min(y) AS DOUBLE) * 0.5 AS v FROM pts GROUP BY 1, 2),
s AS (SELECT *, lead(p) OVER w AS p1, lead(q) OVER w AS q1, lead(u) OVER w AS u1, lead(v) OVER w AS v1 FROM prof WINDOW w AS (PARTITION BY c ORDER BY p)),
t AS (SELECT 1000.0::DOUBLE + k * ((300.0::DOUBLE - 1000.0) / 99) AS t FROM (SELECT unnest(range(0, 100)) AS k)),
i AS (SELECT c, q + (q1 - q) * (t - p) / (p1 - p) AS q, u + (u1 - u) * (t - p) / (p1 - p) AS u, v + (v1 - v) * (t - p) / (p1 - p) AS v FROM s JOIN t ON t > p AND t <= p1),
g AS (SELECT c, sum(q * u * ((300.0 - 1000.0) / 99) * 100.0 / 9.81) AS iu, sum(q * v * ((300.0 - 1000.0) / 99) * 100.0 / 9.81) AS iv FROM i GROUP BY 1)
SELECT c, round(iu, 4) AS ivt_u, round(iv, 4) AS ivt_v, round(sqrt(iu * iu + iv * iv), 4) AS ivt FROM g""")
def vapour_transport(spark, folder):
    p = points(spark, folder).groupBy(F.col("track_id").alias("c"), (1000.0 - F.col("x") * 1.5).alias("p")).agg(
        (F.max("y") * 0.0002).alias("q"), F.max("y").cast("double").alias("u"), (F.min("y") * 0.5).alias("v"))
    out = grid.vapour_transport(p, ["c"], "p", "q", "u", "v")
    return out.select("c", *[F.round(k, 4).alias(k) for k in ("ivt_u", "ivt_v", "ivt")])


@query("bilinear_regridding", f"""WITH {FIELD}, p AS (SELECT slice, n, CAST(x AS DOUBLE) * 0.9 AS px, CAST(y AS DOUBLE) * 0.8 AS py, y, x FROM cells), c AS (SELECT p.slice, p.y, p.x, sum(CAST(f.u AS DOUBLE) * (1 - abs(f.x - px)) * (1 - abs(f.y - py))) AS val FROM p JOIN field f ON f.slice = p.slice AND abs(f.x - px) < 1 AND abs(f.y - py) < 1 GROUP BY 1, 2, 3)
SELECT slice, y, x, round(val, 6) AS val FROM c""")
def bilinear_regridding(spark, folder):
    p = sparse_field(spark, folder).select("slice", F.col("y").alias("y0"), F.col("x").alias("x0"), (F.col("x") * 0.9).alias("px"), (F.col("y") * 0.8).alias("py"))
    out = grid.bilinear_regrid(p, field(spark, folder).select("slice", "y", "x", F.col("u").alias("val")), ["slice"], "px", "py", "val")
    return out.select("slice", F.col("y0").alias("y"), F.col("x0").alias("x"), r6("val").alias("val"))


@query("nearest_grid_cell", f"""WITH {PTS}, g AS (SELECT y, x, x * 5.0 - 120.0 + y * 0.3 AS glon, y * 10.0 + x * 0.2 AS glat FROM (SELECT DISTINCT l_linenumber - 1 AS y, CAST(l_quantity AS INTEGER) - 1 AS x FROM lineitem)),
q AS (SELECT event_id, g.y, g.x, sqrt(pow(((((glon - lon + 180.0) % 360.0) + 360.0) % 360.0) - 180.0, 2) + pow(glat - lat, 2)) AS d, row_number() OVER (PARTITION BY event_id ORDER BY round(sqrt(pow(((((glon - lon + 180.0) % 360.0) + 360.0) % 360.0) - 180.0, 2) + pow(glat - lat, 2)), 9), g.y, g.x) AS rn FROM pts, g)
SELECT event_id, y, x, round(d, 6) AS dist FROM q WHERE rn = 1""")
def nearest_grid_cell(spark, folder):
    g = load(spark, folder, "lineitem").select((F.col("l_linenumber") - 1).alias("y"), (F.col("l_quantity").cast("int") - 1).alias("x")).distinct()
    g = g.withColumns({"glon": F.col("x") * 5.0 - 120.0 + F.col("y") * 0.3, "glat": F.col("y") * 10.0 + F.col("x") * 0.2})
    p = points(spark, folder).select("event_id", "lon", "lat")
    return grid.nearest_grid_cell(p, g, "event_id", "lon", "lat", "glon", "glat", 10.0).withColumn("dist", r6("dist"))


@query("ellipse_field_mean", f"""WITH {FIELD}, e AS (SELECT slice, y, x, CAST(x AS DOUBLE) AS cx, CAST(y AS DOUBLE) AS cy, 5.0 AS a, 2.0 AS b, n * 0.3 AS theta FROM cells)
SELECT e.slice, e.y, e.x, count(*) AS n_cells, round(avg(f.u), 6) AS ellipse_mean FROM e JOIN field f ON f.slice = e.slice AND pow(((f.x - cx) * cos(theta) + (f.y - cy) * sin(theta)) / a, 2) + pow(((f.y - cy) * cos(theta) - (f.x - cx) * sin(theta)) / b, 2) <= 1 GROUP BY 1, 2, 3""")
def ellipse_field_mean(spark, folder):
    e = sparse_field(spark, folder).select(
        "slice", F.struct("slice", "y", "x").alias("pid"), F.col("x").cast("double").alias("cx"), F.col("y").cast("double").alias("cy"), F.lit(5.0).alias("a"), F.lit(2.0).alias("b"), (F.col("n") * 0.3).alias("theta"))
    out = grid.ellipse_mean(e, field(spark, folder).select("slice", "y", "x", "u"), ["slice"], "pid", "u", 8.0)
    return out.select("pid.slice", "pid.y", "pid.x", "n_cells", r6("ellipse_mean").alias("ellipse_mean"))


@query("radial_size", f"""WITH {FIELD}, c AS (SELECT slice, y, x FROM cells), p AS (SELECT c.slice, c.y, c.x, floor(sqrt(pow(f.x - c.x, 2) + pow(f.y - c.y, 2)) / 2.0) AS ring, avg(f.u) AS m FROM c JOIN field f ON f.slice = c.slice AND sqrt(pow(f.x - c.x, 2) + pow(f.y - c.y, 2)) <= 7 GROUP BY 1, 2, 3, 4)
SELECT slice, y, x, CAST(max(CASE WHEN m > 0 THEN (ring + 1) * 2.0 END) AS DOUBLE) AS size FROM p GROUP BY 1, 2, 3""")
def radial_size(spark, folder):
    c = sparse_field(spark, folder).select("slice", F.struct("slice", "y", "x").alias("pid"), F.lit(7.0).alias("rad"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    prof = grid.radial_profile(c, field(spark, folder).select("slice", "y", "x", "u"), ["slice"], "pid", "cx", "cy", "rad", "u", 2.0, 8.0)
    return grid.profile_size(prof, "pid", 2.0).select("pid.slice", "pid.y", "pid.x", "size")

