"""Cell labelling, node and track building queries."""

from pyspark.sql import functions as F

from gyrespark.operators import aggregate, linking, nodes
from gyrespark.operators.labelling import label_cells
from gyrespark.plans import sweep
from gyrespark.plans.catalog.base import CELLS, NX, NY, hourly, query, r6, sparse_field
from gyrespark.session import cut_lineage

EPS, MIN_SAMPLES, SIZE = 1.0, 3, 4

LABELS = CELLS + f""", occ AS (SELECT slice, CAST(sign(u) AS INTEGER) AS sg, y, x, y * 16777216 + x AS cid, CAST(u AS DOUBLE) AS crit FROM cells WHERE u <> 0),
nb AS (SELECT a.slice, a.sg, a.cid AS a, b.cid AS b FROM occ a JOIN occ b ON a.slice = b.slice AND a.sg = b.sg AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= {EPS * EPS}),
core AS (SELECT slice, sg, a AS cid FROM nb GROUP BY 1, 2, 3 HAVING count(*) >= {MIN_SAMPLES}),
ce AS (SELECT nb.* FROM nb JOIN core p ON p.slice = nb.slice AND p.sg = nb.sg AND p.cid = nb.a JOIN core q ON q.slice = nb.slice AND q.sg = nb.sg AND q.cid = nb.b),
reach AS (SELECT slice, sg, cid AS root, cid FROM core UNION SELECT r.slice, r.sg, r.root, e.b FROM reach r JOIN ce e ON e.slice = r.slice AND e.sg = r.sg AND e.a = r.cid),
lab AS (SELECT slice, sg, cid, min(root) AS root FROM reach GROUP BY 1, 2, 3),
mem AS (SELECT nb.slice, nb.sg, nb.a AS cid, min(coalesce(own.root, lab.root)) AS root FROM nb JOIN lab ON lab.slice = nb.slice AND lab.sg = nb.sg AND lab.cid = nb.b
  LEFT JOIN lab own ON own.slice = nb.slice AND own.sg = nb.sg AND own.cid = nb.a GROUP BY 1, 2, 3),
big AS (SELECT slice, sg, root, row_number() OVER (PARTITION BY slice, sg ORDER BY min(cid)) AS no FROM mem GROUP BY slice, sg, root HAVING count(*) >= {SIZE}),
lc AS (SELECT m.slice, o.y, o.x, o.crit, CAST(big.no * m.sg AS INTEGER) AS cluster FROM mem m JOIN big ON big.slice = m.slice AND big.sg = m.sg AND big.root = m.root JOIN occ o ON o.slice = m.slice AND o.cid = m.cid)"""


def labelled(spark, folder, size=SIZE, counted=None):
    f = sparse_field(spark, folder).select("slice", "y", "x", F.col("u").cast("double").alias("crit"))
    return label_cells(f, ["slice"], "crit", EPS, MIN_SAMPLES, size, counted=counted)


@query("density_cluster_labels", f"WITH RECURSIVE {LABELS} SELECT slice, y, x, crit, cluster FROM lc")
def density_cluster_labels(spark, folder):
    return labelled(spark, folder)


CENTRES = """cs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slice, cluster ORDER BY abs(crit) DESC, y, x) AS rn, count(*) OVER (PARTITION BY slice, cluster) AS n FROM lc) WHERE rn = 1),
mx AS (SELECT a.slice, a.y, a.x, a.crit, a.cluster FROM lc a WHERE NOT EXISTS (SELECT 1 FROM lc b WHERE b.slice = a.slice AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1 AND sign(b.crit) = sign(a.crit)
  AND (abs(b.crit) > abs(a.crit) OR (abs(b.crit) = abs(a.crit) AND (b.y < a.y OR (b.y = a.y AND b.x < a.x)))))),
ex AS (SELECT slice, y, x, crit, cluster FROM mx UNION ALL SELECT slice, y, x, crit, cluster FROM cs WHERE (slice, y, x) NOT IN (SELECT (slice, y, x) FROM mx))"""


@query("cluster_centres", f"WITH RECURSIVE {LABELS}, {CENTRES} SELECT slice, cluster, x, y, crit, n AS n_cells, round(sqrt(n / pi()), 6) AS rad_eff FROM cs")
def cluster_centres(spark, folder):
    return aggregate.cluster_stats(labelled(spark, folder), ["slice"]).withColumn("rad_eff", r6("rad_eff"))


@query("extrema_with_centres", f"WITH RECURSIVE {LABELS}, {CENTRES} SELECT ex.slice, ex.y, ex.x, ex.crit, ex.cluster, cs.n AS n_cells, round(sqrt(cs.n / pi()), 6) AS rad_eff FROM ex JOIN cs ON cs.slice = ex.slice AND cs.cluster = ex.cluster")
def extrema_with_centres(spark, folder):
    out = nodes.extrema(labelled(spark, folder), ["slice"], 1)
    return out.select("slice", "y", "x", "crit", "cluster", "n_cells", r6("rad_eff").alias("rad_eff"))


@query("extremum_nodes_min_cells", f"WITH RECURSIVE {LABELS}, {CENTRES} SELECT ex.slice, ex.y, ex.x, ex.crit, ex.cluster FROM ex JOIN cs ON cs.slice = ex.slice AND cs.cluster = ex.cluster WHERE ex.crit > 0 AND cs.n >= 6")
def extremum_nodes_min_cells(spark, folder):
    cells = labelled(spark, folder)
    return nodes.extremum_nodes(nodes.extrema(cells, ["slice"], 1), cells, ["slice"], 6).select("slice", "y", "x", "crit", "cluster")


@query("size_filter_variants", f"WITH RECURSIVE {LABELS}, n AS (SELECT slice, cluster, count(*) AS n FROM lc GROUP BY 1, 2), s AS (SELECT unnest([4, 8, 16]) AS size_filter) SELECT s.size_filter, lc.slice, y, x, lc.cluster FROM lc JOIN n ON n.slice = lc.slice AND n.cluster = lc.cluster JOIN s ON s.size_filter <= n.n")
def size_filter_variants(spark, folder):
    return sweep.size_variants(labelled(spark, folder, counted="n"), ["slice"], [4, 8, 16], "n").select("size_filter", "slice", "y", "x", "cluster")


@query("geometric_nodes", f"""WITH RECURSIVE {LABELS}, c AS (SELECT *, -90.0 + x * 0.25 AS lon, 40.0 + y * 0.25 AS lat FROM lc), g AS (SELECT slice, cluster, degrees(atan2(avg(sin(radians(lon))), avg(cos(radians(lon))))) AS clon, avg(lat) AS clat, sqrt(count(*) / pi()) AS rad FROM c GROUP BY 1, 2),
i AS (SELECT *, CAST(ceil(round((clon + 90.0) / 0.25, 6) - 0.5) AS INTEGER) AS lon_idx, CAST(ceil(round((clat - 40.0) / 0.25, 6) - 0.5) AS INTEGER) AS lat_idx FROM g), j AS (SELECT i.*, f.u AS fc, sqrt(f.u * f.u + f.v * f.v) AS wspd FROM i LEFT JOIN cells f ON f.slice = i.slice AND f.x = i.lon_idx AND f.y = i.lat_idx),
nr AS (SELECT * FROM (SELECT c.slice, c.cluster, c.crit, row_number() OVER (PARTITION BY c.slice, c.cluster ORDER BY pow(c.lat - i.clat, 2) + pow(c.lon - i.clon, 2), c.y, c.x) AS rn FROM c JOIN i ON i.slice = c.slice AND i.cluster = c.cluster) WHERE rn = 1)
SELECT j.slice, j.cluster, lon_idx, lat_idx, round(clon, 6) AS lon, round(clat, 6) AS lat, round(rad, 6) AS rad, CAST(coalesce(fc, nr.crit) AS DOUBLE) AS crit, round(wspd, 6) AS wspd FROM j JOIN nr ON nr.slice = j.slice AND nr.cluster = j.cluster""")
def geometric_nodes(spark, folder):
    f = sparse_field(spark, folder).select("slice", "y", "x", F.col("u").cast("double").alias("crit"), F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")).alias("wspd"))
    out = nodes.geometric_nodes(labelled(spark, folder), f, ["slice"], -90.0, 0.25, NX, 40.0, 0.25, NY)
    return out.select("slice", "cluster", "lon_idx", "lat_idx", *[r6(c).alias(c) for c in ("lon", "lat", "rad")], "crit", r6("wspd").alias("wspd"))


@query("reestimated_radii", None)
def reestimated_radii(spark, folder):
    cells = labelled(spark, folder)
    out = nodes.reestimate_radii(nodes.extrema(cells, ["slice"], 1), cells, ["slice"])
    return out.select("slice", "y", "x", "crit", "cluster", r6("rad_eff").alias("rad_eff"))


@query("merged_extrema", f"""WITH RECURSIVE {LABELS}, {CENTRES} SELECT a.slice, a.y, a.x, a.crit FROM ex a WHERE NOT EXISTS (SELECT 1 FROM ex b WHERE b.slice = a.slice AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 9 AND (abs(b.crit) > abs(a.crit) OR (abs(b.crit) = abs(a.crit) AND (b.y < a.y OR (b.y = a.y AND b.x < a.x)))))""")
def merged_extrema(spark, folder):
    return nodes.merge_close_extrema(nodes.extrema(labelled(spark, folder), ["slice"], 1), ["slice"], 3.0).select("slice", "y", "x", "crit")


def track_nodes(spark, folder, reestimate=False, wind=False):
    """Extrema of clusters of ten cells or more, both senses; the slice is the time step, an hour long.

    With ``wind`` each node has the mean wind of the cells around it as a shift.
    """
    cells = labelled(spark, folder, 10)
    ex = nodes.extrema(cells, ["slice"], 1)
    if reestimate:
        ex = nodes.reestimate_radii(ex, cells, ["slice"])
    ident = (F.col("slice") * NY + F.col("y")) * NX + F.col("x")
    out = ex.select(F.when(F.col("crit") > 0, "C").otherwise("A").alias("sense"), F.col("slice").cast("int").alias("t"), ident.cast("long").alias("node_id"),
                    "x", "y", F.col("rad_eff").alias("rad"), "crit", "cluster")
    if wind:
        field = sparse_field(spark, folder).select(F.col("slice").cast("int").alias("t"), "x", "y", "u", "v")
        out = linking.background_shift(out, field, ["t"], 3600.0, 27_750.0)
    return cut_lineage(out)


def _centres_of(n):
    from pyspark.sql import Window

    w = Window.partitionBy("sense", "t", "cluster").orderBy(F.abs("crit").desc(), "y", "x")
    return n.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _tracks(spark, folder, rule, axes=None, reestimate=False):
    chosen = linking.RULES[rule] if isinstance(rule, str) else rule
    n = track_nodes(spark, folder, reestimate, chosen.predictor in ("bg", "adv_bg"))
    centres = _centres_of(n) if chosen.policy == "cluster" else None
    if chosen.policy == "centres":
        n = _centres_of(n)
    out = linking.track_nodes(n, ["sense"], chosen, (NY, NX), axes, centres)
    return out.select("track_id", "sense", "t", "node_id", "x", "y", r6("track_len").alias("track_len"))


AXES = (-90.0, 0.25, 40.0, 0.25)

for _rule in ("global_only", "local_extrema", "local_only"):
    query(f"tracks_{_rule}", None)(lambda spark, folder, _r=_rule: _tracks(spark, folder, _r))
for _rule in ("local_2_phase", "local_2_phase_cone"):  # the second phase links with re-estimated radii
    query(f"tracks_{_rule}", None)(lambda spark, folder, _r=_rule: _tracks(spark, folder, _r, None, True))
for _rule in ("global_only_km", "local_extrema_km", "local_only_km", "local_2_phase_km", "local_2_phase_cone_km"):
    query(f"tracks_{_rule}", None)(lambda spark, folder, _r=_rule: _tracks(spark, folder, _r, AXES, "2_phase" in _r))
for _how in ("adv", "bg", "adv_bg"):
    query(f"tracks_predicted_{_how}", None)(lambda spark, folder, _h=_how: _tracks(spark, folder, linking.LinkRule(predictor=_h)))


@query("stitched_tracks", None)
def stitched_tracks(spark, folder):
    p = hourly(spark, folder).withColumn("node_id", F.xxhash64("track_id", "time"))
    p = p.select("node_id", "time", "lon", "lat", F.col("y").cast("double").alias("r2d"))
    out = linking.stitch_nodes(p, [], "time", "lon", "lat", 6.0, 4.0, 3.0)
    return out.groupBy("track_id").agg(F.count(F.lit(1)).alias("n_points"), F.min("time").alias("start"), F.max("time").alias("end")).drop("track_id")


@query("stitched_variants", None)
def stitched_variants(spark, folder):
    p = hourly(spark, folder).withColumn("node_id", F.xxhash64("track_id", "time"))
    p = p.select("node_id", "time", "lon", "lat", F.col("y").cast("double").alias("r2d"))
    out = sweep.stitch_variants(p, [], "time", "lon", "lat", [
        {"search_range": 5.0, "mintime": 4, "maxgap": 1}, {"search_range": 5.0, "mintime": 4, "maxgap": 3, "prioritize": "r2d"}])
    return out.groupBy("maxgap", "mintime", "prioritized").agg(F.count_distinct("track_id").alias("n_tracks"), F.count(F.lit(1)).alias("n_points"))


