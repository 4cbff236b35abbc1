"""Aggregation, set, ranking and filter queries."""

from pyspark.sql import functions as F

from gyrespark.functions.aggregates import circular_mean_lon, named_aggregate, vector_mean
from gyrespark.operators import aggregate, filters, grid, ordered, ranking, sets
from gyrespark.plans import sweep
from gyrespark.plans.catalog.base import CELLS, FIELD, HOURLY, PTS, field, hourly, load, points, query, r6, sparse_field

LABELS = {"TC": "purchase", "SS": "signup", "PL": "error"}
L_SQL = "bool_or(label = 'purchase') AS tc, bool_or(label = 'signup') AS ss, bool_or(label = 'error') AS pl"


@query("primary_type_priority", f"""WITH {PTS}, g AS (SELECT track_id, {L_SQL}, arg_min(lon, (time, event_id)) AS glon, arg_min(lat, (time, event_id)) AS glat, min(time) AS gtime FROM pts GROUP BY 1),
k AS (SELECT *, CASE WHEN tc THEN 'TC' WHEN ss THEN 'SS' WHEN pl THEN 'PL' END AS kind, glon BETWEEN -60 AND 125 AND glat BETWEEN 20 AND 60 AS inside FROM g)
SELECT track_id, tc AS "has_TC", ss AS "has_SS", pl AS "has_PL", gtime AS genesis_time, glon AS genesis_lon, glat AS genesis_lat, coalesce(kind = 'TC', FALSE) AND inside AS genesis_in_region,
 coalesce(kind = 'TC', FALSE) AND NOT inside AS excluded_by_genesis, CASE WHEN kind = 'TC' AND NOT inside THEN NULL ELSE kind END AS primary_type FROM k""")
def primary_type_priority(spark, folder):
    inside = F.col("genesis_lon").between(-60.0, 125.0) & F.col("genesis_lat").between(20.0, 60.0)
    return aggregate.primary_type(points(spark, folder), "track_id", "time", "label", "lon", "lat", LABELS, inside, ["event_id"])


@query("primary_type_half_inside", f"""WITH {PTS}, g AS (SELECT track_id, count(*) AS n_points, count(*) FILTER (WHERE lon BETWEEN -70 AND 125) AS n_inside, count(*) FILTER (WHERE label = 'purchase') AS n_lead, count(*) FILTER (WHERE label = 'purchase' AND lon BETWEEN -70 AND 125) AS n_lead_inside,
 bool_or(label = 'signup') AS "has_SS", bool_or(label = 'error') AS "has_PL" FROM pts GROUP BY 1)
SELECT *, CASE WHEN n_lead > 0 THEN CASE WHEN n_lead_inside = n_lead AND n_inside >= 0.5 * n_points THEN 'TC' END WHEN "has_SS" THEN 'SS' WHEN "has_PL" THEN 'PL' END AS primary_type FROM g""")
def primary_type_half_inside(spark, folder):
    return aggregate.primary_type_half_inside(points(spark, folder), "track_id", "label", F.col("lon").between(-70.0, 125.0), LABELS)


@query("node_statistics", f"""WITH {PTS} SELECT track_id, count(*) AS n_nodes, count(*) FILTER (WHERE label = 'purchase') AS n_type_nodes, round(count(*) FILTER (WHERE label = 'purchase') / count(*), 6) AS fraction_type_nodes,
 count(DISTINCT label) AS n_unique_labels, (SELECT string_agg(l, '|' ORDER BY l) FROM (SELECT DISTINCT label AS l FROM pts q WHERE q.track_id = pts.track_id)) AS labels FROM pts GROUP BY track_id""")
def node_statistics(spark, folder):
    out = aggregate.node_label_statistics(points(spark, folder), "track_id", "label", "purchase")
    return out.withColumn("fraction_type_nodes", r6("fraction_type_nodes"))


@query("monthly_summary", """SELECT CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n_points, count(DISTINCT o_custkey) AS n_tracks FROM orders GROUP BY 1""")
def monthly_summary(spark, folder):
    return aggregate.monthly_summary(load(spark, folder, "orders"), "o_custkey", "o_orderdate")


@query("selection_summary", f"""WITH {PTS} SELECT count(*) AS n_points, count(DISTINCT track_id) AS n_tracks, count(*) FILTER (WHERE label = 'error') AS n_type_points, count(DISTINCT CASE WHEN label = 'error' THEN track_id END) AS n_type_tracks, min(time) AS first_time, max(time) AS last_time FROM pts""")
def selection_summary(spark, folder):
    return aggregate.selection_summary(points(spark, folder), "track_id", "time", "label", "error")


@query("track_parameter_statistics", f"""WITH {PTS} SELECT track_id, round(avg(crit), 6) AS crit_mean, min(crit) AS crit_min, max(crit) AS crit_max, round(avg(lat), 6) AS lat_mean, min(lat) AS lat_min, max(lat) AS lat_max, count(*) AS n_points, round((epoch_us(max(time)) - epoch_us(min(time))) / 3.6e9, 6) AS lifetime_hours FROM pts GROUP BY 1""")
def track_parameter_statistics(spark, folder):
    out = aggregate.track_statistics(points(spark, folder), "track_id", "time", ["crit", "lat"])
    return out.withColumns({c: r6(c) for c in ("crit_mean", "lat_mean", "lifetime_hours")})


@query("start_stop_max_rows", f"""WITH {PTS}, q AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY time, event_id) AS a, row_number() OVER (PARTITION BY track_id ORDER BY time DESC, event_id DESC) AS b, row_number() OVER (PARTITION BY track_id ORDER BY crit DESC, time, event_id) AS c FROM pts)
SELECT track_id, 'start' AS kind, event_id, crit FROM q WHERE a = 1 UNION ALL SELECT track_id, 'stop', event_id, crit FROM q WHERE b = 1 UNION ALL SELECT track_id, 'max', event_id, crit FROM q WHERE c = 1""")
def start_stop_max_rows(spark, folder):
    return aggregate.track_ends(points(spark, folder), "track_id", "time", "crit", ["event_id"], ["event_id"]).select("track_id", "kind", "event_id", "crit")


@query("day_coverage_audit", """WITH d AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '1996-12-31', INTERVAL 1 DAY)) AS DATE) AS day),
f AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_totalprice > 400000)
SELECT strftime(d.day, '%Y-%m') AS month, count(*) AS expected_days, count(f.day) AS found_days, coalesce(string_agg(CASE WHEN f.day IS NULL THEN strftime(d.day, '%Y-%m-%d') END, ',' ORDER BY d.day), '') AS missing_days FROM d LEFT JOIN f ON f.day = d.day GROUP BY 1""")
def day_coverage_audit(spark, folder):
    return sweep.audit_days(load(spark, folder, "orders").where("o_totalprice > 400000"), "o_orderdate", "1995-01-01", "1996-12-31")


@query("row_count_reconciliation", """WITH a AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS l_suppkey, coalesce(a.n, 0) AS n_source, coalesce(b.n, 0) AS n_derived, coalesce(a.n, 0) = coalesce(b.n, 0) AS consistent FROM a FULL JOIN b ON a.k = b.k""")
def row_count_reconciliation(spark, folder):
    li = load(spark, folder, "lineitem")
    return aggregate.reconcile_counts(li.where("l_returnflag = 'R'"), li.where("l_linestatus = 'O'"), ["l_suppkey"], ("n_source", "n_derived"))


@query("stale_partitions", """WITH a AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT * FROM (SELECT coalesce(a.k, b.k) AS l_suppkey, coalesce(a.n, 0) AS n_source, coalesce(b.n, 0) AS n_derived, coalesce(a.n, 0) = coalesce(b.n, 0) AS consistent FROM a FULL JOIN b ON a.k = b.k) WHERE NOT consistent""")
def stale_partitions(spark, folder):
    li = load(spark, folder, "lineitem")
    return sweep.stale_partitions(li.where("l_returnflag = 'R'"), li.where("l_linestatus = 'O'"), ["l_suppkey"])


@query("header_counters", """SELECT lang, count(*) FILTER (WHERE starts_with(text, 'The')) AS n_headers, count(*) AS n_lines FROM documents GROUP BY 1""")
def header_counters(spark, folder):
    d = load(spark, folder, "documents")
    return d.groupBy("lang").agg(F.count_if(F.startswith(F.col("text"), F.lit("The"))).alias("n_headers"), F.count(F.lit(1)).alias("n_lines"))


@query("cluster_by_month_pivot", f"""WITH {PTS} SELECT CAST(day(time) AS INTEGER) AS day, count(*) FILTER (WHERE label = 'click') AS click, count(*) FILTER (WHERE label = 'error') AS error, count(*) FILTER (WHERE label = 'purchase') AS purchase, count(*) FILTER (WHERE label = 'signup') AS signup, count(*) FILTER (WHERE label = 'view') AS view FROM pts GROUP BY 1""")
def cluster_by_month_pivot(spark, folder):
    p = points(spark, folder).withColumn("day", F.day("time"))
    return aggregate.cross_tab(p, "day", "label", ["click", "error", "purchase", "signup", "view"])


@query("crosstab", """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", count(*) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def crosstab(spark, folder):
    return aggregate.cross_tab(load(spark, folder, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("value_counts", """SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1""")
def value_counts(spark, folder):
    return aggregate.value_counts(load(spark, folder, "customer"), "c_mktsegment")


@query("mode_label", f"""WITH {PTS}, c AS (SELECT track_id, label, count(*) AS n FROM pts GROUP BY 1, 2), q AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY n DESC, label) AS rn FROM c) SELECT track_id, label, n FROM q WHERE rn = 1""")
def mode_label(spark, folder):
    return aggregate.mode_label(points(spark, folder), ["track_id"], "label")


@query("cluster_means", """SELECT p_type, round(avg(p_size), 6) AS p_size_mean, round(avg(p_retailprice), 6) AS p_retailprice_mean, count(*) AS n FROM part GROUP BY 1""")
def cluster_means(spark, folder):
    out = aggregate.group_means(load(spark, folder, "part"), ["p_type"], ["p_size", "p_retailprice"])
    return out.withColumns({c: r6(c) for c in ("p_size_mean", "p_retailprice_mean")})


@query("mean_lifetime_by_type", f"""WITH {PTS}, h AS (SELECT track_id, label, (epoch_us(max(time)) - epoch_us(min(time))) / 3.6e9 AS h FROM pts GROUP BY 1, 2) SELECT label, round(avg(h), 6) AS mean_lifetime_hours, count(*) AS n_tracks FROM h GROUP BY 1""")
def mean_lifetime_by_type(spark, folder):
    out = aggregate.mean_lifetime_by_type(points(spark, folder), "track_id", "time", "label")
    return out.withColumn("mean_lifetime_hours", r6("mean_lifetime_hours"))


@query("yearly_activity", """WITH t AS (SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, o_custkey, count(*) AS n, min(o_totalprice) AS low FROM orders GROUP BY 1, 2, 3), q AS (SELECT *, row_number() OVER (PARTITION BY year, month ORDER BY low, o_custkey) AS rn FROM t)
SELECT CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, count(*) AS n_tracks, CAST(sum(n) AS BIGINT) AS n_points, min(low) AS lowest, max(CASE WHEN rn = 1 THEN o_custkey END) AS strongest_track FROM q GROUP BY 1, 2""")
def yearly_activity(spark, folder):
    return aggregate.yearly_activity(load(spark, folder, "orders"), "o_custkey", "o_orderdate", "o_totalprice")


@query("named_aggregates", """SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, quantile_cont(l_quantity, 0.5) AS median, min(l_quantity) AS min, max(l_quantity) AS max, sum(l_quantity) AS sum, round(stddev_samp(l_quantity), 6) AS std, round(stddev_pop(l_quantity), 6) AS std_pop,
 round(quantile_cont(l_quantity, 0.05), 6) AS p5, round(quantile_cont(l_quantity, 0.9), 6) AS p90, round(quantile_cont(l_quantity, 0.95), 6) AS p95, round(quantile_cont(l_quantity, 0.95) - quantile_cont(l_quantity, 0.05), 6) AS delta,
 round(quantile_cont(l_quantity, 0.05), 6) AS robust_min, round(quantile_cont(l_quantity, 0.95), 6) AS robust_max FROM lineitem GROUP BY 1""")
def named_aggregates(spark, folder):
    names = ["mean", "median", "min", "max", "sum", "std", "std_pop", "p5", "p90", "p95", "delta", "robust_min", "robust_max"]
    out = load(spark, folder, "lineitem").groupBy("l_returnflag").agg(*[named_aggregate(n, "l_quantity").alias(n) for n in names])
    return out.withColumns({c: r6(c) for c in names})


@query("exact_percentiles_by_key", """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 6) AS p5, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY 1""")
def exact_percentiles_by_key(spark, folder):
    out = ordered.exact_percentiles(load(spark, folder, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p5": 0.05, "median": 0.5, "p95": 0.95})
    return out.withColumns({c: r6(c) for c in ("p5", "median", "p95")})


@query("value_distribution_summary", """SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max, round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS p75 FROM orders GROUP BY 1""")
def value_distribution_summary(spark, folder):
    out = aggregate.value_summary(load(spark, folder, "orders"), ["o_orderpriority"], "o_totalprice")
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "p25", "median", "p75")})


@query("vector_mean_direction", """WITH m AS (SELECT l_suppkey, avg(l_quantity - 25) AS u, avg(l_discount * 100 - 5) AS v FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(u, 6) AS mean_u, round(v, 6) AS mean_v, round((CAST(degrees(atan2(v, u)) AS DOUBLE) + 360.0) % 360.0, 4) AS mean_angle, round(sqrt(u * u + v * v), 6) AS mean_magnitude FROM m""")
def vector_mean_direction(spark, folder):
    li = load(spark, folder, "lineitem").select("l_suppkey", (F.col("l_quantity") - 25).alias("u"), (F.col("l_discount") * 100 - 5).alias("v"))
    out = li.groupBy("l_suppkey").agg(*[c.alias(n) for n, c in vector_mean("u", "v").items()])
    return out.withColumns({"mean_u": r6("mean_u"), "mean_v": r6("mean_v"), "mean_angle": F.round("mean_angle", 4), "mean_magnitude": r6("mean_magnitude")})


@query("circular_mean_longitude", f"""WITH {PTS} SELECT track_id, round(degrees(atan2(avg(sin(radians(lon))), avg(cos(radians(lon))))), 6) AS mean_lon FROM pts GROUP BY 1""")
def circular_mean_longitude(spark, folder):
    return points(spark, folder).groupBy("track_id").agg(r6(circular_mean_lon("lon")).alias("mean_lon"))


@query("time_of_extreme", f"""WITH {PTS} SELECT track_id, max(crit) AS max_value, min(crit) AS min_value, round(avg(crit), 6) AS mean_value, arg_min(time, (-crit, time)) AS time_of_max FROM pts GROUP BY 1""")
def time_of_extreme(spark, folder):
    return aggregate.time_of_extreme(points(spark, folder), "track_id", "time", "crit").withColumn("mean_value", r6("mean_value"))


DISC = f"""WITH {FIELD}, c AS (SELECT slice, y, x, n, CAST(2 + n % 3 AS DOUBLE) AS rad FROM cells),
j AS (SELECT c.slice, c.y AS cy, c.x AS cx, f.u, f.v, f.y, f.x FROM c JOIN field f ON f.slice = c.slice AND sqrt(pow(f.x - c.x, 2) + pow(f.y - c.y, 2)) <= c.rad)"""


def _centres(spark, folder):
    c = sparse_field(spark, folder)
    return c.select("slice", "y", "x", (F.lit(2) + F.col("n") % 3).cast("double").alias("rad"), F.struct("slice", "y", "x").alias("pid"))


def _gridded(spark, folder):
    return field(spark, folder).select("slice", F.col("y").alias("gy"), F.col("x").alias("gx"), F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))


@query("radius_aggregate", DISC + """ SELECT slice, cy AS y, cx AS x, count(*) AS n_cells, round(avg(u), 6) AS u_mean, quantile_cont(u, 0.5) AS u_median, round(stddev_samp(u), 6) AS u_std, round(quantile_cont(u, 0.95) - quantile_cont(u, 0.05), 6) AS u_delta, CAST(sum(v) AS DOUBLE) AS v_sum,
 round(sqrt(pow(avg(u), 2) + pow(avg(v), 2)), 6) AS w_mean_magnitude FROM j GROUP BY 1, 2, 3""")
def radius_aggregate(spark, folder):
    out = aggregate.disc_aggregate(_centres(spark, folder), _gridded(spark, folder), ["slice"], "pid", "x", "y", "rad", "gx", "gy",
                                   {"u_mean": ("u", "mean"), "u_median": ("u", "median"), "u_std": ("u", "std"), "u_delta": ("u", "delta"), "v_sum": ("v", "sum")}, 4.0, vectors={"w": ("u", "v")})
    return out.select("slice", "y", "x", "n_cells", *[r6(c).alias(c) for c in ("u_mean", "u_median", "u_std", "u_delta", "v_sum", "w_mean_magnitude")])


@query("poleward_half_disc", DISC + """ SELECT c.slice, c.y, c.x, count(j.u) AS n_cells, round(avg(j.u), 6) AS u_mean FROM c LEFT JOIN j ON j.slice = c.slice AND j.cy = c.y AND j.cx = c.x AND j.y > j.cy GROUP BY 1, 2, 3""")
def poleward_half_disc(spark, folder):
    out = aggregate.disc_aggregate(_centres(spark, folder), _gridded(spark, folder), ["slice"], "pid", "x", "y", "rad", "gx", "gy", {"u_mean": ("u", "mean")}, 4.0, extra=F.col("gy") > F.col("y"))
    return out.select("slice", "y", "x", "n_cells", r6("u_mean").alias("u_mean"))


@query("box_aggregate", f"""WITH {FIELD}, c AS (SELECT slice, y, x, CAST(2 + n % 3 AS DOUBLE) AS rad FROM cells)
SELECT c.slice, c.y, c.x, count(*) AS n_cells, CAST(min(f.u) AS DOUBLE) AS u_min, CAST(max(f.u) AS DOUBLE) AS u_max, round(avg(sqrt(f.u * f.u + f.v * f.v)), 6) AS wspd_mean FROM c JOIN field f ON f.slice = c.slice AND f.x - c.x >= -rad AND f.x - c.x < rad AND f.y - c.y >= -rad AND f.y - c.y < rad GROUP BY 1, 2, 3""")
def box_aggregate(spark, folder):
    g = _gridded(spark, folder).withColumn("w", F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")))
    out = aggregate.box_aggregate(_centres(spark, folder), g, ["slice"], "pid", "x", "y", "rad", "gx", "gy", {"u_min": ("u", "min"), "u_max": ("u", "max"), "wspd_mean": ("w", "mean")}, 4.0)
    return out.select("slice", "y", "x", "n_cells", "u_min", "u_max", r6("wspd_mean").alias("wspd_mean"))


@query("radius_join_degrees", f"""WITH {FIELD}, c AS (SELECT slice, y, x, x * 7.2 - 180.0 AS lon, y * 10.0 AS lat, 8.0 + n AS r FROM cells), g AS (SELECT slice, x * 7.2 - 180.0 AS glon, y * 10.0 AS glat, u FROM field),
d AS (SELECT c.*, g.u, g.glat - c.lat AS dlat, ((((g.glon - c.lon + 180.0) % 360.0) + 360.0) % 360.0) - 180.0 AS dlon FROM c JOIN g ON g.slice = c.slice)
SELECT slice, y, x, count(*) AS n_cells, round(avg(u), 6) AS u_mean, CAST(max(u) AS DOUBLE) AS u_max FROM d WHERE abs(dlon) <= r AND abs(dlat) <= r AND sqrt(dlat * dlat + pow(dlon * cos(radians(lat)), 2)) <= r GROUP BY 1, 2, 3""")
def radius_join_degrees(spark, folder):
    c = sparse_field(spark, folder).select(
        "slice", "y", "x", (F.col("x") * 7.2 - 180.0).alias("lon"), (F.col("y") * 10.0).alias("lat"), (F.lit(8.0) + F.col("n")).alias("r"), F.struct("slice", "y", "x").alias("pid"))
    g = field(spark, folder).select("slice", (F.col("x") * 7.2 - 180.0).alias("glon"), (F.col("y") * 10.0).alias("glat"), F.col("u").cast("double").alias("u"))
    out = aggregate.disc_aggregate_degrees(c, g, ["slice"], "pid", "lon", "lat", "r", "glon", "glat", {"u_mean": ("u", "mean"), "u_max": ("u", "max")}, 15.0)
    return out.select("slice", "y", "x", "n_cells", r6("u_mean").alias("u_mean"), r6("u_max").alias("u_max"))


@query("radial_profile", f"""WITH {FIELD}, c AS (SELECT slice, y, x FROM cells) SELECT c.slice, c.y, c.x, CAST(floor(sqrt(pow(f.x - c.x, 2) + pow(f.y - c.y, 2)) / 2.0) AS INTEGER) AS ring, round(avg(f.u), 6) AS ring_mean, count(*) AS n_cells
FROM c JOIN field f ON f.slice = c.slice AND sqrt(pow(f.x - c.x, 2) + pow(f.y - c.y, 2)) <= 7 GROUP BY 1, 2, 3, 4""")
def radial_profile(spark, folder):
    c = sparse_field(spark, folder).select("slice", "y", "x", F.struct("slice", "y", "x").alias("pid"), F.lit(7.0).alias("rad"))
    out = grid.radial_profile(
        c.withColumnsRenamed({"x": "cx", "y": "cy"}), field(spark, folder).select("slice", "y", "x", "u"), ["slice"], "pid", "cx", "cy", "rad", "u", 2.0, 8.0)
    return out.select("pid.slice", "pid.y", "pid.x", "ring", r6("ring_mean").alias("ring_mean"), "n_cells")


@query("hist2d", """SELECT CAST(least(floor((l_quantity - 0) / 5.0), 9) AS INTEGER) AS lon_bin, CAST(least(floor(l_linenumber / 2.0), 2) AS INTEGER) AS lat_bin, count(*) AS density FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 AND l_linenumber BETWEEN 0 AND 6 GROUP BY 1, 2""")
def hist2d(spark, folder):
    li = load(spark, folder, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_linenumber") * 2.5).alias("b"))
    return grid.point_density(li, "a", "b", (0.0, 50.0, 0.0, 15.0), 5.0)


@query("hist2d_weighted", """SELECT CAST(least(floor(l_quantity / 5.0), 9) AS INTEGER) AS lon_bin, CAST(least(floor(l_linenumber / 2.0), 2) AS INTEGER) AS lat_bin, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS density FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 AND l_linenumber BETWEEN 0 AND 6 GROUP BY 1, 2""")
def hist2d_weighted(spark, folder):
    li = load(spark, folder, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_linenumber") * 2.5).alias("b"), F.round(F.col("l_discount") * 100, 0).cast("long").alias("w"))
    return grid.point_density(li, "a", "b", (0.0, 50.0, 0.0, 15.0), 5.0, "w")


@query("distinct_tracks_per_cell", f"""WITH {PTS}, c AS (SELECT DISTINCT track_id, CAST(floor((lon + 120) / 10.0) AS INTEGER) AS lon_bin, CAST(floor((lat - 20) / 10.0) AS INTEGER) AS lat_bin FROM pts WHERE lon >= -120 AND lon < 30 AND lat >= 20 AND lat < 70) SELECT lon_bin, lat_bin, count(*) AS n_tracks FROM c GROUP BY 1, 2""")
def distinct_tracks_per_cell(spark, folder):
    return grid.tracks_per_cell(points(spark, folder), "track_id", "lon", "lat", (-120.0, 30.0, 20.0, 70.0), 10.0)


@query("union_all_sources", """SELECT 'c' AS kind, c_custkey AS id, c_acctbal AS bal, c_mktsegment AS seg FROM customer UNION ALL SELECT 's', s_suppkey, s_acctbal, NULL FROM supplier""")
def union_all_sources(spark, folder):
    c = load(spark, folder, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    s = load(spark, folder, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"))
    return sets.union_all([c, s])


UPS = """a AS (SELECT o_custkey AS k, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS p, max(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS q FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1),
b AS (SELECT o_custkey AS k, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS p, max(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS q FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1)"""


def _versions(spark, folder):
    o = load(spark, folder, "orders")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")

    def build(rows):
        return rows.groupBy(F.col("o_custkey").alias("k")).agg(
            F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("p"),
            F.max(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))).alias("q"))

    return build(o.where(F.col("o_orderdate") < cut)), build(o.where(F.col("o_orderdate") >= cut))


@query("upsert_most_complete", f"""WITH {UPS}, u AS (SELECT *, 0 AS fresh FROM a UNION ALL SELECT *, 1 FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY (p IS NOT NULL)::INT + (q IS NOT NULL)::INT DESC, fresh DESC) AS rn FROM u) SELECT k, p, q FROM r WHERE rn = 1""")
def upsert_most_complete(spark, folder):
    old, new = _versions(spark, folder)
    return sets.upsert_most_complete(old, new, ["k"], ["p", "q"])


@query("replace_slice", f"""WITH {UPS} SELECT k, p, q FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, p, q FROM b""")
def replace_slice(spark, folder):
    old, new = _versions(spark, folder)
    return sets.replace_slice(old, new, "k")


@query("refill_column", f"""WITH {UPS} SELECT a.k, coalesce(b.p, a.p) AS p, a.q FROM a LEFT JOIN b ON a.k = b.k""")
def refill_column(spark, folder):
    old, new = _versions(spark, folder)
    return sweep.refill_column(old, new, "k", "p").select("k", "p", "q")


@query("common_timestamps", f"""WITH {PTS}, {HOURLY} SELECT time FROM href INTERSECT SELECT time FROM hown""")
def common_timestamps(spark, folder):
    return sets.common_times(hourly(spark, folder, True), hourly(spark, folder, False), "time")


@query("distinct_track_cells", f"""WITH {PTS} SELECT DISTINCT track_id, x, y FROM pts""")
def distinct_track_cells(spark, folder):
    return sets.distinct_cells(points(spark, folder), ["track_id", "x", "y"])


@query("missing_days", """SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_totalprice > 300000)""")
def missing_days(spark, folder):
    o = load(spark, folder, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return sets.missing_days(o, o.where("o_totalprice > 300000"), "day")


@query("unequal_tracks", f"""WITH {PTS}, b AS (SELECT * FROM pts WHERE crit < 250), sig AS (SELECT track_id, list((time, lon, lat) ORDER BY time, lon, lat) AS s FROM pts GROUP BY 1), sb AS (SELECT track_id, list((time, lon, lat) ORDER BY time, lon, lat) AS s FROM b GROUP BY 1)
SELECT DISTINCT track_id FROM sig WHERE s NOT IN (SELECT s FROM sb)""")
def unequal_tracks(spark, folder):
    p = points(spark, folder)
    return sets.unequal_tracks(p, p.where("crit < 250"), "track_id", ["time", "lon", "lat"]).select("track_id").distinct()


SCORE = """s AS (SELECT o_orderpriority AS cfg, year(o_orderdate) AS yr, count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) AS pod, CASE WHEN year(o_orderdate) < 2001 THEN quantile_cont(o_totalprice, 0.5) / 5000 END AS mo, quantile_cont(o_totalprice, 0.25) / 5000 AS mo1 FROM orders GROUP BY 1, 2)"""


def _scores(spark, folder):
    o = load(spark, folder, "orders")
    o = o.withColumns({"cfg": F.col("o_orderpriority"), "yr": F.year("o_orderdate")})
    keys = ["cfg", "yr"]
    g = o.groupBy(*keys).agg((F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1))).alias("POD"))
    g = g.join(ordered.exact_percentiles(o, keys, "o_totalprice", {"_m": 0.5, "_q": 0.25}), keys)
    return g.withColumns({"median_overlap_percent": F.when(F.col("yr") < 2001, F.col("_m") / 5000), "median_overlap_percent_1to1": F.col("_q") / 5000}).drop("_m", "_q")


@query("combined_score_ranking", f"""WITH {SCORE} SELECT cfg, CAST(yr AS INTEGER) AS yr, round(100 * pod + mo + mo1, 6) AS combined_score FROM s""")
def combined_score_ranking(spark, folder):
    out = ranking.sort_by_score(_scores(spark, folder), ["cfg", "yr"])
    return out.select("cfg", "yr", r6("combined_score").alias("combined_score"))


@query("top_configurations", f"""WITH {SCORE} SELECT cfg, CAST(yr AS INTEGER) AS yr, round(pod, 6) AS "POD" FROM s ORDER BY pod DESC, cfg, yr LIMIT 10""")
def top_configurations(spark, folder):
    out = ranking.top_n(_scores(spark, folder), [F.col("POD").desc(), "cfg", "yr"], 10)
    return out.select("cfg", "yr", r6("POD").alias("POD"))


@query("threshold_filter_all", f"""WITH {SCORE} SELECT cfg, CAST(yr AS INTEGER) AS yr FROM s WHERE pod >= 0.3 AND mo >= 48 AND mo1 >= 20""")
def threshold_filter_all(spark, folder):
    return sweep.select_configurations(_scores(spark, folder), 0.3, 48.0, 20.0, True).select("cfg", "yr")


@query("threshold_filter_any", f"""WITH {SCORE} SELECT cfg, CAST(yr AS INTEGER) AS yr FROM s WHERE pod >= 0.35 OR coalesce(mo >= 52, FALSE) OR mo1 >= 30""")
def threshold_filter_any(spark, folder):
    return sweep.select_configurations(_scores(spark, folder), 0.35, 52.0, 30.0, False).select("cfg", "yr")


@query("optional_filters", """SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def optional_filters(spark, folder):
    return filters.optional_equals(load(spark, folder, "orders"), o_orderstatus="F", o_orderpriority=["1-URGENT", "2-HIGH"], o_custkey=None).select("o_orderkey")


@query("rotation_sense_split", f"""WITH {CELLS} SELECT slice, y, x, u FROM cells WHERE u < 0""")
def rotation_sense_split(spark, folder):
    return filters.rotation_sense(sparse_field(spark, folder), "u", "AC").select("slice", "y", "x", "u")


@query("large_clusters_only", f"""WITH {CELLS} SELECT slice, y, x, u FROM cells WHERE u <> 0 AND (slice, u) IN (SELECT (slice, u) FROM cells WHERE u <> 0 GROUP BY slice, u HAVING count(*) >= 25)""")
def large_clusters_only(spark, folder):
    return filters.large_clusters(sparse_field(spark, folder), ["slice"], "u", 25).select("slice", "y", "x", "u")


@query("longitude_wrap_filter", f"""WITH {PTS} SELECT event_id FROM pts WHERE (((lon + 360.0) % 360.0) >= 300 OR ((lon + 360.0) % 360.0) <= 20)""")
def longitude_wrap_filter(spark, folder):
    from gyrespark.functions import geo

    return points(spark, folder).where(geo.lon_in_range(geo.lon_360("lon"), 300.0, 20.0)).select("event_id")


@query("genesis_box_filter", f"""WITH {PTS} SELECT event_id FROM pts WHERE lon BETWEEN -100 AND -20 AND lat BETWEEN 25 AND 65""")
def genesis_box_filter(spark, folder):
    from gyrespark.functions import geo

    return points(spark, folder).where(geo.in_box("lon", "lat", -100.0, -20.0, 25.0, 65.0)).select("event_id")


@query("outside_polygon_filter", f"""WITH {PTS} SELECT event_id FROM pts WHERE NOT (lat >= 30.0 AND lat < 50.0 AND lon >= -110 AND lon < -110 + (lat - 30.0) * 2.0)""")
def outside_polygon_filter(spark, folder):
    ring = [(-110.0, 30.0), (-70.0, 50.0), (-110.0, 50.0)]
    return points(spark, folder).where(filters.not_in_polygons("lon", "lat", [ring])).select("event_id")


@query("type_label_filter", f"""WITH {PTS} SELECT event_id FROM pts WHERE label = 'signup'""")
def type_label_filter(spark, folder):
    return filters.optional_equals(points(spark, folder), label="signup").select("event_id")


@query("season_of_track", """SELECT o_custkey, CAST(month(min(o_orderdate)) AS INTEGER) AS first_month, CASE WHEN month(min(o_orderdate)) IN (1, 2, 3) THEN 'winter' WHEN month(min(o_orderdate)) IN (7, 8, 9) THEN 'summer' END AS season FROM orders GROUP BY 1""")
def season_of_track(spark, folder):
    return filters.season_of_first_point(load(spark, folder, "orders"), "o_custkey", "o_orderdate")


@query("season_window_wrapping", """SELECT o_orderkey FROM orders WHERE month(o_orderdate) * 100 + day(o_orderdate) >= 1115 OR month(o_orderdate) * 100 + day(o_orderdate) <= 210""")
def season_window_wrapping(spark, folder):
    return filters.season_window(load(spark, folder, "orders"), "o_orderdate", (11, 15), (2, 10)).select("o_orderkey")


@query("month_filter", """SELECT o_orderkey FROM orders WHERE month(o_orderdate) IN (7, 8, 9)""")
def month_filter(spark, folder):
    return filters.months(load(spark, folder, "orders"), "o_orderdate", [7, 8, 9]).select("o_orderkey")


@query("long_tracks_then_dropna", f"""WITH {PTS}, p AS (SELECT *, CASE WHEN crit < 200 THEN crit END AS c FROM pts) SELECT event_id, track_id FROM p WHERE track_id IN (SELECT track_id FROM p GROUP BY 1 HAVING count(*) >= 70) AND c IS NOT NULL""")
def long_tracks_then_dropna(spark, folder):
    p = points(spark, folder).withColumn("c", F.when(F.col("crit") < 200, F.col("crit")))
    return filters.long_tracks(p, "track_id", 70, ["c"]).select("event_id", "track_id")


@query("partly_outside_tracks", f"""WITH {PTS}, s AS (SELECT track_id, avg(CASE WHEN lon <= -60 THEN 1.0 ELSE 0.0 END) AS f FROM pts GROUP BY 1) SELECT track_id, round(f, 6) AS inside_fraction FROM s WHERE f < 0.9""")
def partly_outside_tracks(spark, folder):
    return filters.partly_outside(points(spark, folder), "track_id", F.col("lon") <= -60, 0.9).withColumn("inside_fraction", r6("inside_fraction"))


@query("domain_crop", f"""WITH {PTS} SELECT event_id, lon FROM pts WHERE lon BETWEEN -100 AND 0 AND lat BETWEEN 30 AND 60""")
def domain_crop(spark, folder):
    return filters.crop(points(spark, folder).withColumn("lon", F.col("lon") + 360.0), "lon", "lat", (-100.0, 0.0), (30.0, 60.0)).select("event_id", "lon")


@query("clustering_input_filter", """SELECT p_partkey, p_size FROM part WHERE NOT (p_size = 1 OR p_size = 50) AND CASE WHEN p_retailprice < 950 THEN p_retailprice END IS NOT NULL""")
def clustering_input_filter(spark, folder):
    p = load(spark, folder, "part").withColumns({"start_stop": F.col("p_size").isin(1, 50), "f": F.when(F.col("p_retailprice") < 950, F.col("p_retailprice"))})
    return filters.clustering_input(p, ["f"]).select("p_partkey", "p_size")


@query("column_drop_and_features", """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem""")
def column_drop_and_features(spark, folder):
    li = filters.drop_columns(load(spark, folder, "lineitem"), ["l_tax", "no_such_column"])
    top = filters.numeric_features(li.select("l_quantity", "l_extendedprice", "l_discount"), None, 1)
    return li.select("l_orderkey", "l_linenumber", *top)


@query("latest_run_per_configuration", """WITH q AS (SELECT o_custkey, o_orderstatus, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderstatus DESC, o_orderpriority DESC, o_totalprice DESC) AS rn FROM orders WHERE o_orderstatus IN ('F', 'O'))
SELECT o_custkey, o_orderstatus, o_totalprice FROM q WHERE rn = 1""")
def latest_run_per_configuration(spark, folder):
    log = load(spark, folder, "orders").select("o_custkey", F.col("o_orderdate").alias("timestamp"), F.col("o_orderstatus").alias("status"), "o_orderpriority", "o_totalprice")
    out = sweep.latest_runs(log, ["o_custkey"], ["F", "O"])
    return out.select("o_custkey", F.col("status").alias("o_orderstatus"), "o_totalprice")


@query("cluster_statistics", f"""WITH {CELLS}, c AS (SELECT *, CAST(sign(u) AS INTEGER) * CAST(n AS INTEGER) AS cluster FROM cells WHERE u <> 0), q AS (SELECT *, row_number() OVER (PARTITION BY slice, cluster ORDER BY abs(u) DESC, y, x) AS rn, count(*) OVER (PARTITION BY slice, cluster) AS k FROM c)
SELECT slice, cluster, x, y, CAST(u AS DOUBLE) AS crit, k AS n_cells, round(sqrt(k / pi()), 6) AS rad_eff FROM q WHERE rn = 1""")
def cluster_statistics(spark, folder):
    c = sparse_field(spark, folder).where("u <> 0").select("slice", "y", "x", F.col("u").cast("double").alias("crit"), (F.signum("u").cast("int") * F.col("n").cast("int")).alias("cluster"))
    return aggregate.cluster_stats(c, ["slice"]).withColumn("rad_eff", r6("rad_eff"))


@query("cluster_area_radius", f"""WITH {CELLS}, c AS (SELECT slice, CAST(n AS INTEGER) AS cluster, y * 0.125 + 50.0 AS lat FROM cells), a AS (SELECT slice, cluster, sum(6371.0 * 6371.0 * radians(0.25) * radians(0.125) * cos(radians(lat))) AS area FROM c GROUP BY 1, 2) SELECT slice, cluster, round(area, 4) AS area_km2, round(sqrt(area / pi()), 6) AS rad_km FROM a""")
def cluster_area_radius(spark, folder):
    c = sparse_field(spark, folder).select("slice", F.col("n").cast("int").alias("cluster"), (F.col("y") * 0.125 + 50.0).alias("lat"))
    out = aggregate.cluster_area_radius(c, ["slice"], "cluster", "lat", 0.25, 0.125)
    return out.select("slice", "cluster", F.round("area_km2", 4).alias("area_km2"), r6("rad_km").alias("rad_km"))


@query("grid_step_from_coordinates", f"""WITH {PTS}, a AS (SELECT DISTINCT lat FROM pts), d AS (SELECT lead(lat) OVER (ORDER BY lat) - lat AS d FROM a) SELECT abs(quantile_cont(d, 0.5)) AS step FROM d""")
def grid_step_from_coordinates(spark, folder):
    return grid.grid_step(points(spark, folder), "lat")


@query("sorted_by_strength", f"""WITH {CELLS} SELECT slice, y, x, u, CAST(row_number() OVER (PARTITION BY slice ORDER BY abs(u) DESC, y, x) AS BIGINT) AS place FROM cells""")
def sorted_by_strength(spark, folder):
    return ranking.strongest_first(sparse_field(spark, folder), ["slice"], "u").select("slice", "y", "x", "u", "place")


@query("date_ordered_batches", """SELECT o_orderkey, o_orderdate FROM orders""")
def date_ordered_batches(spark, folder):
    return ranking.date_batches(load(spark, folder, "orders"), "o_orderdate", 8).select("o_orderkey", "o_orderdate")

