"""Scalar-function queries: geometry, thermodynamics, names and times."""

from pyspark.sql import functions as F

from gyrespark.functions import geo, text, thermo
from gyrespark.operators import filters, ordered
from gyrespark.plans import sweep
from gyrespark.plans.catalog.base import CELLS, PTS, hav, load, points, query, r6, sparse_field

P2 = f"WITH {PTS}, q AS (SELECT event_id, lon AS lon1, lat AS lat1, CAST(y AS DOUBLE) * 3.0 - 150.0 AS lon2, CAST(x % 60 AS DOUBLE) + 5.0 AS lat2, crit FROM pts)"


def pairs(spark, folder):
    return points(spark, folder).select(
        "event_id", F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), (F.col("y") * 3.0 - 150.0).alias("lon2"),
        ((F.col("x") % 60).cast("double") + 5.0).alias("lat2"), "crit", "x", "y")


@query("great_circle_distance", f"{P2} SELECT event_id, round({hav('lon1', 'lat1', 'lon2', 'lat2')}, 6) AS dist_km FROM q")
def great_circle_distance(spark, folder):
    return pairs(spark, folder).select("event_id", r6(geo.haversine_km("lon1", "lat1", "lon2", "lat2")).alias("dist_km"))


@query("initial_bearing", f"""{P2}, b AS (SELECT event_id, CAST(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) AS DOUBLE) AS a FROM q)
SELECT event_id, round((a + 360.0) % 360.0, 5) AS bearing FROM b""")
def initial_bearing(spark, folder):
    return pairs(spark, folder).select("event_id", F.round(geo.bearing_deg("lon1", "lat1", "lon2", "lat2"), 5).alias("bearing"))


@query("destination_point", f"""{P2}, r AS (SELECT event_id, radians(lat1) AS la, radians(lon1) AS lo, radians(lat2 * 3) AS b, crit * 10 / 6371.0 AS d FROM q), s AS (SELECT *, asin(sin(la) * cos(d) + cos(la) * sin(d) * cos(b)) AS la2 FROM r)
SELECT event_id, round((CAST(degrees(lo + atan2(sin(b) * sin(d) * cos(la), cos(d) - sin(la) * sin(la2))) AS DOUBLE) + 720.0) % 360.0, 5) AS lon_new, round(degrees(la2), 5) AS lat_new FROM s""")
def destination_point(spark, folder):
    lon, lat = geo.destination("lon1", "lat1", F.col("crit") * 10.0, F.col("lat2") * 3)
    return pairs(spark, folder).select("event_id", F.round(lon, 5).alias("lon_new"), F.round(lat, 5).alias("lat_new"))


@query("search_radius", f"{P2} SELECT event_id, round(greatest(crit * 3600 / 1000.0 + lat2 * 1.5, lat2 * 1.5 / 2), 6) AS radius_km FROM q")
def search_radius(spark, folder):
    return pairs(spark, folder).select("event_id", r6(geo.search_radius_km("crit", 3600.0, "lat2", 1.5)).alias("radius_km"))


@query("longitude_normalisation", f"""WITH {PTS}, q AS (SELECT event_id, lon * 3.0 AS a, CAST(y AS DOUBLE) * 7.0 AS b FROM pts)
SELECT event_id, ((((a + 180.0) % 360.0) + 360.0) % 360.0) - 180.0 AS lon180, ((a % 360.0) + 360.0) % 360.0 AS lon360, ((((a - b + 180.0) % 360.0) + 360.0) % 360.0) - 180.0 AS diff FROM q""")
def longitude_normalisation(spark, folder):
    p = points(spark, folder).select("event_id", (F.col("lon") * 3.0).alias("a"), (F.col("y") * 7.0).alias("b"))
    return p.select("event_id", geo.lon_180("a").alias("lon180"), geo.lon_360("a").alias("lon360"), geo.lon_diff("a", "b").alias("diff"))


@query("grid_distances", f"""WITH {PTS} SELECT event_id, round(6371000.0 * radians(0.25) * cos(radians(lat)), 4) AS dx_m, round(6371000.0 * radians(0.25), 4) AS dy_m, round(crit * sqrt(111.0 * 0.25 * cos(radians(lat)) * 111.0 * 0.25), 6) AS rad_km, round(crit * 27.75, 6) AS rad_fixed_km FROM pts""")
def grid_distances(spark, folder):
    dx, dy = geo.grid_step_m("lat", 0.25)
    return points(spark, folder).select("event_id", F.round(dx, 4).alias("dx_m"), F.round(dy, 4).alias("dy_m"), r6(geo.radius_cells_to_km("crit", "lat", 0.25, 0.25)).alias("rad_km"),
                                        r6(geo.radius_cells_to_km_fixed("crit", 27750.0)).alias("rad_fixed_km"))


@query("index_coordinate_mapping", f"""WITH {PTS} SELECT event_id, -180.0 + least(greatest(crit, 0), 99) * 3.6 AS lon_at, CAST(least(greatest(ceil(round((lat - 90.0) / -0.7, 6) - 0.5), 0), 99) AS INTEGER) AS lat_idx, y * 6.0 / 111.0 AS lat_affine FROM pts""")
def index_coordinate_mapping(spark, folder):
    lat, _ = geo.grid_to_latlon("x", "y", 6.0)
    return points(spark, folder).select("event_id", geo.index_to_coord("crit", -180.0, 3.6, 100).alias("lon_at"), geo.coord_to_index("lat", 90.0, -0.7, 100).alias("lat_idx"), lat.alias("lat_affine"))


@query("coordinate_text_parsing", """WITH q AS (SELECT s_suppkey, concat(printf('%.1f', abs(s_acctbal) / 100), CASE WHEN s_acctbal < 0 THEN 'W' ELSE 'E' END) AS t FROM supplier) SELECT s_suppkey, t, CAST(regexp_extract(t, '([0-9.]+)', 1) AS DOUBLE) * CASE WHEN t LIKE '%W' THEN -1 ELSE 1 END AS lon FROM q""")
def coordinate_text_parsing(spark, folder):
    s = load(spark, folder, "supplier")
    t = F.concat(F.format_string("%.1f", F.abs("s_acctbal") / 100), F.when(F.col("s_acctbal") < 0, "W").otherwise("E"))
    return s.select("s_suppkey", t.alias("t")).withColumn("lon", geo.parse_coordinate("t"))


@query("point_in_ellipse", f"""WITH {PTS} SELECT event_id FROM pts WHERE pow(((x - 50) * cos(0.6) + (y - 50) * sin(0.6)) / 40.0, 2) + pow(((y - 50) * cos(0.6) - (x - 50) * sin(0.6)) / 20.0, 2) <= 1""")
def point_in_ellipse(spark, folder):
    return points(spark, folder).where(geo.in_ellipse("x", "y", 50.0, 50.0, 40.0, 20.0, 0.6)).select("event_id")


E_SQL = """q AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS DOUBLE) AS cx, l_linenumber * 4.0 AS cy, l_quantity + l_tax * 100 AS x1, l_linenumber * 4.0 + 3 AS y1, l_quantity - l_discount * 100 - 1 AS x2, l_linenumber * 4.0 - 5 AS y2, l_quantity + 2 AS x3, l_linenumber * 4.0 - l_tax * 100 AS y3 FROM lineitem)"""


def _ellipses(spark, folder):
    q, n, d, t = F.col("l_quantity"), F.col("l_linenumber") * 4.0, F.col("l_discount") * 100, F.col("l_tax") * 100
    return load(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", q.alias("cx"), n.alias("cy"), (q + t).alias("x1"), (n + 3).alias("y1"), (q - d - 1).alias("x2"), (n - 5).alias("y2"), (q + 2).alias("x3"), (n - t).alias("y3"))


@query("effective_radius", f"""WITH {E_SQL} SELECT l_orderkey, l_linenumber, l_partkey, round((sqrt(pow(x1 - x2, 2) + pow(y1 - y2, 2)) / 2 + sqrt(pow((x1 + x2) / 2 - x3, 2) + pow((y1 + y2) / 2 - y3, 2))) / 2, 6) AS radius FROM q""")
def effective_radius(spark, folder):
    return _ellipses(spark, folder).select("l_orderkey", "l_linenumber", "l_partkey", r6(geo.effective_radius("x1", "y1", "x2", "y2", "x3", "y3")).alias("radius"))


@query("ellipse_from_points", f"""WITH {E_SQL}, e AS (SELECT *, greatest(sqrt(pow(x1 - cx, 2) + pow(y1 - cy, 2)), sqrt(pow(x2 - cx, 2) + pow(y2 - cy, 2))) AS a0, abs((y3 - cy) * (x2 - x1) - (x3 - cx) * (y2 - y1)) / sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS b0, atan2(y2 - y1, x2 - x1) AS an FROM q),
g AS (SELECT *, greatest(greatest(a0, b0), 3) AS a, greatest(least(a0, b0), 2) AS b FROM e)
SELECT l_orderkey, l_linenumber, l_partkey, round(a, 6) AS semi_major_axis, round(b, 6) AS semi_minor_axis, round(sqrt(1 - pow(b / a, 2)), 6) AS eccentricity FROM g""")
def ellipse_from_points(spark, folder):
    e = geo.ellipse_from_points("cx", "cy", "x1", "y1", "x2", "y2", "x3", "y3")
    return _ellipses(spark, folder).select("l_orderkey", "l_linenumber", "l_partkey", *[r6(e[k]).alias(k) for k in ("semi_major_axis", "semi_minor_axis", "eccentricity")])


@query("wind_speed", f"WITH {CELLS} SELECT slice, y, x, round(sqrt(u * u + v * v), 6) AS wspd FROM cells")
def wind_speed(spark, folder):
    return sparse_field(spark, folder).select("slice", "y", "x", r6(geo.wind_speed("u", "v")).alias("wspd"))


T_SQL = "t AS (SELECT event_id, 270.0 + y * 0.3::DOUBLE AS sst, 280.0 + (x % 40) AS t5, 275.0 + (x % 25) AS t7, 980.0 + y * 0.4137::DOUBLE AS slp, 2500.0 + x AS z7 FROM pts)"


def _thermo(spark, folder):
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    return points(spark, folder).select("event_id", (270.0 + y * 0.3).alias("sst"), (280.0 + x % 40).alias("t5"), (275.0 + x % 25).alias("t7"), (980.0 + y * 0.4137).alias("slp"), (2500.0 + x).alias("z7"))


@query("cold_air_outbreak_indices", f"""WITH {PTS}, {T_SQL} SELECT event_id, round((sst - t5) / (slp * 100.0 - 50000.0), 8) AS mcao_500, round((sst - t7) / (slp * 100.0 - 70000.0), 8) AS mcao_700, round(7.5e5 / z7 * (ln(sst) - ln(t7)), 6) AS mcao_log FROM t""")
def cold_air_outbreak_indices(spark, folder):
    return _thermo(spark, folder).select("event_id", F.round(thermo.mcao_kolstad("sst", "t5", "slp", 50000.0), 8).alias("mcao_500"), F.round(thermo.mcao_kolstad("sst", "t7", "slp", 70000.0), 8).alias("mcao_700"),
                                         r6(thermo.mcao_bracegirdle("sst", "t7", "z7")).alias("mcao_log"))


@query("george_k_index", f"""WITH {PTS}, {T_SQL} SELECT event_id, round((sst - 273.15 - (t5 - 300.0)) + (sst - 276.15) - ((t7 - 283.15) - (t7 - 288.15)), 6) AS k_index FROM t""")
def george_k_index(spark, folder):
    k = thermo.george_k(F.col("sst") - 273.15, F.col("t7") - 283.15, F.col("t5") - 300.0, F.col("sst") - 276.15, F.col("t7") - 288.15)
    return _thermo(spark, folder).select("event_id", r6(k).alias("k_index"))


@query("lifted_index_p95", None)
def lifted_index_p95(spark, folder):
    t = _thermo(spark, folder).withColumn("li", thermo.lifted_index(F.col("t5") - 25.0, F.col("sst") - 268.15, F.col("sst") - 271.15, "slp"))
    p = points(spark, folder).select("event_id", "track_id")
    top = ordered.exact_percentiles(t.join(p, "event_id"), ["track_id"], "li", {"li_p95": 0.95})
    return top.withColumn("li_p95", F.round("li_p95", 4))


@query("shear_vector", f"""WITH {PTS}, s AS (SELECT event_id, CAST(x AS DOUBLE) AS ad, y * 3.6 AS ap, crit AS m FROM pts), a AS (SELECT *, ((ad - ap) % 360.0 + 360.0) % 360.0 AS raw FROM s), b AS (SELECT *, CASE WHEN raw > 180 THEN raw - 360.0 ELSE raw END AS an FROM a)
SELECT event_id, round(an, 6) AS angle, round(m * cos(radians(an)), 6) AS shear_u, round(m * sin(radians(an)), 6) AS shear_v FROM b""")
def shear_vector(spark, folder):
    a, u, v = thermo.shear_vector("x", F.col("y") * 3.6, "crit")
    return points(spark, folder).select("event_id", r6(a).alias("angle"), r6(u).alias("shear_u"), r6(v).alias("shear_v"))


@query("configuration_labels", """SELECT p_partkey, concat('eps', lpad(CAST(p_size % 3 AS VARCHAR), 2, '0'), '_sf', lpad(CAST(p_size AS VARCHAR), 2, '0'), '_', p_type, '_mg', p_size % 7, 'h_mt', p_size % 11, 'h', CASE WHEN p_retailprice > 950 THEN '_prioritize' ELSE '' END) AS label,
 concat('_range_', replace(CAST(p_size / 4 AS VARCHAR), '.', '_'), '_', p_size, 'h_', p_size % 5, 'h', CASE WHEN p_retailprice > 950 THEN '_prioritize_r2d' ELSE '' END) AS postfix FROM part""")
def configuration_labels(spark, folder):
    p = load(spark, folder, "part")
    s, hot = F.col("p_size"), F.col("p_retailprice") > 950
    return p.select("p_partkey", text.combo_label(s % 3, s, "p_type", s % 7, s % 11, hot).alias("label"), text.tracking_postfix(s / 4, s, s % 5, hot).alias("postfix"))


@query("postfix_parsing", """SELECT p_partkey, p_size / 4 AS search_range, p_size AS mintime, p_size % 5 AS maxgap, p_retailprice > 950 AS prioritize FROM part""")
def postfix_parsing(spark, folder):
    s, hot = F.col("p_size"), F.col("p_retailprice") > 950
    q = load(spark, folder, "part").select("p_partkey", text.tracking_postfix(s / 4, s, s % 5, hot).alias("postfix"))
    parsed = text.parse_postfix("postfix")
    return q.select("p_partkey", *[c.alias(n) for n, c in parsed.items()])


@query("sweep_labels_from_grid", """WITH g AS (SELECT unnest([1, 2]) AS eps), s AS (SELECT unnest([10, 25, 49]) AS size_filter), n AS (SELECT p_type, count(*) AS n_parts FROM part GROUP BY 1)
SELECT eps, size_filter, p_type, n_parts, concat('eps', lpad(CAST(eps AS VARCHAR), 2, '0'), '_sf', lpad(CAST(size_filter AS VARCHAR), 2, '0'), '_', p_type, '_mg3h_mt12h') AS label FROM g, s, n""")
def sweep_labels_from_grid(spark, folder):
    kinds = load(spark, folder, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n_parts"))
    g = sweep.parameter_grid(spark, {"eps": [1, 2], "size_filter": [10, 25, 49]})
    full = sweep.with_configurations(kinds, g).withColumns({"extr_type": F.col("p_type"), "maxgap": F.lit(3), "mintime": F.lit(12), "prioritize": F.lit(False)})
    return sweep.labelled(full).select("eps", "size_filter", "p_type", "n_parts", "label")


@query("name_prefix_padding", """SELECT o_orderkey, concat(lpad(CAST(o_orderkey AS VARCHAR), 8, '0'), '_track_', strftime(o_orderdate, '%Y-%m-%d'), 'T00.csv') AS name, CAST(o_orderdate AS DATE) AS start_date, o_orderkey AS id FROM orders""")
def name_prefix_padding(spark, folder):
    raw = F.concat(F.col("o_orderkey").cast("string"), F.lit("_track_"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00.csv"))
    q = load(spark, folder, "orders").select("o_orderkey", raw.alias("raw"), F.concat(F.lit("t_"), F.col("o_orderkey").cast("string"), F.lit("_x")).alias("tag"))
    return q.select("o_orderkey", text.pad_name_prefix("raw").alias("name"), text.start_date_of_name("raw").alias("start_date"), text.last_number("tag").alias("id"))


@query("regex_ids", """SELECT c_custkey, CAST(regexp_extract(c_name, '(\\d+)$', 1) AS BIGINT) AS id FROM customer""")
def regex_ids(spark, folder):
    return load(spark, folder, "customer").select("c_custkey", text.last_number("c_name").alias("id"))


@query("tolerant_time_parsing", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS t FROM orders""")
def tolerant_time_parsing(spark, folder):
    d = F.col("o_orderdate")
    raw = (F.when(F.col("o_orderstatus") == "P", F.lit("n/a")).when(F.col("o_orderpriority") == "1-URGENT", F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
           .when(F.col("o_orderpriority") == "2-HIGH", F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).when(F.col("o_orderpriority") == "3-MEDIUM", F.date_format(d, "yyyy-MM-dd_HH:mm:ss"))
           .otherwise(F.date_format(d, "yyyy-MM-dd")))
    return load(spark, folder, "orders").select("o_orderkey", text.parse_time(raw).alias("t"))


@query("cf_time_decoding", f"""WITH {PTS} SELECT event_id, make_timestamp(CAST(epoch_us(TIMESTAMP '1900-01-01 00:00:00') + x * 3600000000::BIGINT + y * 36000000::BIGINT AS BIGINT)) AS t FROM pts""")
def cf_time_decoding(spark, folder):
    return points(spark, folder).select("event_id", text.decode_cf_time(F.col("x") + F.col("y") * 0.01, "hours", "1900-01-01 00:00:00").alias("t"))


@query("boolean_text", """SELECT p_partkey, p_size % 3 = 0 AS flag FROM part""")
def boolean_text(spark, folder):
    raw = F.when(F.col("p_size") % 3 == 0, F.when(F.col("p_size") % 2 == 0, "True").otherwise("1")).otherwise("no")
    return load(spark, folder, "part").select("p_partkey", text.text_is_true(raw).alias("flag"))


@query("duration_bins", f"""WITH {PTS} SELECT CASE WHEN crit <= 25 THEN 'short' WHEN crit <= 75 THEN 'medium' WHEN crit <= 150 THEN 'long' ELSE 'very long' END AS bin, count(*) AS n FROM pts GROUP BY 1""")
def duration_bins(spark, folder):
    c = F.col("crit")
    label = F.when(c <= 25, "short").when(c <= 75, "medium").when(c <= 150, "long").otherwise("very long")
    return points(spark, folder).groupBy(label.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("canonical_track_projection", f"""WITH {PTS} SELECT track_id, time, lon, lat, crit, CAST(year(time) AS INTEGER) AS year, CAST(month(time) AS INTEGER) AS month, CAST(day(time) AS INTEGER) AS day, CAST(hour(time) AS INTEGER) AS hour FROM pts""")
def canonical_track_projection(spark, folder):
    from gyrespark.sources import tables

    return tables.with_date_parts(tables.canonical_tracks(points(spark, folder), "track_id", "time", "lon", "lat", ["crit"]))


@query("fuzzy_column_lookup", """SELECT c_custkey AS id, c_acctbal AS balance FROM customer""")
def fuzzy_column_lookup(spark, folder):
    from gyrespark.schemas import resolve_column

    c = load(spark, folder, "customer")
    return c.select(F.col(resolve_column(c.columns, ["CUSTKEY"])).alias("id"), F.col(resolve_column(c.columns, "acctbal")).alias("balance"))


@query("nan_to_null", f"""WITH {PTS} SELECT event_id, CASE WHEN y >= 50 THEN crit END AS value FROM pts""")
def nan_to_null(spark, folder):
    p = points(spark, folder).select("event_id", F.when(F.col("y") >= 50, F.col("crit")).otherwise(F.lit(float("nan"))).alias("value"))
    return filters.nan_to_null(p)
