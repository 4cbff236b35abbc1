"""Window and ordered-sequence queries."""

from pyspark.sql import functions as F

from gyrespark.operators import aggregate, ordered, sequences
from gyrespark.plans import climatology
from gyrespark.plans.catalog.base import PTS, TIE, chunk, hav, points, query, r6

W = "OVER (PARTITION BY track_id ORDER BY time, event_id)"


@query("track_path_length", f"""WITH {PTS}, s AS (SELECT *, coalesce(sqrt(pow(x - lag(x) {W}, 2) + pow(y - lag(y) {W}, 2)), 0) AS step FROM pts)
SELECT event_id, track_id, round(sum(step) OVER (PARTITION BY track_id ORDER BY time, event_id ROWS UNBOUNDED PRECEDING), 6) AS track_len FROM s""")
def track_path_length(spark, folder):
    out = sequences.path_length(points(spark, folder), "track_id", "time", "x", "y", chunk(), TIE)
    return out.select("event_id", "track_id", r6("track_len").alias("track_len"))


@query("track_peak_row", f"""WITH {PTS}, n AS (SELECT *, row_number() {W} AS rn FROM pts),
b AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY crit DESC, time, event_id) AS best FROM n WHERE rn > 1)
SELECT track_id, event_id, time, crit, label FROM b WHERE best = 1""")
def track_peak_row(spark, folder):
    out = aggregate.peak_row(points(spark, folder), "track_id", "time", "crit", ["event_id", "label"], tie=TIE)
    return out.select("track_id", "event_id", "time", "crit", "label")


@query("track_peak_speed", f"""WITH {PTS}, s AS (SELECT *, row_number() {W} AS rn, count(*) OVER (PARTITION BY track_id) AS n,
  sqrt(pow(x - lag(x) {W}, 2) + pow(y - lag(y) {W}, 2)) AS step FROM pts),
b AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY crit DESC, time, event_id) AS best FROM s WHERE rn > 1),
p AS (SELECT track_id, event_id, rn, n FROM b WHERE best = 1)
SELECT p.track_id, p.event_id, round(avg(s.step) * 77.0 / 3.0, 6) AS velocity, p.rn = p.n OR p.rn = 1 AS start_stop
FROM p JOIN s ON s.track_id = p.track_id AND s.rn BETWEEN greatest(p.rn - 2, 1) + 1 AND least(p.rn + 2, p.n) GROUP BY 1, 2, p.rn, p.n""")
def track_peak_speed(spark, folder):
    p = points(spark, folder)
    peak = aggregate.peak_row(p, "track_id", "time", "crit", ["event_id"], tie=TIE).select(F.col("event_id").alias("_pk"))
    marked = p.join(peak, p["event_id"] == peak["_pk"], "left").withColumn("_flag", F.col("_pk").isNotNull()).drop("_pk")
    out = sequences.peak_speed(marked, "track_id", "time", "x", "y", F.col("_flag"), 77.0 / 3.0, chunk(), TIE)
    return out.select("track_id", "event_id", r6("velocity").alias("velocity"), "start_stop")


@query("peak_summary_table", f"""WITH {PTS}, s AS (SELECT *, row_number() {W} AS rn, coalesce(sqrt(pow(x - lag(x) {W}, 2) + pow(y - lag(y) {W}, 2)), 0) AS step FROM pts),
t AS (SELECT track_id, round(sum(step), 6) AS track_len, round((epoch_us(max(time)) - epoch_us(min(time))) / 3.6e9, 6) AS duration FROM s GROUP BY 1),
b AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY crit DESC, time, event_id) AS best FROM s WHERE rn > 1)
SELECT b.track_id, b.event_id, b.crit, t.track_len, t.duration FROM b JOIN t USING (track_id) WHERE best = 1""")
def peak_summary_table(spark, folder):
    out = climatology.peak_table(points(spark, folder), "track_id", "time", "x", "y", "crit", 77.0 / 3.0, TIE)
    return out.select("track_id", "event_id", "crit", r6("track_len").alias("track_len"), r6("duration").alias("duration"))


@query("rolling_mean_centered", f"""WITH {PTS}, s AS (SELECT *, row_number() {W} AS rn, count(*) OVER (PARTITION BY track_id) AS n,
  coalesce(sqrt(pow(x - lag(x) {W}, 2) + pow(y - lag(y) {W}, 2)), 0) AS step, x - lag(x) {W} AS dx, y - lag(y) {W} AS dy, lead(x) {W} - x AS ex, lead(y) {W} - y AS ey FROM pts)
SELECT event_id, round(CASE WHEN n >= 2 THEN avg(step) OVER (PARTITION BY track_id ORDER BY time, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) ELSE 0 END * 77.0 / 3.0, 6) AS speed,
  round(CASE WHEN rn = 1 OR rn = n THEN 0 ELSE atan2(dx * ey - dy * ex, dx * ex + dy * ey) END, 6) AS turn_angle FROM s""")
def rolling_mean_centered(spark, folder):
    out = sequences.rolling_speed_and_turn(points(spark, folder), "track_id", "time", "x", "y", 77.0, 3.0, chunk(), TIE)
    return out.select("event_id", r6("speed").alias("speed"), r6("turn_angle").alias("turn_angle"))


def _bergeron_sql(tau: int, k: int) -> str:
    lag, lead = f"lag(%s, {k}) {W}", f"lead(%s, {k}) {W}"
    return (f"round(CASE WHEN abs((epoch_us(time) - epoch_us({lag % 'time'})) / 3.6e9 - {tau / 2}) < 6 "
            f"AND abs((epoch_us({lead % 'time'}) - epoch_us(time)) / 3.6e9 - {tau / 2}) < 6 THEN "
            f"({lag % 'crit'} - {lead % 'crit'}) / {float(tau)} * sin(radians(45.0)) / sin(radians(({lag % 'lat'} + {lead % 'lat'}) / 2)) END, 6) AS bergeron_{tau}h")


@query("bergeron_lag_lead", f"""WITH {PTS} SELECT event_id, {', '.join(_bergeron_sql(t, k) for t, k in [(12, 1), (24, 2), (48, 4)])} FROM pts""")
def bergeron_lag_lead(spark, folder):
    out = sequences.bergeron_index(points(spark, folder), "track_id", "time", "lat", "crit", [12, 24, 48], 6.0, 6.0, chunk(), TIE)
    return out.select("event_id", *[r6(f"bergeron_{t}h").alias(f"bergeron_{t}h") for t in (12, 24, 48)])


@query("forward_dt_fill", f"""WITH {PTS}, s AS (SELECT *, (epoch_us(lead(time) {W}) - epoch_us(time)) / 3.6e9 AS dt,
  {hav('lon', 'lat', f'lead(lon) {W}', f'lead(lat) {W}')} AS d FROM pts),
m AS (SELECT track_id, quantile_cont(dt, 0.5) AS med FROM s GROUP BY 1), gg AS (SELECT quantile_cont(dt, 0.5) AS g0 FROM s)
SELECT event_id, round(CASE WHEN coalesce(dt, med, g0) <= 0 THEN g0 ELSE coalesce(dt, med, g0) END, 6) AS dt_h_fwd,
  round(CASE WHEN dt > 0 THEN d / dt END, 4) AS speed_kmh FROM s JOIN m USING (track_id), gg""")
def forward_dt_fill(spark, folder):
    out = sequences.forward_step(points(spark, folder), "track_id", "time", "lon", "lat", chunk(), TIE)
    return out.select("event_id", r6("dt_h_fwd").alias("dt_h_fwd"), F.round("speed_kmh", 4).alias("speed_kmh"))


@query("rain_deaccumulation", f"""WITH {PTS} SELECT event_id, round(crit - lag(crit) {W}, 6) AS delta FROM pts""")
def rain_deaccumulation(spark, folder):
    out = sequences.step_difference(points(spark, folder), ["track_id"], "time", "crit", chunk(), TIE)
    return out.select("event_id", r6("delta").alias("delta"))


@query("propagation_direction", f"""WITH {PTS}, s AS (SELECT event_id, (lat - lag(lat) {W}) * 111.0 AS dy,
  (lon - lag(lon) {W}) * 111.0 * cos(radians((lat + lag(lat) {W}) / 2)) AS dx FROM pts)
SELECT event_id, round((CAST(degrees(atan2(dy, dx)) AS DOUBLE) + 360.0) % 360.0, 6) AS alpha_p, round(sqrt(dx * dx + dy * dy), 6) AS propagation_speed FROM s""")
def propagation_direction(spark, folder):
    out = sequences.propagation(points(spark, folder), "track_id", "time", "lon", "lat", 1.0, chunk(), TIE)
    return out.select("event_id", r6("alpha_p").alias("alpha_p"), r6("propagation_speed").alias("propagation_speed"))


@query("resample_fixed_length", f"""WITH {PTS}, s AS (SELECT track_id, crit, row_number() {W} - 1 AS i, lead(crit) {W} AS nxt, count(*) OVER (PARTITION BY track_id) - 1 AS last FROM pts),
g AS (SELECT unnest(range(0, 11)) AS step), q AS (SELECT DISTINCT track_id, last, step, step * last / 10.0 AS pos FROM s, g)
SELECT q.track_id, CAST(q.step AS INTEGER) AS step, round(s.crit + CASE WHEN q.pos > s.i THEN (s.nxt - s.crit) * (q.pos - s.i) ELSE 0 END, 6) AS crit
FROM q JOIN s ON s.track_id = q.track_id AND s.i = floor(q.pos)""")
def resample_fixed_length(spark, folder):
    out = sequences.resample(points(spark, folder), "track_id", "time", ["crit"], 11, chunk(), TIE)
    return out.select("track_id", "step", r6("crit").alias("crit"))


@query("composite_life_cycle", f"""WITH {PTS}, s AS (SELECT track_id, crit, row_number() {W} - 1 AS i, lead(crit) {W} AS nxt, count(*) OVER (PARTITION BY track_id) - 1 AS last FROM pts),
g AS (SELECT unnest(range(0, 11)) AS step), q AS (SELECT DISTINCT track_id, last, step, step * last / 10.0 AS pos FROM s, g),
r AS (SELECT q.track_id, CAST(q.step AS INTEGER) AS step, s.crit + CASE WHEN q.pos > s.i THEN (s.nxt - s.crit) * (q.pos - s.i) ELSE 0 END AS crit
FROM q JOIN s ON s.track_id = q.track_id AND s.i = floor(q.pos))
SELECT step, round(quantile_cont(crit, 0.5), 6) AS crit, round(stddev_pop(crit), 6) AS crit_std FROM r GROUP BY step""")
def composite_life_cycle(spark, folder):
    life = sequences.resample(points(spark, folder), "track_id", "time", ["crit"], 11, chunk(), TIE)
    out = sequences.composite(life, "step", ["crit"])
    return out.select("step", r6("crit").alias("crit"), r6("crit_std").alias("crit_std"))


@query("hourly_interpolation", f"""WITH {PTS}, s AS (SELECT track_id, lon, lat, epoch_us(time) AS t0, epoch_us(lead(time) {W}) AS t1, lead(lon) {W} AS lon1, lead(lat) {W} AS lat1 FROM pts),
h AS (SELECT *, unnest(range(CAST(ceil(t0 / 10.8e9) AS BIGINT), CAST(ceil(coalesce(t1, floor(t0 / 10.8e9) * 10.8e9 + 1) / 10.8e9) AS BIGINT))) AS slot FROM s WHERE t1 IS NOT NULL)
SELECT track_id, make_timestamp(CAST(slot * 10800000000 AS BIGINT)) AS time, round(lon + (lon1 - lon) * ((slot * 10800000000 - t0) / (t1 - t0)), 6) AS lon,
  round(lat + (lat1 - lat) * ((slot * 10800000000 - t0) / (t1 - t0)), 6) AS lat FROM h""")
def hourly_interpolation(spark, folder):
    out = sequences.interpolate_times(points(spark, folder), "track_id", "time", ["lon", "lat"], "3 hours", chunk(), TIE)
    return out.select("track_id", "time", r6("lon").alias("lon"), r6("lat").alias("lat"))


@query("row_numbering", f"""WITH {PTS} SELECT event_id, track_id, CAST(row_number() {W} AS BIGINT) AS point_seq FROM pts""")
def row_numbering(spark, folder):
    return ordered.number_rows(points(spark, folder), ["track_id"], ["time", *TIE], chunk()).select("event_id", "track_id", "point_seq")


@query("gap_sessions", f"""WITH {PTS}, g AS (SELECT *, CASE WHEN lag(time) {W} IS NULL OR (epoch_us(time) - epoch_us(lag(time) {W})) / 3.6e9 > 12 THEN 1 ELSE 0 END AS fresh FROM pts)
SELECT event_id, track_id, CAST(sum(fresh) OVER (PARTITION BY track_id ORDER BY time, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id FROM g""")
def gap_sessions(spark, folder):
    out = sequences.session_tracks(points(spark, folder), ["track_id"], "time", 12.0, chunk(), TIE)
    return out.select("event_id", "track_id", "session_id")


@query("last_label_value_fill", f"""WITH {PTS} SELECT event_id, last_value(CASE WHEN label = 'click' THEN crit END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY time, event_id ROWS UNBOUNDED PRECEDING) AS click_prev FROM pts""")
def last_label_value_fill(spark, folder):
    p = points(spark, folder).withColumn("click", F.when(F.col("label") == "click", F.col("crit")))
    return ordered.carry(p, ["track_id"], ["time", *TIE], ["click"], chunk()).select("event_id", "click_prev")
