"""Track-wise window operators: path length, speed, angles, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyrespark.functions import geo, thermo
from gyrespark.functions.text import hours_between
from gyrespark.operators import ordered

DEFAULT_CHUNK = "30 days"


def _chunk(time: str, chunk: Column | None) -> Column:
    return ordered.time_chunk(time, DEFAULT_CHUNK) if chunk is None else chunk


def path_length(df: DataFrame, track: str, time: str, x: str, y: str, chunk: Column | None = None,
                tie: list[str] | None = None, out: str = "track_len") -> DataFrame:
    """Cumulative path length per track; the first point has length 0.

    One summary per chunk (its ends and inner length) gives both the bridges
    between chunks and the length before them.
    """
    order = [time, *(tie or [])]
    inside = Window.partitionBy(track, ordered.CHUNK).orderBy(*ordered._order(order))
    over = ordered._over_chunks([track])
    base = df.withColumn(ordered.CHUNK, _chunk(time, chunk))
    step = geo.euclid(F.col(x), F.col(y), F.lag(x).over(inside), F.lag(y).over(inside))
    base = base.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    at, key = F.struct(F.col(x).alias("x"), F.col(y).alias("y")), F.struct(*order)
    parts = base.groupBy(track, ordered.CHUNK).agg(
        F.sum("_step").alias("_inner"), F.min_by(at, key).alias("_first"), F.max_by(at, key).alias("_last"))
    before = F.lag("_last").over(over)
    bridge = geo.euclid(F.col("_first")["x"], F.col("_first")["y"], before["x"], before["y"])
    parts = parts.withColumn("_bridge", F.coalesce(bridge, F.lit(0.0)))
    earlier = F.coalesce(F.sum("_inner").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    bridges = F.sum("_bridge").over(over.rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("_prefix", earlier + bridges).select(track, ordered.CHUNK, "_prefix")
    joined = ordered._join_summary(base, parts, [track])
    local = F.sum("_step").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn(out, local + F.col("_prefix")).drop(ordered.CHUNK, "_step", "_prefix")


def peak_speed(df: DataFrame, track: str, time: str, x: str, y: str, peak: Column, scale: float,
               chunk: Column | None = None, tie: list[str] | None = None, lat: str | None = None) -> DataFrame:
    """Mean step length over two rows either side of the flagged peak row.

    ``scale`` turns cells per step into the wanted unit.  With ``lat`` each
    step is shrunk by the cosine of the latitude of the row it starts from.
    Adds ``velocity`` and ``start_stop`` to the peak rows and returns those only.
    """
    c, order = _chunk(time, chunk), [time, *(tie or [])]
    values = [x, y] + ([lat] if lat else [])
    wide = ordered.neighbours(df.withColumn("_peak", peak), [track], order, values, [-2, -1, 1, 2], c)

    def at(col: str, k: int) -> Column:
        return F.col(col) if k == 0 else F.col(f"{col}_lag{-k}" if k < 0 else f"{col}_lead{k}")

    steps = []
    for k in range(-2, 2):
        step = geo.euclid(at(x, k), at(y, k), at(x, k + 1), at(y, k + 1))
        steps.append(step * F.cos(F.radians(at(lat, k))) if lat else step)
    known = F.filter(F.array(*steps), lambda s: s.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, s: a + s)
    mean = F.when(F.size(known) > 0, total / F.size(known))
    out = wide.where("_peak").withColumn("velocity", mean * scale)
    only_point = at(x, -1).isNull() & at(x, 1).isNull()
    out = out.withColumn("start_stop", ~only_point & (at(x, -1).isNull() | at(x, 1).isNull()))
    return out.drop("_peak", *[f"{v}_{s}" for v in values for s in ("lag1", "lag2", "lead1", "lead2")])


def rolling_speed_and_turn(df: DataFrame, track: str, time: str, x: str, y: str, km_per_cell: float,
                           step_hours: float, chunk: Column | None = None,
                           tie: list[str] | None = None) -> DataFrame:
    """Centred five-row mean speed (at least two rows) and turning angle.

    The step of the first row is 0 and takes part in the mean; the turning
    angle is 0 at both ends of a track.
    """
    c, order = _chunk(time, chunk), [time, *(tie or [])]
    wide = ordered.neighbours(df, [track], order, [x, y], [-3, -2, -1, 1, 2], c)

    def at(col: str, k: int) -> Column:
        return F.col(col) if k == 0 else F.col(f"{col}_lag{-k}" if k < 0 else f"{col}_lead{k}")

    steps = []
    for k in range(-2, 3):
        inner = geo.euclid(at(x, k), at(y, k), at(x, k - 1), at(y, k - 1))
        steps.append(F.when(at(x, k).isNotNull(), F.coalesce(inner, F.lit(0.0))))
    known = F.filter(F.array(*steps), lambda s: s.isNotNull())
    mean = F.when(F.size(known) >= 2, F.aggregate(known, F.lit(0.0), lambda a, s: a + s) / F.size(known))
    dx, dy = at(x, 0) - at(x, -1), at(y, 0) - at(y, -1)
    ex, ey = at(x, 1) - at(x, 0), at(y, 1) - at(y, 0)
    angle = F.atan2((dx * ey - dy * ex).cast("double"), (dx * ex + dy * ey).cast("double"))
    out = wide.withColumns({
        "speed": F.coalesce(mean, F.lit(0.0)) * km_per_cell / step_hours,
        "turn_angle": F.coalesce(angle, F.lit(0.0)),
    })
    return out.drop(*[f"{v}_{s}" for v in (x, y) for s in ("lag1", "lag2", "lag3", "lead1", "lead2")])


def bergeron_index(df: DataFrame, track: str, time: str, lat: str, pressure: str,
                   taus: list[int] | None = None, step_hours: float = 1.0, tolerance_hours: float = 0.1,
                   chunk: Column | None = None, tie: list[str] | None = None) -> DataFrame:
    """Deepening rate over each tau, valid only where both times are exact."""
    taus = taus or [2, 4, 6, 12, 24]
    c, order = _chunk(time, chunk), [time, *(tie or [])]
    rows = {tau: max(1, round(tau / 2 / step_hours)) for tau in taus}
    offsets = sorted({s * k for k in rows.values() for s in (-1, 1)})
    wide = ordered.neighbours(df, [track], order, [time, lat, pressure], offsets, c)
    outputs = {}
    for tau, k in rows.items():
        before = F.abs(hours_between(time, f"{time}_lag{k}") - tau / 2) < tolerance_hours
        after = F.abs(hours_between(f"{time}_lead{k}", time) - tau / 2) < tolerance_hours
        fall = F.col(f"{pressure}_lag{k}") - F.col(f"{pressure}_lead{k}")
        mean_lat = (F.col(f"{lat}_lag{k}") + F.col(f"{lat}_lead{k}")) / 2
        outputs[f"bergeron_{tau}h"] = F.when(before & after, thermo.bergeron(fall, mean_lat, tau))
    extra = [f"{v}_{s}{k}" for v in (time, lat, pressure) for s in ("lag", "lead") for k in set(rows.values())]
    return wide.withColumns(outputs).drop(*extra)


def forward_step(df: DataFrame, track: str, time: str, lon: str, lat: str, chunk: Column | None = None,
                 tie: list[str] | None = None) -> DataFrame:
    """Hours to the next point and speed towards it.

    The last point of a track takes the median step of its track, then the
    median of all steps; non-positive steps take the overall median too.  The
    medians are computed as exact distributed percentiles.
    """
    c, order = _chunk(time, chunk), [time, *(tie or [])]
    wide = ordered.neighbours(df, [track], order, [time, lon, lat], [1], c)
    dt = hours_between(f"{time}_lead1", time)
    dist = geo.haversine_km(lon, lat, f"{lon}_lead1", f"{lat}_lead1")
    wide = wide.withColumn("_dt", dt).withColumn("speed_kmh", F.when(dt > 0, dist / dt))
    wide = wide.drop(f"{time}_lead1", f"{lon}_lead1", f"{lat}_lead1")
    by_track = ordered.exact_percentiles(wide, [track], "_dt", {"_med": 0.5})
    overall = ordered.exact_percentiles(wide.withColumn("_all", F.lit(0)), ["_all"], "_dt", {"_global": 0.5}).drop("_all")
    out = ordered._left_on(wide, by_track, [track]).join(F.broadcast(overall), how="left")  # one row
    fill = F.coalesce("_global", F.lit(1.0))
    filled = F.coalesce("_dt", "_med", fill)
    return out.withColumn("dt_h_fwd", F.when(filled <= 0, fill).otherwise(filled)).drop("_dt", "_med", "_global")


def step_difference(df: DataFrame, by: list[str], time: str, value: str, chunk: Column | None = None,
                    tie: list[str] | None = None, out: str = "delta") -> DataFrame:
    """Value minus its predecessor: de-accumulates running totals such as rain."""
    c, order = _chunk(time, chunk), [time, *(tie or [])]
    wide = ordered.neighbours(df, by, order, [value], [-1], c)
    return wide.withColumn(out, F.col(value) - F.col(f"{value}_lag1")).drop(f"{value}_lag1")


def propagation(df: DataFrame, track: str, time: str, lon: str, lat: str, dt_hours: float = 1.0,
                chunk: Column | None = None, tie: list[str] | None = None) -> DataFrame:
    """Direction (degrees from east, counter-clockwise) and speed from the previous point."""
    c, order = _chunk(time, chunk), [time, *(tie or [])]
    wide = ordered.neighbours(df, [track], order, [lon, lat], [-1], c)
    mean_lat = (F.col(lat) + F.col(f"{lat}_lag1")) / 2
    dy = (F.col(lat) - F.col(f"{lat}_lag1")) * geo.KM_PER_DEG
    dx = (F.col(lon) - F.col(f"{lon}_lag1")) * geo.KM_PER_DEG * F.cos(F.radians(mean_lat))
    return wide.withColumns({
        "alpha_p": F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0)),
        "propagation_speed": F.sqrt(dx * dx + dy * dy) / dt_hours,
    }).drop(f"{lon}_lag1", f"{lat}_lag1")


def resample(df: DataFrame, track: str, time: str, values: list[str], length: int,
             chunk: Column | None = None, tie: list[str] | None = None) -> DataFrame:
    """Linear resampling of each track to ``length`` equally spaced steps.

    Each point and its successor span one segment of the row index; a segment
    emits the steps that fall into it, so the work per row is bounded by the
    number of steps and no track is gathered.
    """
    c, order = _chunk(time, chunk), [time, *(tie or [])]
    wide = ordered.neighbours(df, [track], order, values, [1], c)
    wide = ordered.running(wide, [track], order, c, number="_rn", total="_n")
    i, last = F.col("_rn") - 1, F.col("_n") - 1
    steps = length - 1
    # step s sits at row position s * last / steps; it belongs to segment i when
    # i <= position < i + 1, the final point takes the final step
    first = F.when(last > 0, F.ceil(i * steps / last)).otherwise(F.lit(0))
    stop = F.when(last > 0, F.when(i == last, F.lit(steps)).otherwise(F.ceil((i + 1) * steps / last) - 1)).otherwise(F.lit(steps))
    emit = wide.withColumn("_from", first.cast("int")).withColumn("_to", stop.cast("int")).where("_from <= _to")
    emit = emit.withColumn("step", F.explode(F.sequence("_from", "_to")))
    pos = F.when(last > 0, F.col("step") * last / F.lit(float(steps))).otherwise(F.lit(0.0))
    part = pos - i
    interpolated = [
        F.when((part > 0) & F.col(f"{v}_lead1").isNotNull(),
               F.col(v) + (F.col(f"{v}_lead1") - F.col(v)) * part).otherwise(F.col(v).cast("double")).alias(v)
        for v in values]
    return emit.select(track, "step", *interpolated)


def composite(df: DataFrame, step: str, values: list[str]) -> DataFrame:
    """Median and population spread per normalised step over all tracks."""
    medians = ordered.exact_percentiles_of(df, [step], {v: (v, 0.5) for v in values})
    spread = df.groupBy(step).agg(*[F.stddev_pop(v).alias(f"{v}_std") for v in values])
    return ordered._left_on(medians, spread, [step])


def interpolate_times(df: DataFrame, track: str, time: str, values: list[str], every: str = "1 hour",
                      chunk: Column | None = None, tie: list[str] | None = None) -> DataFrame:
    """Positions at every full interval between consecutive fixes."""
    c, order = _chunk(time, chunk), [time, *(tie or [])]
    wide = ordered.neighbours(df, [track], order, [time, *values], [1], c)
    number, unit = every.split()
    width = int(number) * ordered._UNITS[unit.rstrip("s")]
    t0 = F.unix_micros(F.col(time).cast("timestamp"))
    t1 = F.unix_micros(F.col(f"{time}_lead1").cast("timestamp"))
    w = F.lit(width * 1_000_000)
    first = F.ceil(t0 / w)
    stop = F.when(t1.isNull(), F.floor(t0 / w)).otherwise(F.ceil(t1 / w) - 1)
    emit = wide.withColumns({"_t0": t0, "_t1": t1, "_from": first, "_to": stop}).where("_from <= _to")
    emit = emit.withColumn("_slot", F.explode(F.sequence("_from", "_to")))
    at = F.col("_slot") * w
    part = F.when(F.col("_t1") > F.col("_t0"), (at - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))).otherwise(F.lit(0.0))
    return emit.select(
        track, F.timestamp_micros(at).cast("timestamp_ntz").alias(time),
        *[F.when(F.col("_t1").isNotNull(), F.col(v) + (F.col(f"{v}_lead1") - F.col(v)) * part)
          .otherwise(F.col(v).cast("double")).alias(v) for v in values])


def session_tracks(df: DataFrame, by: list[str], time: str, max_gap_hours: float,
                   chunk: Column | None = None, tie: list[str] | None = None, out: str = "session_id") -> DataFrame:
    """Cut each key wherever consecutive points are further apart than the gap."""
    c, order = _chunk(time, chunk), [time, *(tie or [])]
    wide = ordered.neighbours(df, by, order, [time], [-1], c)
    gap = hours_between(time, f"{time}_lag1")
    start = F.when(gap > max_gap_hours, 1).when(gap.isNull(), 1).otherwise(0)
    marked = wide.withColumn("_new", start.cast("long")).drop(f"{time}_lag1")
    return ordered.running(marked, by, order, c, sums={out: F.col("_new")}).drop("_new")
