"""Matching track sets and measuring how well one reproduces the other."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyrespark.functions import geo
from gyrespark.functions.aggregates import ratio
from gyrespark.functions.text import hours_between
from gyrespark.operators import joins, ordered, pairs, ranking
from gyrespark.session import cut_lineage

# Thresholds of the catalogue match.
MAX_DIST_KM = 200.0
MEAN_DIST_KM = 120.0
MIN_OVERLAP = 3


def catalogue_match(ref: DataFrame, own: DataFrame, ref_id: str, own_id: str, time: str, lon: str, lat: str,
                    max_dist: float = MAX_DIST_KM, mean_dist: float = MEAN_DIST_KM,
                    min_overlap: int = MIN_OVERLAP, best: str | None = None, spans: bool = False) -> DataFrame:
    """Track pairs with enough equal-time points close together.

    Every counted point is within ``max_dist``, their mean within ``mean_dist``
    and there are at least ``min_overlap`` of them (all bounds inclusive).
    Where only each reference's best partner, or whether a track has one, is asked
    for, ``best`` (``steps``, ``some``: see ``pairs.common_time``) leaves out other
    pairs.  With ``spans`` the pairs carry the life spans of both tracks.
    """
    g = pairs.common_time(ref, own, ref_id, own_id, time, lon, lat, [max_dist], sphere=True, least=min_overlap, mean=mean_dist, best=best,
                          carry=_spans_of_both(ref, own, ref_id, own_id, time) if spans else (None, None))
    return g.withColumnsRenamed({"n": "temp", "avg_dist": "dist"}).drop("which")


def pod(matches: DataFrame, ref: DataFrame, ref_id: str) -> DataFrame:
    """Share of reference tracks with a match (one row)."""
    hit = matches.agg(F.count_distinct("id_ref").alias("n_matched"))
    total = ref.agg(F.count_distinct(ref_id).alias("n_reference"))
    return hit.crossJoin(total).withColumn("POD", ratio("n_matched", "n_reference"))  # one row each


def track_spans(points: DataFrame, track: str, time: str) -> DataFrame:
    return points.groupBy(track).agg(F.count(F.lit(1)).alias("n_points"), F.min(time).alias("start"), F.max(time).alias("end"))


def _spans_of_both(ref: DataFrame, own: DataFrame, ref_id: str, own_id: str, time: str) -> tuple[DataFrame, DataFrame]:
    return tuple(track_spans(df, key, time).withColumnsRenamed({"n_points": f"{tag}_points", "start": f"{tag}_start", "end": f"{tag}_end"})
                 for df, key, tag in ((ref, ref_id, "ref"), (own, own_id, "own")))


def temporal_overlap(pairs: DataFrame, ref: DataFrame, own: DataFrame, ref_id: str, own_id: str, time: str) -> DataFrame:
    """Overlap of the life spans of matched tracks, in hours and as a share of the reference."""
    a = track_spans(ref, ref_id, time).withColumnsRenamed({ref_id: "id_ref", "n_points": "ref_points", "start": "_rs", "end": "_re"})
    b = track_spans(own, own_id, time).withColumnsRenamed({own_id: "id_own", "n_points": "own_points", "start": "_os", "end": "_oe"})
    out = pairs.join(a, "id_ref").join(b, "id_own")
    start, end = F.greatest("_rs", "_os"), F.least("_re", "_oe")
    hours = F.greatest(hours_between(end, start), F.lit(0.0))
    length = hours_between("_re", "_rs")
    return out.withColumns({
        "overlap_start": start, "overlap_end": end, "overlap_hours": hours,
        "overlap_fraction_time": F.when(length > 0, hours / length).otherwise(0.0),
    }).drop("_rs", "_re", "_os", "_oe")


def track_statistics(ref: DataFrame, own: DataFrame, matches: DataFrame, ref_id: str, own_id: str, time: str) -> DataFrame:
    """One row per reference track: its best partner and how much of it is covered."""
    best = ranking.best_matches(matches, "id_ref", "id_own")
    over = temporal_overlap(best, ref, own, ref_id, own_id, time)
    spans = track_spans(ref, ref_id, time).withColumnRenamed(ref_id, "id_ref")
    cols = over.select("id_ref", "id_own", "temp", "dist", "overlap_start", "overlap_end", "overlap_hours", "overlap_fraction_time")
    out = spans.join(cols, "id_ref", "left")
    found = F.col("id_own").isNotNull()
    share = F.when(found, F.col("temp") / F.col("n_points")).otherwise(0.0)
    part = F.coalesce("overlap_fraction_time", F.lit(0.0))
    return out.select(
        F.col("id_ref").alias("reference_id"), found.alias("detected"), F.col("id_own").alias("best_id"),
        F.col("n_points").alias("reference_n_points"), hours_between("end", "start").alias("reference_duration_hours"),
        F.coalesce("temp", F.lit(0).cast("long")).alias("matched_n_points"), share.alias("overlap_fraction"),
        (100.0 * share).alias("overlap_percent"), F.col("dist").alias("mean_distance_km"), "overlap_start", "overlap_end",
        F.coalesce("overlap_hours", F.lit(0.0)).alias("overlap_duration_hours"),
        part.alias("overlap_duration_fraction"), (100.0 * part).alias("overlap_duration_percent"))


def summarise(stats: DataFrame, own: DataFrame, own_id: str, by: list[str] | None = None) -> DataFrame:
    """Summary of track statistics over detected tracks."""
    by = by or []
    base = stats if by else stats.withColumn("_all", F.lit(0))
    keys = by or ["_all"]
    counts = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_reference_tracks"), F.count_if("detected").alias("n_matched"),
        F.count_if(~F.col("detected")).alias("n_unmatched"),
        *[F.avg(F.when(F.col("detected"), F.col(c))).alias(f"mean_{n}") for c, n in _SUMMARY.items()])
    counts = counts.withColumn("POD", ratio("n_matched", "n_reference_tracks"))
    counts = counts.withColumn("mean_overlap_percent_1to1", F.col("mean_temporal_overlap_percent"))
    wanted = {f"median_{name}": (column, 0.5) for column, name in _SUMMARY.items()}
    counts = ordered._left_on(counts, ordered.exact_percentiles_of(base.where("detected"), keys, wanted), keys)
    counts = counts.withColumn("median_overlap_percent_1to1", F.col("median_temporal_overlap_percent"))
    n_own = own.agg(F.count_distinct(own_id).alias("n_own_tracks"))
    out = counts.crossJoin(F.broadcast(n_own))  # one row
    return out if by else out.drop("_all")


_SUMMARY = {"overlap_percent": "overlap_percent", "overlap_duration_percent": "temporal_overlap_percent",
            "mean_distance_km": "distance_km"}


def contingency(ref: DataFrame, own: DataFrame, matches: DataFrame, ref_id: str, own_id: str) -> DataFrame:
    """Hits, misses, false alarms and POD, FAR, CSI (one row).

    False alarms are own tracks without any match, so they never go negative.
    """
    refs = ref.select(F.col(ref_id).alias("id_ref")).distinct()
    owns = own.select(F.col(own_id).alias("id_own")).distinct()
    hit = refs.join(matches.select("id_ref").distinct(), "id_ref", "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    miss = refs.join(matches.select("id_ref").distinct(), "id_ref", "left_anti").agg(F.count(F.lit(1)).alias("misses"))
    false = owns.join(matches.select("id_own").distinct(), "id_own", "left_anti").agg(F.count(F.lit(1)).alias("false_alarms"))
    return scores(hit.crossJoin(miss).crossJoin(false))  # one row each


def scores(counts: DataFrame) -> DataFrame:
    h, m, f = F.col("hits"), F.col("misses"), F.col("false_alarms")
    return counts.withColumns({"POD": ratio(h, h + m), "FAR": ratio(f, h + f), "CSI": ratio(h, h + m + f)})


def false_alarms(own: DataFrame, matches: DataFrame, own_id: str) -> DataFrame:
    """Own tracks that match no reference."""
    return own.select(F.col(own_id).alias("id_own")).distinct().join(matches.select("id_own").distinct(), "id_own", "left_anti")


def distance_report(pairs: DataFrame, dist: str = "dist_km", weight: str | None = None) -> DataFrame:
    """Mean, median, bounds and population spread of pair distances (one row); a row is ``weight`` pairs, if given."""
    bounds = [F.min(dist).alias("min_km"), F.max(dist).alias("max_km")]
    if weight is None:
        plain = pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(dist).alias("mean_km"), *bounds, F.stddev_pop(dist).alias("std_km"))
    else:
        w, d = F.when(F.col(dist).isNotNull(), F.col(weight)).cast("double"), F.col(dist)
        sums = pairs.agg(F.coalesce(F.sum(weight), F.lit(0).cast("long")).alias("n_pairs"), *bounds, F.sum(w).alias("_w"),
                         F.sum(w * d).alias("_d"), F.sum(w * d * d).alias("_dd")).withColumn("mean_km", F.col("_d") / F.col("_w"))
        spread = F.sqrt(F.greatest(F.col("_dd") / F.col("_w") - F.col("mean_km") * F.col("mean_km"), F.lit(0.0)))
        plain = sums.withColumn("std_km", F.when(F.col("_w").isNotNull(), spread)).drop("_w", "_d", "_dd")
    mid = ordered.exact_percentiles(pairs.withColumn("_all", F.lit(0)), ["_all"], dist, {"median_km": 0.5}, weight=weight).drop("_all")
    return plain.join(F.broadcast(mid), how="left")  # one row


def duration_ratios(matches: DataFrame, ref: DataFrame, own: DataFrame, ref_id: str, own_id: str, time: str) -> DataFrame:
    """Reference over own duration of each matched pair (own of positive length)."""
    if "ref_start" not in matches.columns:  # else the pairs carry the spans
        a, b = _spans_of_both(ref, own, ref_id, own_id, time)
        matches = matches.join(a.withColumnRenamed(ref_id, "id_ref"), "id_ref").join(b.withColumnRenamed(own_id, "id_own"), "id_own")
    own_hours = hours_between("own_end", "own_start")
    return matches.where(own_hours > 0).select("id_ref", "id_own", (hours_between("ref_end", "ref_start") / own_hours).alias("duration_ratio"))


def _named(ref: DataFrame, own: DataFrame, ref_id: str, own_id: str) -> tuple[DataFrame, DataFrame]:
    """The points that belong to a track."""
    return ref.where(F.col(ref_id).isNotNull()), own.where(F.col(own_id).isNotNull())


def nearest_point_matches(ref: DataFrame, own: DataFrame, ref_id: str, own_id: str, time: str, x: str, y: str,
                          max_dist: float, tolerance_hours: float, min_steps: int, whole_hours: bool = False) -> DataFrame:
    """Pairs with at least ``min_steps`` (one at least) nearest-in-time points within an index distance."""
    if not whole_hours:
        out = pairs.nearest_time(*_named(ref, own, ref_id, own_id), ref_id, own_id, time, x, y, max_dist, tolerance_hours, min_steps)
        return out.withColumnRenamed("value", "avg_dist")
    among = joins.close_tracks(ref, own, ref_id, own_id, time, x, y, max_dist, tolerance_hours, whole_hours)
    near = joins.asof_nearest_pairs(ref, own, ref_id, own_id, time, [x, y], tolerance_hours, whole_hours, among)
    d = geo.euclid(f"{x}_ref", f"{y}_ref", f"{x}_own", f"{y}_own")
    g = near.withColumn("_d", d).where(F.col("_d") <= max_dist).groupBy("id_ref", "id_own").agg(
        F.count(F.lit(1)).alias("n_steps"), F.avg("_d").alias("avg_dist"))
    return g.where(F.col("n_steps") >= min_steps)


def all_points_close(ref: DataFrame, own: DataFrame, ref_id: str, own_id: str, time: str, lon: str, lat: str,
                     max_km: float, tolerance_hours: float, min_steps: int) -> DataFrame:
    """Pairs whose nearest-in-time points are all within a great-circle distance."""
    out = pairs.nearest_time(*_named(ref, own, ref_id, own_id), ref_id, own_id, time, lon, lat, max_km, tolerance_hours, min_steps,
                             sphere=True, every=True)
    return out.withColumnRenamed("value", "median_km")


def common_time_distance(ref: DataFrame, own: DataFrame, ref_id: str, own_id: str, time: str, x: str, y: str,
                         scale_km: float = 1.0, among: DataFrame | None = None, closest: tuple[float, int] | None = None) -> DataFrame:
    """Mean index distance (scaled) and share of common times of every pair (or those ``among``) that shares one.

    ``closest`` (largest mean, fewest steps) keeps what ``ranking.closest_partner`` chooses from.
    """
    if among is None:
        n = ref.groupBy(ref_id).agg(F.count(F.lit(1)).alias("_n"))
        mean, least = closest or (None, 1)
        g = pairs.common_time(ref, own, ref_id, own_id, time, x, y, scale=scale_km, carry=(n, None), mean=mean, least=least,
                              best="quality" if closest else None)
        return g.select("id_ref", "id_own", F.col("n").alias("n_common"), "avg_dist", (100.0 * F.col("n") / F.col("_n")).alias("match_percent"))
    else:
        listed = joins.same_time_pairs(ref, own, ref_id, own_id, time, [x, y], among=among)
        d = geo.euclid(f"{x}_ref", f"{y}_ref", f"{x}_own", f"{y}_own") * scale_km
        g = listed.groupBy("id_ref", "id_own").agg(F.count(F.lit(1)).alias("n_common"), F.avg(d).alias("avg_dist"))
    n = ref.groupBy(F.col(ref_id).alias("id_ref")).agg(F.count(F.lit(1)).alias("_n"))
    return g.join(n, "id_ref").withColumn("match_percent", 100.0 * F.col("n_common") / F.col("_n")).drop("_n")


def interval_matches(ref: DataFrame, own: DataFrame, ref_id: str, own_id: str, time: str, x: str, y: str,
                     grid_step_km: float = 77.0, max_km: float = 500.0, best: tuple[float, float] | None = None) -> DataFrame:
    """Pairs sharing timestamps whose mean distance stays within a limit.

    ``best`` (``max_km`` and ``max_shift_hours`` of ``best_composite_match``) keeps what that chooses from.

    Sharing a timestamp implies overlapping intervals, and a mean within the limit
    needs a point within it, so only pairs that come so close are looked at.
    """
    limit = max_km / grid_step_km * (1 + 1e-9)  # a rounded mean may fall below the least distance
    g = pairs.common_time(ref, own, ref_id, own_id, time, x, y, scale=grid_step_km, mean=max_km, within=limit * grid_step_km,
                          carry=_spans_of_both(ref, own, ref_id, own_id, time), best=best and partial(_composite_score, best))
    return g.drop("which", "n_pairs").withColumnRenamed("n", "n_common")


def match_score(matches: DataFrame) -> DataFrame:
    """Score of interval matches from shared time, distance and shift of the ends."""
    share = F.col("n_common") / F.greatest("ref_points", "own_points")
    near = 1.0 / (1.0 + F.col("avg_dist") / 20.0)
    shift = F.abs(hours_between("own_start", "ref_start")) + F.abs(hours_between("own_end", "ref_end"))
    return matches.withColumns({"time_score": share, "distance_score": near, "shift_score": 1.0 / (1.0 + shift / 12.0)})


def _composite_score(bounds: tuple[float, float], n, mean, ref: dict, own: dict):
    """The score of ``best_composite_match`` of arrays of pairs."""
    import numpy as np

    shift = {end: np.abs(own[f"own_{end}"] - ref[f"ref_{end}"]) / 3.6e9 for end in ("start", "end")}
    agrees = sum(0.1 / (1.0 + h / bounds[1]) for h in shift.values())
    return 0.4 * n / np.maximum(ref["ref_points"], own["own_points"]) + 0.4 / (1.0 + mean / bounds[0]) + agrees


def best_composite_match(matches: DataFrame, max_km: float = 250.0, max_shift_hours: float = 6.0) -> DataFrame:
    """The best partner of each reference track by a weighted score of its interval matches.

    Shared time and nearness weigh 0.4 each, the agreement of starts and of ends
    0.1 each; equal scores (to nine digits) go to the lower id.
    """
    def agrees(end: str) -> Column:
        return 1.0 / (1.0 + F.abs(hours_between(f"own_{end}", f"ref_{end}")) / max_shift_hours)

    share = F.col("n_common") / F.greatest("ref_points", "own_points")
    near = 1.0 / (1.0 + F.col("avg_dist") / max_km)
    scored = matches.withColumn("composite_score", 0.4 * share + 0.4 * near + 0.1 * agrees("start") + 0.1 * agrees("end"))
    rest = [c for c in scored.columns if c != "id_ref"]
    return ordered.best_row(scored, ["id_ref"], [-F.round("composite_score", 9), F.col("id_own")], rest)


def _mean_cosine(steps: DataFrame) -> DataFrame:
    """(id_ref, id_own, path_score) from pairs of step vectors; a step of no length counts as a right angle."""
    size = F.sqrt((F.col("_ux") ** 2 + F.col("_uy") ** 2) * (F.col("_vx") ** 2 + F.col("_vy") ** 2))
    cosine = F.when(size > 0, (F.col("_ux") * F.col("_vx") + F.col("_uy") * F.col("_vy")) / size).otherwise(F.lit(0.0))
    mean = F.avg(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))
    return steps.groupBy("id_ref", "id_own").agg(((mean + 1.0) / 2.0).alias("path_score"))


def path_similarity(matches: DataFrame, ref: DataFrame, own: DataFrame, ref_id: str, own_id: str, time: str,
                    x: str, y: str, length: int | None = None, chunk: Column | None = None) -> DataFrame:
    """Add ``path_score``: mean cosine of the two tracks' steps, scaled to 0 to 1.

    Without ``length`` the steps of tracks with equally many points (two at
    least) are compared in turn; every other pair scores 0.5.  With it, both
    tracks are cut to their common interval and resampled to that many
    positions, so tracks of any length compare.
    """
    if length is not None:
        low, high = F.greatest("ref_start", "own_start"), F.least("ref_end", "own_end")
        return pairs.resampled_similarity(matches, ref, own, ref_id, own_id, time, x, y, low, high, length)
    c = ordered.time_chunk(time) if chunk is None else chunk
    keys = ["id_ref", "id_own"]
    matches = cut_lineage(matches)  # read four times
    even = matches.where((F.col("ref_points") == F.col("own_points")) & (F.col("ref_points") > 1)).select(*keys)

    def walk(points: DataFrame, track: str, key: str, name: str) -> DataFrame:
        used = points.select(F.col(track).alias(key), time, x, y).join(even.select(key).distinct(), key, "left_semi")
        wide = ordered.running(ordered.neighbours(used, [key], [time], [x, y], [1], c), [key], [time], c, number="_rn")
        return wide.where(F.col(f"{x}_lead1").isNotNull() & F.col(f"{y}_lead1").isNotNull()).select(
            key, "_rn", (F.col(f"{x}_lead1") - F.col(x)).cast("double").alias(f"_{name}x"),
            (F.col(f"{y}_lead1") - F.col(y)).cast("double").alias(f"_{name}y"))

    steps = even.join(walk(ref, ref_id, "id_ref", "u"), "id_ref").join(walk(own, own_id, "id_own", "v"), ["id_own", "_rn"])
    out = matches.join(_mean_cosine(steps), keys, "left")
    return out.withColumn("path_score", F.coalesce("path_score", F.lit(0.5)))


def reduced_mean_distance(ref: DataFrame, own: DataFrame, ref_id: str, own_id: str, time: str, lon: str, lat: str,
                          wanted: DataFrame | None = None, max_km: float | None = None) -> DataFrame:
    """Mean equal-time distance without points beyond mean + 2 sigma (population).

    ``wanted`` lists the pairs to report; those without a common time get
    infinity.  Without it, ``max_km`` keeps the pairs of at most that value, which
    must come so close at some time; else every pair that shares a time appears.
    """
    if wanted is None:
        within = None if max_km is None else max_km * (1 + 1e-9)
        out = pairs.common_time(*_named(ref, own, ref_id, own_id), ref_id, own_id, time, lon, lat, sphere=True, mean=max_km, reduced=True,
                                within=within)
        return out.select("id_ref", "id_own", F.col("avg_dist").alias("rmcpd"))
    among = wanted.select("id_ref", "id_own").distinct()
    listed = joins.same_time_pairs(ref, own, ref_id, own_id, time, [lon, lat], among=among)
    listed = listed.withColumn("_d", geo.haversine_km(f"{lon}_ref", f"{lat}_ref", f"{lon}_own", f"{lat}_own"))
    keys = ["id_ref", "id_own"]
    stats = listed.groupBy(*keys).agg(F.avg("_d").alias("_m"), F.stddev_pop("_d").alias("_s"))
    kept = listed.join(stats, keys).where(F.col("_d") <= F.col("_m") + 2 * F.col("_s") + 1e-9)
    # the smallest distance never exceeds the mean, so every pair keeps a point
    out = kept.groupBy(*keys).agg(F.avg("_d").alias("rmcpd"))
    return among.join(out, keys, "left").withColumn("rmcpd", F.coalesce("rmcpd", F.lit(float("inf"))))


def coverage_same_time(ref: DataFrame, own: DataFrame, ref_id: str, own_id: str, time: str, lon: str, lat: str,
                       max_km: float) -> DataFrame:
    """Percent of reference points with an own point of the same time within a distance."""
    near = joins.geo_time_pairs(ref, own, ref_id, own_id, time, lon, lat, max_km).select("id_ref", "t").distinct()
    hit = near.groupBy("id_ref").agg(F.count(F.lit(1)).alias("n_covered"))
    n = ref.groupBy(F.col(ref_id).alias("id_ref")).agg(F.count_distinct(time).alias("n_points"))
    return _coverage(n, hit)


def coverage_any_time(ref: DataFrame, own: DataFrame, ref_id: str, own_id: str, partner: DataFrame, time: str,
                      lon: str, lat: str, max_km: float) -> DataFrame:
    """Percent of reference points near any point of the matched own tracks.

    ``partner`` lists (id_ref, id_own).  Own points are filed under the
    reference track, so candidates come from an equi-join on track and cell.
    """
    filed = own.join(partner.select("id_ref", F.col("id_own").alias(own_id)), own_id).select(
        F.col("id_ref").alias("_key"), F.col(lon).alias(lon), F.col(lat).alias(lat), F.col(own_id).alias("_o"))
    base = ref.select(F.col(ref_id).alias("_key"), F.struct(ref_id, time).alias("_pt"), lon, lat)
    near = joins.geo_time_pairs(base.withColumnRenamed("_pt", "_id"), filed, "_id", "_o", "_key", lon, lat, max_km)
    hit = near.select("id_ref", "t").distinct().groupBy(F.col("t").alias("_k")).agg(F.count(F.lit(1)).alias("n_covered"))
    n = ref.groupBy(F.col(ref_id).alias("id_ref")).agg(F.count_distinct(time).alias("n_points"))
    return _coverage(n, hit.withColumnRenamed("_k", "id_ref"))


def _coverage(n: DataFrame, hit: DataFrame) -> DataFrame:
    out = n.join(hit, "id_ref", "left").withColumn("n_covered", F.coalesce("n_covered", F.lit(0).cast("long")))
    return out.withColumn("coverage_percent", 100.0 * F.col("n_covered") / F.col("n_points"))


def matches_per_reference(ref: DataFrame, matches: DataFrame, ref_id: str) -> DataFrame:
    refs = ref.select(F.col(ref_id).alias("id_ref")).distinct()
    # of pairs chosen by ``best`` each says for how many it stands
    n = matches.groupBy("id_ref").agg((F.sum("n_pairs") if "n_pairs" in matches.columns else F.count(F.lit(1))).alias("_n"))
    return refs.join(n, "id_ref", "left").select(
        "id_ref", F.coalesce("_n", F.lit(0).cast("long")).alias("n_matches"), F.col("_n").isNotNull().alias("matched"))


def pair_report(ref: DataFrame, matches: DataFrame, ref_id: str, time: str, extra: DataFrame | None = None) -> DataFrame:
    """One row per match, or one empty row for a reference without any."""
    spans = track_spans(ref, ref_id, time).withColumnRenamed(ref_id, "id_ref")
    out = spans.join(matches, "id_ref", "left")
    return out.join(extra, "id_own", "left") if extra is not None else out


def set_matching_summary(ref: DataFrame, own: DataFrame, matches: DataFrame, ref_id: str, own_id: str) -> DataFrame:
    """One-row agreement of two track sets."""
    n = ref.agg(F.count_distinct(ref_id).alias("n_ref")).crossJoin(own.agg(F.count_distinct(own_id).alias("n_own")))
    m = matches.agg(F.count(F.lit(1)).alias("n_matches"), F.count_distinct("id_ref").alias("n_ref_matched"),
                    F.count_distinct("id_own").alias("n_own_matched"), F.avg("avg_dist").alias("mean_dist"),
                    F.sum("n_common").alias("n_common_points"))
    out = n.crossJoin(m)  # one row each
    return out.withColumns({"ref_percent": 100.0 * ratio("n_ref_matched", "n_ref"),
                            "own_percent": 100.0 * ratio("n_own_matched", "n_own")})


def coverage_of_best(matches: DataFrame, ref: DataFrame, ref_id: str) -> DataFrame:
    """Percent of each matched reference track covered by its best partner."""
    best = ranking.best_matches(matches, "id_ref", "id_own")
    n = ref.groupBy(F.col(ref_id).alias("id_ref")).agg(F.count(F.lit(1)).alias("n_points"))
    return best.join(n, "id_ref").withColumn("coverage_percent", 100.0 * F.col("temp") / F.col("n_points"))


