"""Aggregations over discs, boxes, clusters, tracks and catalogues."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gyrespark.functions import geo
from gyrespark.functions.aggregates import (aggregate_list, finite, label_set, named_aggregate,
                                            vector_direction, vector_mean)
from gyrespark.functions.text import hours_between
from gyrespark.operators import joins, ordered, pairs
from gyrespark.operators.labelling import in_tiles, tiles_together
from gyrespark.session import spread

DISC_CELLS = 1 << 19  # candidate cells of discs looked at together, or one disc's
SHARES = {"median": (0.5,), "p5": (0.05,), "p25": (0.25,), "p75": (0.75,), "p90": (0.9,), "p95": (0.95,),
          "delta": (0.05, 0.95), "robust_min": (0.05,), "robust_max": (0.95,)}
MOMENTS = ("mean", "min", "max", "sum", "count", "std", "std_pop")


def disc_aggregate(points: DataFrame, grid: DataFrame, on: list[str], point_id: str, x: str, y: str, radius: str,
                   gx: str, gy: str, config: dict[str, tuple[str, str]], bucket: float,
                   extra: Column | None = None, vectors: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Named aggregates of the cells within an index radius of each point.

    ``extra`` keeps a part of the disc, such as its poleward half.  Points
    without any cell keep a row with nulls.  Percentiles of discs are taken where
    points and cells meet, so the cells of discs are neither sorted nor shuffled.
    """
    names = [name for _, name in config.values()]
    if extra is None and any(n in SHARES for n in names) and all(n in SHARES or n in MOMENTS for n in names):
        sizes = points.groupBy(point_id).agg(F.count(F.lit(1)).alias("n"), F.max(F.col(radius).cast("double")).alias("r")).agg(
            F.max("n").alias("n"), F.max("r").alias("r")).first()
        if sizes["n"] == 1:  # a repeated point has the cells of all its discs
            halo = max(1, math.ceil(min(sizes["r"] or 1.0, 1e6)))
            return _discs_in_tiles(points, grid, on, point_id, x, y, radius, gx, gy, config, vectors or {}, halo)
    joined = joins.radius_join_cells(points, grid, on, x, y, radius, gx, gy, bucket)
    return _finish_disc(points, joined, point_id, config, extra, vectors)


def _named_of_segments(name: str, v, which, m: int):
    """An aggregate (see ``AGGREGATES``) of the values of ``m`` segments, and where it is missing; values are sorted by (segment, value)."""
    import numpy as np

    n = np.bincount(which, minlength=m)
    if name == "count":
        return n, np.zeros(m, dtype=bool)
    missing, ends, many = n == 0, np.cumsum(n), np.maximum(n, 1)
    if not len(v):
        return np.zeros(m), missing
    low = np.minimum(ends - n, len(v) - 1)

    def at(q: float):
        place = (n - 1) * q
        i, j = (np.clip(low + f(place).astype(np.int64), 0, len(v) - 1) for f in (np.floor, np.ceil))
        part = place - np.floor(place)
        between = (np.ceil(place) - place) * v[i] + part * v[j]
        return np.where((part == 0) | (v[i] == v[j]), v[i], between)

    if name in SHARES:
        found = [at(q) for q in SHARES[name]]
        return found[-1] - found[0] if len(found) > 1 else found[0], missing
    if name in ("min", "max"):
        return v[low if name == "min" else np.maximum(ends - 1, 0)], missing
    total = np.bincount(which, v, minlength=m)
    if name == "sum":
        return total, missing
    mean = total / many
    if name == "mean":
        return mean, missing
    squares = np.bincount(which, (v - mean[which]) ** 2, minlength=m)
    if name == "std_pop":
        return np.sqrt(squares / many), missing
    return np.sqrt(squares / np.maximum(n - 1, 1)), n < 2


def _disc_tiles(table: pa.Table, number, width: int, values: list[str], wanted: list, vectors: list, kept: list[str]) -> pa.Table:
    """Aggregates of the discs of the points of numbered tiles, all tiles together."""
    import numpy as np

    def array(name: str):
        return table.column(name).combine_chunks().cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False)

    cell = np.asarray(table.column("_cell").combine_chunks())
    is_cell, is_point = np.flatnonzero(cell), np.flatnonzero(~cell)
    x, y, r = array("x"), array("y"), array("_r")[is_point]
    # lattice squares of a tile, counted from its halo
    col, row = (a - array(name) for a, name in ((x, "_x0"), (y, "_y0")))
    square = (number[is_cell] * width + np.floor(col[is_cell]).astype(np.int64)) * width + np.floor(row[is_cell]).astype(np.int64)
    order = np.argsort(square, kind="stable")
    square, is_cell = square[order], is_cell[order]
    gx, gy = x[is_cell], y[is_cell]
    px, py, pc_, pr, tile = x[is_point], y[is_point], col[is_point], row[is_point], number[is_point]
    there = ~(np.isnan(px) | np.isnan(py) | np.isnan(r)) & (r >= 0)
    edge = [np.clip(np.nan_to_num(np.floor(c + s * r)), 0, width - 1).astype(np.int64) for c in (pc_, pr) for s in (-1, 1)]
    steps = int((edge[1] - edge[0])[there].max()) + 1 if there.any() else 0
    reached = []
    for k in range(steps):
        base = (tile * width + edge[0] + k) * width
        on = there & (edge[0] + k <= edge[1])
        lo, hi = np.searchsorted(square, base + edge[2], "left"), np.searchsorted(square, base + edge[3], "right")
        reached.append((np.where(on, lo, 0), np.where(on, hi, 0)))
    ends = np.cumsum(sum((hi - lo for lo, hi in reached), np.zeros(len(px), np.int64)))
    data = {c: array(c)[is_cell] for c in values}
    frames, first = [], 0
    while first < len(px):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + DISC_CELLS, "right")))
        found = list(pairs._expanded([(lo[first:last], hi[first:last]) for lo, hi in reached], DISC_CELLS))
        i, j = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
        p = i + first
        inside = np.sqrt((gx[j] - px[p]) ** 2 + (gy[j] - py[p]) ** 2) <= r[p]
        i, j, m = i[inside], j[inside], last - first
        n = np.bincount(i, minlength=m)
        columns = {"n_cells": pa.array(n)}
        for c in values:
            v = data[c][j]
            at = np.flatnonzero(~np.isnan(v))
            at = at[np.lexsort((v[at], i[at]))]
            for out, (column, name) in wanted:
                if column == c:
                    found, missing = _named_of_segments(name, v[at], i[at], m)
                    columns[out] = pa.array(found, mask=missing | (n == 0))
        for prefix, (u, w) in vectors:
            a, b = data[u][j], data[w][j]
            both = ~(np.isnan(a) | np.isnan(b))
            for part, v in (("u", a), ("v", b)):
                found, missing = _named_of_segments("mean", v[both], i[both], m)
                columns[f"{prefix}_mean_{part}"] = pa.array(found, mask=missing)
        rows = table.select(kept).take(pa.array(is_point[first:last]))
        for name in ["n_cells", *[out for out, _ in wanted], *[f"{prefix}_mean_{part}" for prefix, _ in vectors for part in "uv"]]:
            rows = rows.append_column(name, columns[name])
        frames.append(rows)
        first = last
    if frames:
        return pa.concat_tables(frames)
    out = table.select(kept).slice(0, 0)
    for name, kind in [("n_cells", pa.int64()), *[(out_, pa.int64() if f[1] == "count" else pa.float64()) for out_, f in wanted],
                       *[(f"{prefix}_mean_{part}", pa.float64()) for prefix, _ in vectors for part in "uv"]]:
        out = out.append_column(name, pa.array([], kind))
    return out


def _discs_in_tiles(points: DataFrame, grid: DataFrame, on: list[str], point_id: str, x: str, y: str, radius: str, gx: str, gy: str,
                    config: dict[str, tuple[str, str]], vectors: dict[str, tuple[str, str]], halo: int) -> DataFrame:
    """Aggregates of discs of radius ``halo`` at most: a tile's points meet the cells of the tile and its halo in one task."""
    tile = max(64, 4 * halo)
    taken = list(dict.fromkeys([*[c for c, _ in config.values()], *[c for v in vectors.values() for c in v]]))
    values = {c: f"_v{k}" for k, c in enumerate(taken)}
    carried = {c: f"_p{k}" for k, c in enumerate(points.columns)}
    origin = {"_x0": F.col("_tx") * tile - halo, "_y0": F.col("_ty") * tile - halo}
    number = lambda c: F.col(c).cast("double")
    p = points.select(*on, number(x).alias("x"), number(y).alias("y"), F.when(F.col(point_id).isNotNull(), number(radius)).alias("_r"),
                      *[F.col(c).alias(k) for c, k in carried.items()], F.lit(False).alias("_cell"))
    p = p.withColumns({"_ty": F.coalesce(F.floor(F.col("y") / tile), F.lit(0).cast("long")), "_tx": F.coalesce(F.floor(F.col("x") / tile), F.lit(0).cast("long"))})
    g = grid.select(*on, number(gx).alias("x"), number(gy).alias("y"), *[finite(c).alias(k) for c, k in values.items()], F.lit(True).alias("_cell"))
    for c in ("x", "y", *on):
        g = g.where(F.col(c).isNotNull())
    rows = p.unionByName(in_tiles(g, halo, tile), allowMissingColumns=True)
    groups = [*on, "_ty", "_tx"]
    kinds = [T.StructField(k, points.schema[c].dataType) for c, k in carried.items()] + [T.StructField("n_cells", T.LongType())]
    kinds += [T.StructField(out, T.LongType() if name == "count" else T.DoubleType()) for out, (_, name) in config.items()]
    kinds += [T.StructField(f"{prefix}_mean_{part}", T.DoubleType()) for prefix in vectors for part in "uv"]
    kernel = partial(_disc_tiles, width=tile + 2 * halo + 2, values=list(values.values()), wanted=[(out, (values[c], name)) for out, (c, name) in config.items()],
                     vectors=[(prefix, (values[u], values[v])) for prefix, (u, v) in vectors.items()], kept=list(carried.values()))

    def discs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from tiles_together(batches, groups, kernel)

    out = spread(rows, groups).sortWithinPartitions(*groups).withColumns(origin).mapInArrow(discs, T.StructType(kinds))
    parts = [c.alias(f"{prefix}_{part}") for prefix in vectors for part, c in vector_direction(f"{prefix}_mean_u", f"{prefix}_mean_v").items()]
    first = [F.col(carried[c]).alias(c) for c in (point_id, *[c for c in points.columns if c != point_id])]
    return out.select(*first, "n_cells", *config, *parts)


def disc_aggregate_degrees(points: DataFrame, grid: DataFrame, on: list[str], point_id: str, lon: str, lat: str,
                           radius: str, grid_lon: str, grid_lat: str, config: dict[str, tuple[str, str]],
                           bucket: float, vectors: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """As :func:`disc_aggregate` with a radius in degrees and periodic longitude.

    Aggregate name ``point`` takes the value of the cell nearest the centre.
    """
    joined = joins.radius_join_degrees(points, grid, on, lon, lat, radius, grid_lon, grid_lat, bucket)
    return _finish_disc(points, joined, point_id, config, None, vectors,
                        nearest=F.struct(F.col("dist_deg"), F.col(grid_lat), F.col(grid_lon)))


def _finish_disc(points, joined, point_id, config, extra, vectors, nearest=None) -> DataFrame:
    if extra is not None:
        joined = joined.where(extra)
    plain = {k: v for k, v in config.items() if v[1] != "point"}
    aggs = aggregate_list(plain)
    for out, (column, name) in config.items():
        if name == "point":
            aggs.append(F.min_by(F.col(column), nearest).alias(out))
    for prefix, (u, v) in (vectors or {}).items():
        aggs += [c.alias(f"{prefix}_{part}") for part, c in vector_mean(u, v).items()]
    found = joined.groupBy(point_id).agg(F.count(F.lit(1)).alias("n_cells"), *aggs)
    out = points.join(found, point_id, "left")
    return out.withColumn("n_cells", F.coalesce("n_cells", F.lit(0).cast("long")))


def derived_winds(field: DataFrame) -> DataFrame:
    """Wind speeds and 500-850 hPa shear, once per cell and time."""
    return field.withColumns({
        "wind10": geo.wind_speed("u10", "v10"),
        "wind850": geo.wind_speed("u850", "v850"),
        "wind500": geo.wind_speed("u500", "v500"),
        "du_500_850": F.col("u500") - F.col("u850"),
        "dv_500_850": F.col("v500") - F.col("v850"),
    })


def node_parameters(points: DataFrame, field: DataFrame, tropopause: DataFrame, on: list[str], point_id: str,
                    bucket: float, radius_multiplier: float = 4.0) -> DataFrame:
    """The twelve parameters of each node, in one pass per grid.

    ``field`` holds surface and pressure-level variables on one grid;
    ``tropopause`` (column ``trop_z``) lives on its own grid and is aggregated
    separately, then joined by point.
    """
    centres = points.withColumn("_r", F.col("rad") * radius_multiplier)
    main = disc_aggregate_degrees(
        centres, derived_winds(field).withColumnsRenamed({"lon": "glon", "lat": "glat"}), on, point_id, "lon", "lat",
        "_r", "glon", "glat",
        {
            "_slp_c": ("mslp", "point"), "_slp_95": ("mslp", "p95"), "U10_mean": ("wind10", "median"),
            "U850_mean": ("wind850", "median"), "_u500": ("wind500", "median"), "_pv": ("pv850", "median"),
            "_t2": ("t2", "median"), "_t850": ("t850", "median"), "T850_disp": ("t850", "std"),
            "_blh": ("blh", "median"), "w_850": ("w850", "p95"), "RH_850": ("r850", "median"),
            "RAIN_HOURLY_sum": ("precip", "sum"),
        }, bucket, vectors={"_dv": ("du_500_850", "dv_500_850")})
    trop = disc_aggregate_degrees(
        centres.select(point_id, *on, "lon", "lat", "_r"), tropopause.withColumnsRenamed({"lon": "glon", "lat": "glat"}),
        on, point_id, "lon", "lat", "_r", "glon", "glat", {"_trop": ("trop_z", "median")}, bucket
    ).select(point_id, "_trop")
    out = main.join(trop, point_id, "left")
    return out.withColumns({
        "SLP_diff_cent_95": 0.01 * (F.col("_slp_95") - F.col("_slp_c")),
        "U500_U850_frac": F.when(F.col("U850_mean") > 0, F.col("_u500") / F.col("U850_mean")),
        "U500_minus_U850": F.col("_dv_mean_magnitude"),
        "PV_850_mean": F.col("_pv") * 1_000_000.0,
        "T2_minus_T850_mean": F.col("_t2") - F.col("_t850"),
        "pbl_trop_frac": F.when(F.col("_trop") > 0, F.col("_blh") * 1000.0 / F.col("_trop")),
    }).drop("_r", "_slp_c", "_slp_95", "_u500", "_pv", "_t2", "_t850", "_blh", "_trop", "_dv_mean_u", "_dv_mean_v",
            "_dv_mean_angle", "_dv_mean_magnitude", "n_cells")


def box_aggregate(points: DataFrame, grid: DataFrame, on: list[str], point_id: str, x: str, y: str, half: str,
                  gx: str, gy: str, config: dict[str, tuple[str, str]], bucket: float,
                  half_open: bool = True) -> DataFrame:
    """Aggregates over a square index box; the upper edge is excluded by default."""
    h = F.col(half)
    p = points.withColumn("_bx", F.explode(F.sequence(F.floor((F.col(x) - h) / bucket), F.floor((F.col(x) + h) / bucket))))
    p = p.withColumn("_by", F.explode(F.sequence(F.floor((F.col(y) - h) / bucket), F.floor((F.col(y) + h) / bucket))))
    g = grid.withColumn("_bx", F.floor(F.col(gx) / F.lit(float(bucket)))).withColumn("_by", F.floor(F.col(gy) / F.lit(float(bucket))))
    joined = p.join(g, [*on, "_bx", "_by"])
    dx, dy = F.col(gx) - F.col(x), F.col(gy) - F.col(y)
    upper = (dx < h) & (dy < h) if half_open else (dx <= h) & (dy <= h)
    joined = joined.where((dx >= -h) & (dy >= -h) & upper)
    return _finish_disc(points, joined, point_id, config, None, None)


def geo_box_aggregate(points: DataFrame, grid: DataFrame, on: list[str], point_id: str, lon: str, lat: str,
                      half_deg: str, grid_lon: str, grid_lat: str, config: dict[str, tuple[str, str]],
                      bucket: float) -> DataFrame:
    """Aggregates over a latitude-longitude box around each point."""
    shifted = grid.withColumn("_gx", F.col(grid_lon)).withColumn("_gy", F.col(grid_lat))
    return box_aggregate(points, shifted, on, point_id, lon, lat, half_deg, "_gx", "_gy", config, bucket, half_open=False)


def cluster_stats(cells: DataFrame, by: list[str], cluster: str = "cluster", crit: str = "crit") -> DataFrame:
    """Strongest cell and effective radius of each cluster; first (y, x) on ties."""
    rank = F.struct(-F.abs(F.col(crit)), F.col("y"), F.col("x"))
    g = cells.groupBy(*by, cluster).agg(
        F.min_by(F.struct("x", "y", F.col(crit).alias("crit")), rank).alias("_m"), F.count(F.lit(1)).alias("n_cells"))
    return g.select(*by, cluster, "_m.x", "_m.y", "_m.crit", "n_cells",
                    F.sqrt(F.col("n_cells") / F.pi()).alias("rad_eff"))


def cluster_area_radius(cells: DataFrame, by: list[str], cluster: str, lat: str, dlon_deg: float,
                        dlat_deg: float) -> DataFrame:
    """Radius of the disc with the cluster's latitude-weighted area, in km."""
    cell = (F.lit(geo.EARTH_RADIUS_KM ** 2) * F.radians(F.lit(float(dlon_deg))) * F.radians(F.lit(float(dlat_deg)))
            * F.cos(F.radians(F.col(lat))))
    g = cells.groupBy(*by, cluster).agg(F.sum(cell).alias("area_km2"))
    return g.withColumn("rad_km", F.when(F.col("area_km2") > 0, F.sqrt(F.col("area_km2") / F.pi())))


def track_statistics(df: DataFrame, track: str, time: str, columns: list[str], length: str | None = None,
                     stats: tuple[str, ...] = ("mean", "min", "max")) -> DataFrame:
    """Mean, minimum and maximum of many parameters plus lifetime and length."""
    aggs = [named_aggregate(s, c).alias(f"{c}_{s}") for c in columns for s in stats]
    aggs += [F.count(F.lit(1)).alias("n_points"), hours_between(F.max(time), F.min(time)).alias("lifetime_hours")]
    if length:
        aggs.append(F.max(length).alias("track_length"))
    return df.groupBy(track).agg(*aggs)


def node_label_statistics(df: DataFrame, track: str, label: str, wanted: str) -> DataFrame:
    """Counts, share and set of labels along each track."""
    n, k = F.count(F.lit(1)), F.count_if(F.coalesce(F.col(label) == wanted, F.lit(False)))
    return df.groupBy(track).agg(
        n.alias("n_nodes"), k.alias("n_type_nodes"), (k / n).alias("fraction_type_nodes"),
        F.count_distinct(label).alias("n_unique_labels"), label_set(label).alias("labels"))


# Catalogue label of each track type, in order of priority.
TYPE_LABELS = {"TC": "TC", "SS": "SS(STLC)", "PL": "PL(PTLC)"}


def primary_type(df: DataFrame, track: str, time: str, label: str, lon: str, lat: str,
                 labels: dict[str, str] | None = None, genesis: Column | None = None,
                 tie: list[str] | None = None) -> DataFrame:
    """One exclusive type per track by priority, with its genesis point.

    ``genesis`` is a condition on ``genesis_lon``/``genesis_lat``; tracks of the
    first type that fail it lose their type.
    """
    labels = labels or TYPE_LABELS
    first = F.min_by(F.struct(F.col(time).alias("t"), F.col(lon).alias("lon"), F.col(lat).alias("lat")),
                     F.struct(time, *(tie or [])))
    g = df.groupBy(track).agg(
        *[F.coalesce(F.bool_or(F.col(label) == v), F.lit(False)).alias(f"has_{k}") for k, v in labels.items()],
        first.alias("_g"))
    out = g.select(track, *[f"has_{k}" for k in labels], F.col("_g.t").alias("genesis_time"),
                   F.col("_g.lon").alias("genesis_lon"), F.col("_g.lat").alias("genesis_lat"))
    names = list(labels)
    kind = F.lit(None).cast("string")
    for name in reversed(names):
        kind = F.when(F.col(f"has_{name}"), name).otherwise(kind)
    inside = F.lit(True) if genesis is None else F.coalesce(genesis, F.lit(False))
    out = out.withColumn("_kind", kind).withColumn("_in", inside)
    lead = F.coalesce(F.col("_kind") == names[0], F.lit(False))
    return out.withColumns({
        "genesis_in_region": lead & F.col("_in"),
        "excluded_by_genesis": lead & ~F.col("_in"),
        "primary_type": F.when(~(lead & ~F.col("_in")), F.col("_kind")),
    }).drop("_kind", "_in")


def primary_type_half_inside(df: DataFrame, track: str, label: str, inside: Column,
                             labels: dict[str, str] | None = None, share: float = 0.5) -> DataFrame:
    """Variant: the first type needs all its points inside and half of all points."""
    labels = labels or TYPE_LABELS
    names = list(labels)
    lead = F.coalesce(F.col(label) == labels[names[0]], F.lit(False))
    g = df.withColumn("_in", F.coalesce(inside, F.lit(False))).groupBy(track).agg(
        F.count(F.lit(1)).alias("n_points"), F.count_if("_in").alias("n_inside"), F.count_if(lead).alias("n_lead"),
        F.count_if(lead & F.col("_in")).alias("n_lead_inside"),
        *[F.coalesce(F.bool_or(F.col(label) == labels[k]), F.lit(False)).alias(f"has_{k}") for k in names[1:]])
    ok = (F.col("n_lead_inside") == F.col("n_lead")) & (F.col("n_inside") >= share * F.col("n_points"))
    rest = F.lit(None).cast("string")
    for name in reversed(names[1:]):
        rest = F.when(F.col(f"has_{name}"), name).otherwise(rest)
    kind = F.when(F.col("n_lead") > 0, F.when(ok, names[0])).otherwise(rest)
    return g.withColumn("primary_type", kind)


def monthly_summary(df: DataFrame, track: str, time: str) -> DataFrame:
    """Points and distinct tracks per month; a track counts in each month it spans."""
    return df.groupBy(F.month(time).alias("month")).agg(
        F.count(F.lit(1)).alias("n_points"), F.count_distinct(track).alias("n_tracks"))


def selection_summary(df: DataFrame, track: str, time: str, label: str, wanted: str) -> DataFrame:
    """One-row summary of a selection."""
    hit = F.coalesce(F.col(label) == wanted, F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("n_points"), F.count_distinct(track).alias("n_tracks"),
        F.count_if(hit).alias("n_type_points"), F.count_distinct(F.when(hit, F.col(track))).alias("n_type_tracks"),
        F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def peak_row(df: DataFrame, track: str, time: str, value: str, columns: list[str], use_min: bool = False,
             skip_first: bool = True, tie: list[str] | None = None) -> DataFrame:
    """Row of the extreme value per track, the earliest on ties.

    The first point is skipped without numbering the track: its order key is
    the track's minimum, found by the same partial aggregate.
    """
    order = [time, *(tie or [])]
    key = F.struct(*order)
    value_rank = F.col(value) if use_min else -F.col(value)
    if skip_first:
        starts = df.groupBy(track).agg(F.min(key).alias("_start"))
        df = df.join(starts, track).where(key > F.col("_start")).drop("_start")
    df = df.where(F.col(value).isNotNull())
    extra = [c for c in dict.fromkeys([time, value, *columns]) if c != track]
    return ordered.best_row(df, [track], [value_rank, *[F.col(o) for o in order]], extra)


def track_ends(df: DataFrame, track: str, time: str, value: str, columns: list[str],
               tie: list[str] | None = None) -> DataFrame:
    """Start, stop and maximum rows of each track, one row each."""
    key = F.struct(time, *(tie or []))
    row = F.struct(*dict.fromkeys([time, value, *columns]))
    best = F.struct(-F.col(value), key)
    g = df.groupBy(track).agg(F.min_by(row, key).alias("start"), F.max_by(row, key).alias("stop"),
                              F.min_by(row, best).alias("max"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("row")) for k in ("start", "stop", "max")]))
    return g.select(track, kinds.alias("_k")).select(track, F.col("_k.kind").alias("kind"), "_k.row.*")


def day_coverage(df: DataFrame, time: str, first_day: str, last_day: str) -> DataFrame:
    """Expected against found days per month, with the missing days listed."""
    spark = df.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))).alias("day"))
    found = df.select(F.col(time).cast("date").alias("day")).distinct().withColumn("_f", F.lit(True))
    both = days.join(found, "day", "left").withColumn("month", F.date_format("day", "yyyy-MM"))
    missing = F.when(F.col("_f").isNull(), F.date_format("day", "yyyy-MM-dd"))
    return both.groupBy("month").agg(
        F.count(F.lit(1)).alias("expected_days"), F.count("_f").alias("found_days"),
        F.array_join(F.array_sort(F.collect_list(missing)), ",").alias("missing_days"))


def reconcile_counts(left: DataFrame, right: DataFrame, by: list[str], names: tuple[str, str]) -> DataFrame:
    """Row counts of two tables per key and whether they agree."""
    a = left.groupBy(*by).agg(F.count(F.lit(1)).alias(names[0]))
    b = right.groupBy(*by).agg(F.count(F.lit(1)).alias(names[1]))
    out = a.join(b, by, "full_outer")
    out = out.withColumns({n: F.coalesce(n, F.lit(0).cast("long")) for n in names})
    return out.withColumn("consistent", F.col(names[0]) == F.col(names[1]))


def cross_tab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of two labels; ``values`` fixes the columns so no pass lists them."""
    return df.groupBy(row).pivot(column, values).count().fillna(0)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def mode_label(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """Most frequent label per key; the alphabetically first on ties."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    return ordered.best_row(counts, by, [-F.col("n"), F.col(label)], [label, "n"])


def group_means(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(c).alias(f"{c}_mean") for c in columns], F.count(F.lit(1)).alias("n"))


def mean_lifetime_by_type(df: DataFrame, track: str, time: str, label: str) -> DataFrame:
    """Lifetime per track and type, then its mean per type."""
    life = df.groupBy(track, label).agg(hours_between(F.max(time), F.min(time)).alias("_h"))
    return life.groupBy(label).agg(F.avg("_h").alias("mean_lifetime_hours"), F.count(F.lit(1)).alias("n_tracks"))


def yearly_activity(df: DataFrame, track: str, time: str, value: str) -> DataFrame:
    """Distinct tracks, points and the strongest (lowest) value per year and month."""
    per = df.groupBy(F.year(time).alias("year"), F.month(time).alias("month"), track).agg(
        F.count(F.lit(1)).alias("_n"), F.min(value).alias("_low"))
    return per.groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("n_tracks"), F.sum("_n").alias("n_points"), F.min("_low").alias("lowest"),
        F.min_by(track, F.struct("_low", track)).alias("strongest_track"))


def value_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, median, spread, bounds and quartiles of a column."""
    plain = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    quart = ordered.exact_percentiles(df, by, value, {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return ordered._left_on(plain, quart, by)


def time_of_extreme(df: DataFrame, track: str, time: str, value: str) -> DataFrame:
    """Largest, smallest and mean value and when the largest was reached."""
    return df.groupBy(track).agg(
        F.max(value).alias("max_value"), F.min(value).alias("min_value"), F.avg(value).alias("mean_value"),
        F.min_by(time, F.struct(-F.col(value), time)).alias("time_of_max"))


