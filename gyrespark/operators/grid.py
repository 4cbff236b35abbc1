"""Gridded-field operators: gradients, smoothing, maxima, density, profiles.

A slice is one (time, level) of a field.  Its number of rows is fixed by the
grid, so a slice is a bounded group; parallelism comes from the slices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyrespark.functions.geo import _c
from gyrespark.operators import joins, ordered
from gyrespark.operators.labelling import in_tiles, tiles_together
from gyrespark.session import cut_lineage, spread


def densify(cells: DataFrame, by: list[str], nx: int, ny: int, values: list[str], fill: float | None = None) -> DataFrame:
    """Every cell of the grid for each slice; absent cells get ``fill``."""
    slices = cells.select(*by).distinct()
    full = slices.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(ny - 1)))).withColumn(
        "x", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))))
    out = full.join(cells.select(*by, "y", "x", *values), [*by, "y", "x"], "left")
    return out.fillna(fill, subset=values) if fill is not None else out


def _axis_gradient(value: str, part: list[str], axis: str, step: Column) -> Column:
    w = Window.partitionBy(*part).orderBy(axis)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    contiguous = F.lag(axis).over(w) == F.col(axis) - 1
    ahead = F.lead(axis).over(w) == F.col(axis) + 1
    lo = F.lag(F.lit(1)).over(w).isNotNull()
    hi = F.lead(F.lit(1)).over(w).isNotNull()
    inner = (after - before) / (2.0 * step)
    return (F.when(lo & hi, F.when(contiguous & ahead, inner))
            .when(hi, F.when(ahead, (after - F.col(value)) / step))
            .when(lo, F.when(contiguous, (F.col(value) - before) / step)))


def gradients(field: DataFrame, by: list[str], values: list[str], dx, dy) -> DataFrame:
    """Add ``<value>_dx`` and ``<value>_dy``: central inside, one-sided at edges.

    ``dx``/``dy`` may be numbers or Columns (``dx`` depends on latitude on a
    geographic grid).  One shuffle by slice serves the windows of both axes.
    """
    dx, dy = _as_step(dx), _as_step(dy)
    out = field.repartition(*by)
    out = out.withColumns({f"{v}_dx": _axis_gradient(v, [*by, "y"], "x", dx) for v in values})
    return out.withColumns({f"{v}_dy": _axis_gradient(v, [*by, "x"], "y", dy) for v in values})


def _as_step(step) -> Column:
    return step if isinstance(step, Column) else F.lit(float(step)) if not isinstance(step, str) else F.col(step)


def vertical_gradient(field: DataFrame, by: list[str], value: str, depth: str, out: str) -> DataFrame:
    """Second-order gradient along an unevenly spaced vertical axis.

    ``by`` names one column of the grid; its levels are few.
    """
    w = Window.partitionBy(*by).orderBy(depth)
    vb, va = F.lag(value).over(w), F.lead(value).over(w)
    hb, ha = F.col(depth) - F.lag(depth).over(w), F.lead(depth).over(w) - F.col(depth)
    v = F.col(value)
    inner = (hb * hb * va + (ha * ha - hb * hb) * v - ha * ha * vb) / (hb * ha * (hb + ha))
    return field.withColumn(out, F.when(hb.isNull(), (va - v) / ha).when(ha.isNull(), (v - vb) / hb).otherwise(inner))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(raw)
    return [r / total for r in raw]


def _smooth_axis(df: DataFrame, part: list[str], axis: str, values: list[str], weights: list[float], size: int) -> DataFrame:
    """Weighted moving sum along grid lines with mirrored edges.

    Each line is extended by mirrored copies of its cells (index -1-i, period
    twice the line length), so the sum is a plain window of neighbours.
    """
    r = len(weights) // 2
    turns = range(-(r // (2 * size)) - 1, r // (2 * size) + 2)
    at = F.col(axis)
    copies = [c + 2 * size * m for m in turns for c in (at, -1 - at)]
    inside = F.filter(F.array(*copies), lambda i: (i >= -r) & (i < size + r))
    wide = df.withColumn("_i", F.explode(inside))
    w = Window.partitionBy(*part).orderBy("_i")

    def term(value: str, k: int) -> Column:
        moved = F.col(value) if k == 0 else F.lead(value, k).over(w) if k > 0 else F.lag(value, -k).over(w)
        return moved * F.lit(weights[k + r])

    sums = {f"_s_{v}": sum((term(v, k) for k in range(-r + 1, r + 1)), term(v, -r)) for v in values}
    out = wide.withColumns(sums).where((F.col("_i") >= 0) & (F.col("_i") < size))
    return out.select(*part, F.col("_i").alias(axis), *[F.col(f"_s_{v}").alias(v) for v in values])


def gaussian_smooth(field: DataFrame, by: list[str], values: list[str], sigma: float, nx: int, ny: int,
                    truncate: float = 4.0) -> DataFrame:
    """Separable Gaussian filter on y and x only, mirrored at the edges.

    ``field`` is dense (see :func:`densify`).  Both passes work on one shuffle
    by slice.
    """
    weights = gaussian_weights(sigma, truncate)
    base = field.select(*by, "y", "x", *[F.col(v).cast("double").alias(v) for v in values]).repartition(*by)
    rows = _smooth_axis(base, [*by, "y"], "x", values, weights, nx)
    return _smooth_axis(rows, [*by, "x"], "y", values, weights, ny)


def _maxima_of_tiles(table: pa.Table, number, by: list[str], value: str, payload: list[str], d: int, tile: int) -> pa.Table:
    """Maxima among the own cells of numbered tiles, all tiles together."""
    import numpy as np

    def at(name: str):
        return table.column(name).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)

    # two halos of empty rows and columns keep tiles apart
    width = tile + 4 * d
    ly, lx = (at(axis) - at(name) * tile + 2 * d for name, axis in (("_ty", "y"), ("_tx", "x")))
    key = ((number * 3 + at("_sign") + 1) * width + ly) * width + lx
    size = pc.rank(pc.abs(table.column(value)), tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
    # the last of the rows of one cell stands for it, with the largest size of them
    place = np.empty(len(key), np.int64)
    place[pc.sort_indices(table, [(c, "ascending") for c in (value, *payload)], null_placement="at_start").to_numpy()] = np.arange(len(key))
    order = np.lexsort((place, key))
    key, starts = np.unique(key[order], return_index=True)
    size = np.maximum.reduceat(size[order], starts)
    row = order[np.r_[starts[1:], len(order)] - 1]
    ly, lx = ly[row], lx[row]

    beaten = np.zeros(len(key), dtype=bool)
    for dy in range(-d, d + 1):
        first = np.searchsorted(key, key + dy * width - d, "left")
        last = np.searchsorted(key, key + dy * width + d, "right")
        for step in range(2 * d + 1):
            k = np.minimum(first + step, len(key) - 1)
            other = (first + step < last) & (k != np.arange(len(key)))
            beaten |= other & ((size[k] > size) | ((size[k] == size) & (key[k] < key)))
    own = (ly >= 2 * d) & (ly < tile + 2 * d) & (lx >= 2 * d) & (lx < tile + 2 * d)
    return table.select([*by, "y", "x", value, *payload]).take(pa.array(row[own & ~beaten]))


def local_maxima(cells: DataFrame, by: list[str], value: str = "crit", min_distance: int = 1,
                 payload: list[str] | None = None) -> DataFrame:
    """Cells that exceed every cell within ``min_distance`` in both axes.

    Positive and negative extrema are found separately, each by absolute
    value.  Of equal neighbouring cells the first in (y, x) order stays.
    Slices are cut into tiles with a halo, of which a kernel call takes a
    bounded number of cells.
    """
    payload, tile, d = payload or [], max(64, 8 * min_distance), min_distance
    rows = cells.where(F.col(value) != 0).select(*by, F.signum(value).cast("int").alias("_sign"), "y", "x", value, *payload)
    out = rows.select(*by, "y", "x", value, *payload).schema
    groups = [*by, "_ty", "_tx"]
    kernel = partial(_maxima_of_tiles, by=by, value=value, payload=payload, d=d, tile=tile)

    def maxima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from tiles_together(batches, groups, kernel)

    return spread(in_tiles(rows, d, tile), groups).sortWithinPartitions(*groups).mapInArrow(maxima, out)


def log_normalise(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """log10 of positive values scaled to [0, 1] within each slice."""
    log = F.when(F.col(value) > 0, F.log10(value))
    span = df.groupBy(*by).agg(F.min(log).alias("_lo"), F.max(log).alias("_hi"))
    joined = ordered._left_on(df, span, by)
    return joined.withColumn(out, F.when(F.col("_hi") > F.col("_lo"), (log - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))).drop("_lo", "_hi")


def standardise(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Zero mean, unit population deviation within each slice."""
    span = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    joined = ordered._left_on(df, span, by)
    return joined.withColumn(out, F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def point_density(df: DataFrame, lon: str, lat: str, extent: tuple[float, float, float, float], cell: float,
                  weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """2-D histogram of points (or of weights); the last edge belongs to the last bin."""
    lon0, lon1, lat0, lat1 = extent
    nx, ny = round((lon1 - lon0) / cell), round((lat1 - lat0) / cell)
    inside = F.col(lon).between(float(lon0), float(lon0 + nx * cell)) & F.col(lat).between(float(lat0), float(lat0 + ny * cell))
    i = F.least(F.floor((F.col(lon) - lon0) / cell), F.lit(nx - 1)).cast("int")
    j = F.least(F.floor((F.col(lat) - lat0) / cell), F.lit(ny - 1)).cast("int")
    agg = F.sum(weight) if weight else F.count(F.lit(1))
    return df.where(inside).groupBy(*(by or []), i.alias("lon_bin"), j.alias("lat_bin")).agg(agg.alias("density"))


def tracks_per_cell(df: DataFrame, track: str, lon: str, lat: str, extent: tuple[float, float, float, float],
                    cell: float) -> DataFrame:
    """Distinct tracks per cell; here the last edge is outside the grid."""
    lon0, lon1, lat0, lat1 = extent
    nx, ny = round((lon1 - lon0) / cell), round((lat1 - lat0) / cell)
    i, j = F.floor((F.col(lon) - lon0) / cell).cast("int"), F.floor((F.col(lat) - lat0) / cell).cast("int")
    hit = df.select(track, i.alias("lon_bin"), j.alias("lat_bin")).where(
        F.col("lon_bin").between(0, nx - 1) & F.col("lat_bin").between(0, ny - 1)).dropDuplicates()
    return hit.groupBy("lon_bin", "lat_bin").agg(F.count(F.lit(1)).alias("n_tracks"))


def grid_step(df: DataFrame, coord: str, by: list[str] | None = None) -> DataFrame:
    """Median spacing of the distinct coordinates of an axis (few values)."""
    by = by or []
    axis = df.select(*by, coord).distinct()
    w = Window.partitionBy(*by).orderBy(coord) if by else Window.partitionBy(F.lit(0)).orderBy(coord)
    steps = axis.withColumn("_d", F.lead(coord).over(w) - F.col(coord))
    return steps.groupBy(*by).agg(F.abs(F.percentile("_d", F.lit(0.5))).alias("step"))


def interpolate_levels(profile: DataFrame, by: list[str], height: str, value: str, targets: list[float],
                       out_height: str = "target") -> DataFrame:
    """Linear interpolation of each vertical column to target heights.

    Every pair of neighbouring levels emits the targets it brackets; heights
    outside the profile give no value (a null row per target).
    """
    w = Window.partitionBy(*by).orderBy(height)
    seg = profile.where(F.col(value).isNotNull() & F.col(height).isNotNull())
    h0, v0 = F.col(height), F.col(value)
    seg = seg.withColumns({"_h1": F.lead(height).over(w), "_v1": F.lead(value).over(w), "_first": F.row_number().over(w) == 1})
    goals = F.array(*[F.lit(float(t)) for t in targets])
    inside = F.filter(goals, lambda t: ((t > h0) & (t <= F.col("_h1"))) | (F.col("_first") & (t == h0)))
    got = seg.withColumn(out_height, F.explode(inside)).withColumn(
        "_o", F.when(F.col(out_height) == h0, v0.cast("double")).otherwise(
            v0 + (F.col("_v1") - v0) * (F.col(out_height) - h0) / (F.col("_h1") - h0)))
    got = got.select(*by, out_height, F.col("_o").alias(value))
    wanted = profile.select(*by).distinct().withColumn(out_height, F.explode(goals))
    return wanted.join(got, [*by, out_height], "left")


def tropopause_height(profile: DataFrame, by: list[str], height: str, pv: str, threshold: float = 2.0,
                      min_height: float = 3000.0) -> DataFrame:
    """Lowest height at or above ``min_height`` where PV reaches the threshold."""
    w = Window.partitionBy(*by).orderBy(height)
    high = profile.where(F.col(height) >= min_height).withColumns(
        {"_h0": F.lag(height).over(w), "_p0": F.lag(pv).over(w)})
    crossing = high.where(F.col(pv) >= threshold)
    at = F.when(F.col("_h0").isNull(), F.col(height)).when(
        F.col(pv) == F.col("_p0"), F.col("_h0")).otherwise(
        F.col("_h0") + (threshold - F.col("_p0")) / (F.col(pv) - F.col("_p0")) * (F.col(height) - F.col("_h0")))
    found = crossing.groupBy(*by).agg(F.min_by(at, F.col(height)).alias("tropopause_z"))
    return profile.select(*by).distinct().join(found, by, "left")


def vapour_transport(profile: DataFrame, by: list[str], pressure: str, q: str, u: str, v: str,
                     bottom: float = 1000.0, top: float = 300.0, levels: int = 100) -> DataFrame:
    """Vertically integrated vapour transport on evenly spaced pressure levels.

    Levels outside a profile contribute nothing; the last layer repeats the
    thickness of the one before it.
    """
    step = (top - bottom) / (levels - 1)
    w = Window.partitionBy(*by).orderBy(pressure)
    p0 = F.col(pressure)
    seg = profile.withColumns({f"_{c}1": F.lead(c).over(w) for c in (pressure, q, u, v)} | {"_first": F.row_number().over(w) == 1})
    p1 = F.col(f"_{pressure}1")
    goals = F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: F.lit(bottom) + k * F.lit(step))
    inside = F.filter(goals, lambda t: ((t > p0) & (t <= p1)) | (F.col("_first") & (t == p0)))
    got = seg.withColumn("_t", F.explode(inside))
    part = F.when(p1.isNull(), F.lit(0.0)).otherwise((F.col("_t") - p0) / (p1 - p0))
    mix = {c: F.when(p1.isNull(), F.col(c)).otherwise(F.col(c) + (F.col(f"_{c}1") - F.col(c)) * part) for c in (q, u, v)}
    dp = step * 100.0
    got = got.withColumns({"_fu": mix[q] * mix[u] * dp / 9.81, "_fv": mix[q] * mix[v] * dp / 9.81})
    sums = got.groupBy(*by).agg(F.sum("_fu").alias("ivt_u"), F.sum("_fv").alias("ivt_v"))
    return sums.withColumn("ivt", F.sqrt(F.col("ivt_u") * F.col("ivt_u") + F.col("ivt_v") * F.col("ivt_v")))


def bilinear_regrid(points: DataFrame, grid: DataFrame, on: list[str], x: str, y: str, value: str) -> DataFrame:
    """Bilinear value at fractional grid positions from the four cells around."""
    fx, fy = F.col(x) - F.floor(x), F.col(y) - F.floor(y)
    corners = [F.struct((F.floor(x) + i).cast("int").alias("gx"), (F.floor(y) + j).cast("int").alias("gy"),
                        ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w"))
               for i in (0, 1) for j in (0, 1)]
    p = points.withColumn("_c", F.explode(F.filter(F.array(*corners), lambda c: c["w"] > 0)))
    p = p.withColumn("_gx", F.col("_c.gx")).withColumn("_gy", F.col("_c.gy"))
    g = grid.select(*on, F.col("x").alias("_gx"), F.col("y").alias("_gy"), F.col(value).alias("_v"))
    joined = p.join(g, [*on, "_gx", "_gy"], "left")
    keys = list(points.columns)
    full = F.count("_v") == F.count(F.lit(1))
    return joined.groupBy(*keys).agg(F.when(full, F.sum(F.col("_v") * F.col("_c.w"))).alias(value))


def nearest_grid_cell(points: DataFrame, grid: DataFrame, point_id: str, lon: str, lat: str, grid_lon: str,
                      grid_lat: str, cell: float) -> DataFrame:
    """Nearest cell of a curvilinear grid for every point, wherever it lies.

    Nine buckets around a point hold every cell nearer than one bucket: a cell is
    filed under all nine, a point is not copied.  Points whose best hit is farther, or that have none, are searched again with
    buckets of twice the width.  Longitudes wrap; equal distances go to the
    smaller (y, x).  An empty grid has no nearest cell and gives no rows.
    """
    rest = points.select(point_id, F.pmod(F.col(lon) + 180.0, F.lit(360.0)).alias("_lon"), F.col(lat).alias("_lat"))
    rest = cut_lineage(rest.where("_lon IS NOT NULL AND _lat IS NOT NULL"))
    found = []
    cells = grid.select("y", "x", F.pmod(F.col(grid_lon) + 180.0, F.lit(360.0)).alias("_glon"), F.col(grid_lat).alias("_glat"))
    cells = cut_lineage(cells.where("_glon IS NOT NULL AND _glat IS NOT NULL"))
    cells_left = not cells.isEmpty()
    while cells_left and not rest.isEmpty():
        def bucket(column, step=0, width=cell):
            return F.floor(F.col(column) / width) + step

        near = [F.struct((bucket("_l") + i).alias("bx"), (bucket("_glat") + j).alias("by")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        g = cells.withColumn("_l", F.explode(F.array(*[F.col("_glon") + s for s in (-360.0, 0.0, 360.0)]))).withColumn("_near", F.explode(F.array(*near)))
        p = rest.withColumn("_near", F.struct(bucket("_lon").alias("bx"), bucket("_lat").alias("by")))
        d = F.sqrt(F.pow(F.col("_l") - F.col("_lon"), 2) + F.pow(F.col("_glat") - F.col("_lat"), 2))
        # estimates do not know of the copies of g: neither side must be broadcast
        best = p.hint("merge").join(g, "_near").groupBy(point_id).agg(
            F.min_by(F.struct("y", "x", d.alias("dist")), F.struct(F.round(d, 9), "y", "x")).alias("_m")).where(F.col("_m.dist") <= cell)
        best = cut_lineage(best.select(point_id, "_m.y", "_m.x", "_m.dist"))
        found.append(best)
        rest, cell = cut_lineage(rest.join(best.select(point_id), point_id, "left_anti")), cell * 2
    none = points.where("false").select(point_id, F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(0.0).alias("dist"))
    return reduce(lambda a, b: a.unionByName(b), found) if found else none


def radial_profile(points: DataFrame, grid: DataFrame, on: list[str], point_id: str, x: str, y: str, radius: str,
                   value: str, bin_width: float, bucket: float) -> DataFrame:
    """Mean of a field in rings around each point."""
    joined = joins.radius_join_cells(points, grid.withColumnsRenamed({"x": "_gx", "y": "_gy"}), on, x, y, radius, "_gx", "_gy", bucket)
    d = F.sqrt(F.pow(F.col("_gx") - F.col(x), 2) + F.pow(F.col("_gy") - F.col(y), 2))
    return joined.groupBy(point_id, F.floor(d / bin_width).cast("int").alias("ring")).agg(
        F.avg(value).alias("ring_mean"), F.count(F.lit(1)).alias("n_cells"))


def profile_size(profile: DataFrame, point_id: str, bin_width: float) -> DataFrame:
    """Outer edge of the last ring with a positive mean."""
    return profile.groupBy(point_id).agg(
        F.max(F.when(F.col("ring_mean") > 0, (F.col("ring") + 1) * bin_width)).alias("size"))


def ellipse_mean(ellipses: DataFrame, grid: DataFrame, on: list[str], ellipse_id: str, value: str, bucket: float) -> DataFrame:
    """Mean of a field inside rotated ellipses (cx, cy, a, b, theta)."""
    from gyrespark.functions.geo import in_ellipse

    e = ellipses.withColumn("_r", F.greatest("a", "b"))
    joined = joins.radius_join_cells(e, grid.withColumnsRenamed({"x": "_gx", "y": "_gy"}), on, "cx", "cy", "_r", "_gx", "_gy", bucket)
    hit = joined.where(in_ellipse("_gx", "_gy", "cx", "cy", "a", "b", "theta"))
    return hit.groupBy(ellipse_id).agg(F.count(F.lit(1)).alias("n_cells"), F.avg(_c(value)).alias("ellipse_mean"))
