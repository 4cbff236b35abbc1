"""From labelled cells to nodes: centres, extrema, radii."""

from __future__ import annotations

import math
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrespark.functions import geo
from gyrespark.functions.aggregates import circular_mean_lon
from gyrespark.operators import aggregate, grid
from gyrespark.session import cut_lineage, spread


CELLS_TOGETHER = 10_000  # cells of clusters whose radii one kernel call re-estimates, on average


def extrema(cells: DataFrame, by: list[str], min_distance: int = 1) -> DataFrame:
    """Local extrema of each slice plus the cluster centres that are not among them."""
    # few rows a cluster, read twice each
    maxima = cut_lineage(grid.local_maxima(cells, by, "crit", min_distance, payload=["cluster"]))
    stats = cut_lineage(aggregate.cluster_stats(cells, by))
    rest = stats.join(maxima.select(*by, "x", "y"), [*by, "x", "y"], "left_anti")
    both = maxima.unionByName(rest.select(*by, "y", "x", "crit", "cluster"))
    return both.join(stats.select(*by, "cluster", "rad_eff", "n_cells"), [*by, "cluster"])


def _half_way_radius(at, crit, radius, site, value, samples: int):
    """Radii of the extrema of one cluster from the weakest point on the way to the nearest other one."""
    import numpy as np

    out = radius.copy()
    if len(at) > 1 and len(site):
        for i, p in enumerate(at):
            d = np.hypot(*(at - p).T)
            d[d == 0] = np.inf
            path = np.linspace(p, at[int(d.argmin())], num=samples)
            # blocks of path points bound the size of the distance table
            blocks = np.array_split(path, max(1, len(path) * len(site) // 1_000_000))
            nearest = np.concatenate([((site[None, :, :] - b[:, None, :]) ** 2).sum(axis=2).argmin(axis=1) for b in blocks])
            out[i] = np.hypot(*(p - path[int(value[nearest].argmin())]))
        out[int(crit.argmax())] = radius.max()
    return np.maximum(out, 1.0)


def _radii_of_many(peaks: pd.DataFrame, cells: pd.DataFrame, keys: list[str], samples: int) -> pd.DataFrame:
    """Radii of the extrema of several clusters; frames are sorted once, clusters are slices of arrays."""
    import numpy as np

    if not len(peaks):
        return peaks
    peaks = peaks.sort_values(["y", "x"], kind="stable").reset_index(drop=True)
    cells = cells.sort_values(["site_y", "site_x"], kind="stable").reset_index(drop=True)
    at, site = peaks[["x", "y"]].to_numpy(dtype=float), cells[["site_x", "site_y"]].to_numpy(dtype=float)
    crit, value = (np.abs(c.to_numpy(dtype=float)) for c in (peaks["crit"], cells["site_crit"]))
    radius = peaks["rad_eff"].to_numpy(dtype=float).copy()
    members = cells.groupby([f"site_{k}" for k in keys]).indices
    none = np.empty(0, np.int64)
    for k, rows in peaks.groupby(keys).indices.items():
        of = members.get(k, none)
        radius[rows] = _half_way_radius(at[rows], crit[rows], radius[rows], site[of], value[of], samples)
    return peaks.assign(rad_eff=radius)


def reestimate_radii(peaks: DataFrame, cells: DataFrame, by: list[str], samples: int = 100) -> DataFrame:
    """Radii of extrema that share a cluster.

    The strongest extremum (largest absolute value) keeps the cluster radius,
    every other one reaches to the weakest cell on its way to the nearest
    neighbour; no radius falls below one cell.  Only clusters with several
    extrema visit the kernel, whole clusters in groups of a bounded number of cells.
    """
    keys = [*by, "cluster"]
    many = peaks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys)
    single = peaks.join(many, keys, "left_anti").withColumn("rad_eff", F.greatest("rad_eff", F.lit(1.0)))
    shared = peaks.join(many, keys, "left_semi")
    sites = cells.join(many, keys, "left_semi").select(
        *[F.col(k).alias(f"site_{k}") for k in [*keys, "y", "x", "crit"]])
    buckets = max(1, math.ceil(sites.count() / CELLS_TOGETHER))
    dealt = lambda df, prefix: df.withColumn("_g", F.pmod(F.xxhash64(*[prefix + k for k in keys]), F.lit(buckets)))
    kernel = partial(_radii_of_many, keys=keys, samples=samples)
    a, b = spread(dealt(shared, ""), ["_g"]).groupBy("_g"), spread(dealt(sites, "site_"), ["_g"]).groupBy("_g")
    done = a.cogroup(b).applyInPandas(lambda p, c: kernel(p.drop(columns="_g"), c), shared.schema)
    return single.unionByName(done)


def identify(field: DataFrame, by: list[str], crit: str = "crit", eps: float = 1.0, min_samples: int = 4,
             size_filter: int = 10, min_distance: int = 1, update_radii: bool = True) -> dict[str, DataFrame]:
    """Cells, centres and extrema of a criterion field."""
    from gyrespark.operators.labelling import label_cells

    cells = label_cells(field, by, crit, eps, min_samples, size_filter)
    centres = aggregate.cluster_stats(cells, by)
    peaks = extrema(cells, by, min_distance)
    if update_radii:
        peaks = reestimate_radii(peaks, cells, by)
    return {"cells": cells, "centres": centres, "extrema": peaks}


def geometric_nodes(cells: DataFrame, field: DataFrame, by: list[str], lon0: float, dlon: float, nx: int,
                    lat0: float, dlat: float, ny: int, min_cells: int | None = None) -> DataFrame:
    """Centroid nodes: circular mean longitude, value at the centroid cell.

    Where the centroid cell has no value (a hole in a curved cluster) the
    nearest member cell supplies it.  The radius is that of the cluster.
    """
    keys = [*by, "cluster"]
    c = cells.withColumn("_lon", F.lit(lon0) + F.col("x") * dlon).withColumn("_lat", F.lit(lat0) + F.col("y") * dlat)
    g = c.groupBy(*keys).agg(circular_mean_lon("_lon").alias("lon"), F.avg("_lat").alias("lat"),
                             F.count(F.lit(1)).alias("n_cells"), F.sqrt(F.count(F.lit(1)) / F.pi()).alias("rad"))
    if min_cells is not None:
        g = g.where(F.col("n_cells") >= min_cells)
    offset = F.pmod(F.col("lon") - F.lit(lon0), F.lit(360.0))
    g = g.withColumn("lon_idx", F.least(geo.nearest_index(offset / dlon), F.lit(nx - 1)))
    g = g.withColumn("lat_idx", geo.coord_to_index("lat", lat0, dlat, ny))
    at = field.select(*by, F.col("x").alias("lon_idx"), F.col("y").alias("lat_idx"), F.col("crit").alias("_c"),
                      F.col("wspd").alias("wspd"))
    g = g.join(at, [*by, "lon_idx", "lat_idx"], "left")
    dist = F.pow(F.col("_lat") - F.col("lat"), 2) + F.pow(geo.lon_diff("_lon", "lon"), 2)
    near = c.join(g.where(F.col("_c").isNull()).select(*keys, "lon", "lat"), keys).groupBy(*keys).agg(
        F.min_by("crit", F.struct(dist, "y", "x")).alias("_near"))
    out = g.join(near, keys, "left").withColumn("crit", F.coalesce("_c", "_near"))
    return out.select(*by, "cluster", "lon_idx", "lat_idx", "lon", "lat", "rad", "crit", "wspd")


def extremum_nodes(peaks: DataFrame, cells: DataFrame, by: list[str], min_cells: int | None = None,
                   positive_only: bool = True) -> DataFrame:
    """Extrema written as nodes: positive ones of clusters that are large enough."""
    from gyrespark.operators.filters import large_clusters

    out = peaks.where(F.col("crit") > 0) if positive_only else peaks
    if min_cells is not None:
        ok = large_clusters(cells, by, "cluster", min_cells).select(*by, "cluster").distinct()
        out = out.join(ok, [*by, "cluster"], "left_semi")
    return out


def merge_close_extrema(peaks: DataFrame, by: list[str], distance: float) -> DataFrame:
    """Drop extrema that have a stronger one within a distance (detection merge)."""
    from gyrespark.operators.joins import radius_join_cells

    a = peaks.withColumn("_r", F.lit(float(distance)))
    b = peaks.select(*by, F.col("x").alias("_ox"), F.col("y").alias("_oy"), F.abs("crit").alias("_oc"))
    near = radius_join_cells(a, b, by, "x", "y", "_r", "_ox", "_oy", max(1.0, float(distance)))
    stronger = (F.col("_oc") > F.abs(F.col("crit"))) | (
        (F.col("_oc") == F.abs(F.col("crit"))) & (F.struct("_oy", "_ox") < F.struct("y", "x")))
    weak = near.where(stronger).select(*by, "y", "x").distinct()
    return peaks.join(weak, [*by, "y", "x"], "left_anti")
