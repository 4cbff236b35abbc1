"""Row and track filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gyrespark.functions import geo


def nan_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Turn NaN into NULL in floating columns: missing data has one form here."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    names = [c for c in floats if columns is None or c in columns]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names}) if names else df


def rotation_sense(df: DataFrame, crit: str, sense: str = "C") -> DataFrame:
    """Cyclonic cells have a positive criterion, anticyclonic a negative one."""
    return df.where(F.col(crit) > 0 if sense == "C" else F.col(crit) < 0)


def large_clusters(cells: DataFrame, by: list[str], cluster: str, min_cells: int) -> DataFrame:
    """Cells of clusters with at least ``min_cells`` members; 0 is background."""
    real = cells.where(F.col(cluster) != 0)
    sizes = real.groupBy(*by, cluster).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_cells)
    return real.join(sizes.drop("_n"), [*by, cluster], "left_semi")


def optional_equals(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters; ``None`` means no filter, a list means membership."""
    for column, value in wanted.items():
        if value is None:
            continue
        if isinstance(value, (list, tuple, set)):
            df = df.where(F.col(column).isin(list(value)))
        else:
            df = df.where(F.col(column) == value)
    return df


def thresholds(df: DataFrame, minimums: dict[str, float], require_all: bool = True) -> DataFrame:
    """AND/OR of lower bounds; a missing value fails only its own bound."""
    cond: Column | None = None
    for column, low in minimums.items():
        term = F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")) >= F.lit(float(low)), F.lit(False))
        cond = term if cond is None else (cond & term if require_all else cond | term)
    return df if cond is None else df.where(cond)


def not_in_polygons(lon, lat, rings: list[list[tuple[float, float]]]) -> Column:
    """True where a point lies outside every ring (even-odd rule).

    The rings are a small, fixed geometry given by the caller; the test is a
    plain expression per edge, so it stays on the JVM.
    """
    x, y = geo._c(lon), geo._c(lat)
    crossings = F.lit(0)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
            if y1 == y2:
                continue
            spans = (F.lit(y1) > y) != (F.lit(y2) > y)
            at = (y - F.lit(y1)) * F.lit((x2 - x1) / (y2 - y1)) + F.lit(x1)
            crossings = crossings + F.when(spans & (x < at), 1).otherwise(0)
    return crossings % 2 == 0


def ocean_tracks(points: DataFrame, mask: DataFrame, track: str, x: str, y: str, nx: int, ny: int,
                 threshold: float = 0.8) -> DataFrame:
    """Points of tracks whose share of ocean points reaches the threshold.

    Indices outside the grid are clipped to its edge before the lookup.
    """
    cx = F.least(F.greatest(F.col(x).cast("int"), F.lit(0)), F.lit(nx - 1))
    cy = F.least(F.greatest(F.col(y).cast("int"), F.lit(0)), F.lit(ny - 1))
    land = mask.select(F.col("x").alias("_mx"), F.col("y").alias("_my"), F.col("is_land").alias("_land"))
    joined = points.withColumn("_cx", cx).withColumn("_cy", cy).join(
        land, (F.col("_cx") == F.col("_mx")) & (F.col("_cy") == F.col("_my")), "left")
    share = joined.groupBy(track).agg(F.avg(F.when(F.coalesce("_land", F.lit(False)), 0.0).otherwise(1.0)).alias("ocean_fraction"))
    return points.join(share.where(F.col("ocean_fraction") >= threshold), track, "inner")


# Months of the two seasons.
SEASON_MONTHS = {"winter": [1, 2, 3], "summer": [7, 8, 9]}


def season_of_first_point(points: DataFrame, track: str, time: str) -> DataFrame:
    """One row per track with the season of its first point (null otherwise)."""
    month = F.month(F.min(time))
    season = F.lit(None).cast("string")
    for name, months in SEASON_MONTHS.items():
        season = F.when(month.isin(months), name).otherwise(season)
    return points.groupBy(track).agg(month.alias("first_month"), season.alias("season"))


def months(df: DataFrame, time: str, wanted: list[int]) -> DataFrame:
    return df.where(F.month(time).isin(wanted))


def season_window(df: DataFrame, time: str, start: tuple[int, int], end: tuple[int, int]) -> DataFrame:
    """Month-day window; a start after the end wraps through the year end."""
    at = F.month(time) * 100 + F.dayofmonth(time)
    lo, hi = start[0] * 100 + start[1], end[0] * 100 + end[1]
    return df.where(at.between(lo, hi) if lo <= hi else (at >= lo) | (at <= hi))


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*[c for c in columns if c in df.columns])


def long_tracks(points: DataFrame, track: str, min_points: int, dropna: list[str] | None = None,
                strict: bool = False) -> DataFrame:
    """Tracks with enough points; incomplete rows are dropped after counting."""
    n = F.count(F.lit(1))
    ids = points.groupBy(track).agg(n.alias("_n")).where(F.col("_n") > min_points if strict else F.col("_n") >= min_points)
    kept = points.join(ids.select(track), track, "left_semi")
    return kept.dropna(how="any", subset=dropna) if dropna else kept


def partly_outside(points: DataFrame, track: str, inside: Column, min_share: float = 1.0) -> DataFrame:
    """Tracks whose share of inside points is below ``min_share``."""
    return points.groupBy(track).agg(F.avg(F.when(inside, 1.0).otherwise(0.0)).alias("inside_fraction")).where(
        F.col("inside_fraction") < min_share)


def clustering_input(df: DataFrame, features: list[str]) -> DataFrame:
    """Peak rows that are not at a track end and have every feature."""
    return df.where(~F.col("start_stop")).dropna(subset=features)


def crop(df: DataFrame, lon: str, lat: str, lon_range: tuple[float, float], lat_range: tuple[float, float]) -> DataFrame:
    """Re-centre longitudes to [-180, 180) and keep a box."""
    return df.withColumn(lon, geo.lon_180(lon)).where(
        F.col(lon).between(*[float(v) for v in lon_range]) & F.col(lat).between(*[float(v) for v in lat_range]))


def numeric_features(df: DataFrame, requested: list[str] | None = None, top: int = 12) -> list[str]:
    """Requested numeric columns, else the ``top`` ones by variance."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    if requested:
        found = [c for c in requested if c in numeric]
        if found:
            return found
    row = df.agg(*[F.var_samp(c).alias(c) for c in numeric]).first()
    ranked = sorted(numeric, key=lambda c: (-(row[c] if row[c] is not None else -1.0), c))
    return ranked[:top]
