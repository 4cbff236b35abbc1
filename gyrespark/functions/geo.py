"""Distances, bearings and grid/coordinate conversions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
KM_PER_DEG = 111.0


def _c(value) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.col(value)
    return F.lit(float(value))


def haversine_km(lon1, lat1, lon2, lat2, clip: bool = True) -> Column:
    """Great-circle distance on a sphere of radius 6371 km; null where a coordinate is."""
    la1, la2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    half_lat = (la2 - la1) / 2
    half_lon = (F.radians(_c(lon2)) - F.radians(_c(lon1))) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(la1) * F.cos(la2) * F.pow(F.sin(half_lon), 2)
    if clip:
        a = F.when(a > 1.0, 1.0).when(a < 0.0, 0.0).otherwise(a)  # unlike least and greatest, null stays null
    return 2.0 * EARTH_RADIUS_KM * F.asin(F.sqrt(a))


def euclid(x1, y1, x2, y2) -> Column:
    dx, dy = _c(x1) - _c(x2), _c(y1) - _c(y2)
    return F.sqrt(dx * dx + dy * dy)


def bearing_deg(lon1, lat1, lon2, lat2) -> Column:
    """Initial bearing from the first to the second point, in [0, 360)."""
    la1, la2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlon = F.radians(_c(lon2)) - F.radians(_c(lon1))
    east = F.sin(dlon) * F.cos(la2)
    north = F.cos(la1) * F.sin(la2) - F.sin(la1) * F.cos(la2) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def destination(lon, lat, distance_km, bearing) -> tuple[Column, Column]:
    """Point reached from (lon, lat); returns (lon in [0, 360), lat)."""
    la, lo, b = F.radians(_c(lat)), F.radians(_c(lon)), F.radians(_c(bearing))
    d = _c(distance_km) / EARTH_RADIUS_KM
    la2 = F.asin(F.sin(la) * F.cos(d) + F.cos(la) * F.sin(d) * F.cos(b))
    lo2 = lo + F.atan2(F.sin(b) * F.sin(d) * F.cos(la), F.cos(d) - F.sin(la) * F.sin(la2))
    return F.pmod(F.degrees(lo2), F.lit(360.0)), F.degrees(la2)


def search_radius_km(speed_ms, dt_step, base_radius_km, hw_scale: float = 1.5) -> Column:
    """Expected displacement plus the scaled radius, never below half of it."""
    scaled = _c(base_radius_km) * hw_scale
    return F.greatest(_c(speed_ms) * _c(dt_step) / 1000.0 + scaled, scaled / 2)


def lon_180(lon) -> Column:
    return F.pmod(_c(lon) + 180.0, F.lit(360.0)) - 180.0


def lon_360(lon) -> Column:
    return F.pmod(_c(lon), F.lit(360.0))


def lon_diff(a, b) -> Column:
    """Signed shortest longitude difference in [-180, 180)."""
    return F.pmod(_c(a) - _c(b) + 180.0, F.lit(360.0)) - 180.0


def grid_step_m(lat, step_deg: float) -> tuple[Column, Column]:
    """(dx, dy) in metres of a regular cell at a latitude."""
    dy = F.lit(EARTH_RADIUS_KM * 1000.0) * F.radians(F.lit(float(step_deg)))
    return dy * F.cos(F.radians(_c(lat))), dy


def cell_scale_km(lat, dlon_deg, dlat_deg, km_per_deg: float = 111.0) -> Column:
    """Geometric-mean cell size: keeps the area of a radius given in cells."""
    dx = F.lit(km_per_deg) * _c(dlon_deg) * F.cos(F.radians(_c(lat)))
    dy = F.lit(km_per_deg) * _c(dlat_deg)
    return F.sqrt(F.greatest(dx * dy, F.lit(0.0)))


def radius_cells_to_km(rad_cells, lat, dlon_deg, dlat_deg) -> Column:
    return _c(rad_cells) * cell_scale_km(lat, dlon_deg, dlat_deg)


def radius_cells_to_km_fixed(rad_cells, dist_m: float) -> Column:
    return _c(rad_cells) * (float(dist_m) / 1000.0)


def index_to_coord(index, first: float, step: float, size: int) -> Column:
    """Fractional grid index to coordinate on a regular axis, clipped to it."""
    clipped = F.least(F.greatest(_c(index), F.lit(0.0)), F.lit(float(size - 1)))
    return F.lit(float(first)) + clipped * F.lit(float(step))


def nearest_index(position) -> Column:
    """Nearest whole index, the lower one half-way (up to rounding noise)."""
    return F.ceil(F.round(_c(position), 6) - 0.5).cast("int")


def coord_to_index(coord, first: float, step: float, size: int) -> Column:
    """Nearest index on a regular axis (arithmetic, no search)."""
    raw = nearest_index((_c(coord) - F.lit(float(first))) / F.lit(float(step)))
    return F.least(F.greatest(raw, F.lit(0)), F.lit(size - 1))


def grid_to_latlon(x, y, spacing_km: float = 6.0, origin_lat: float = 0.0,
                   origin_lon: float = 0.0) -> tuple[Column, Column]:
    """Affine index-to-degree mapping of a Cartesian grid."""
    lat = F.lit(float(origin_lat)) + _c(y) * spacing_km / KM_PER_DEG
    lon = F.lit(float(origin_lon)) + _c(x) * spacing_km / (
        F.lit(KM_PER_DEG) * F.cos(F.radians(F.lit(float(origin_lat)))))
    return lat, lon


def lon_in_range(lon, lo: float, hi: float) -> Column:
    """Longitude window that may wrap through the date line."""
    if lo <= hi:
        return _c(lon).between(float(lo), float(hi))
    return (_c(lon) >= float(lo)) | (_c(lon) <= float(hi))


def in_box(lon, lat, lon_min, lon_max, lat_min, lat_max) -> Column:
    return lon_in_range(lon, lon_min, lon_max) & _c(lat).between(float(lat_min), float(lat_max))


def in_ellipse(x, y, cx, cy, a, b, theta) -> Column:
    """Inside (or on) an ellipse rotated by ``theta`` radians."""
    xt, yt = _c(x) - _c(cx), _c(y) - _c(cy)
    cos, sin = F.cos(_c(theta)), F.sin(_c(theta))
    xr, yr = xt * cos + yt * sin, yt * cos - xt * sin
    return F.pow(xr / _c(a), 2) + F.pow(yr / _c(b), 2) <= 1.0


def effective_radius(x1, y1, x2, y2, x3, y3) -> Column:
    """Mean of the semi-axes given two major-axis ends and a minor-axis end."""
    major = euclid(x1, y1, x2, y2) / 2
    minor = euclid((_c(x1) + _c(x2)) / 2, (_c(y1) + _c(y2)) / 2, x3, y3)
    return (major + minor) / 2


def ellipse_from_points(cx, cy, x1, y1, x2, y2, x3, y3) -> dict[str, Column]:
    """Ellipse of a hand-drawn vortex: axes, eccentricity and orientation.

    The longer of the two half-axes becomes ``semi_major`` (at least 3 cells,
    the other at least 2); swapping the axes turns the orientation by 90°.
    """
    r1, r2, r3 = euclid(x1, y1, cx, cy), euclid(x2, y2, cx, cy), euclid(x3, y3, cx, cy)
    mx, my = _c(x2) - _c(x1), _c(y2) - _c(y1)
    length = F.sqrt(mx * mx + my * my)
    px, py = _c(x3) - _c(cx), _c(y3) - _c(cy)
    along = length > 0
    a0 = F.greatest(r1, r2)
    b0 = F.when(along, F.abs((py * mx - px * my) / length)).otherwise(r3)
    angle = F.when(along, F.atan2(my, mx)).otherwise(F.atan2(py, px) + F.pi() / 2)
    swap = b0 > a0
    a = F.greatest(F.when(swap, b0).otherwise(a0), F.lit(3.0))
    b = F.greatest(F.when(swap, a0).otherwise(b0), F.lit(2.0))
    theta = F.when(swap, angle + F.pi() / 2).otherwise(angle)
    return {
        "semi_major_axis": a,
        "semi_minor_axis": b,
        "eccentricity": F.sqrt(1 - F.pow(b / a, 2)),
        "orientation_rad": theta,
        "orientation_deg": F.degrees(theta),
    }


def parse_coordinate(text) -> Column:
    """"25.4N" / "71.2W" to signed degrees."""
    value = F.regexp_extract(_c(text), r"^\s*([0-9.]+)\s*[NSEWnsew]\s*$", 1)
    side = F.upper(F.regexp_extract(_c(text), r"([NSEWnsew])\s*$", 1))
    number = F.when(value != "", value).cast("double")
    return F.when(side.isin("S", "W"), -number).otherwise(number)


def wind_speed(u, v) -> Column:
    return F.sqrt(_c(u) * _c(u) + _c(v) * _c(v))
