"""Named aggregates: a name picks the Column builder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gyrespark.functions.geo import _c


def finite(value) -> Column:
    """Null for null, NaN and infinities."""
    v = _c(value).cast("double")
    return F.when(F.abs(v) < float("inf"), v)


def _pct(q: float) -> Callable[[Column], Column]:
    return lambda v: F.percentile(v, F.lit(q))


AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "median": _pct(0.5),
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "count": F.count,
    "std": F.stddev_samp,
    "std_pop": F.stddev_pop,
    "p5": _pct(0.05),
    "p25": _pct(0.25),
    "p75": _pct(0.75),
    "p90": _pct(0.9),
    "p95": _pct(0.95),
    "delta": lambda v: F.percentile(v, F.lit(0.95)) - F.percentile(v, F.lit(0.05)),
    # robust bounds: the 5 % and 95 % points stand in for minimum and maximum
    "robust_min": _pct(0.05),
    "robust_max": _pct(0.95),
}


def named_aggregate(name: str, value) -> Column:
    """Aggregate ``value`` by name, ignoring non-finite input."""
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate {name!r}; choose from {sorted(AGGREGATES)}")
    return AGGREGATES[name](finite(value))


def aggregate_list(config: dict[str, tuple[str, str]]) -> list[Column]:
    """Aggregates from ``{output: (column, aggregate name)}``."""
    return [named_aggregate(agg, column).alias(out) for out, (column, agg) in config.items()]


def circular_mean_lon(lon) -> Column:
    r = F.radians(_c(lon))
    return F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r))))


def vector_mean(u, v) -> dict[str, Column]:
    """Mean components, direction in [0, 360) and magnitude of the mean vector."""
    both = finite(u).isNotNull() & finite(v).isNotNull()
    return vector_direction(F.avg(F.when(both, _c(u))), F.avg(F.when(both, _c(v))))


def vector_direction(u, v) -> dict[str, Column]:
    """Components, direction and magnitude of a mean vector."""
    mu, mv = _c(u), _c(v)
    return {"mean_u": mu, "mean_v": mv,
            "mean_angle": F.pmod(F.degrees(F.atan2(mv, mu)), F.lit(360.0)),
            "mean_magnitude": F.sqrt(mu * mu + mv * mv)}


def label_set(label, sep: str = "|") -> Column:
    """Sorted distinct labels joined to one string."""
    return F.array_join(F.array_sort(F.collect_set(_c(label))), sep)


def ratio(num, den) -> Column:
    """num/den, zero when the denominator is zero."""
    d = _c(den).cast("double")
    return F.when(d > 0, _c(num).cast("double") / d).otherwise(0.0)
