"""Names, labels and time strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gyrespark.functions.geo import _c

# Time layouts accepted by the tolerant parser, tried in order.
TIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd_HH:mm:ss",
                "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH", "yyyyMMddHH", "yyyy-MM-dd"]


def parse_time(text, formats: list[str] | None = None) -> Column:
    """First layout that fits wins; unparsable text becomes null."""
    tries = [F.try_to_timestamp(_c(text), F.lit(f)) for f in (formats or TIME_FORMATS)]
    return F.coalesce(*tries).cast("timestamp_ntz")


def parse_underscore_time(text) -> Column:
    """Byte-string times of model output, ``2010-01-31_06:00:00``."""
    return parse_time(text, ["yyyy-MM-dd_HH:mm:ss"])


def start_date_of_name(name) -> Column:
    """Date embedded in a file name (``..._track_2010-01-31T06.csv``)."""
    found = F.regexp_extract(_c(name), r"(\d{4}-\d{2}-\d{2})", 1)
    return F.to_date(F.when(found != "", found))


def pad_name_prefix(name, width: int = 8) -> Column:
    """Zero-pad the digits in front of the first underscore."""
    digits = F.regexp_extract(_c(name), r"^(\d+)(_.*)$", 1)
    rest = F.regexp_extract(_c(name), r"^(\d+)(_.*)$", 2)
    padded = F.concat(F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0")), rest)
    return F.when(digits != "", padded).otherwise(_c(name))


def last_number(name) -> Column:
    """Last group of digits in a name, as an id."""
    return F.try_element_at(F.regexp_extract_all(_c(name), F.lit(r"(\d+)"), F.lit(1)), F.lit(-1)).cast("long")


def combo_label(eps, size_filter, extr_type, maxgap, mintime, prioritize) -> Column:
    base = F.format_string("eps%02d_sf%02d_%s_mg%dh_mt%dh", _c(eps).cast("int"), _c(size_filter).cast("int"),
                           _c(extr_type), _c(maxgap).cast("int"), _c(mintime).cast("int"))
    return F.concat(base, F.when(_c(prioritize), "_prioritize").otherwise(""))


def tracking_postfix(search_range, mintime, maxgap, prioritize) -> Column:
    """``_range_1_5_18h_3h[_prioritize_r2d]`` from the linking parameters."""
    return F.concat(
        F.lit("_range_"), F.replace(_c(search_range).cast("string"), F.lit("."), F.lit("_")),
        F.lit("_"), _c(mintime).cast("int").cast("string"), F.lit("h_"),
        _c(maxgap).cast("int").cast("string"), F.lit("h"),
        F.when(_c(prioritize), "_prioritize_r2d").otherwise(""))


def parse_postfix(postfix) -> dict[str, Column]:
    pattern = r"^_range_(\d+(?:_\d+)?)_(\d+)h_(\d+)h(_prioritize_r2d)?$"
    part = [F.regexp_extract(_c(postfix), pattern, i) for i in range(5)]
    ok = part[0] != ""
    return {
        "search_range": F.when(ok, F.replace(part[1], F.lit("_"), F.lit("."))).cast("double"),
        "mintime": F.when(ok, part[2]).cast("int"),
        "maxgap": F.when(ok, part[3]).cast("int"),
        "prioritize": F.when(ok, part[4] != ""),
    }


def decode_cf_time(value, unit: str, origin: str) -> Column:
    """CF times (``hours since 1900-01-01``) to timestamps."""
    seconds = {"seconds": 1.0, "minutes": 60.0, "hours": 3600.0, "days": 86400.0}[unit]
    micros = F.round(_c(value) * (seconds * 1e6), 0).cast("long")
    start = F.lit(origin).cast("timestamp")
    return F.timestamp_micros(F.unix_micros(start) + micros).cast("timestamp_ntz")


def text_is_true(value) -> Column:
    return F.coalesce(F.lower(F.trim(_c(value).cast("string"))).isin("true", "1"), F.lit(False))


def micros(time) -> Column:
    """Microseconds since the epoch of a zone-less (UTC) timestamp."""
    return F.unix_micros(_c(time).cast("timestamp"))


def hours_between(later, earlier) -> Column:
    return (micros(later) - micros(earlier)) / 3.6e9
