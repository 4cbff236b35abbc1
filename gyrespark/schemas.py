"""Canonical table schemas and the dialect registry of the input datasets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T


_TYPES = {"INT": T.IntegerType(), "LONG": T.LongType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(),
          "BOOLEAN": T.BooleanType(), "TIMESTAMP_NTZ": T.TimestampNTZType()}


def _schema(text: str) -> T.StructType:
    """Schema from ``name TYPE`` pairs; needs no running session."""
    fields = [part.split() for part in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


FIELD = _schema("time TIMESTAMP_NTZ, level INT, y INT, x INT, lat DOUBLE, lon DOUBLE, "
                "u DOUBLE, v DOUBLE, wspd DOUBLE")
NODES = _schema("time TIMESTAMP_NTZ, lon_idx INT, lat_idx INT, lon DOUBLE, lat DOUBLE, "
                "rad DOUBLE, crit DOUBLE, wspd DOUBLE")
CELLS = _schema("time TIMESTAMP_NTZ, y INT, x INT, crit DOUBLE, cluster INT")
TRACKS = _schema("track_id LONG, t INT, time TIMESTAMP_NTZ, x INT, y INT, lat DOUBLE, lon DOUBLE, "
                 "rad DOUBLE, crit DOUBLE, track_len DOUBLE")
LINKED_TRACKS = _schema("track_id LONG, i INT, j INT, lon DOUBLE, lat DOUBLE, rad DOUBLE, r2d DOUBLE, "
                        "wspd DOUBLE, time TIMESTAMP_NTZ")
CATALOGUE = _schema("TID LONG, ISOTIME TIMESTAMP_NTZ, LON DOUBLE, LAT DOUBLE, MSLP DOUBLE, WS DOUBLE, "
                    "Short_Label STRING, Adjusted_Label STRING, Tropical_Flag INT, "
                    "Transition_Zone INT, Track_Info STRING, LPSAREA DOUBLE")
MANUAL_TRACKS = _schema("time TIMESTAMP_NTZ, pxc_ind INT, pyc_ind INT, px1_ind INT, py1_ind INT, "
                        "px2_ind INT, py2_ind INT, px3_ind INT, py3_ind INT, px4_ind INT, "
                        "py4_ind INT, mean_radius DOUBLE")
STORM_CATALOGUE = _schema("Id STRING, Name STRING, datetime TIMESTAMP_NTZ, status STRING, "
                          "lat STRING, lon STRING")
MATCHES = _schema("id_ref LONG, id_own LONG, temp LONG, dist DOUBLE")
RUN_LOG = _schema("timestamp STRING, eps INT, size_filter INT, extr_type STRING, search_range DOUBLE, "
                  "mintime INT, maxgap INT, prioritize STRING, year INT, combo_dir STRING, "
                  "postfix STRING, params_parquet STRING, tracks_txt STRING, csv_tracks_dir STRING, "
                  "final_dir STRING, n_missing_params INT, status STRING, error STRING")
LAND_MASK = _schema("y INT, x INT, is_land BOOLEAN")

# Names of the twelve parameters computed for each node.
NODE_PARAMETERS = [
    "SLP_diff_cent_95", "U10_mean", "U850_mean", "U500_U850_frac", "U500_minus_U850",
    "PV_850_mean", "T2_minus_T850_mean", "T850_disp", "pbl_trop_frac", "w_850",
    "RH_850", "RAIN_HOURLY_sum",
]


@dataclass(frozen=True)
class Dialect:
    """Naming, spacing and time step of one input dataset."""

    name: str
    dist_m: float
    dt_step: int
    u: str
    v: str
    level_dim: str
    x_dim: str
    y_dim: str
    time_dim: str

    @property
    def rename_map(self) -> dict[str, str]:
        return {self.u: "u", self.v: "v", self.level_dim: "level",
                self.x_dim: "x", self.y_dim: "y", self.time_dim: "time"}


# Grid spacing, time step and variable names per dataset.
DIALECTS = {
    d.name: d for d in [
        Dialect("HiRes", 13897.18, 10800, "ue", "ve", "interp_level", "west_east", "south_north", "XTIME"),
        Dialect("ERA5", 27750.0, 3600, "u", "v", "pressure_level", "longitude", "latitude", "valid_time"),
        Dialect("GPN", 6000.0, 3600, "ua", "va", "bottom_top", "west_east", "south_north", "XTIME"),
        Dialect("SMP", 6000.0, 3600, "ua", "va", "bottom_top", "west_east", "south_north", "Time"),
        Dialect("LoRes", 77824.23, 10800, "ue", "ve", "interp_level", "west_east", "south_north", "XTIME"),
        Dialect("GLORYS", 13875.0, 86400, "uo", "vo", "depth", "longitude", "latitude", "time"),
        Dialect("ALT", 13875.0, 86400, "ugos", "vgos", "depth", "longitude", "latitude", "time"),
    ]
}


def dialect(name: str, override: dict | None = None) -> Dialect:
    """Look up a dialect; ``override`` (for example from a JSON file) wins."""
    base = DIALECTS[name]
    if not override:
        return base
    values = {**base.__dict__, **{k: v for k, v in override.items() if k in base.__dict__}}
    return Dialect(**values)


def resolve_column(columns: list[str], wanted: str | list[str]) -> str | None:
    """Fuzzy column lookup: exact name, then case-insensitive, then substring."""
    names = [wanted] if isinstance(wanted, str) else list(wanted)
    for name in names:
        if name in columns:
            return name
    lowered = {c.lower(): c for c in columns}
    for name in names:
        if name.lower() in lowered:
            return lowered[name.lower()]
    for name in names:
        for column in columns:
            if name.lower() in column.lower() or column.lower() in name.lower():
                return column
    return None


def to_canonical_field(df: DataFrame, data: Dialect) -> DataFrame:
    """Rename the dataset's own column names to the canonical field names."""
    present = {old: new for old, new in data.rename_map.items() if old in df.columns}
    return df.withColumnsRenamed(present)
