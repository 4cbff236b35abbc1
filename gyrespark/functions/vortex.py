"""Vortex criteria from velocity-gradient columns.

All two-dimensional criteria and the symmetric 3x3 eigenvalue are closed-form
Column expressions and stay inside whole-stage codegen.  Only the eigenvector
of a general 3x3 tensor needs numpy, batched over Arrow.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gyrespark.functions.geo import _c

TENSOR_3D = ["ux", "uy", "uz", "vx", "vy", "vz", "wx", "wy", "wz"]


def vorticity_2d(uy, vx) -> Column:
    return _c(vx) - _c(uy)


def vorticity_3d(g: dict) -> tuple[Column, Column, Column]:
    """(omega_x, omega_y, omega_z) from the nine gradients, keyed as TENSOR_3D."""
    c = {k: _c(v) for k, v in g.items()}
    return c["wy"] - c["vz"], c["uz"] - c["wx"], c["vx"] - c["uy"]


def strain_rotation_2d(ux, uy, vx, vy) -> dict[str, Column]:
    return {"s11": _c(ux), "s12": 0.5 * (_c(uy) + _c(vx)), "s22": _c(vy),
            "a12": 0.5 * (_c(uy) - _c(vx))}


def strain_rotation_3d(g: dict) -> dict[str, Column]:
    c = {k: _c(v) for k, v in g.items()}
    return {
        "s11": c["ux"], "s22": c["vy"], "s33": c["wz"],
        "s12": 0.5 * (c["uy"] + c["vx"]), "s13": 0.5 * (c["uz"] + c["wx"]),
        "s23": 0.5 * (c["vz"] + c["wy"]),
        "a12": 0.5 * (c["uy"] - c["vx"]), "a13": 0.5 * (c["uz"] - c["wx"]),
        "a23": 0.5 * (c["vz"] - c["wy"]),
    }


def q_2d(ux, uy, vx, vy) -> Column:
    """Half the excess of squared rotation over squared strain."""
    p = strain_rotation_2d(ux, uy, vx, vy)
    strain = p["s11"] * p["s11"] + p["s22"] * p["s22"] + 2.0 * p["s12"] * p["s12"]
    return 0.5 * (2.0 * p["a12"] * p["a12"] - strain)


def q_3d(g: dict) -> Column:
    p = strain_rotation_3d(g)
    strain = (p["s11"] * p["s11"] + p["s22"] * p["s22"] + p["s33"] * p["s33"]
              + 2.0 * (p["s12"] * p["s12"] + p["s13"] * p["s13"] + p["s23"] * p["s23"]))
    rotation = 2.0 * (p["a12"] * p["a12"] + p["a13"] * p["a13"] + p["a23"] * p["a23"])
    return 0.5 * (rotation - strain)


def det_2d(ux, uy, vx, vy) -> Column:
    return _c(ux) * _c(vy) - _c(vx) * _c(uy)


def det_3d(g: dict) -> Column:
    c = {k: _c(v) for k, v in g.items()}
    return (c["ux"] * (c["vy"] * c["wz"] - c["vz"] * c["wy"])
            - c["uy"] * (c["vx"] * c["wz"] - c["vz"] * c["wx"])
            + c["uz"] * (c["vx"] * c["wy"] - c["vy"] * c["wx"]))


def delta_from(q: Column, det: Column) -> Column:
    third, half = q / 3.0, 0.5 * det
    return third * third * third + half * half


def delta_2d(ux, uy, vx, vy) -> Column:
    return delta_from(q_2d(ux, uy, vx, vy), det_2d(ux, uy, vx, vy))


def delta_3d(g: dict) -> Column:
    return delta_from(q_3d(g), det_3d(g))


def lambda2_2d(ux, uy, vx, vy) -> Column:
    """Minus the larger eigenvalue of S^2 + A^2, which is symmetric 2x2."""
    p = strain_rotation_2d(ux, uy, vx, vy)
    m11 = p["s11"] * p["s11"] + p["s12"] * p["s12"] - p["a12"] * p["a12"]
    m22 = p["s22"] * p["s22"] + p["s12"] * p["s12"] - p["a12"] * p["a12"]
    m12 = p["s12"] * (p["s11"] + p["s22"])
    half_gap = F.sqrt(F.pow((m11 - m22) / 2, 2) + m12 * m12)
    return -((m11 + m22) / 2 + half_gap)


def lambda2_3d(g: dict) -> Column:
    """Minus the middle eigenvalue of S^2 + A^2 (trigonometric closed form)."""
    p = strain_rotation_3d(g)
    s = [[p["s11"], p["s12"], p["s13"]], [p["s12"], p["s22"], p["s23"]], [p["s13"], p["s23"], p["s33"]]]
    zero = F.lit(0.0)
    a = [[zero, p["a12"], p["a13"]], [-p["a12"], zero, p["a23"]], [-p["a13"], -p["a23"], zero]]

    def entry(i: int, j: int) -> Column:
        return sum((s[i][k] * s[k][j] + a[i][k] * a[k][j] for k in range(1, 3)),
                   s[i][0] * s[0][j] + a[i][0] * a[0][j])

    m11, m22, m33 = entry(0, 0), entry(1, 1), entry(2, 2)
    m12, m13, m23 = entry(0, 1), entry(0, 2), entry(1, 2)
    mean = (m11 + m22 + m33) / 3.0
    d1, d2, d3 = m11 - mean, m22 - mean, m33 - mean
    off = m12 * m12 + m13 * m13 + m23 * m23
    scale = F.sqrt((d1 * d1 + d2 * d2 + d3 * d3 + 2.0 * off) / 6.0)
    half_det = (d1 * (d2 * d3 - m23 * m23) - m12 * (m12 * d3 - m23 * m13)
                + m13 * (m12 * m23 - d2 * m13)) / (2.0 * scale * scale * scale)
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), half_det))) / 3.0
    largest = mean + 2.0 * scale * F.cos(angle)
    smallest = mean + 2.0 * scale * F.cos(angle + 2.0 * math.pi / 3.0)
    middle = 3.0 * mean - largest - smallest
    return F.when(scale > 0, -middle).otherwise(-mean)


def swirling_strength_2d(ux, uy, vx, vy) -> Column:
    """Imaginary part of the complex eigenvalue pair; null where there is none."""
    trace = _c(ux) + _c(vy)
    disc = 4.0 * (_c(ux) * _c(vy) - _c(uy) * _c(vx)) - trace * trace
    return F.when(disc > 0, F.sqrt(disc) / 2.0)


def rortex_2d(ux, uy, vx, vy) -> Column:
    """Signed rigid rotation (positive cyclonic), null without swirl.

    The denominator is guarded by 1e-16 and vorticity within 1e-8 of zero is
    treated as no rotation.
    """
    omega = vorticity_2d(uy, vx)
    swirl = swirling_strength_2d(ux, uy, vx, vy)
    term = 4.0 * swirl * swirl / (omega * omega + 1e-16)
    value = (1.0 - F.sqrt(F.greatest(1.0 - term, F.lit(0.0)))) * omega
    return F.when(F.abs(omega) > 1e-8, F.when(swirl.isNotNull(), value))


def rortex_2d_raw(swirl, omega) -> Column:
    """Unguarded form from swirling strength and vorticity; null outside its domain."""
    ratio = 1.0 - 4.0 * _c(swirl) * _c(swirl) / (_c(omega) * _c(omega))
    return F.when((_c(omega) != 0) & (ratio >= 0), (1.0 - F.sqrt(ratio)) * _c(omega))


SWIRL_3D = T.StructType([T.StructField(n, T.DoubleType()) for n in ("swirl", "axis_x", "axis_y", "axis_z")])


@F.pandas_udf(SWIRL_3D)
def _swirl_axis(ux: pd.Series, uy: pd.Series, uz: pd.Series, vx: pd.Series, vy: pd.Series,
                vz: pd.Series, wx: pd.Series, wy: pd.Series, wz: pd.Series) -> pd.DataFrame:
    import numpy as np

    n = len(ux)
    tensor = np.stack([s.to_numpy(dtype=float, na_value=np.nan)
                       for s in (ux, uy, uz, vx, vy, vz, wx, wy, wz)], axis=1).reshape(n, 3, 3)
    out = np.full((n, 4), np.nan)
    ok = np.isfinite(tensor).all(axis=(1, 2))
    if ok.any():
        values, vectors = np.linalg.eig(tensor[ok])
        swirl = np.abs(values.imag).max(axis=1)
        # the axis belongs to the eigenvalue with the smallest imaginary part
        real = np.abs(values.imag).argmin(axis=1)
        axis = np.real(np.take_along_axis(vectors, real[:, None, None], axis=2))[:, :, 0]
        rotating = swirl > 0
        out[ok] = np.where(rotating[:, None], np.column_stack([swirl, axis]), np.nan)
    return pd.DataFrame(out, columns=["swirl", "axis_x", "axis_y", "axis_z"]).astype(object).where(
        ~np.isnan(out), None)


def swirling_strength_3d(g: dict) -> Column:
    """Struct (swirl, axis_x, axis_y, axis_z); null fields where nothing swirls."""
    return _swirl_axis(*[_c(g[k]) for k in TENSOR_3D])


def rortex_3d(df: DataFrame, g: dict, prefix: str = "r3d") -> DataFrame:
    """Add vorticity, axis and 3-D rortex; the axis is turned along vorticity."""
    ox, oy, oz = vorticity_3d(g)
    out = df.withColumn("_swirl", swirling_strength_3d(g))
    along = (ox * F.col("_swirl.axis_x") + oy * F.col("_swirl.axis_y") + oz * F.col("_swirl.axis_z"))
    side = F.when(along < 0, -1.0).otherwise(1.0)
    term = 4.0 * F.col("_swirl.swirl") * F.col("_swirl.swirl") / (along * along + 1e-16)
    return (
        out.withColumn(prefix, (1.0 - F.sqrt(F.greatest(1.0 - term, F.lit(0.0)))) * F.abs(along))
        .withColumns({f"{prefix}_axis_{k}": side * F.col(f"_swirl.axis_{k}") for k in "xyz"})
        .withColumn(f"{prefix}_swirl", F.col("_swirl.swirl"))
        .drop("_swirl")
    )
