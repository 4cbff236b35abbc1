"""Thermodynamic indices as Column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gyrespark.functions.geo import _c

GRAVITY = 9.81
LATENT = 7.5e5


def _zero_if_bad(value: Column) -> Column:
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def mcao_kolstad(theta_sst, theta_level, slp_hpa, level_pa: float) -> Column:
    """Cold-air-outbreak index per pascal between the surface and a level."""
    depth = _c(slp_hpa) * 100.0 - float(level_pa)
    return F.when(depth == 0, 0.0).otherwise(
        _zero_if_bad((_c(theta_sst) - _c(theta_level)) / F.nullif(depth, F.lit(0.0))))


def mcao_bracegirdle(theta_sst, theta_700, z_700) -> Column:
    """Logarithmic stability index scaled by the height of the 700 hPa level."""
    ok = (_c(z_700) != 0) & (_c(theta_sst) > 0) & (_c(theta_700) > 0)
    value = LATENT / F.nullif(_c(z_700), F.lit(0.0)) * (F.ln(_c(theta_sst)) - F.ln(_c(theta_700)))
    return F.when(ok, value).otherwise(0.0)


def george_k(t850, t700, t500, td850, td700) -> Column:
    """K index; all temperatures in Celsius."""
    return (_c(t850) - _c(t500)) + _c(td850) - (_c(t700) - _c(td700))


def potential_temperature(t_k, p_hpa) -> Column:
    return _c(t_k) * F.pow(F.lit(1000.0) / _c(p_hpa), F.lit(0.2857142857142857))


def vapour_pressure(t_c) -> Column:
    """Saturation vapour pressure in hPa (Bolton 1980)."""
    return 6.112 * F.exp(17.67 * _c(t_c) / (_c(t_c) + 243.5))


def lcl_temperature(t_c, td_c) -> Column:
    """Temperature in K at the lifting condensation level (Bolton 1980, eq. 15)."""
    td_k = _c(td_c) + 273.15
    return 1.0 / (1.0 / (td_k - 56.0) + F.ln((_c(t_c) + 273.15) / td_k) / 800.0) + 56.0


def equivalent_potential_temperature(t_c, td_c, p_hpa) -> Column:
    """Bolton (1980), eq. 43."""
    e = vapour_pressure(td_c)
    r = 0.622 * e / (_c(p_hpa) - e)
    t_k, t_l = _c(t_c) + 273.15, lcl_temperature(t_c, td_c)
    dry = t_k * F.pow(1000.0 / (_c(p_hpa) - e), F.lit(0.2854)) * F.pow(t_k / t_l, 0.28 * r)
    return dry * F.exp((3036.0 / t_l - 1.78) * r * (1.0 + 0.448 * r))


def lifted_parcel_temperature(t_c, td_c, p_hpa, target_hpa: float = 500.0, steps: int = 12) -> Column:
    """Temperature (K) of a surface parcel lifted to ``target_hpa``.

    Dry-adiabatic below the condensation level; above it the saturated
    equivalent potential temperature is conserved and solved by a constant number
    of bisections over whole columns of a batch.
    """
    theta_e = equivalent_potential_temperature(t_c, td_c, p_hpa)
    t_l = lcl_temperature(t_c, td_c)
    p_l = _c(p_hpa) * F.pow(t_l / (_c(t_c) + 273.15), F.lit(1.0 / 0.2854))
    dry = (_c(t_c) + 273.15) * F.pow(target_hpa / _c(p_hpa), F.lit(0.2854))

    # a parcel is colder than its theta-e, and its vapour pressure below the level's
    a = math.log(0.99 * target_hpa / 6.112)
    top = (17.67 * 273.15 - 29.65 * a) / (17.67 - a)
    halvings = steps * 3

    @F.pandas_udf("double")
    def saturated(te: pd.Series) -> pd.Series:
        import numpy as np

        te = te.to_numpy(dtype=float)
        lo, hi = np.full(len(te), 100.0), np.fmin(te, top)
        for _ in range(halvings):
            mid = (lo + hi) / 2.0
            e = 6.112 * np.exp(17.67 * (mid - 273.15) / (mid - 29.65))
            r = 0.622 * e / (target_hpa - e)
            est = mid * np.power(1000.0 / (target_hpa - e), 0.2854) * np.exp((3036.0 / mid - 1.78) * r * (1.0 + 0.448 * r))
            warm = est > te
            lo, hi = np.where(warm, lo, mid), np.where(warm, mid, hi)
        return pd.Series((lo + hi) / 2.0)

    moist = F.when(theta_e.isNotNull(), saturated(theta_e)).otherwise(F.lit(top))
    return F.when(p_l <= target_hpa, dry).otherwise(moist)


def lifted_index(t500_k, t2_c, td2_c, p_hpa) -> Column:
    return _c(t500_k) - lifted_parcel_temperature(t2_c, td2_c, p_hpa)


def shear_vector(alpha_d, alpha_p, strength) -> tuple[Column, Column, Column]:
    """Shear angle relative to motion in (-180, 180] and its two components."""
    raw = F.pmod(_c(alpha_d) - _c(alpha_p), F.lit(360.0))
    angle = F.when(raw > 180.0, raw - 360.0).otherwise(raw)
    return angle, _c(strength) * F.cos(F.radians(angle)), _c(strength) * F.sin(F.radians(angle))


SIN_45 = math.sin(math.radians(45.0))


def bergeron(delta_p, mean_lat, tau_hours: float) -> Column:
    """Pressure fall over ``tau_hours``, scaled to 45 degrees latitude."""
    return _c(delta_p) / float(tau_hours) * SIN_45 / F.sin(F.radians(_c(mean_lat)))
