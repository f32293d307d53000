"""Great-circle distance and distance-based scores, as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Distances beyond which the reward is zero; three defaults are in use.
SELECTOR_MAX_KM, REWARD_MAX_KM, METRIC_MAX_KM = 18050.0, 2000.0, 20000.0
REPORT_SCALE_KM = 18050.0
THRESHOLDS_KM = (2500, 750, 200, 25, 1)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres; null if any coordinate is null."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def reward_geoscore(km: Column, max_km: float = REWARD_MAX_KM) -> Column:
    """exp(-10 d / max), zero from ``max_km`` on and for no distance."""
    return F.when(km.isNull() | (km >= max_km), 0.0).otherwise(F.exp(-10.0 * km / max_km))


def report_geoscore(km: Column) -> Column:
    """5000 exp(-10 d / 18050), without a cut-off."""
    return 5000.0 * F.exp(-10.0 * km / REPORT_SCALE_KM)


def valid_coordinates(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def ellipsoidal_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, steps: int = 30) -> Column:
    """Distance on the WGS84 ellipsoid by Vincenty's inverse formula, in kilometres.

    ``steps`` turns of the iteration reach a tenth of a millimetre but for
    points almost opposite to each other, whose distance is null then, as it
    is for null coordinates. The turns run over Arrow batches, each value of a
    turn once; nested expressions would compute them anew wherever they are used.
    """
    @F.pandas_udf("double")
    def km(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            return pd.Series(_vincenty_km(*(np.radians(x.to_numpy(float)) for x in (lat1, lon1, lat2, lon2)), steps))

    return F.nanvl(km(lat1, lon1, lat2, lon2), F.lit(None).cast("double"))


def _vincenty_km(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray, steps: int) -> np.ndarray:
    """Of radians; not a number where the turns do not settle."""
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    u1, u2 = (np.arctan((1 - f) * np.tan(x)) for x in (lat1, lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    wide = lon2 - lon1

    def parts(lam: np.ndarray) -> tuple[np.ndarray, ...]:
        sin_lam, cos_lam = np.sin(lam), np.cos(lam)
        sin = np.sqrt((c2 * sin_lam) ** 2 + (c1 * s2 - s1 * c2 * cos_lam) ** 2)
        cos = s1 * s2 + c1 * c2 * cos_lam
        sa = np.where(sin > 0, c1 * c2 * sin_lam / sin, 0.0)
        c2a = 1 - sa * sa
        mid = np.where(c2a > 1e-15, cos - 2 * s1 * s2 / c2a, 0.0)
        return sin, cos, np.arctan2(sin, cos), sa, c2a, mid

    lam, moved = wide, np.ones_like(wide)
    for _ in range(steps):
        sin, cos, angle, sa, c2a, mid = parts(lam)
        c = f / 16 * c2a * (4 + f * (4 - 3 * c2a))
        new = wide + (1 - c) * f * sa * (angle + c * sin * (mid + c * cos * (2 * mid * mid - 1)))
        lam, moved = new, np.abs(new - lam)
    sin, cos, angle, _, c2a, mid = parts(lam)
    v = c2a * (a * a - b * b) / (b * b)
    big_a = 1 + v / 16384 * (4096 + v * (-768 + v * (320 - 175 * v)))
    big_b = v / 1024 * (256 + v * (-128 + v * (74 - 47 * v)))
    m2 = 2 * mid * mid
    bend = big_b * sin * (mid + big_b / 4 * (cos * (m2 - 1) - big_b / 6 * mid * (4 * sin * sin - 3) * (2 * m2 - 3)))
    return np.where(moved < 1e-11, b * big_a * (angle - bend) / 1000, np.nan)
