"""Where the sun is: closed forms as Columns, and a precise numpy ephemeris.

The closed forms (Spencer's series) stay in generated code; ``solar_position`` follows
the published low-order series of the Astronomical Almanac with refraction, good to about
0.01 degrees between 1950 and 2050.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Published coefficients (Spencer 1971): constant, then cos and sin of 1, 2, 3 times the day angle.
DECLINATION = (0.006918, (-0.399912, 0.070257), (-0.006758, 0.000907), (-0.002697, 0.00148))
EQUATION_OF_TIME = (0.000075, (0.001868, -0.032077), (-0.014615, -0.040849))


def _series(angle: Column, coefficients: tuple) -> Column:
    constant, *pairs = coefficients
    out = F.lit(constant)
    for k, (c, s) in enumerate(pairs, 1):
        out = out + c * F.cos(angle * k) + s * F.sin(angle * k)
    return out


def day_angle(day_of_year: Column) -> Column:
    return F.lit(2 * math.pi) * (day_of_year - 1) / F.lit(365.0)


def declination(day_of_year: Column) -> Column:
    """Radians."""
    return _series(day_angle(day_of_year), DECLINATION)


def declination_of(day_of_year: int) -> float:
    b = 2 * math.pi * (day_of_year - 1) / 365.0
    constant, *pairs = DECLINATION
    return constant + sum(c * math.cos(k * b) + s * math.sin(k * b) for k, (c, s) in enumerate(pairs, 1))


def sun_at(ts: Column, lat: float, lon: float) -> tuple[Column, Column]:
    """(azimuth, elevation) in degrees at a UTC timestamp."""
    day = F.dayofyear(ts).cast("double")
    hour = F.hour(ts) + F.minute(ts) / F.lit(60.0) + F.floor(F.second(ts)) / F.lit(3600.0)
    delta = declination(day)
    minutes = 229.18 * _series(day_angle(day), EQUATION_OF_TIME)
    h = F.radians((hour + lon / 15.0 + minutes / 60.0 - 12.0) * 15.0)
    phi = math.radians(lat)
    elevation = F.degrees(F.asin(math.sin(phi) * F.sin(delta) + math.cos(phi) * F.cos(delta) * F.cos(h)))
    azimuth = F.pmod(F.lit(180.0) + F.degrees(F.atan2(F.sin(h), F.cos(h) * math.sin(phi) - F.tan(delta) * math.cos(phi))), F.lit(360.0))
    return azimuth, elevation


def solar_position(unix_seconds: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(azimuth, apparent elevation) in degrees."""
    days = np.asarray(unix_seconds, float) / 86400.0 + 2440587.5 - 2451545.0
    century = (days + 69.0 / 86400.0) / 36525.0
    mean_long = np.radians((280.46646 + century * (36000.76983 + 0.0003032 * century)) % 360)
    anomaly = np.radians(357.52911 + century * (35999.05029 - 0.0001537 * century))
    eccentricity = 0.016708634 - century * (0.000042037 + 0.0000001267 * century)
    centre = np.radians(np.sin(anomaly) * (1.914602 - century * (0.004817 + 0.000014 * century)) + np.sin(2 * anomaly) * (0.019993 - 0.000101 * century) + 0.000289 * np.sin(3 * anomaly))
    node = np.radians(125.04 - 1934.136 * century)
    apparent = mean_long + centre - np.radians(0.00569 + 0.00478 * np.sin(node))
    tilt = np.radians(23 + (26 + (21.448 - century * (46.815 + century * (0.00059 - 0.001813 * century))) / 60) / 60 + 0.00256 * np.cos(node))
    delta = np.arcsin(np.sin(tilt) * np.sin(apparent))
    y = np.tan(tilt / 2) ** 2
    time_min = 4 * np.degrees(y * np.sin(2 * mean_long) - 2 * eccentricity * np.sin(anomaly) + 4 * eccentricity * y * np.sin(anomaly) * np.cos(2 * mean_long) - 0.5 * y * y * np.sin(4 * mean_long) - 1.25 * eccentricity**2 * np.sin(2 * anomaly))
    hour = np.radians(((np.asarray(unix_seconds, float) % 86400) / 60 + time_min + 4 * lon) / 4 - 180)
    phi = np.radians(lat)
    true = np.degrees(np.arcsin(np.clip(np.sin(phi) * np.sin(delta) + np.cos(phi) * np.cos(delta) * np.cos(hour), -1, 1)))
    azimuth = (180 + np.degrees(np.arctan2(np.sin(hour), np.cos(hour) * np.sin(phi) - np.tan(delta) * np.cos(phi)))) % 360
    bend = 1.02 / (60 * np.tan(np.radians(true + 10.3 / (true + 5.11)))) * (1010 / 1010) * (283 / 285)
    return azimuth, true + np.where(true > -0.83, bend, 0.0)


@F.pandas_udf(T.StructType([T.StructField("azimuth", T.DoubleType()), T.StructField("elevation", T.DoubleType())]))
def solar_position_udf(ts: pd.Series, lat: pd.Series, lon: pd.Series) -> pd.DataFrame:
    seconds = ts.astype("datetime64[ns]").astype("int64").to_numpy() / 1e9
    azimuth, elevation = solar_position(seconds, lat.to_numpy(), lon.to_numpy())
    return pd.DataFrame({"azimuth": azimuth, "elevation": elevation})
