"""Angles, their quantised forms, and reading a skyline at an azimuth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the data model.
GROUND, VEGETATION, BUILDING, NO_BLOCKER = 0, 1, 2, 255
MAX_ANGLE, TOP = 90.0, 255
SECTORS = 64


def quantise_angle(angle: Column) -> Column:
    """0..255 for 0..90 degrees, halves to even."""
    return F.greatest(F.lit(0), F.least(F.lit(TOP), F.rint(angle * TOP / MAX_ANGLE))).cast("smallint")


def dequantise_angle(q: Column) -> Column:
    return (q.cast("float") * F.lit(MAX_ANGLE / TOP).cast("float")).cast("float")


def quantise_fraction(f: Column) -> Column:
    return F.rint(f * TOP).cast("smallint")


def slope_angle(slope: Column) -> Column:
    """Degrees above the horizontal; never below it."""
    return F.greatest(F.degrees(F.atan(slope)), F.lit(0.0))


def sector_below(azimuth: Column, sectors: int = SECTORS) -> Column:
    return (F.floor(F.pmod(azimuth, F.lit(360.0)) / F.lit(360.0 / sectors)) % sectors).cast("int")


def sector_share(azimuth: Column, sectors: int = SECTORS) -> Column:
    """How far the azimuth lies from the sector below towards the next, 0 to 1."""
    position = F.pmod(azimuth, F.lit(360.0)) / F.lit(360.0 / sectors)
    return position - F.floor(position)


def skyline_at(profile: Column, azimuth: Column, sectors: int = SECTORS, scale: float | None = None) -> Column:
    """Interpolated angle of a profile at an azimuth: degrees, or codes times ``scale``.

    Only the two sectors beside the azimuth are read.
    """
    low = sector_below(azimuth, sectors)
    share = sector_share(azimuth, sectors)
    at = (lambda k: F.get(profile, k)) if scale is None else (lambda k: F.get(profile, k).cast("double") * scale)
    return (1 - share) * at(low) + share * at((low + 1) % sectors)


def contributing_sector(profile: Column, azimuth: Column, sectors: int = SECTORS) -> Column:
    """Of the two sectors beside an azimuth the higher one; equal: the lower index side."""
    low = sector_below(azimuth, sectors)
    high = (low + 1) % sectors
    return F.when(F.get(profile, low) >= F.get(profile, high), low).otherwise(high)


def tone(lightness: Column, edges: tuple[float, ...] = (0.45, 0.62, 0.78)) -> Column:
    """1 + how many edges lie at or below the value."""
    out = F.lit(1)
    for edge in edges:
        out = out + F.when(lightness >= edge, 1).otherwise(0)
    return out
