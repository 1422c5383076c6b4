"""Map projections and tile arithmetic, as Columns and as numpy twins."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: GRS80 and the transverse Mercator constants (published).
A, FLATTENING, SCALE, FALSE_EASTING = 6378137.0, 1 / 298.257222101, 0.9996, 500000.0
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_E = 2 * math.sqrt(_N) / (1 + _N)


def central_meridian(zone: int) -> float:
    return -183.0 + 6 * zone


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180.0) / 6.0) + 1).cast("int")


def epsg_code(zone: Column, lat: Column, europe: Column) -> Column:
    """ETRS89 (258xx) in Europe's zones 28 to 38 north, else WGS84 north 326xx or south 327xx."""
    return F.when(europe & zone.between(28, 38) & (lat >= 0), 25800 + zone).when(lat >= 0, 32600 + zone).otherwise(32700 + zone)


def to_utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """(easting, northing) by Krüger's series."""
    phi, lam = F.radians(lat), F.radians(lon - central_meridian(zone))
    t = F.sinh(F.atanh(F.sin(phi)) - _E * F.atanh(_E * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return FALSE_EASTING + SCALE * _RADIUS * x, SCALE * _RADIUS * y


def from_utm(x: Column, y: Column, zone: int) -> tuple[Column, Column]:
    """(lon, lat)."""
    xi, eta = y / (SCALE * _RADIUS), (x - FALSE_EASTING) / (SCALE * _RADIUS)
    u, v = xi, eta
    for j, b in enumerate(_BETA, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return central_meridian(zone) + F.degrees(F.atan2(F.sinh(v), F.cos(u))), F.degrees(phi)


def great_circle_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on a sphere of mean radius; within 0.5 % of the ellipsoid."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * 6371008.8 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def mercator_tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Web Mercator tile (x, y) that holds a point."""
    n = float(1 << zoom)
    x = F.floor((lon + 180.0) / 360.0 * n)
    y = F.floor((1 - F.log(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / math.pi) / 2 * n)
    top = int(n) - 1
    clamp = lambda v: F.greatest(F.lit(0), F.least(F.lit(top), v)).cast("int")
    return clamp(x), clamp(y)


def tile_resolution_m(lat: Column, zoom: int) -> Column:
    """Ground metres of one pixel of a 256-pixel tile."""
    return F.cos(F.radians(lat)) * (2 * math.pi * A / 256 / (1 << zoom))


def hilbert_id(x: np.ndarray, y: np.ndarray, zoom: int) -> np.ndarray:
    """Position in the tile archive's order: all smaller zooms, then the Hilbert curve of this one."""
    x, y = np.array(x, np.int64), np.array(y, np.int64)
    d = np.zeros_like(x)
    half = (1 << zoom) >> 1
    while half:
        rx, ry = (x & half) > 0, (y & half) > 0
        d += half * half * ((3 * rx) ^ ry)
        flip = ~ry
        mirror = flip & rx
        x, y = np.where(mirror, half - 1 - (x & (half - 1)), x & (half - 1)), np.where(mirror, half - 1 - (y & (half - 1)), y & (half - 1))
        x, y = np.where(flip, y, x), np.where(flip, x, y)
        half >>= 1
    return d + ((1 << (2 * zoom)) - 1) // 3


def hilbert_column(x: Column, y: Column, zoom: int) -> Column:
    """``hilbert_id`` as an expression: one step for each bit."""
    state = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    steps = F.array(*[F.lit(1 << k).cast("long") for k in range(zoom - 1, -1, -1)])

    def step(s, half):
        rx, ry = s["x"].bitwiseAND(half) > 0, s["y"].bitwiseAND(half) > 0
        low = half - 1
        lx, ly = s["x"].bitwiseAND(low), s["y"].bitwiseAND(low)
        mx, my = F.when(rx & ~ry, low - lx).otherwise(lx), F.when(rx & ~ry, low - ly).otherwise(ly)
        quadrant = F.when(rx, F.when(ry, 2).otherwise(3)).otherwise(F.when(ry, 1).otherwise(0))
        return F.struct(F.when(ry, mx).otherwise(my).alias("x"), F.when(ry, my).otherwise(mx).alias("y"), (s["d"] + half * half * quadrant).alias("d"))

    return F.aggregate(steps, state, step)["d"] + F.lit(((1 << (2 * zoom)) - 1) // 3)
