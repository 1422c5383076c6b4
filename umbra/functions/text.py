"""Strings, times and small formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lat_lon(text: Column) -> tuple[Column, Column]:
    """'lat,lon' as two doubles; null unless both parse and lie on Earth."""
    parts = F.split(text, ",")
    lat, lon = F.expr("try_cast(null as double)"), None
    lat = F.when(F.size(parts) == 2, F.trim(F.get(parts, F.lit(0)))).try_cast("double")
    lon = F.when(F.size(parts) == 2, F.trim(F.get(parts, F.lit(1)))).try_cast("double")
    ok = lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(ok, lat), F.when(ok, lon)


def slug(text: Column) -> Column:
    """Lower case, runs of other characters as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def bytes_text(n: Column) -> Column:
    """1536 -> '1.5 KB'."""
    out = F.format_string("%d B", n.cast("long"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        size = float(1024**power)
        out = F.when(n >= size, F.format_string(f"%.1f {unit}", n / size)).otherwise(out)
    return out


def duration_text(seconds: Column) -> Column:
    """3725 -> '1 h 02 m'."""
    s = F.floor(seconds).cast("long")
    return (
        F.when(s >= 3600, F.format_string("%d h %02d m", F.floor(s / 3600), F.floor(s / 60) % 60))
        .when(s >= 60, F.format_string("%d m %02d s", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%d s", s))
    )


def ladder_date(day: Column, year: int) -> Column:
    """The same month and day in another year; 29 February borrows the 28th."""
    leap = (F.month(day) == 2) & (F.dayofmonth(day) == 29)
    return F.make_date(F.lit(year), F.month(day), F.when(leap, 28).otherwise(F.dayofmonth(day)))


def resolve_instant(local: Column, zone: str) -> Column:
    """City-clock time to UTC."""
    return F.to_utc_timestamp(local, zone)


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)
