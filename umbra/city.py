"""What a city is: its configuration, checked when read."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import re
from dataclasses import dataclass
from pathlib import Path
from zoneinfo import ZoneInfo

from umbra.functions.grid import Grid

_LINE = re.compile(r"^([a-z_]+):\s*(.*?)\s*(?:#.*)?$")
#: A value alone on the line under its key: no list item and no key of its own.
_UNDER = re.compile(r"^\s+(?!-\s)([^\s#:]+(?::[^\s#:]+)?)\s*(?:#.*)?$")
#: Fixed by the input: what city files call the fields.
NAMES = {"resolution_m": "resolution", "horizon_sectors": "sectors", "horizon_max_distance_m": "reach"}
PROTECTED = ("id", "bbox", "area")


@dataclass(frozen=True)
class City:
    id: str
    name: str
    timezone: str
    utm_zone: int
    bbox: tuple[float, float, float, float]  #: metres, x_min y_min x_max y_max
    resolution: float = 1.0
    sectors: int = 64
    reach: float = 500.0
    area: str | None = None

    def __post_init__(self):
        x0, y0, x1, y1 = self.bbox
        if not (x0 < x1 and y0 < y1):
            raise ValueError(f"{self.id}: bbox is not in order")
        ZoneInfo(self.timezone)
        if self.resolution <= 0 or self.sectors < 4 or self.reach <= 0:
            raise ValueError(f"{self.id}: resolution, sectors and reach must be positive")

    @property
    def grid(self) -> Grid:
        return Grid.covering(*self.bbox, self.resolution)

    @property
    def digest(self) -> str:
        return hashlib.sha256(json.dumps(dataclasses.asdict(self), sort_keys=True).encode()).hexdigest()


def scalar(text: str):
    if text.startswith("["):
        return tuple(float(v) for v in text.strip("[]").split(","))
    if text in ("", "null", "~"):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text.strip("'\"")


def zone_of(crs: str) -> int:
    """The UTM zone, north, of an EPSG code: ETRS89 (25828 to 25838) or WGS84 (32601 to 32660)."""
    m = re.fullmatch(r"(?:EPSG:)?(\d+)", str(crs).strip("'\""), re.IGNORECASE)
    code = int(m[1]) if m else 0
    for base, zones in ((25800, range(28, 39)), (32600, range(1, 61))):
        if code - base in zones:
            return code - base
    raise ValueError(f"{crs} is not a UTM zone of the northern half")


def read_city(path: str | Path) -> City:
    """From the flat part of a YAML file: top-level scalars and one-line lists; what it doesn't know it leaves.

    A value may stand alone on the line under its key; ``crs`` gives the zone.
    """
    known = {f.name for f in dataclasses.fields(City)}
    found, crs, open_key = {}, None, None
    for line in Path(path).read_text().splitlines():
        m = _LINE.match(line)
        key, text = (m[1], m[2]) if m else (open_key, under[1]) if open_key and (under := _UNDER.match(line)) else (None, None)
        open_key = key if m and not m[2] else open_key if not line.strip() or line.lstrip().startswith("#") else None
        if key == "crs" and text:
            crs = text
        elif key and (name := NAMES.get(key, key)) in known:
            found[name] = scalar(text)
    if crs is not None:
        found.setdefault("utm_zone", zone_of(crs))
    missing = [f.name for f in dataclasses.fields(City) if f.default is dataclasses.MISSING and f.name not in found]
    if missing:
        raise ValueError(f"{path}: {', '.join(missing)} missing")
    return City(**found)


def edit_city(path: str | Path, key: str, value) -> City:
    """Changes one top-level scalar, comments kept; the result is checked before it is written."""
    if key in PROTECTED:
        raise ValueError(f"{key} can't be edited")
    path = Path(path)
    lines, n = [], 0
    for line in path.read_text().splitlines():
        m = _LINE.match(line)
        if m and m[1] == key:
            comment = line[line.index("#"):] if "#" in line else ""
            line, n = f"{key}: {value}" + (f"  {comment}" if comment else ""), n + 1
        lines.append(line)
    if not n:
        lines.append(f"{key}: {value}")
    trial = path.with_suffix(".trial")
    trial.write_text("\n".join(lines) + "\n")
    try:
        city = read_city(trial)
    except Exception:
        trial.unlink()
        raise
    trial.replace(path)
    return city
