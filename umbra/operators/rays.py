"""The cells that a ray crosses, as a small table of offsets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

#: Boundaries this close, relatively, are met at a corner; there the row steps first.
CORNER = 1e-9


def ray_cells(azimuth: float, reach: float, res: float) -> list[tuple[int, int, float, float]]:
    """(d_row, d_col, entry, exit) of the cells along an azimuth, nearest first, without the start.

    Both families of grid lines are merged by distance; each crossing moves one cell.
    """
    east, south = math.sin(math.radians(azimuth)), -math.cos(math.radians(azimuth))

    def crossings(speed: float) -> list[float]:
        if speed == 0.0:
            return []
        step = res / abs(speed)
        n = max(0, math.ceil(reach / step - 0.5) + 2)
        out, at = [], 0.5 * step
        for _ in range(n):
            out.append(at)
            at += step
        return out

    rows, cols = crossings(south), crossings(east)
    down, right = (1 if south > 0 else -1), (1 if east > 0 else -1)
    i = j = 0
    entered: list[tuple[int, int, float]] = []
    while True:
        row_at = rows[i] if i < len(rows) else math.inf
        col_at = cols[j] if j < len(cols) else math.inf
        by_row = row_at <= col_at or math.isclose(row_at, col_at, rel_tol=CORNER)
        entry = row_at if by_row else col_at
        if entry >= reach:
            break
        i, j = i + by_row, j + (not by_row)
        entered.append((down * i, right * j, entry))
    exits = [e for *_, e in entered[1:]] + [reach]
    return [(r, c, e, x) for (r, c, e), x in zip(entered, exits, strict=True)]


def offset_rows(sectors: int, reach: float, res: float, digits: int | None = None) -> list[tuple[int, int, int, int, float, float]]:
    """(sector, ord, d_row, d_col, entry, exit) for every sector."""
    cut = (lambda v: v) if digits is None else (lambda v: round(v, digits))
    return [(s, k, r, c, cut(e), cut(x)) for s in range(sectors) for k, (r, c, e, x) in enumerate(ray_cells(s * 360.0 / sectors, reach, res))]


OFFSETS = "sector int, ord int, d_row int, d_col int, entry double, exit double"


def offsets(spark: SparkSession, sectors: int, reach: float, res: float, digits: int | None = None) -> DataFrame:
    """The offsets as a table: about 1.3 * reach / res rows a sector, whatever the city's size."""
    return spark.createDataFrame(offset_rows(sectors, reach, res, digits), OFFSETS)


@udtf(returnType="ord: int, d_row: int, d_col: int, entry: double, exit: double")
class RayCells:
    """SQL: SELECT * FROM ray_cells(azimuth, reach, res)."""

    def eval(self, azimuth: float, reach: float, res: float):
        for k, cell in enumerate(ray_cells(float(azimuth), float(reach), float(res))):
            yield (k, *cell)
