"""From classified points to surface, terrain and land-cover cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from umbra.functions.angles import BUILDING, GROUND, VEGETATION
from umbra.functions.grid import Grid, locate

#: Point classes (fixed by the file standard): ground, vegetation, building, noise.
CLASS_GROUND, CLASS_VEGETATION, CLASS_BUILDING, CLASS_NOISE = 2, (3, 4, 5), 6, (7, 12, 18)
#: A roof this little below the top of a cell still makes it a building.
ROOF_TOLERANCE = 1.0


def clean_points(points: DataFrame) -> DataFrame:
    """Without noise, withheld and overlap points; synthetic ones stay."""
    return points.where(~F.col("cls").isin(*CLASS_NOISE) & ~F.col("withheld") & ~F.col("overlap"))


def bin_points(points: DataFrame, grid: Grid) -> DataFrame:
    """row, col, dsm, ground, building_top, vegetation_top, n_points: one pass, one shuffle with partial aggregation."""
    first = F.col("ret") == 1
    top = lambda when: F.max(F.when(when, F.col("z").cast("float")))
    return (
        locate(clean_points(points), grid).groupBy("row", "col").agg(
            top(first).alias("dsm"),
            F.avg(F.when(F.col("cls") == CLASS_GROUND, F.col("z"))).cast("float").alias("ground"),
            top(first & (F.col("cls") == CLASS_BUILDING)).alias("building_top"),
            top(first & F.col("cls").isin(*CLASS_VEGETATION)).alias("vegetation_top"),
            F.count("*").alias("n_points"),
        )
    )


def label(dsm: Column, building_top: Column, vegetation_top: Column) -> Column:
    """Building if a roof reaches the top (within the tolerance), else vegetation if it is the top."""
    return (
        F.when(building_top >= dsm - F.lit(ROOF_TOLERANCE).cast("float"), BUILDING)
        .when(vegetation_top >= dsm, VEGETATION).otherwise(GROUND).cast("smallint")
    )


def finish_cells(binned: DataFrame, terrain: DataFrame) -> DataFrame:
    """Cells of ``terrain`` (row, col, dtm without holes): surfaces filled from it and never below it."""
    return terrain.join(binned, ["row", "col"], "left").select(
        "row", "col",
        F.greatest(F.coalesce("dsm", "dtm"), F.col("dtm")).alias("dsm"), "dtm",
        F.when(F.col("dsm").isNull(), F.lit(GROUND).cast("smallint")).otherwise(label(F.col("dsm"), F.col("building_top"), F.col("vegetation_top"))).alias("landcover"),
    )


def nearest_in_quadrants(plane: np.ndarray, rows: np.ndarray, cols: np.ndarray, reach: int):
    """For each of four quadrants: value and squared distance of the known cell nearest to each hole (infinite: none).

    Running minima along the rows say where the next known cell lies on either side; then
    all holes look one row further at a time, until no row could hold a nearer one.  Of
    equal distances the cell in the nearer row counts.
    """
    size, known = plane.shape[1], ~np.isnan(plane)
    at = np.arange(size)
    right = np.minimum.accumulate(np.where(known, at, 4 * size)[:, ::-1], axis=1)[:, ::-1]
    left = np.maximum.accumulate(np.where(known, at, -4 * size), axis=1)
    for side, shift, down, first in ((right, 0, -1, 1), (right, 1, 1, 0), (left, 0, 1, 1), (left, -1, -1, 0)):
        best, value = np.full(len(rows), np.inf), np.full(len(rows), np.nan)
        for k in range(first, reach + 1):
            open_ = np.flatnonzero(best > k * k)
            if not len(open_):
                break
            r, c = rows[open_] + down * k, cols[open_]
            there = side[r, np.clip(c + shift, 0, size - 1)]
            far2 = k * k + (there - c) ** 2.0
            nearer = (far2 < best[open_]) & (far2 <= reach * reach)
            best[open_[nearer]] = far2[nearer]
            value[open_[nearer]] = plane[r[nearer], there[nearer]]
        yield value, best


def fill_terrain(binned: DataFrame, grid: Grid, search: float = 200.0, tile: int = 256) -> DataFrame:
    """(row, col, dtm) of the whole grid; holes get the inverse-distance mean of the nearest
    ground in each quadrant within ``search`` metres.  Raises where none is in reach.

    Tiles are padded with the search distance, so every tile is filled by itself.
    """
    reach = int(np.ceil(search / grid.res))
    known = binned.where("ground is not null").select("row", "col", F.col("ground").alias("z"))
    span = lambda c: F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile))
    placed = known.withColumn("tr", F.explode(span("row"))).withColumn("tc", F.explode(span("col")))
    tiles = F.lit((grid.rows - 1) // tile), F.lit((grid.cols - 1) // tile)
    placed = placed.where(F.col("tr").between(0, tiles[0]) & F.col("tc").between(0, tiles[1]))
    wanted = grid.cells(binned.sparkSession).select(F.floor(F.col("row") / tile).alias("tr"), F.floor(F.col("col") / tile).alias("tc")).distinct()

    def fill(key, wanted_: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(key[0]), int(key[1])
        r0, c0 = tr * tile, tc * tile
        height, width = min(tile, grid.rows - r0), min(tile, grid.cols - c0)
        if not len(wanted_):
            return pd.DataFrame({"row": [], "col": [], "dtm": []})
        plane = np.full((height + 2 * reach, width + 2 * reach), np.nan)
        plane[points["row"].to_numpy() - r0 + reach, points["col"].to_numpy() - c0 + reach] = points["z"].to_numpy(float)
        z = plane[reach:reach + height, reach:reach + width]
        rows, cols = (x + reach for x in np.nonzero(np.isnan(z)))
        total, weight = np.zeros(len(rows)), np.zeros(len(rows))
        for found, far2 in nearest_in_quadrants(plane, rows, cols, reach):
            near = np.isfinite(far2)
            w = 1 / np.sqrt(far2[near])
            total[near] += w * found[near]
            weight[near] += w
        if not weight.all():
            k = int(np.argmin(weight))
            raise ValueError(f"no ground within {search} m of cell ({rows[k] - reach + r0}, {cols[k] - reach + c0})")
        z[rows - reach, cols - reach] = total / weight
        at = np.indices(z.shape)
        return pd.DataFrame({"row": (at[0] + r0).ravel(), "col": (at[1] + c0).ravel(), "dtm": z.ravel()})

    return wanted.groupBy("tr", "tc").cogroup(placed.groupBy("tr", "tc")).applyInPandas(fill, "row int, col int, dtm float")


def canopy_height(cells: DataFrame) -> DataFrame:
    return cells.withColumn("chm", (F.col("dsm") - F.col("dtm")).cast("float"))


def felled(cells: DataFrame) -> DataFrame:
    """The surface with every tree gone."""
    return cells.withColumn("felled", F.when(F.col("landcover") == VEGETATION, F.col("dtm")).otherwise(F.col("dsm")))


def height_datum(cells: DataFrame) -> DataFrame:
    """One row: the median terrain height to whole hundreds (halves to even)."""
    return cells.agg((F.rint(F.median("dtm") / 100) * 100).alias("datum"))


def footprint_override(cells: DataFrame, footprints: DataFrame, margin: float = 2.0) -> DataFrame:
    """Vegetation as high as its footprint's median roof (less a margin) is roof.

    ``footprints``: (row, col, footprint).  A footprint without roof cells changes nothing.
    """
    tall = canopy_height(cells).join(footprints, ["row", "col"], "left")
    roofs = tall.where((F.col("landcover") == BUILDING) & F.col("footprint").isNotNull()).groupBy("footprint").agg(F.median("chm").alias("roof"))
    flip = (F.col("landcover") == VEGETATION) & (F.col("chm") >= F.col("roof") - margin)
    return tall.join(roofs, "footprint", "left").withColumn("landcover", F.when(flip, F.lit(BUILDING).cast("smallint")).otherwise(F.col("landcover"))).drop("roof")


def hillshade(cells: DataFrame, value: str, res: float, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Light on a surface, 0 to 1; central differences inside, one-sided at the edges."""
    import math

    def gradient(line: str, along: str) -> Column:
        w = W.partitionBy(line).orderBy(along)
        before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        return F.when(before.isNotNull() & after.isNotNull(), (after - before) / (2 * res)).when(after.isNotNull(), (after - here) / res).when(before.isNotNull(), (here - before) / res).otherwise(F.lit(0.0))

    zenith, bearing = math.radians(90 - altitude), math.radians(azimuth)
    lit = cells.withColumn("gy", gradient("col", "row")).withColumn("gx", gradient("row", "col"))
    # Rows grow southward; the light comes from (sin, cos) of its bearing in (east, north).
    dot = math.cos(zenith) - math.sin(zenith) * (F.col("gx") * math.sin(bearing) - F.col("gy") * math.cos(bearing))
    return lit.withColumn("light", F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / F.sqrt(1 + F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))))
