"""Skylines: how high the sky begins in every sector of every cell, and what begins it.

``relational`` states it as joins and aggregates (the reference, for small reach);
``sweep`` is the production form: tiles with a halo as wide as the reach, each swept by
vectorised numpy in one task.  Results do not depend on the tile size.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.functions.angles import BUILDING, MAX_ANGLE, NO_BLOCKER, TOP, VEGETATION, slope_angle
from umbra.operators.rays import OFFSETS, offset_rows, ray_cells

EYE = 1.6
MOST_PARTITIONS = 100_000


def along_rays(cells: DataFrame, rays: list[tuple], fields: str, columns: list[str]) -> DataFrame:
    """Each observer cell with the cells its rays cross: an equi-join on shifted keys.

    ``rays`` holds rows of ``fields``; it is a constant of the plan (its size depends on the
    reach alone), exploded beside every observer.
    """
    names = [f.split()[0] for f in fields.split(", ")]
    kind = "array<struct<" + ",".join(f.replace(" ", ":") for f in fields.split(", ")) + ">>"
    table = F.from_json(F.lit(json.dumps([dict(zip(names, r, strict=True)) for r in rays])), kind)
    observers = cells.select("row", "col", (F.col("dtm") + F.lit(EYE)).cast("double").alias("eye"))
    targets = cells.select(F.col("row").alias("t_row"), F.col("col").alias("t_col"), *columns)
    spread = observers.select("*", F.explode(table).alias("ray")).select("row", "col", "eye", "ray.*")
    spread = spread.withColumn("t_row", F.col("row") + F.col("d_row")).withColumn("t_col", F.col("col") + F.col("d_col"))
    return spread.join(targets, ["t_row", "t_col"])


def relational(cells: DataFrame, sectors: int, reach: float, res: float, digits: int | None = None) -> DataFrame:
    """row, col, sector, slope, blocker, slope_felled: of equal slopes the nearest names the blocker."""
    surface = F.when(F.col("landcover") == VEGETATION, F.col("dtm")).otherwise(F.col("dsm"))
    seen = along_rays(cells.withColumn("felled", surface), offset_rows(sectors, reach, res, digits), OFFSETS, ["dsm", "felled", "landcover"])
    slope = (F.col("dsm") - F.col("eye")) / F.col("entry")
    return (
        seen.withColumn("slope", slope).withColumn("bare", (F.col("felled") - F.col("eye")) / F.col("entry"))
        .groupBy("row", "col", "sector")
        .agg(F.max("slope").alias("slope"), F.max_by("landcover", F.struct(F.col("slope"), -F.col("ord"))).alias("kind"), F.max("bare").alias("slope_felled"))
        .select("row", "col", "sector", "slope", F.when(F.col("slope") > 0, F.col("kind")).otherwise(F.lit(NO_BLOCKER)).cast("smallint").alias("blocker"), "slope_felled")
    )


def angles(skyline: DataFrame) -> DataFrame:
    return skyline.select("row", "col", "sector", slope_angle(F.col("slope")).alias("angle"), "blocker", slope_angle(F.col("slope_felled")).alias("angle_felled"))


def bracket(cells: DataFrame, azimuth: float, elevation: float, reach: float, res: float, digits: int | None = None) -> DataFrame:
    """(row, col, most, least): shade if obstacles stand where the ray enters their cell, and where it leaves it."""
    cut = (lambda v: v) if digits is None else (lambda v: round(v, digits))
    rows = [(k, r, c, cut(e), cut(x)) for k, (r, c, e, x) in enumerate(ray_cells(azimuth, reach, res))]
    rise = math.tan(math.radians(elevation))
    above = lambda d: F.bool_or(F.col("dsm") > F.col("eye") + F.lit(rise) * F.col(d))
    return along_rays(cells, rows, "ord int, d_row int, d_col int, entry double, exit double", ["dsm"]).groupBy("row", "col").agg(above("entry").alias("most"), above("exit").alias("least"))


def first_blocker(cells: DataFrame, azimuth: float, elevation: float, reach: float, res: float, digits: int | None = None) -> DataFrame:
    """(row, col, blocker): the land cover of the first cell that reaches the elevation, null if none.

    The walk ends at the first cell that is not there, so what stands beyond a gap doesn't count.
    """
    cut = (lambda v: v) if digits is None else (lambda v: round(v, digits))
    rows = [(k, r, c, cut(e)) for k, (r, c, e, _) in enumerate(ray_cells(azimuth, reach, res))]
    seen = along_rays(cells, rows, "ord int, d_row int, d_col int, entry double", ["dsm", "landcover"])
    blocks = F.degrees(F.atan2(F.col("dsm") - F.col("eye"), F.col("entry"))) >= elevation
    # In order a cell stands at its own number as long as none is missing before it.
    met = F.array_sort(F.collect_list(F.struct("ord", blocks.alias("blocks"), "landcover")))
    hits = F.filter(met, lambda x, i: (x["ord"] == i) & x["blocks"])
    walk = seen.groupBy("row", "col").agg(F.get(hits, F.lit(0)).alias("hit"))
    return cells.select("row", "col").join(walk, ["row", "col"], "left").select("row", "col", F.col("hit.landcover").alias("blocker"))


def march_blocker(cells: DataFrame, skylines: DataFrame, azimuth: float, elevation: float, sectors: int, reach: float, res: float, digits: int | None = None) -> DataFrame:
    """(row, col, blocker): what the walk towards the sun meets first, a crown or a building; null if neither.

    Where that walk names nothing, the one along the sector that lifts the skyline there
    answers: of the two beside the sun the higher, equal: the lower number.  ``skylines``: row, col, q.
    """
    named = lambda at, name: first_blocker(cells, at, elevation, reach, res, digits).select("row", "col", F.when(F.col("blocker").isin(BUILDING, VEGETATION), F.col("blocker")).alias(name))
    width = 360.0 / sectors
    low = int((azimuth % 360.0) / width) % sectors
    high = (low + 1) % sectors
    raised = skylines.select("row", "col", (F.get("q", F.lit(low)) >= F.get("q", F.lit(high))).alias("lower"))
    met = named(azimuth, "own").join(raised, ["row", "col"], "left").join(named(low * width, "below"), ["row", "col"]).join(named(high * width, "above"), ["row", "col"])
    beside = F.when(F.col("lower"), F.col("below")).when(~F.col("lower"), F.col("above"))
    return met.select("row", "col", F.coalesce("own", beside).alias("blocker"))


def sweep(cells: DataFrame, sectors: int, reach: float, res: float, tile: int = 256, datum: float = 0.0) -> DataFrame:
    """row, col, q, q_felled, blocker: arrays over the sectors, quantised, for every covered cell.

    ``cells``: row, col, dsm, dtm, landcover, and optionally covered (boolean).  Each cell
    goes to the tiles whose halo holds it (one shuffle, at most 9 copies where the tile is
    wider than the reach), and a tile without covered cells isn't swept.
    """
    pad = math.ceil(reach / res)
    rays = offset_rows(sectors, reach, res)
    covered = F.col("covered") if "covered" in cells.columns else F.lit(True)
    span = lambda c: F.sequence(F.floor((F.col(c) - pad) / tile), F.floor((F.col(c) + pad) / tile))
    spread = (
        cells.select("row", "col", (F.col("dsm") - datum).cast("float").alias("dsm"), (F.col("dtm") - datum).cast("float").alias("dtm"), "landcover", F.coalesce(covered, F.lit(False)).alias("covered"))
        .withColumn("tr", F.explode(span("row"))).withColumn("tc", F.explode(span("col")))
    )
    wanted = cells.where(covered).select(F.floor(F.col("row") / tile).alias("tr"), F.floor(F.col("col") / tile).alias("tc")).distinct()

    def kernel(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        r0, c0 = key[0].as_py() * tile, key[1].as_py() * tile
        size = tile + 2 * pad
        rows, cols = block["row"].to_numpy() - r0 + pad, block["col"].to_numpy() - c0 + pad
        plane = lambda name, kind, none: _placed(size, rows, cols, block[name].to_numpy(), kind, none)
        dsm, dtm = plane("dsm", np.float32, -np.inf), plane("dtm", np.float32, np.nan)
        cover, lit = plane("landcover", np.uint8, NO_BLOCKER), plane("covered", bool, False)
        wooded = bool((cover == VEGETATION).any())  # without trees both skylines are one
        bare = np.where(cover == VEGETATION, np.where(np.isnan(dtm), -np.inf, dtm), dsm)
        inner = (slice(pad, pad + tile),) * 2
        eye = dtm[inner] + np.float32(EYE)
        out = np.empty((3, sectors, tile, tile), np.int16)
        by_sector: list[list[tuple]] = [[] for _ in range(sectors)]
        for s, _, dr, dc, entry, _ in rays:
            by_sector[s].append(((slice(pad + dr, pad + dr + tile), slice(pad + dc, pad + dc + tile)), np.float32(entry)))
        slope, better = np.empty((tile, tile), np.float32), np.empty((tile, tile), bool)
        for s in range(sectors):
            best = np.full((tile, tile), -np.inf, np.float32)
            kind = np.full((tile, tile), NO_BLOCKER, np.uint8)
            best_bare = np.full((tile, tile), -np.inf, np.float32) if wooded else best
            for at, entry in by_sector[s]:
                np.subtract(dsm[at], eye, out=slope)
                np.divide(slope, entry, out=slope)
                np.greater(slope, best, out=better)
                np.copyto(best, slope, where=better)
                np.copyto(kind, cover[at], where=better)
                if wooded:
                    np.subtract(bare[at], eye, out=slope)
                    np.divide(slope, entry, out=slope)
                    np.fmax(best_bare, slope, out=best_bare)
            kind[~(best > 0)] = NO_BLOCKER
            for plane_, values in ((0, best), (1, best_bare)):
                degrees = np.maximum(np.degrees(np.arctan(values)), 0)
                out[plane_, s] = np.clip(np.rint(degrees * (TOP / MAX_ANGLE)), 0, TOP)
            out[2, s] = kind
        at = np.nonzero(lit[inner])
        ends = pa.array(np.arange(len(at[0]) + 1, dtype=np.int32) * sectors)
        arrays = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(a[:, at[0], at[1]].T).ravel())) for a in out]
        return pa.Table.from_arrays([pa.array((at[0] + r0).astype(np.int32)), pa.array((at[1] + c0).astype(np.int32)), *arrays], names=["row", "col", "q", "q_felled", "blocker"])

    # A tile is much work on little data: a partition for about every tile, which is not merged by size.
    parts = min(2 * max(1, wanted.count()), MOST_PARTITIONS)
    dealt = spread.join(wanted, ["tr", "tc"], "left_semi").repartition(parts, "tr", "tc")
    return dealt.groupBy("tr", "tc").applyInArrow(kernel, "row int, col int, q array<smallint>, q_felled array<smallint>, blocker array<smallint>")


def _placed(size: int, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, kind, none) -> np.ndarray:
    out = np.full((size, size), none, kind)
    inside = (rows >= 0) & (rows < size) & (cols >= 0) & (cols < size)
    out[rows[inside], cols[inside]] = values[inside]
    return out
