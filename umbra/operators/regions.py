"""Connected regions of cells, and what is decided by their shape."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from umbra.functions.angles import BUILDING, VEGETATION
from umbra.operators.store import cut

#: Fixed thresholds of the canopy and clutter rules.
CANOPY_HEIGHT, SIEVE, CROWN_ROUGHNESS, LINE_LENGTH = 2.5, 8, 0.20, 8
OPENING, PROTRUSION, BASE_HEIGHT = 5, 3.0, 2.0
SLAB_LOW, SLAB_HIGH, SLAB_ROUGHNESS, SLAB_GROUND = 1.0, 3.0, 0.20, 0.75
NEAR, DENSE = 4.0, 60.0


def neighbours(cells: DataFrame, columns: list[str], prefix: str = "n_") -> DataFrame:
    """(row, col) of each of the 8 cells around every cell, with that cell's columns."""
    around = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0)])
    spread = cells.withColumn("_d", F.explode(around))
    return spread.select((F.col("row") + F.col("_d.r")).alias("row"), (F.col("col") + F.col("_d.c")).alias("col"), *[F.col(c).alias(prefix + c) for c in columns])


TILE = 512


def components(cells: DataFrame, value: str | None = None, tile: int = TILE) -> DataFrame:
    """Adds ``region`` to (row, col[, value]): 8-connected, within equal values; the least cell number names it.

    Every tile is labelled by one vectorised kernel; cells at tile borders then meet their
    neighbours beyond, and only those pairs of labels are joined into classes.
    """
    number = F.col("row").cast("long") * F.lit(1 << 31) + F.col("col").cast("long")
    level = F.xxhash64(value) if value else F.lit(0).cast("long")
    keyed = cells.select("row", "col", level.alias("v")).withColumn("tr", F.floor(F.col("row") / tile)).withColumn("tc", F.floor(F.col("col") / tile))

    def label(key, block: pd.DataFrame) -> pd.DataFrame:
        r, c = block["row"].to_numpy(np.int64) - int(key[0]) * tile, block["col"].to_numpy(np.int64) - int(key[1]) * tile
        flat = _labels(r, c, block["v"].to_numpy(np.int64), tile)
        first = (block["row"].to_numpy(np.int64) << 31) + block["col"].to_numpy(np.int64)
        return pd.DataFrame({"row": block["row"], "col": block["col"], "v": block["v"], "local": first[flat]})

    local = cut(keyed.groupBy("tr", "tc").applyInPandas(label, "row int, col int, v long, local long"), "labels")
    edge = (F.col("row") % tile).isin(0, tile - 1) | (F.col("col") % tile).isin(0, tile - 1)
    border = local.where(edge)
    pairs = neighbours(border, ["v", "local"]).join(border, ["row", "col"]).where("n_v = v and n_local <> local").select(F.col("n_local").alias("a"), F.col("local").alias("b")).distinct()
    classes = connect(pairs).select(F.col("node").alias("local"), "root")
    named = local.join(classes, "local", "left").select("row", "col", F.coalesce("root", "local").alias("region"))
    return cells.join(named, ["row", "col"])


def _labels(r: np.ndarray, c: np.ndarray, v: np.ndarray, size: int) -> np.ndarray:
    """For each cell the index of the cell that names its component: the first in row-major order."""
    none = np.iinfo(np.int64).max
    place = np.full((size + 2, size + 2), -1, np.int64)
    order = np.lexsort((c, r))
    rank = np.empty(len(r), np.int64)
    rank[order] = np.arange(len(r))
    place[r + 1, c + 1] = rank
    values = v[order]
    r, c = r[order], c[order]
    around = np.stack([place[r + 1 + i, c + 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)])
    linked = (around >= 0) & (values[around] == values)
    label = np.arange(len(r))
    while True:
        least = np.minimum(label, np.where(linked, label[around], none).min(axis=0))
        np.minimum.at(least, label, least.copy())  # roots learn what their cells have met
        while True:
            above = least[least]
            if (above == least).all():
                break
            least = above
        if (least == label).all():
            return order[label][rank]
        label = least


def connect(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b), by alternating star steps.

    Large-star ties the neighbours above a node to the least around it, small-star those
    below; each round's edges are written to the shared folder.  Rounds go on until one changes
    nothing, some logarithm of the longest chain.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(floor, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(floor.select("u", F.col("m").alias("v")))
        edges = cut(down.where("u <> v").distinct(), "links")


def shapes(cells: DataFrame, value: str | None = None) -> DataFrame:
    """Per region: area, longest side of its box, mean and population deviation of a value."""
    side = lambda c: F.max(c) - F.min(c) + 1
    more = [F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd")] if value else []
    return cells.groupBy("region").agg(F.count("*").alias("area"), F.greatest(side("row"), side("col")).alias("longest"), *more)


def linear(area: Column, longest: Column) -> Column:
    return (longest >= LINE_LENGTH) & (area <= 2 * longest)


def sieve(mask: DataFrame, least: int = SIEVE) -> DataFrame:
    """``on`` of every cell, with regions of either value below ``least`` cells taken over by their largest neighbour (equal: the lowest)."""
    labelled = components(mask.select("row", "col", "on"), "on")
    area = labelled.groupBy("region").agg(F.count("*").alias("area"))
    sized = labelled.join(area, "region")
    small = sized.where(F.col("area") < least)
    around = neighbours(sized, ["region", "area", "on"])
    best = (
        small.join(around, ["row", "col"]).where("n_region <> region").groupBy("region")
        .agg(F.max_by("n_on", F.struct("n_area", -F.col("n_region"))).alias("taken"))
    )
    return labelled.join(best, "region", "left").select("row", "col", F.coalesce("taken", "on").alias("on"))


def canopy(cells: DataFrame) -> DataFrame:
    """(row, col) of tree crowns: tall vegetation, sieved, without smooth or line-like regions."""
    chm = (F.col("dsm") - F.col("dtm")).cast("float")
    tall = cells.select("row", "col", chm.alias("chm"), ((F.col("landcover") == VEGETATION) & (chm >= F.lit(CANOPY_HEIGHT).cast("float"))).alias("on"))
    kept = sieve(tall).where("on").join(tall.select("row", "col", "chm"), ["row", "col"])
    crowns = components(kept)
    bad = shapes(crowns, "chm").where((F.col("sd") < CROWN_ROUGHNESS) | linear(F.col("area"), F.col("longest")))
    return crowns.join(bad, "region", "left_anti").select("row", "col", "region")


def opening(cells: DataFrame, value: str, size: int = OPENING) -> DataFrame:
    """Adds ``opened``: erosion, then dilation, over size × size cells; edges reflect.

    Reflected cells repeat cells of the window itself, so at an edge the window is simply
    cut off.
    """
    half = size // 2

    def along(f, column: str, line: str, order: str) -> Column:
        return f(column).over(W.partitionBy(line).orderBy(order).rowsBetween(-half, half))

    out = cells
    for f in (F.min, F.max):
        source = value if f is F.min else "_eroded"
        out = out.withColumn("_line", along(f, source, "row", "col"))
        out = out.withColumn("_eroded" if f is F.min else "opened", along(f, "_line", "col", "row"))
    return out.drop("_line", "_eroded")


def remove_linear(cells: DataFrame) -> DataFrame:
    """Thin tall things flattened to what is around them; regions that touch a footprint are spared.

    ``cells``: row, col, dsm, dtm, landcover, built (boolean).
    """
    opened = opening(cells, "dsm")
    sticks = opened.where((F.col("dsm") - F.col("opened") >= PROTRUSION) & (F.col("opened") - F.col("dtm") < BASE_HEIGHT))
    regions = components(sticks)
    drop = shapes(regions).where(linear(F.col("area"), F.col("longest"))).join(regions.where("built"), "region", "left_anti")
    flat = regions.join(drop, "region", "left_semi").select("row", "col", F.greatest("opened", "dtm").alias("lowered"))
    return opened.join(flat, ["row", "col"], "left").withColumn("dsm", F.coalesce("lowered", "dsm")).drop("lowered", "opened")


def remove_slabs(cells: DataFrame) -> DataFrame:
    """Low flat slabs over open ground put back to the terrain."""
    chm = (F.col("dsm") - F.col("dtm")).cast("float")
    tall = cells.withColumn("chm", chm)
    regions = components(tall.where(F.col("chm").between(SLAB_LOW, SLAB_HIGH) & (F.col("landcover") != BUILDING)).select("row", "col", "chm"))
    flat = shapes(regions, "chm").where(F.col("sd") < SLAB_ROUGHNESS)
    outline = neighbours(regions, ["region"]).join(regions.select("row", "col"), ["row", "col"], "left_anti").groupBy("row", "col").agg(F.max("n_region").alias("region"))
    open_ = outline.join(tall.select("row", "col", "chm"), ["row", "col"]).groupBy("region").agg(F.avg((F.col("chm") < SLAB_LOW).cast("double")).alias("open"))
    drop = flat.join(open_.where(F.col("open") >= SLAB_GROUND), "region", "left_semi")
    gone = regions.join(drop, "region", "left_semi").select("row", "col", F.lit(True).alias("gone"))
    return tall.join(gone, ["row", "col"], "left").withColumn("dsm", F.when(F.col("gone"), F.col("dtm")).otherwise(F.col("dsm"))).drop("gone", "chm")


def declutter(cells: DataFrame) -> DataFrame:
    """Lines first, then slabs."""
    return remove_slabs(remove_linear(cells))


def tree_zones(cells: DataFrame, trees: DataFrame, near: float = NEAR, dense: float = DENSE, res: float = 1.0) -> DataFrame:
    """Adds ``zone`` (near, dense, none) by the distance to the nearest tree cell (row, col).

    Cells and trees meet in buckets as wide as the widest zone, with the eight around.
    """
    wide = max(1, int(-(-dense // res)))
    bucket = lambda c: F.floor(F.col(c) / wide)
    near_by = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1)])
    seeds = trees.select(F.col("row").alias("t_row"), F.col("col").alias("t_col")).distinct().withColumn("_d", F.explode(near_by))
    seeds = seeds.select("t_row", "t_col", (bucket("t_row") + F.col("_d.r")).alias("br"), (bucket("t_col") + F.col("_d.c")).alias("bc"))
    placed = cells.withColumn("br", bucket("row")).withColumn("bc", bucket("col"))
    square = F.pow(F.col("row") - F.col("t_row"), F.lit(2)) + F.pow(F.col("col") - F.col("t_col"), F.lit(2))
    distance = placed.join(seeds, ["br", "bc"]).groupBy("row", "col").agg((F.sqrt(F.min(square)) * res).alias("distance"))
    zone = F.when(F.col("distance") <= near, "near").when(F.col("distance") <= dense, "dense").otherwise("none")
    return cells.join(distance, ["row", "col"], "left").withColumn("zone", zone).drop("distance")


def crown_audit(crowns: DataFrame) -> DataFrame:
    """One row: area of crowns (region, zone) in inventoried places, and of those with a tree near."""
    region = crowns.groupBy("region").agg(F.count("*").alias("area"), F.avg((F.col("zone") != "none").cast("double")).alias("known"), F.bool_or(F.col("zone") == "near").alias("tree"))
    judged = F.col("known") > 0.5
    area = lambda when: F.coalesce(F.sum(F.when(when, F.col("area"))), F.lit(0))
    return region.agg(area(judged).alias("judgeable"), area(judged & F.col("tree")).alias("corroborated"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
