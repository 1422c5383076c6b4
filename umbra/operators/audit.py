"""Checks of derived tables, and plain comparisons of what is there with what should be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.functions.angles import BUILDING, NO_BLOCKER

ZERO_SHARE, NOVEG_QUANTUM = 0.05, 1


def skyline_checks(cells: DataFrame) -> DataFrame:
    """sector, then counts of violations, from row, col, sector, q, q_felled, blocker, covered.

    One aggregate: a horizon without blocker, blockers under an open sky beyond their
    share, a felled skyline above the full one or off where a building stands, and data
    outside the coverage.
    """
    on = F.col("covered")
    return cells.groupBy("sector").agg(
        F.count_if(on).alias("n_covered"),
        F.count_if(on & (F.col("q") > 0) & (F.col("blocker") == NO_BLOCKER)).alias("blockerless"),
        (F.count_if(on & (F.col("q") == 0) & (F.col("blocker") != NO_BLOCKER)) > ZERO_SHARE * F.count_if(on)).alias("open_with_blocker"),
        F.count_if(on & (F.col("q_felled") > F.col("q") + NOVEG_QUANTUM)).alias("felled_above"),
        F.count_if(on & (F.col("blocker") == BUILDING) & (F.abs(F.col("q_felled") - F.col("q")) > NOVEG_QUANTUM)).alias("felled_off"),
        F.count_if(~on & ((F.col("q") > 0) | (F.col("blocker") != NO_BLOCKER))).alias("leaks"),
    )


def cell_checks(cells: DataFrame) -> DataFrame:
    """(name, failures) over surfaces and land cover."""
    checks = {
        "nan": F.isnan("dsm") | F.isnan("dtm") | F.col("dsm").isNull() | F.col("dtm").isNull(),
        "surface_below_terrain": F.col("dsm") < F.col("dtm"),
        "land_cover_domain": ~F.coalesce(F.col("landcover").isin(0, 1, 2), F.lit(False)),
    }
    counted = cells.agg(*[F.count_if(c).alias(k) for k, c in checks.items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("failures")) for k in checks])).alias("x")).select("x.*")


def coherence(edges: DataFrame, n_nodes: int, fractions: DataFrame, n_columns: int) -> DataFrame:
    """One row of violation counts over a stored network."""
    e = edges.agg(
        F.count_if((F.col("u") < 0) | (F.col("v") < 0) | (F.col("u") >= n_nodes) | (F.col("v") >= n_nodes)).alias("bad_node"),
        F.count_if(~(F.col("len") > 0) | F.isnan("len")).alias("bad_length"),
        F.count_if(F.size("geom") < 2).alias("bad_geometry"),
    )
    f = fractions.agg(
        F.count_if((F.col("col") < 0) | (F.col("col") >= n_columns)).alias("bad_column"),
        F.count_if(F.col("sun_q") + F.col("veg_q") > 256).alias("bad_shares"),
    )
    return e.join(f)  # one row each


def covered_tiles(cells: DataFrame, sizes: list[int]) -> DataFrame:
    """size, n_tiles, swept_tiles, swept_cells for several tile sizes in one pass."""
    sized = cells.withColumn("size", F.explode(F.array(*map(F.lit, sizes))))
    tiles = sized.groupBy("size", F.floor(F.col("row") / F.col("size")).alias("tr"), F.floor(F.col("col") / F.col("size")).alias("tc")).agg(F.bool_or("covered").alias("on"), F.count("*").alias("n"))
    return tiles.groupBy("size").agg(F.count("*").alias("n_tiles"), F.count_if("on").alias("swept_tiles"), F.coalesce(F.sum(F.when(F.col("on"), F.col("n"))), F.lit(0)).alias("swept_cells"))


def missing(needed: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    return needed.select(*keys).distinct().join(cached.select(*keys).distinct(), keys, "left_anti")


def build_vs_served(local: DataFrame, served: DataFrame) -> DataFrame:
    """city, verdict from (city, built): same, stale, local_only, served_only."""
    both = local.select("city", F.col("built").alias("here")).join(served.select("city", F.col("built").alias("there")), "city", "full_outer")
    verdict = F.when(F.col("there").isNull(), "local_only").when(F.col("here").isNull(), "served_only").when(F.col("here") == F.col("there"), "same").otherwise("stale")
    return both.withColumn("verdict", verdict)
