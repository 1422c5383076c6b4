"""Before and after publishing: readiness, plans and clearing, as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.operators.audit import covered_tiles
from umbra.plans import cost

#: What clearing a city sets back; downloads and the area stay.
CLEARED = ("basemap", "build", "graph", "tiles")


def readiness(facts: DataFrame, engine: str) -> DataFrame:
    """(city, name, failure, note) from one row of facts a city.

    ``facts``: city, failed_checks (array), has_area, has_coverage, has_manifest, has_basemap,
    tiles_built, built (timestamps), engine.  Another engine is a note, no refusal.
    """
    checks = [
        ("verify", F.when(F.size("failed_checks") > 0, F.concat(F.lit("does not verify: "), F.array_join("failed_checks", "; "))), None),
        ("coverage", F.when(F.col("has_area") & ~F.col("has_coverage"), F.lit("an area is declared, its coverage is missing")), None),
        ("manifest", F.when(~F.col("has_manifest"), F.lit("no tiles are rendered")), None),
        ("basemap", F.when(~F.col("has_basemap"), F.lit("no basemap to read the overlay against")), None),
        ("tiles", F.when(F.col("tiles_built") != F.col("built"), F.lit("tiles are of another build")), None),
        ("engine", None, F.when(F.coalesce(F.col("engine"), F.lit("?")) != engine, F.lit("built by another engine"))),
    ]
    none = F.lit(None).cast("string")
    rows = F.array(*[F.struct(F.lit(n).alias("name"), (none if f is None else f).alias("failure"), (none if t is None else t).alias("note")) for n, f, t in checks])
    return facts.select("city", F.explode(rows).alias("x")).select("city", "x.*")


def clearing(files: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What clearing a city frees (city, kind, bytes), and its steps afterwards."""
    freed = files.where(F.col("kind") != "lidar").groupBy("city", "kind").agg(F.sum("bytes").alias("bytes"))
    return freed, steps.withColumn("status", F.when(F.col("step").isin(*CLEARED), "pending").otherwise(F.col("status")))


def report(cells: DataFrame, sectors: int, reach_cells: int, workers: int, sizes: tuple[int, ...] = (128, 256, 512)) -> DataFrame:
    """For each tile size: tiles and cells to sweep, share saved, seconds, bytes."""
    t = covered_tiles(cells, list(sizes))
    total = cells.agg(F.count("*").alias("total"), F.count_if("covered").alias("covered"))
    return t.join(total).select(  # one row
        "size", "n_tiles", "swept_tiles", "swept_cells", (1 - F.col("swept_cells") / F.col("total")).alias("saved"),
        cost.sweep_seconds(F.col("swept_cells"), F.lit(sectors), F.lit(reach_cells), F.lit(workers)).alias("seconds"), cost.artifact_bytes(F.col("covered")).alias("artifact_bytes"))


def newest_build(candidates: list[str], existing: DataFrame) -> DataFrame:
    """The latest of the candidate days that exists."""
    days = existing.sparkSession.createDataFrame([(c,) for c in candidates], "day string")
    return days.join(existing.select("day"), "day", "left_semi").agg(F.max("day").alias("day"))


def themes(spark: SparkSession, palettes: dict[str, dict[str, dict[int, tuple[int, int, int, int]]]]) -> DataFrame:
    """(theme, kind, state, position, r, g, b, a) as a lookup table; positions are the file format."""
    rows = [(t, k, s, i, *c) for t, kinds in palettes.items() for k, colors in kinds.items() for i, (s, c) in enumerate(colors.items())]
    return spark.createDataFrame(rows, "theme string, kind string, state int, position int, r int, g int, b int, a int")
