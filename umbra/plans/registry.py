"""Which cities are served, and what every setting of a city means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

#: What each setting does and what a change of it costs.
KNOBS = {
    "sectors": ("azimuth sectors of a skyline; more follow the sun closer", "rebuild"),
    "reach": ("how far obstacles are looked for, in metres", "rebuild"),
    "resolution": ("metres of a cell", "rebuild"),
    "area": ("polygon outside which nothing is computed", "rebuild"),
    "timezone": ("clock of naive instants and of days", "tiles"),
    "name": ("shown to people", "nothing"),
}


def registry(cities: DataFrame, built: DataFrame, graphs: DataFrame) -> DataFrame:
    """city, verdict, routes from configured cities (city, epsg), builds (city, epsg) and graphs (city, coherent).

    No build: skipped.  Another projection, or an incoherent graph: abort.  No graph: served
    without routes.
    """
    met = cities.join(built.select("city", F.col("epsg").alias("built_epsg")), "city", "left").join(graphs, "city", "left")
    verdict = F.when(F.col("built_epsg").isNull(), "skip").when((F.col("built_epsg") != F.col("epsg")) | ~F.coalesce("coherent", F.lit(True)), "abort").otherwise("serve")
    return met.select("city", verdict.alias("verdict"), (verdict == "serve").__and__(F.coalesce("coherent", F.lit(False))).alias("routes"))


def attribution(sources: DataFrame) -> DataFrame:
    """(city, attribution): credits in order, each once, from (city, position, credit)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "credit"))), lambda x: x["credit"])
    return sources.groupBy("city").agg(F.array_distinct(ordered).alias("attribution"))


def eta(progress: DataFrame) -> DataFrame:
    """Adds ``left_s``: seconds to go by the mean of the units done so far, from (job, unit, seconds, total)."""
    w = W.partitionBy("job").orderBy("unit")
    return progress.withColumn("left_s", F.avg("seconds").over(w) * (F.col("total") - F.row_number().over(w)))


def source_dates(points: DataFrame) -> DataFrame:
    """One row: the span of survey dates; unknown dates don't count."""
    return points.agg(F.min("created").alias("first"), F.max("created").alias("last"))


def reconciled(manifest: dict, basemap_exists: bool, url: str = "basemap.pmtiles") -> dict:
    """The manifest with ``basemap_url`` exactly where there is a basemap; doing it twice changes nothing."""
    rest = {k: v for k, v in manifest.items() if k != "basemap_url"}
    return rest | ({"basemap_url": url} if basemap_exists else {})
