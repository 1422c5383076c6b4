"""Verdicts: sun, shade or night, what casts the shade, and for how long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from umbra.functions.angles import BUILDING, MAX_ANGLE, SECTORS, TOP, VEGETATION, contributing_sector, skyline_at

#: Codes of the state raster.
SUN, SHADE_BUILDING, SHADE_VEGETATION, SHADE_OTHER, SHADE_BOTH, OUTSIDE = 0, 1, 2, 3, 4, 255
OPAQUE_CANOPY = "tree crowns are taken as opaque"


def read_skyline(rows: DataFrame, sectors: int = SECTORS) -> DataFrame:
    """Adds horizon, horizon_felled (degrees at ``azimuth``) and blocker_at from q, q_felled, blocker."""
    at = lambda c: skyline_at(F.col(c), F.col("azimuth"), sectors, MAX_ANGLE / TOP)
    return (
        rows.withColumn("horizon", at("q")).withColumn("horizon_felled", at("q_felled"))
        .withColumn("blocker_at", F.get("blocker", contributing_sector(F.col("q"), F.col("azimuth"), sectors)))
    )


def verdict(rows: DataFrame) -> DataFrame:
    """Adds state and shade_type from elevation, canopy, horizon, horizon_felled, blocker_at.

    Night first; then a crown overhead; then the skyline (strictly above the sun).  Without
    a felled skyline nothing is said to hold without trees.
    """
    el = F.col("elevation")
    up, low = el > 0, el < F.col("horizon")
    holds = F.coalesce(el < F.col("horizon_felled"), F.lit(False))
    crown = F.coalesce(F.col("canopy"), F.lit(False))
    by_trees = F.when(holds, "both").otherwise("vegetation")
    return (
        rows.withColumn("state", F.when(~up, "night").when(crown | low, "shade").otherwise("sun"))
        .withColumn("shade_type", F.when(up & crown, by_trees).when(up & low & (F.col("blocker_at") == VEGETATION), by_trees).when(up & low & (F.col("blocker_at") == BUILDING), "building"))
    )


def state_code(rows: DataFrame) -> DataFrame:
    """Adds ``code``, the raster's state: shade that fells with the trees is vegetation whatever the blocker.

    Without a felled skyline, shade holds wherever vegetation isn't the blocker.
    """
    el, kind = F.col("elevation"), F.col("blocker_at")
    shaded = el < F.col("horizon")
    holds = F.coalesce(el < F.col("horizon_felled"), shaded & (kind != VEGETATION))
    crown = F.coalesce(F.col("canopy"), F.lit(False))
    code = (
        F.when(~(F.coalesce("covered", F.lit(True)) if "covered" in rows.columns else F.lit(True)), OUTSIDE)
        .when(crown & holds, SHADE_BOTH).when(crown, SHADE_VEGETATION)
        .when(~shaded, SUN).when(~holds, SHADE_VEGETATION)
        .when(kind == VEGETATION, SHADE_BOTH).when(kind == BUILDING, SHADE_BUILDING).otherwise(SHADE_OTHER)
    )
    return rows.withColumn("code", code.cast("smallint"))


def cast_layers(rows: DataFrame) -> DataFrame:
    """building_layer and trees_layer from code, canopy and landcover: disjoint, clear under crowns, roofs and outside."""
    code, crown = F.col("code"), F.coalesce(F.col("canopy"), F.lit(False))
    away = (F.col("landcover") == BUILDING) | (code == OUTSIDE)
    buildings = F.when(away, OUTSIDE).when(crown & (code == SHADE_VEGETATION), SUN).when(code == SHADE_BOTH, SHADE_BUILDING).when(code == SHADE_VEGETATION, SUN).otherwise(code)
    trees = F.when(away, OUTSIDE).when(~crown & (code == SHADE_VEGETATION), SHADE_VEGETATION).otherwise(SUN)
    return rows.withColumn("building_layer", buildings.cast("smallint")).withColumn("trees_layer", trees.cast("smallint"))


def caveats(types: Column) -> Column:
    """What to say beside verdicts: only trees as the whole reason bring the remark on crowns."""
    return F.when(F.array_contains(types, "vegetation"), F.array(F.lit(OPAQUE_CANOPY))).otherwise(F.array().cast("array<string>"))


def day_samples(days: DataFrame, zone: str, step_minutes: int = 5) -> DataFrame:
    """UTC instants ``ts`` of each local day in ``day``: 288, or 276 and 300 where clocks change."""
    start = F.to_utc_timestamp(F.col("day").cast("timestamp"), zone)
    end = F.to_utc_timestamp(F.date_add("day", 1).cast("timestamp"), zone)
    step = F.make_dt_interval(mins=F.lit(step_minutes))
    return days.withColumn("ts", F.explode(F.sequence(start, end - step, step)))


def intervals(samples: DataFrame, keys: list[str], values: list[str], ts: str = "ts", step: str = "INTERVAL 5 MINUTES", night: Column | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Runs of equal values in order of time: (keys, values, start, end, n).

    A run ends where the next sample differs (night samples end a run and start none);
    the last ends one step after its last sample.  Samples of one instant go by ``ties``.
    """
    w = W.partitionBy(*keys).orderBy(ts, *ties)
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.lag(v).over(w))
    marked = (
        samples.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).when(same, 0).otherwise(1))
        .withColumn("_next", F.coalesce(F.lead(ts).over(w), F.col(ts) + F.expr(step)))
        .withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    )
    if night is not None:
        marked = marked.where(~night)
    return marked.groupBy(*keys, "_run", *values).agg(F.min(ts).alias("start"), F.max("_next").alias("end"), F.count("*").alias("n")).drop("_run")


def shaded_until(runs: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Per key: until when the shade that holds ``now`` lasts; null in sun, at night, and in gaps.

    Runs of shade that touch (they differ in what casts it) count as one.
    """
    shade = runs.where("state = 'shade'")
    w = W.partitionBy(*keys).orderBy("start")
    apart = F.when(F.col("start") == F.lag("end").over(w), 0).otherwise(1)
    merged = shade.withColumn("_new", apart).withColumn("_run", F.sum("_new").over(w)).groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    holding = merged.where((F.col("start") <= now) & (now < F.col("end"))).groupBy(*keys).agg(F.max("end").alias("shaded_until"))
    return runs.select(*keys).distinct().join(holding, keys, "left")
