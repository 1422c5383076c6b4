"""Values from one grid on another, and smoothing, as joins and windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def resample(cells: DataFrame, value: str, px: Column, py: Column, cells_per_pixel: float) -> DataFrame:
    """(px, py, value): a field on target pixels; ``px``, ``py`` place each cell's centre in pixel units.

    Where pixels are wider than cells they take the mean of the cells inside; where they
    are narrower each pixel takes its cells by distance (a tent as wide as a cell), which is
    bilinear interpolation.  Thresholds belong after this, labels to ``nearest``.
    """
    placed = cells.select(F.col(value).cast("double").alias("v"), px.alias("u"), py.alias("w"))
    if cells_per_pixel >= 1:
        return placed.groupBy(F.floor("u").alias("px"), F.floor("w").alias("py")).agg(F.avg("v").alias(value))
    reach = 1 / cells_per_pixel  # pixels a cell
    span = lambda c: F.sequence(F.ceil(F.col(c) - 0.5 - reach).cast("long"), F.floor(F.col(c) - 0.5 + reach).cast("long"))
    spread = placed.withColumn("px", F.explode(span("u"))).withColumn("py", F.explode(span("w")))
    tent = lambda a, b: F.greatest(F.lit(0.0), 1 - F.abs(F.col(a) + 0.5 - F.col(b)) / reach)
    weight = tent("px", "u") * tent("py", "w")
    return spread.withColumn("k", weight).where("k > 0").groupBy("px", "py").agg((F.sum(F.col("k") * F.col("v")) / F.sum("k")).alias(value))


def nearest(cells: DataFrame, label: str, px: Column, py: Column, cells_per_pixel: float) -> DataFrame:
    """(px, py, label): the label of the cell whose centre is nearest to the pixel's."""
    reach = max(1.0, 1 / cells_per_pixel)
    placed = cells.select(F.col(label).alias("v"), px.alias("u"), py.alias("w"))
    span = lambda c: F.sequence(F.ceil(F.col(c) - 0.5 - reach).cast("long"), F.floor(F.col(c) - 0.5 + reach).cast("long"))
    spread = placed.withColumn("px", F.explode(span("u"))).withColumn("py", F.explode(span("w")))
    square = (F.col("px") + 0.5 - F.col("u")) * (F.col("px") + 0.5 - F.col("u")) + (F.col("py") + 0.5 - F.col("w")) * (F.col("py") + 0.5 - F.col("w"))
    return spread.groupBy("px", "py").agg(F.min_by("v", F.struct(square, F.col("v"))).alias(label))


def blur(cells: DataFrame, value: str, sigma: float) -> DataFrame:
    """Adds ``blurred``: a Gaussian of sigma cells, rows then columns, weights renewed at the edges."""
    half = max(1, math.ceil(3 * sigma))
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]

    def along(column: str, line: str, order: str) -> Column:
        w = W.partitionBy(line).orderBy(order)
        pick = lambda k: F.lag(column, -k).over(w) if k else F.col(column)
        total = norm = F.lit(0.0)
        for k, g in zip(range(-half, half + 1), weights, strict=True):
            v = pick(k)
            total = total + F.coalesce(v * g, F.lit(0.0))
            norm = norm + F.when(v.isNotNull(), g).otherwise(0.0)
        return total / norm

    return cells.withColumn("_b", along(value, "row", "col")).withColumn("blurred", along("_b", "col", "row")).drop("_b")


def projected_bounds(bounds: tuple[float, float, float, float], to, spark, steps: int = 21) -> tuple[float, float, float, float]:
    """Bounds after a projection, along densified edges; ``to`` maps (x, y) Columns to Columns."""
    x0, y0, x1, y1 = bounds
    t = F.col("id") / (steps - 1)
    edges = [(x0 + t * (x1 - x0), F.lit(y0)), (x0 + t * (x1 - x0), F.lit(y1)), (F.lit(x0), y0 + t * (y1 - y0)), (F.lit(x1), y0 + t * (y1 - y0))]
    walk = spark.range(steps).select(F.explode(F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in edges])).alias("p"))
    u, v = to(F.col("p.x"), F.col("p.y"))
    return tuple(walk.select(u.alias("u"), v.alias("v")).agg(F.min("u"), F.min("v"), F.max("u"), F.max("v")).first())
