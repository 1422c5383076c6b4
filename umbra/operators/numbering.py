"""Consecutive numbers and running sums over a whole table, without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from umbra.operators.store import cut


def running(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds for each name the sum of its column over all rows before, in the order of the columns.

    Rows are ranged by the order; each range sums its own rows, and the totals of the
    ranges (one row a range) say where it starts.  The ranges are written first, so that a
    lost executor can't redraw them.
    """
    ranged = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_sum_{name}") for name, c in sums.items()])
    starts = totals.select("_range", *[F.coalesce(F.sum(f"_sum_{name}").over(before(W.orderBy("_range"))), F.lit(0)).alias(f"_start_{name}") for name in sums])
    own = before(W.partitionBy("_range").orderBy(*order))
    joined = ranged.join(starts, "_range")
    for name, c in sums.items():
        joined = joined.withColumn(name, F.col(f"_start_{name}") + F.coalesce(F.sum(c).over(own), F.lit(0)))
    return joined.drop("_range", *[f"_start_{name}" for name in sums])


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... in the order of the columns."""
    return running(rows, order, {name: F.lit(1)}).withColumn(name, F.col(name).cast("long"))
