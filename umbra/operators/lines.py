"""Polylines as vertex rows: arcs, even samples, and points projected onto them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def segments(vertices: DataFrame, key: str = "line", order: str = "i") -> DataFrame:
    """(line, seg, x1, y1, x2, y2, len, arc0): consecutive vertices with the length before each; none across lines."""
    w = W.partitionBy(key).orderBy(order)
    ends = (
        vertices.withColumn("seg", F.row_number().over(w) - 1)
        .withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w))
        .where(F.col("x2").isNotNull())
        .select(key, "seg", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")
    )
    length = F.sqrt((F.col("x2") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("y2") - F.col("y1")) * (F.col("y2") - F.col("y1")))
    before = W.partitionBy(key).orderBy("seg").rowsBetween(W.unboundedPreceding, -1)
    return ends.withColumn("len", length).withColumn("arc0", F.coalesce(F.sum("len").over(before), F.lit(0.0)))


def sample_count(total: Column, spacing: float) -> Column:
    """How many even samples a line gets, both ends included; a point gets one."""
    return F.when(total == 0, 1).otherwise(F.greatest(F.floor(total / spacing) + 2, F.lit(2))).cast("int")


def samples(vertices: DataFrame, spacing: float, key: str = "line", order: str = "i") -> DataFrame:
    """(line, k, x, y): even samples by arc length, interpolated between vertices."""
    segs = segments(vertices, key, order)
    totals = segs.groupBy(key).agg(F.sum("len").alias("total"), F.max("seg").alias("last"))
    n = sample_count(F.col("total"), spacing)
    wanted = totals.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    wanted = wanted.withColumn("s", F.when(F.col("n") == 1, 0.0).otherwise(F.col("total") * F.col("k") / (F.col("n") - 1)))
    # The segment of a position: the last that begins at or before it.
    s, inside = F.col("s"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce((F.col("s") - F.col("arc0")) / F.nullif(F.col("len"), F.lit(0.0)), F.lit(0.0))))
    met = wanted.join(segs, key).where((F.col("arc0") <= s) | (F.col("seg") == 0))
    at = F.max(F.struct("seg", (F.col("x1") + inside * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + inside * (F.col("y2") - F.col("y1"))).alias("y")))
    return met.groupBy(key, "k", "n", "total").agg(at.alias("at")).select(key, "k", "n", "total", "at.x", "at.y")


def on_segment(px: Column, py: Column) -> tuple[Column, Column]:
    """(t, squared distance) of the nearest place of segment x1,y1 - x2,y2; a point segment has t = 0."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    along = ((px - F.col("x1")) * dx + (py - F.col("y1")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    ex, ey = px - (F.col("x1") + t * dx), py - (F.col("y1") + t * dy)
    return t, ex * ex + ey * ey


def snap(points: DataFrame, segs: DataFrame, reach: float, key: str = "line", place: bool = False) -> DataFrame:
    """(point, line, seg, s, distance): the nearest segment within ``reach``; equal: lowest line, then segment.

    With ``place`` also x and y, where on the segment that is.

    Segments go to the square buckets (as wide as the reach) that their box, grown by the
    reach, meets; a point looks in its own bucket, so this is an equi-join.  Equal segments
    (the lowest stands for them) and equal places meet once.  Neither side is broadcast: its
    size before the buckets says little of that after them.
    """
    low = lambda a, b: F.floor((F.least(a, b) - reach) / reach)
    high = lambda a, b: F.floor((F.greatest(a, b) + reach) / reach)
    ends = ["x1", "y1", "x2", "y2"]
    apart = segs.groupBy(*ends).agg(F.min(F.struct(key, "seg", "arc0", "len")).alias("_s")).select(*ends, "_s.*")
    spread = apart.withColumn("bx", F.explode(F.sequence(low("x1", "x2"), high("x1", "x2")))).withColumn("by", F.explode(F.sequence(low("y1", "y2"), high("y1", "y2"))))
    named = points.select("point", F.col("x").alias("px"), F.col("y").alias("py"))
    placed = named.select("px", "py").distinct().withColumn("bx", F.floor(F.col("px") / reach)).withColumn("by", F.floor(F.col("py") / reach))
    t, square = on_segment(F.col("px"), F.col("py"))
    near = placed.join(spread.hint("merge"), ["bx", "by"]).withColumn("t", t).withColumn("square", square).where(F.col("square") <= reach * reach)
    best = near.groupBy("px", "py").agg(F.min(F.struct("square", key, "seg", (F.col("arc0") + F.col("t") * F.col("len")).alias("s"), (F.col("x1") + F.col("t") * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + F.col("t") * (F.col("y2") - F.col("y1"))).alias("y"))).alias("b"))
    met = named.join(best.hint("merge"), ["px", "py"]).groupBy("point").agg(F.min("b").alias("b"))
    return met.select("point", F.col(f"b.{key}").alias(key), "b.seg", "b.s", F.sqrt("b.square").alias("distance"), *(["b.x", "b.y"] if place else []))


def clip(spans: DataFrame, segs: DataFrame, keys: list[str], key: str = "line") -> DataFrame:
    """(keys, points): the piece of a line between two places of it, from ``s_from`` to ``s_to`` as walked.

    ``spans``: keys, line, s_from, s_to, total (the length the places are measured in, which
    may be rounded: the arcs are stretched to it).  Ends that fall on vertices are those
    vertices.  An equi-join on the line; what is gathered is one piece.
    """
    own = W.partitionBy(key)
    arcs = segs.withColumn("_sum", F.sum("len").over(own))
    low, high = F.least("s_from", "s_to"), F.greatest("s_from", "s_to")
    stretch = F.col("total") / F.nullif(F.col("_sum"), F.lit(0.0))
    met = (
        spans.join(arcs, key).withColumn("_low", low).withColumn("_high", high)
        .withColumn("_a", F.col("arc0") * stretch).withColumn("_b", F.when(F.abs(F.col("arc0") + F.col("len") - F.col("_sum")) < 1e-9, F.col("total")).otherwise((F.col("arc0") + F.col("len")) * stretch))
        .where("_a < _high and _b > _low")
    )
    along = lambda s: F.coalesce((s - F.col("_a")) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0.0)), F.lit(0.0))
    inside = lambda s, a, b: F.when(s >= F.col("_b"), b).otherwise(a + (b - a) * along(s))
    at = lambda s: F.struct(inside(s, F.col("x1"), F.col("x2")).alias("x"), inside(s, F.col("y1"), F.col("y2")).alias("y"))
    parts = met.select(*keys, "s_from", "s_to", "seg", at(F.greatest("_a", "_low")).alias("first"), at(F.least("_b", "_high")).alias("last"))
    whole = parts.groupBy(*keys).agg(F.any_value(F.col("s_from") > F.col("s_to")).alias("back"), F.array_sort(F.collect_list(F.struct("seg", "first", "last"))).alias("p"))
    points = F.array_append(F.transform("p", lambda x: x["first"]), F.element_at("p", -1)["last"])
    return whole.select(*keys, F.when(F.col("back"), F.reverse(points)).otherwise(points).alias("points"))


def near(points: DataFrame, others: DataFrame, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """All pairs within a radius by a bucketed equi-join; both sides need id columns of their own.

    ``others`` has x, y and further columns; its coordinates come out as ox, oy.
    """
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    rest = [c for c in others.columns if c not in (x, y)]
    spread = others.select(*rest, F.col(x).alias("ox"), F.col(y).alias("oy"), F.explode(around).alias("_d"))
    spread = spread.withColumn("_bx", F.floor(F.col("ox") / radius) + F.col("_d.i")).withColumn("_by", F.floor(F.col("oy") / radius) + F.col("_d.j")).drop("_d")
    placed = points.withColumn("_bx", F.floor(F.col(x) / radius)).withColumn("_by", F.floor(F.col(y) / radius))
    dx, dy = F.col("ox") - F.col(x), F.col("oy") - F.col(y)
    return placed.join(spread, ["_bx", "_by"]).withColumn("distance", F.sqrt(dx * dx + dy * dy)).where(F.col("distance") <= radius).drop("_bx", "_by")


def nearest(points: DataFrame, others: DataFrame, radius: float, k: int, point: str, other: str) -> DataFrame:
    """(point, rank, other, distance): the ``k`` nearest within a radius; equal distances: lowest ``other``.

    Both sides have an id, x and y.  Equal places meet once: points stand together, and of the others
    at a place the ``k`` lowest can be among the nearest.  Groups of others are ranked by place,
    then one by one; neither side is broadcast, as ids are many where places are few.
    """
    first = others.withColumn("_n", F.row_number().over(W.partitionBy("x", "y").orderBy(other))).where(F.col("_n") <= k)
    groups = first.groupBy("x", "y").agg(F.array_sort(F.collect_list(other)).alias("_ids"))
    met = near(points.select("x", "y").distinct(), groups.hint("merge"), radius)
    ranked = lambda rows, *keys: rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy("distance", other))).where(F.col("rank") <= k)
    best = ranked(met.select("x", "y", "distance", F.explode("_ids").alias(other)), "x", "y").drop("rank")
    return ranked(points.join(best.hint("merge"), ["x", "y"]), point).select(point, "rank", other, "distance")  # again, as points may repeat


def as_of(left: DataFrame, right: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """Each left row with the right rows at or before (``low_*``) and after it (``high_*``) of its keys.

    One union and two windows; equal instants count as before.
    """
    both = left.withColumn("_side", F.lit(1)).withColumn("_at", F.lit(None).cast(right.schema[ts].dataType)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).unionByName(
        right.select(*keys, ts, F.col(ts).alias("_at"), F.col(value).alias("_v"), F.lit(0).alias("_side")), allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy(ts, "_side")
    # What follows is read in falling order: a frame that only grows costs one step a row.
    back = w.rowsBetween(W.unboundedPreceding, 0)
    fore = W.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col("_side").desc()).rowsBetween(W.unboundedPreceding, -1)
    pair = F.when(F.col("_side") == 0, F.struct("_at", "_v"))
    out = both.withColumn("_low", F.last(pair, ignorenulls=True).over(back)).withColumn("_high", F.last(pair, ignorenulls=True).over(fore)).where(F.col("_side") == 1)
    return out.withColumn("low_at", F.col("_low._at")).withColumn("low_value", F.col("_low._v")).withColumn("high_at", F.col("_high._at")).withColumn("high_value", F.col("_high._v")).drop("_side", "_at", "_v", "_low", "_high")


def lerp(value_low: Column, value_high: Column, share: Column) -> Column:
    """Single-precision interpolation; beyond either end the other holds."""
    w = share.cast("float")
    mixed = ((F.lit(1.0).cast("float") - w) * value_low.cast("float") + w * value_high.cast("float")).cast("float")
    return F.coalesce(mixed, value_low.cast("float"), value_high.cast("float"))
