"""The engine's questions, batched: DataFrames of questions in, DataFrames of answers out.

Errors are a ``status`` column (ok, outside, night, no_route, no_snap, same_spot, refused), never a failed job.
``skylines`` is what ``operators.horizon.sweep`` makes, with canopy and covered flags and the
land cover: row, col, q, q_felled, blocker, canopy, covered.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from umbra.city import City
from umbra.functions.projection import from_utm, to_utm
from umbra.functions.sun import solar_position_udf
from umbra.operators import binning, horizon, lines, network, polygons, regions, shade
from umbra.plans import ladder

ZONE_SPACING, ZONE_LIMIT, MAJORITY, SNAP_REACH = 10.0, 50, 0.5, 400.0


def build(points: DataFrame, city: City, footprints: DataFrame | None = None, tile: int = 256, area: DataFrame | None = None) -> DataFrame:
    """From points to skylines of every covered cell: bin, fill, footprints, declutter, sweep, canopy.

    ``area``: polygons (id, rings of lon, lat as x, y).  Cells with their centre in none of them
    cast shade but have no skyline, and tiles without a covered cell are not swept.
    """
    grid = city.grid
    binned = binning.bin_points(points, grid)
    cells = binning.finish_cells(binned, binning.fill_terrain(binned, grid))
    if footprints is not None:
        cells = binning.footprint_override(cells, footprints)
        cells = regions.declutter(cells.withColumn("built", F.col("footprint").isNotNull()).drop("footprint", "chm"))
    cells = cells.select("row", "col", "dsm", "dtm", "landcover")
    if area is not None:
        metres = lambda p: F.struct(*[c.alias(n) for c, n in zip(to_utm(p["x"], p["y"], city.utm_zone), "xy", strict=True)])
        inside = polygons.rasterise(area.select("id", F.transform("rings", lambda ring: F.transform(ring, metres)).alias("rings")), grid)
        cells = cells.join(inside.select("row", "col", F.lit(True).alias("covered")), ["row", "col"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
    cells = regions.cut(cells, "cells")
    datum = binning.height_datum(cells).first()["datum"] or 0.0
    sky = horizon.sweep(cells, city.sectors, city.reach, city.resolution, tile, datum)
    crowns = regions.canopy(cells).select("row", "col", F.lit(True).alias("canopy"))
    return (
        sky.join(crowns, ["row", "col"], "left").join(cells.select("row", "col", "landcover"), ["row", "col"])
        .withColumn("canopy", F.coalesce("canopy", F.lit(False))).withColumn("covered", F.lit(True))
    )


def _placed(questions: DataFrame, city: City) -> DataFrame:
    x, y = to_utm(F.col("lon"), F.col("lat"), city.utm_zone)
    grid = city.grid
    return questions.withColumn("x", x).withColumn("y", y).withColumn("row", grid.row(F.col("y"))).withColumn("col", grid.col(F.col("x")))


def _sunlit(rows: DataFrame, ts: str) -> DataFrame:
    return rows.withColumn("_sun", solar_position_udf(F.col(ts), F.col("lat"), F.col("lon"))).withColumn("azimuth", F.col("_sun.azimuth")).withColumn("elevation", F.col("_sun.elevation")).drop("_sun")


def shade_at(questions: DataFrame, skylines: DataFrame, city: City) -> DataFrame:
    """id, status, state, in_shade, shade_type, azimuth, elevation, caveats from (id, lat, lon, at): ``at`` is UTC."""
    met = _sunlit(_placed(questions, city), "at").join(skylines.where("covered"), ["row", "col"], "left")
    known = F.col("q").isNotNull()
    out = shade.verdict(shade.read_skyline(met, city.sectors))
    return out.select(
        "id", F.when(~known, "outside").when(F.col("state") == "night", "night").otherwise("ok").alias("status"),
        F.when(known, F.col("state")).alias("state"), F.when(known, F.col("state") == "shade").alias("in_shade"), F.when(known, F.col("shade_type")).alias("shade_type"),
        F.bround("azimuth", 2).alias("azimuth"), F.bround("elevation", 2).alias("elevation"), shade.caveats(F.array("shade_type")).alias("caveats"))


def timeline(questions: DataFrame, skylines: DataFrame, city: City, step_minutes: int = 5, now: dt.datetime | None = None) -> DataFrame:
    """Runs of sun and shade of each local day: (id, status, state, shade_type, start, end, n, shaded_until) from (id, lat, lon, day).

    A place off the map has one row of status outside.  ``now`` (UTC) tells until when the
    shade lasts that holds it, for days that are today; other days have no shaded_until.
    """
    # Each place meets its skyline once; its samples are spread after that, inside the stage.
    placed = _placed(questions, city)
    known = placed.join(skylines.where("covered"), ["row", "col"])
    judged = shade.verdict(shade.read_skyline(_sunlit(shade.day_samples(known, city.timezone, step_minutes), "ts"), city.sectors))
    runs = shade.intervals(judged, ["id"], ["state", "shade_type"], step=f"INTERVAL {step_minutes} MINUTES", night=F.col("state") == "night")
    if now is None:
        runs = runs.withColumn("shaded_until", F.lit(None).cast("timestamp"))
    else:  # only the runs of today hold the present
        runs = runs.join(shade.shaded_until(runs, ["id"], F.lit(now).cast("timestamp")), "id", "left")
    outside = placed.join(skylines.where("covered").select("row", "col"), ["row", "col"], "left_anti").select("id", F.lit("outside").alias("status"))
    return runs.withColumn("status", F.lit("ok")).select("id", "status", "state", "shade_type", "start", "end", "n", "shaded_until").unionByName(outside, allowMissingColumns=True)


def parking_nearby(questions: DataFrame, zones: DataFrame, skylines: DataFrame, city: City, radius: float = 300.0) -> DataFrame:
    """Zones within a radius of each question (id, lat, lon, at), nearest first, with their shade.

    ``zones``: zone, vertices (line, i, lon, lat); a zone is shaded when half of its samples
    are; one without samples on the map has no verdict; at most 50 a question, as a list has.
    """
    x, y = to_utm(F.col("lon"), F.col("lat"), city.utm_zone)
    vertices = zones.withColumn("x", x).withColumn("y", y).withColumn("line", F.struct("zone", "line"))
    samples = lines.samples(vertices, ZONE_SPACING).select("line.zone", "x", "y")
    asked = _placed(questions, city).select("id", F.col("x").alias("x"), F.col("y").alias("y"), "lat", "lon", "at")
    close = lines.near(asked, samples, radius)
    # The distance alone ranks, so only the zones that will be told are judged.
    nearest = close.groupBy("id", "zone").agg(F.min("distance").alias("distance")).withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("distance", "zone"))).where(F.col("rank") <= ZONE_LIMIT)
    grid = city.grid
    mine = _sunlit(nearest.join(asked, "id").join(samples.withColumnRenamed("x", "sx").withColumnRenamed("y", "sy"), "zone"), "at")
    met = mine.withColumn("row", grid.row(F.col("sy"))).withColumn("col", grid.col(F.col("sx"))).join(skylines.where("covered"), ["row", "col"], "left")
    judged = shade.verdict(shade.read_skyline(met, city.sectors))
    told = judged.groupBy("id", "zone", "distance", "rank").agg(
        F.avg(F.when(F.col("q").isNotNull(), (F.col("state") == "shade").cast("double"))).alias("fraction"), F.bool_and(F.col("state") == "night").alias("night"))
    lit = ~F.col("night") & F.col("fraction").isNotNull()
    state = F.when(F.col("fraction").isNull(), F.lit(None)).when(F.col("night"), "night").when(F.col("fraction") >= MAJORITY, "shade").otherwise("sun")
    answers = told.select("id", "rank", "zone", F.bround("distance", 1).alias("distance"), state.alias("state"), F.when(lit, F.bround("fraction", 3)).alias("shade_fraction"))
    until = _zones_until(met, answers.where("state = 'shade'").select("id", "zone"), city)
    return answers.join(until, ["id", "zone"], "left")


def _zones_until(samples: DataFrame, shaded: DataFrame, city: City) -> DataFrame:
    """(id, zone, shaded_until): the first later step of the local day at which a zone loses its majority or the sun sets."""
    local = F.from_utc_timestamp("at", city.timezone).cast("date")
    later = shade.day_samples(samples.join(shaded, ["id", "zone"], "left_semi").withColumn("day", local), city.timezone).where("ts > at")
    judged = shade.verdict(shade.read_skyline(_sunlit(later, "ts"), city.sectors)).where("q is not null")
    steps = judged.groupBy("id", "zone", "ts").agg(F.avg((F.col("state") == "shade").cast("double")).alias("fraction"), F.bool_and(F.col("state") == "night").alias("night"))
    return steps.where(F.col("night") | (F.col("fraction") < MAJORITY)).groupBy("id", "zone").agg(F.min("ts").alias("shaded_until"))


def _snapped(questions: DataFrame, segs: DataFrame) -> DataFrame:
    """Questions whose two ends (x_a, y_a, x_b, y_b) lie within reach of the network, with the places there."""
    for end in "ab":
        asked = questions.select(F.col("id").alias("point"), F.col(f"x_{end}").alias("x"), F.col(f"y_{end}").alias("y"))
        place = lines.snap(asked, segs, SNAP_REACH, "edge", place=True).select(F.col("point").alias("id"), F.col("edge").cast("int").alias(f"edge_{end}"), F.col("s").alias(f"s_{end}"), F.col("x").alias(f"x_{end}"), F.col("y").alias(f"y_{end}"))
        questions = questions.drop(f"x_{end}", f"y_{end}").join(place, "id")
    return questions


def _both_tastes(ready: DataFrame) -> DataFrame:
    both = F.array(F.struct("alpha", "beta"), F.struct(F.lit(0.0).alias("alpha"), F.lit(0.0).alias("beta")))
    return ready.withColumn("_t", F.explode(F.array_distinct(both))).withColumn("alpha", F.col("_t.alpha")).withColumn("beta", F.col("_t.beta")).drop("_t")


def shaded_routes(questions: DataFrame, nodes: DataFrame, edges: DataFrame, vertices: DataFrame, alternatives: bool = False) -> DataFrame:
    """For questions (id, x_a, y_a, x_b, y_b, alpha, beta): the shaded and the shortest way, or all alternatives.

    ``edges`` has fixed sun and veg shares; ``routes_at`` takes them from the ladder.
    Ends further than 400 m from the network give status no_snap.
    """
    segs = lines.segments(vertices, "line").withColumnRenamed("line", "edge")
    ready = _snapped(questions, segs).withColumnRenamed("id", "query")
    found = network.routes(network.spread_alphas(ready) if alternatives else _both_tastes(ready), nodes, edges).drop("spans")
    lost = questions.join(ready.select(F.col("query").alias("id")), "id", "left_anti").select(F.col("id").alias("query"), F.col("alpha").cast("double").alias("alpha"), F.lit("no_snap").alias("status"))
    return found.unionByName(lost, allowMissingColumns=True)


MOST_TASTE = 10.0


def routes_at(questions: DataFrame, nodes: DataFrame, edges: DataFrame, vertices: DataFrame, fractions: DataFrame, city: City, alternatives: bool = False) -> DataFrame:
    """Walks at an instant: (id, kind, status, alpha, beta, azimuth, elevation, length, sun_length, sun_fraction, veg_length, points, segments).

    ``questions``: id, lat_a, lon_a, lat_b, lon_b, at (UTC), alpha, beta; ``edges``: edge, u, v,
    len; ``vertices``: line (the edge), i, x, y; ``fractions``: edge, column, sun_q, veg_q by
    the ladder's columns.  Every question has a row of kind shaded and one of kind shortest,
    or, with ``alternatives``, one for each way worth a choice.  ``points`` are (lon, lat) from
    start to end, ``segments`` the pieces by edge with their shares.

    status: ok; night (no sun to avoid: both are the shortest way); same_spot (length 0);
    no_route; no_snap (an end over 400 m off the network); outside (an end off the map);
    refused (alpha or beta not within 0 to 10, or beta above alpha) - the last four have no way.
    """
    asked = questions.withColumn("alpha", F.col("alpha").cast("double")).withColumn("beta", F.col("beta").cast("double"))
    inside = F.lit(True)
    for end in "ab":
        x, y = to_utm(F.col(f"lon_{end}"), F.col(f"lat_{end}"), city.utm_zone)
        asked = asked.withColumn(f"x_{end}", x).withColumn(f"y_{end}", y)
        inside = inside & F.col(f"x_{end}").between(city.bbox[0], city.bbox[2]) & F.col(f"y_{end}").between(city.bbox[1], city.bbox[3])
    sane = F.col("alpha").between(0, MOST_TASTE) & F.col("beta").between(0, MOST_TASTE) & (F.col("beta") <= F.col("alpha"))
    asked = _sunlit(asked.withColumn("lat", F.col("lat_a")).withColumn("lon", F.col("lon_a")), "at").withColumn("_refusal", F.when(~F.coalesce(sane, F.lit(False)), "refused").when(~F.coalesce(inside, F.lit(False)), "outside"))
    segs = lines.segments(vertices, "line").withColumnRenamed("line", "edge")
    ready = ladder.columns_at(_snapped(asked.where("_refusal is null"), segs).withColumn("up", F.col("elevation") > 0), "at", city.timezone)
    if alternatives:  # without a sun there is nothing to trade
        spread = network.spread_alphas(ready).where("up or alpha = 0").withColumn("kind", F.lit("alternative"))
    else:
        tastes = F.array(F.struct(F.lit("shaded").alias("kind"), "alpha", "beta"), F.struct(F.lit("shortest").alias("kind"), F.lit(0.0).alias("alpha"), F.lit(0.0).alias("beta")))
        spread = ready.withColumn("_t", F.explode(tastes)).withColumn("kind", F.col("_t.kind")).withColumn("alpha", F.col("_t.alpha")).withColumn("beta", F.col("_t.beta")).drop("_t")
    # Walks get a number that several joins read: they are written once.
    keyed = regions.cut(spread.withColumn("query", F.monotonically_increasing_id()), "asked")
    found = regions.cut(network.routes(keyed, nodes, edges, fractions), "routes")
    walks = keyed.drop("alpha").join(found, "query")
    if alternatives:
        ways = network.distinct_routes(walks.drop("query").withColumnRenamed("id", "query"))
        front = network.pareto(ways).select(F.col("query").alias("id"), F.explode("front.alpha").alias("alpha"))
        walks = walks.join(front, ["id", "alpha"], "left_semi").unionByName(walks.where("status <> 'ok' and alpha = 0"))
    total = F.col("total")
    spans = (
        walks.select("query", "up", "low_column", "high_column", "share", F.posexplode("spans").alias("k", "span")).select("*", "span.*").drop("span")
        .join(edges.select("edge", F.col("len").cast("double").alias("total")), "edge")
    )
    mixed = lambda c: lines.lerp(F.col(f"low.{c}") / 255, F.col(f"high.{c}") / 255, F.col("share")).cast("double")
    told = fractions.select("edge", "column", "sun_q", "veg_q")
    shares = (
        spans.join(told.select("edge", F.col("column").alias("low_column"), F.struct("sun_q", "veg_q").alias("low")), ["edge", "low_column"], "left")
        .join(told.select("edge", F.col("column").alias("high_column"), F.struct("sun_q", "veg_q").alias("high")), ["edge", "high_column"], "left")
        .select("query", "k", F.abs(F.col("s_to") - F.col("s_from")).alias("length"), F.when(F.col("up"), F.coalesce(mixed("sun_q"), F.lit(1.0))).otherwise(0.0).alias("sun"), F.when(F.col("up"), F.coalesce(mixed("veg_q"), F.lit(0.0))).otherwise(0.0).alias("veg"))
    )
    pieces = lines.clip(spans.select("query", "k", "edge", "s_from", "s_to", total.alias("total")), segs, ["query", "k"], "edge").join(shares, ["query", "k"])
    lonlat = lambda p: F.struct(*[c.alias(n) for c, n in zip(from_utm(p["x"], p["y"], city.utm_zone), ("lon", "lat"), strict=True)])
    pieces = pieces.withColumn("points", F.transform("points", lonlat))
    legs = pieces.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("k", "length", "sun", "veg", "points"))).alias("segments"))
    # A joint is told once: every piece but the first leaves out its first point.
    path = F.flatten(F.transform("segments", lambda s, i: F.when(i == 0, s["points"]).otherwise(F.slice(s["points"], 2, F.greatest(F.size(s["points"]) - 1, F.lit(0))))))
    legs = legs.select("query", path.alias("points"), F.transform("segments", lambda s: s.dropFields("k")).alias("segments"))
    spot = F.struct(*[c.alias(n) for c, n in zip(from_utm(F.col("x_a"), F.col("y_a"), city.utm_zone), ("lon", "lat"), strict=True)])
    status = F.when(F.col("status").isin("ok", "same_spot") & ~F.col("up"), "night").otherwise(F.col("status"))
    answers = walks.join(legs, "query", "left").select(
        "id", "kind", status.alias("status"), "alpha", "beta", F.bround("azimuth", 2).alias("azimuth"), F.bround("elevation", 2).alias("elevation"), "length", "sun_length",
        F.when(F.col("length") > 0, F.col("sun_length") / F.col("length")).when(F.col("length") == 0, 0.0).alias("sun_fraction"), "veg_length",
        F.when(F.size("spans") == 0, F.array(spot, spot)).otherwise(F.col("points")).alias("points"),
        F.when(F.size("spans") == 0, F.array().cast(legs.schema["segments"].dataType)).otherwise(F.col("segments")).alias("segments"))
    kept = asked.join(keyed.select("id"), "id", "left_anti").withColumn("status", F.coalesce("_refusal", F.lit("no_snap")))
    kinds = F.array(*map(F.lit, ["alternative"] if alternatives else ["shaded", "shortest"]))
    lost = kept.select("id", F.explode(kinds).alias("kind"), "status", "alpha", "beta", F.bround("azimuth", 2).alias("azimuth"), F.bround("elevation", 2).alias("elevation"))
    return answers.unionByName(lost, allowMissingColumns=True)
