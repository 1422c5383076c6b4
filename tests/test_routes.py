"""Walks at an instant: exposure from the ladder, night, refusals, and what a walk looks like."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbra import engine
from umbra.city import City
from umbra.functions.projection import from_utm
from umbra.operators import lines, network
from umbra.plans import ladder

CITY = City("square", "Square", "Europe/Madrid", 30, (341000.0, 4192000.0, 341200.0, 4192200.0))


def test_pieces_of_a_line(spark):
    shape = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0), (1, 2, 10.0, 0.0), (1, 3, 10.0, 10.0)], "line int, i int, x double, y double")
    spans = spark.createDataFrame([(0, 1, 0.0, 20.0), (1, 1, 20.0, 0.0), (2, 1, 4.0, 13.0), (3, 1, 13.0, 4.0), (4, 1, 2.0, 3.0)], "k int, line int, s_from double, s_to double").withColumn("total", F.lit(20.0))
    got = {r.k: [tuple(p) for p in r.points] for r in lines.clip(spans, lines.segments(shape), ["k"]).collect()}
    corner = [(10.0, 0.0), (10.0, 0.0)]  # a vertex told twice stays
    assert got[0] == [(0.0, 0.0), *corner, (10.0, 10.0)] and got[1] == got[0][::-1]
    assert got[2] == [(4.0, 0.0), *corner, (10.0, 3.0)] and got[3] == got[2][::-1] and got[4] == [(2.0, 0.0), (3.0, 0.0)]


def test_pieces_measured_in_a_rounded_length(spark):
    """Places measured in single precision still end on the last vertex."""
    shape = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1.1, 0.7), (1, 2, 3.3, 0.1)], "line int, i int, x double, y double")
    total = float(np.float32(math.hypot(1.1, 0.7) + math.hypot(2.2, 0.6)))
    spans = spark.createDataFrame([(0, 1, 0.0, total)], "k int, line int, s_from double, s_to double").withColumn("total", F.lit(total))
    points = lines.clip(spans, lines.segments(shape), ["k"]).first().points
    assert [tuple(p) for p in points] == [(0.0, 0.0), (1.1, 0.7), (3.3, 0.1)]


def test_columns_of_an_instant(spark):
    hours = {(r.rung, r.hour): r.column for r in ladder.instants(spark).collect()}
    at = [(0, "2027-06-21 10:30:00"), (1, "2027-06-21 03:00:00"), (2, "2027-06-21 21:59:00"), (3, "2028-02-29 11:15:00"), (4, "2027-06-21 10:00:00")]
    rows = spark.createDataFrame(at, "id int, at string").withColumn("at", F.to_timestamp("at"))
    got = {r.id: (r.low_column, r.high_column, r.share) for r in ladder.columns_at(rows, "at", "Europe/Madrid").collect()}
    assert got[0] == (hours[5, 12], hours[5, 13], 0.5)  # 12:30 by the city's clock
    assert got[1] == (hours[5, 8], hours[5, 8], 0.0) and got[2] == (hours[5, 21], hours[5, 21], 0.0)
    assert got[3] == (hours[1, 12], hours[1, 13], 0.25) and got[4] == (hours[5, 12], hours[5, 13], 0.0)


@pytest.fixture(scope="module")
def town(spark):
    """Two ways from west to east: 100 m straight, and 140 m over the north, which trees shade at every hour but 12."""
    x0, y0 = 341000.0, 4192000.0
    nodes = spark.createDataFrame([(0, x0 + 50, y0 + 50), (1, x0 + 150, y0 + 50), (2, x0 + 30, y0 + 50), (3, x0 + 170, y0 + 50)], "id int, x double, y double")
    shapes = {0: [(30, 50), (50, 50)], 1: [(50, 50), (150, 50)], 2: [(50, 50), (50, 70), (150, 70), (150, 50)], 3: [(150, 50), (170, 50)]}
    vertices = spark.createDataFrame([(e, i, x0 + x, y0 + y) for e, p in shapes.items() for i, (x, y) in enumerate(p)], "line int, i int, x double, y double")
    edges = spark.createDataFrame([(0, 2, 0, 20.0), (1, 0, 1, 100.0), (2, 0, 1, 140.0), (3, 1, 3, 20.0)], "edge int, u int, v int, len double")
    told = []
    for r in ladder.instants(spark).collect():
        told += [(e, r.column, 255 if e != 2 or r.hour == 12 else 0, 255 if e == 2 and r.hour != 12 else 0) for e in range(4)]
    return nodes, edges, vertices, spark.createDataFrame(told, "edge int, column int, sun_q smallint, veg_q smallint")


def ask(spark, rows):
    """Questions from metres within the square."""
    df = spark.createDataFrame(rows, "id string, xa double, ya double, xb double, yb double, at string, alpha double, beta double")
    for e in "ab":
        lon, lat = from_utm(F.col(f"x{e}") + 341000.0, F.col(f"y{e}") + 4192000.0, 30)
        df = df.withColumn(f"lon_{e}", lon).withColumn(f"lat_{e}", lat)
    df = df.withColumn("at", F.to_timestamp("at")).drop("xa", "ya", "xb", "yb")
    return spark.createDataFrame(df.collect(), df.schema)


def test_walks_at_instants(spark, town):
    shade, noon, half, night = "2026-06-21 12:00:00", "2026-06-21 10:00:00", "2026-06-21 10:30:00", "2026-06-21 00:00:00"
    rows = [("shade", 35.0, 45.0, 165.0, 52.0, shade, 1.0, 0.0), ("noon", 35.0, 45.0, 165.0, 52.0, noon, 1.0, 0.0), ("half", 35.0, 45.0, 165.0, 52.0, half, 2.0, 0.0), ("night", 35.0, 45.0, 165.0, 52.0, night, 1.0, 0.5),
            ("spot", 35.0, 45.0, 35.0, 55.0, shade, 1.0, 0.0), ("off", -500.0, 50.0, 165.0, 52.0, shade, 1.0, 0.0), ("taste", 35.0, 45.0, 165.0, 52.0, shade, 1.0, 2.0), ("null", 35.0, 45.0, 165.0, 52.0, shade, None, 0.0)]
    got = {(r.id, r.kind): r for r in engine.routes_at(ask(spark, rows), *town, CITY).collect()}
    assert len(got) == 2 * len(rows)
    tree = got["shade", "shaded"]
    assert tree.status == "ok" and tree.length == pytest.approx(170) and tree.veg_length == pytest.approx(140) and tree.sun_length == pytest.approx(30) and tree.sun_fraction == pytest.approx(30 / 170)
    assert got["shade", "shortest"].length == pytest.approx(130) and got["shade", "shortest"].sun_fraction == pytest.approx(1)
    assert got["noon", "shaded"].length == pytest.approx(130)  # the trees don't help at twelve
    assert got["half", "shaded"].veg_length == pytest.approx(70, abs=1e-4) and got["half", "shaded"].sun_length == pytest.approx(100, abs=1e-4)
    dark = got["night", "shaded"]
    assert dark.status == got["night", "shortest"].status == "night" and dark.length == pytest.approx(130) and dark.sun_length == 0 and dark.elevation < 0
    assert [s.sun for s in dark.segments] == [0.0] * 3
    assert got["spot", "shaded"].status == "same_spot" and got["spot", "shaded"].length == 0 and len(got["spot", "shaded"].points) == 2 and got["spot", "shaded"].segments == []
    assert got["off", "shaded"].status == "outside" and got["taste", "shortest"].status == got["null", "shaded"].status == "refused" and got["off", "shaded"].points is None
    # What a walk looks like: its joints are told once, its pieces in order.
    metres = spark.createDataFrame(tree.points)
    from umbra.functions.projection import to_utm

    xy = [(round(a - 341000, 3), round(b - 4192000, 3)) for a, b in metres.select(*to_utm(F.col("lon"), F.col("lat"), 30)).collect()]
    assert xy == [(35, 50), (50, 50), (50, 70), (150, 70), (150, 50), (165, 50)]
    assert [(round(s.length, 3), s.sun, s.veg) for s in tree.segments] == [(15, 1, 0), (140, 0, 1), (15, 1, 0)]
    assert [s.points[-1] for s in tree.segments[:-1]] == [s.points[0] for s in tree.segments[1:]]


def test_alternatives_at_an_instant(spark, town):
    rows = [("shade", 35.0, 45.0, 165.0, 52.0, "2026-06-21 12:00:00", 1.0, 0.0), ("night", 35.0, 45.0, 165.0, 52.0, "2026-06-21 00:00:00", 1.0, 0.0), ("spot", 35.0, 45.0, 35.0, 55.0, "2026-06-21 12:00:00", 1.0, 0.0), ("off", -500.0, 50.0, 165.0, 52.0, "2026-06-21 12:00:00", 1.0, 0.0)]
    found = engine.routes_at(ask(spark, rows), *town, CITY, alternatives=True).collect()
    got = sorted((r.id, r.status, r.alpha, None if r.length is None else round(r.length, 3)) for r in found)
    assert got == [("night", "night", 0.0, 130.0), ("off", "outside", 1.0, None), ("shade", "ok", 0.0, 130.0), ("shade", "ok", 0.5, 170.0), ("spot", "same_spot", 0.0, 0.0)]


def test_the_search_aims_at_the_place_on_the_network(spark):
    """A pin far off the network must not end the search early: what bounds it is the distance to the place on it."""
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 100.0, 0.0), (2, -20.0, 0.0)], "id int, x double, y double")
    edges = spark.createDataFrame([(0, 0, 1, 100.0), (1, 0, 1, 220.0), (2, 2, 0, 20.0)], "edge int, u int, v int, len double").withColumn("sun", F.lit(0.0)).withColumn("veg", F.lit(0.0))
    shapes = {0: [(0, 0), (100, 0)], 1: [(0, 0), (0, -60), (100, -60), (100, 0)], 2: [(-20, 0), (0, 0)]}
    vertices = spark.createDataFrame([(e, i, float(x), float(y)) for e, p in shapes.items() for i, (x, y) in enumerate(p)], "line int, i int, x double, y double")
    asked = spark.createDataFrame([(1, -10.0, 0.0, 400.0, -20.0, 0.0, 0.0)], "id long, x_a double, y_a double, x_b double, y_b double, alpha double, beta double")
    assert engine.shaded_routes(asked, nodes, edges, vertices).first().length == pytest.approx(130)


def test_a_large_network_is_refused(spark, town):
    nodes, edges, _, fractions = town
    with pytest.raises(ValueError, match="bytes"):
        network.routes(spark.createDataFrame([], "query long"), nodes, edges, fractions, most_bytes=100)
