"""Outlines, tiles and distances: worked examples and slow versions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbra.functions.grid import Grid
from umbra.operators import polygons, tiles

COLORS = {0: (0, 0, 0, 0), 1: (40, 50, 90, 140), 2: (30, 90, 50, 140), 3: (60, 60, 60, 140), 4: (20, 20, 20, 140), 255: (0, 0, 0, 0)}
BOUNDS = (-4.80, 37.87, -4.79, 37.88)


def turned_square(side, degrees, size=90):
    """A mask of the cells whose centres lie in a turned square."""
    r, c = np.indices((size, size)) + 0.5 - size / 2
    a = math.radians(degrees)
    x, y = c * math.cos(a) - r * math.sin(a), c * math.sin(a) + r * math.cos(a)
    return (np.abs(x) <= side / 2) & (np.abs(y) <= side / 2)


@pytest.mark.parametrize("degrees", [0, 10, 30, 45, 77])
def test_turned_squares_get_four_corners(degrees):
    mask = turned_square(40, degrees)
    (ring,) = polygons.outline(mask)
    xy = np.column_stack([ring[:, 1], -ring[:, 0]])
    assert abs((polygons.dominant_angle(xy) - degrees + 45) % 90 - 45) < 1.5
    square = polygons.regularised(xy)
    assert len(square) == 4
    assert abs(abs(polygons._area(square)) - 1600) < 120


def test_faces_of_something_thin_stay_two():
    """A thin wall: its faces head opposite ways and must not become one."""
    ring = np.array([(0, 0), (30, 0), (30, 4), (0, 4)], float)
    assert len(polygons.regularised(ring)) == 4
    comb = np.array([(0, 0), (40, 0), (40, 20), (24, 20), (24, 8), (20, 8), (20, 20), (0, 20)], float)
    assert abs(polygons._area(polygons.regularised(comb))) == pytest.approx(abs(polygons._area(comb)), rel=0.02)


def test_pulling_in():
    square = np.array([(0, 0), (10, 0), (10, 10), (0, 10)], float)
    assert abs(polygons._area(polygons.pulled_in(square, 0.5, True))) == pytest.approx(81, abs=1e-3)
    assert abs(polygons._area(polygons.pulled_in(square, 0.5, False))) == pytest.approx(121, abs=1e-3)  # a hole, round which is solid
    assert polygons.pulled_in(np.array([(0, 0), (10, 0), (10, 0.8), (0, 0.8)], float), 0.5, True) is None
    bone = np.array([(0, 0), (6, 0), (6, 2.8), (14, 2.8), (14, 0), (24, 0), (24, 6), (14, 6), (14, 3.2), (6, 3.2), (6, 6), (0, 6)], float)
    assert abs(polygons._area(polygons.pulled_in(bone, 0.5, True))) == pytest.approx(9 * 5, abs=1e-3)  # the larger end stays


def test_outlines_are_pulled_in(spark):
    rows = spark.createDataFrame([(1, r, c) for r in range(2, 12) for c in range(3, 15) if not (5 <= r < 9 and 6 <= c < 10)], "region long, row int, col int")
    (one,) = polygons.outlines(rows, Grid(0.0, 20.0, 1.0, 20, 20)).collect()
    areas = sorted(abs(polygons._area(np.array([(p.x, p.y) for p in ring]))) for ring in one.rings)
    assert one.area == 104 and areas == pytest.approx([25, 99], abs=1e-3)


def test_few_cells_outside_do_not_win(spark):
    """25 of 1,600 cells outside: a coarse map still shows all its pixels."""
    cells = spark.range(1600).select((F.col("id") / 40).cast("int").alias("row"), (F.col("id") % 40).cast("int").alias("col")).withColumn("code", F.when((F.col("row") % 8 == 0) & (F.col("col") % 8 == 0), 255).otherwise(1))
    pixels = tiles.nearest_codes(cells, BOUNDS, 10, (40, 40)).collect()
    marked = cells.select("row", "col", F.lit(-5.0).alias("margin"), F.lit(-5.0).alias("margin_felled"), F.lit(2).alias("blocker_at"), F.lit(False).alias("canopy"), (F.col("code") == 1).alias("covered"))
    smooth = tiles.pixel_codes(marked, BOUNDS, 10, (40, 40)).collect()
    assert len(pixels) == len(smooth) >= 70
    assert sum(r.code == 255 for r in pixels) <= 4 and sum(r.code == 255 for r in smooth) <= 4


def test_threshold_after_the_mean(spark):
    """One deep shadow among three slightly sunny cells: the mean margin decides, not a majority."""
    cells = spark.createDataFrame([(r, c, -9.0 if (r + c) % 4 == 0 else 1.0, -9.0, 2, False, True) for r in range(40) for c in range(40)], "row int, col int, margin double, margin_felled double, blocker_at int, canopy boolean, covered boolean")
    assert {r.code for r in tiles.pixel_codes(cells, BOUNDS, 9, (40, 40)).collect()} == {1}


def test_pyramid(spark):
    cells = spark.createDataFrame([(r, c, 1.0 if c < 20 else -1.0, 1.0, 1, False, True) for r in range(40) for c in range(40)], "row int, col int, margin double, margin_felled double, blocker_at int, canopy boolean, covered boolean")
    zooms = range(14, 17)
    made = tiles.pyramid(cells, BOUNDS, zooms, (40, 40), COLORS).cache()
    totals = {r.zoom: (r.written, r.blank) for r in tiles.pyramid_totals(made, BOUNDS, zooms).collect()}
    assert totals[14][0] >= 1 and totals[16][1] > 0 and all(tiles.decode_png(bytes(r.png)).shape == (256, 256) for r in made.collect())
    sunny = tiles.pyramid(cells.withColumn("margin", F.lit(3.0)), BOUNDS, zooms, (40, 40), COLORS).groupBy("zoom").count().collect()
    assert [r.zoom for r in sunny] == [14]  # transparent, and yet there


def test_whole_distances(spark):
    rng = np.random.default_rng(2)
    mask = rng.random((30, 41)) < 0.03
    here = rng.random(mask.shape) < 0.9
    cells = spark.createDataFrame([(int(r), int(c), bool(mask[r, c])) for r, c in zip(*np.nonzero(here), strict=True)], "row int, col int, on boolean")
    on, off = np.argwhere(mask & here), np.argwhere(~mask & here)
    got = tiles.distances(cells, "on").collect()
    assert len(got) == here.sum()
    for r in got:
        other = off if mask[r.row, r.col] else on
        want = np.sqrt(((other - (r.row, r.col)) ** 2).sum(axis=1).min())
        assert r.distance == pytest.approx(want if mask[r.row, r.col] else -want)
    assert all(math.isinf(r.distance) for r in tiles.distances(cells.withColumn("on", F.lit(True)), "on").collect())
