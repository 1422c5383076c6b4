"""Hand-made scenes with verdicts that can be worked out on paper."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from umbra.city import City, edit_city, read_city
from umbra.functions import angles, projection, sun, text
from umbra.functions.grid import Grid, locate
from umbra.operators import audit, binning, horizon, lines, network, polygons, regions, shade, tiles
from umbra.operators.rays import ray_cells
from umbra.plans import chain, cost, ladder, publish


def plane(spark, dsm, dtm=None, cover=None):
    rows, cols = dsm.shape
    dtm = np.zeros_like(dsm) if dtm is None else dtm
    cover = np.zeros(dsm.shape, int) if cover is None else cover
    data = [(r, c, float(dsm[r, c]), float(dtm[r, c]), int(cover[r, c])) for r in range(rows) for c in range(cols)]
    return spark.createDataFrame(data, "row int, col int, dsm float, dtm float, landcover smallint")


def test_ray_is_contiguous_and_ordered():
    for azimuth in np.linspace(0, 360, 37):
        cells = ray_cells(azimuth, 25.0, 1.0)
        assert all(a[3] == b[2] for a, b in zip(cells, cells[1:], strict=False)) and cells[-1][3] == 25.0
        at = [(0, 0)] + [(r, c) for r, c, *_ in cells]
        assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(at, at[1:], strict=False)) and len(set(at)) == len(at)
    assert ray_cells(45.0, 3.0, 1.0)[0][:2] == (-1, 0)  # corners step the row first
    assert ray_cells(180.0, 3.0, 1.0) == [(1, 0, 0.5, 1.5), (2, 0, 1.5, 2.5), (3, 0, 2.5, 3.0)]


@pytest.fixture(scope="module")
def golden(spark):
    dsm, cover = np.full((51, 51), 367.0), np.zeros((51, 51), int)
    for dr, dc, h, k in ((10, 0, 20, 2), (0, 7, 12, 2), (0, -6, 8, 1), (-4, 1, 12, 2)):
        dsm[25 + dr, 25 + dc] += h
        cover[25 + dr, 25 + dc] = k
    return plane(spark, dsm, np.full((51, 51), 367.0), cover).cache()


def test_golden_skyline(golden):
    one = golden.where("row = 25 and col = 25")
    got = {r.sector: r for r in horizon.angles(horizon.relational(golden, 64, 20.0, 1.0)).where("row = 25 and col = 25").collect()}
    for sector, kind, angle, q in ((32, 2, 62.692496, 178), (16, 2, 57.994617, 164), (48, 1, 49.325060, 140), (4, 2, 69.985006, 198)):
        assert got[sector].blocker == kind and got[sector].angle == pytest.approx(angle, abs=1e-5)
        assert round(got[sector].angle * 255 / 90) == q
    assert got[48].angle_felled == 0 and one.count() == 1
    assert all(r.angle == 0 and r.blocker == 255 for s, r in got.items() if s not in (2, 3, 4, 16, 32, 48))


@pytest.mark.parametrize("tile", [16, 64])
def test_sweep_equals_relational(golden, tile):
    sky = horizon.angles(horizon.relational(golden, 16, 12.0, 1.0)).groupBy("row", "col").agg(F.map_from_entries(F.collect_list(F.struct("sector", F.struct("angle", "blocker")))).alias("s"))
    for r in horizon.sweep(golden, 16, 12.0, 1.0, tile).join(sky, ["row", "col"]).collect():
        for s in range(16):
            want = r.s.get(s)
            assert abs(r.q[s] - (want.angle if want else 0) * 255 / 90) <= 0.51
            assert r.blocker[s] == (want.blocker if want else 255)


def test_lifting_the_city_changes_nothing(spark, golden):
    low = horizon.sweep(golden, 16, 12.0, 1.0, 32, 0.0)
    high = horizon.sweep(golden.withColumn("dsm", F.col("dsm") + 400).withColumn("dtm", F.col("dtm") + 400), 16, 12.0, 1.0, 32, 700.0)
    assert low.exceptAll(high).isEmpty()


def test_first_blocker_and_bracket(golden):
    blockers = {(r.row, r.col): r.blocker for r in horizon.first_blocker(golden, 180.0, 30.0, 20.0, 1.0).collect()}
    assert blockers[(25, 25)] == 2 and blockers[(50, 25)] is None
    b = {(r.row, r.col): (r.most, r.least) for r in horizon.bracket(golden, 180.0, 61.0, 20.0, 1.0).collect()}
    assert b[(25, 25)] == (True, False)  # tan(61) * 9.5 + 1.6 < 20 < tan(61) * 10.5 + 1.6


def points(spark, rows):
    return spark.createDataFrame([(x, y, z, c, r, w, o) for x, y, z, c, r, w, o in rows], "x double, y double, z double, cls int, ret int, withheld boolean, overlap boolean")


def test_binning(spark):
    p = points(spark, [
        (0.5, 0.5, 5.0, 4, 1, False, False), (0.5, 0.5, 9.0, 4, 2, False, False), (0.5, 0.5, 1.0, 2, 3, False, False), (0.5, 0.5, 2.0, 2, 1, False, False),
        (1.5, 0.5, 5.0, 6, 1, False, False), (1.5, 0.5, 5.3, 4, 1, False, False), (1.5, 0.5, 99.0, 7, 1, False, False), (1.5, 0.5, 98.0, 4, 1, True, False), (1.5, 0.5, 97.0, 4, 1, False, True),
        (2.5, 0.5, 5.0, 6, 1, False, False), (2.5, 0.5, 8.0, 4, 1, False, False), (4.0, 0.5, 1.0, 2, 1, False, False), (float("nan"), 0.5, 1.0, 2, 1, False, False)])
    grid = Grid.covering(0, 0, 4, 4, 1)
    got = {(r.row, r.col): r for r in binning.bin_points(p, grid).collect()}
    assert set(got) == {(3, 0), (3, 1), (3, 2)}
    assert got[(3, 0)].dsm == 5.0 and got[(3, 0)].ground == 1.5 and got[(3, 1)].dsm == pytest.approx(5.3)
    terrain = binning.fill_terrain(binning.bin_points(p, grid), grid)
    cells = {(r.row, r.col): r for r in binning.finish_cells(binning.bin_points(p, grid), terrain).collect()}
    assert len(cells) == 16 and all(r.dsm >= r.dtm for r in cells.values())
    assert (cells[(3, 0)].landcover, cells[(3, 1)].landcover, cells[(3, 2)].landcover, cells[(0, 0)].landcover) == (1, 2, 1, 0)
    with pytest.raises(Exception, match="no ground within"):
        binning.fill_terrain(binning.bin_points(p.where("cls <> 2"), grid), grid).collect()
    assert locate(p, grid).count() == 11


def test_quantising_rounds_halves_to_even(spark):
    got = spark.range(1).select(angles.quantise_angle(F.lit(90 * 2.5 / 255)).alias("a"), angles.quantise_angle(F.lit(100.0)).alias("b"), angles.quantise_fraction(F.lit(0.5)).alias("c"), angles.tone(F.lit(0.62)).alias("d")).first()
    assert tuple(got) == (2, 255, 128, 3)


def test_verdicts(spark):
    rows = [(i, el, crown, h, b, k) for i, (el, crown, h, b, k) in enumerate([
        (-1.0, True, 9.0, 9.0, 2), (5.0, True, 1.0, 1.0, 255), (5.0, True, 9.0, 9.0, 2), (5.0, False, 9.0, 9.0, 2), (5.0, False, 9.0, 9.0, 1), (5.0, False, 9.0, 1.0, 1),
        (5.0, False, 5.0, 5.0, 2), (5.0, False, 9.0, 9.0, 0), (5.0, False, 9.0, None, 1)])]
    df = spark.createDataFrame(rows, "i int, elevation double, canopy boolean, horizon double, horizon_felled double, blocker_at int")
    got = [(r.state, r.shade_type) for r in shade.verdict(df).orderBy("i").collect()]
    assert got == [("night", None), ("shade", "vegetation"), ("shade", "both"), ("shade", "building"), ("shade", "both"), ("shade", "vegetation"), ("sun", None), ("shade", None), ("shade", "vegetation")]
    assert [r.code for r in shade.state_code(df).orderBy("i").collect()][1:] == [2, 4, 1, 4, 2, 0, 3, 2]


def test_intervals_and_until(spark):
    t0 = dt.datetime(2026, 6, 1, 8)
    states = ["night", "sun", "sun", "shade:building", "shade:both", "sun", "night", "shade:building"]
    rows = [(1, t0 + dt.timedelta(minutes=5 * i), s.split(":")[0], (s.split(":") + [None])[1]) for i, s in enumerate(states)]
    runs = shade.intervals(spark.createDataFrame(rows, "id int, ts timestamp, state string, shade_type string"), ["id"], ["state", "shade_type"], night=F.col("state") == "night")
    got = [((r.start - t0).seconds // 60, (r.end - t0).seconds // 60, r.state) for r in runs.orderBy("start").collect()]
    assert got == [(5, 15, "sun"), (15, 20, "shade"), (20, 25, "shade"), (25, 30, "sun"), (35, 40, "shade")]
    until = lambda m: shade.shaded_until(runs, ["id"], F.lit(t0 + dt.timedelta(minutes=m))).first().shaded_until
    assert until(16) == t0 + dt.timedelta(minutes=25) and until(6) is None and until(26) is None


def test_days_of_changing_clocks(spark):
    days = spark.createDataFrame([(dt.date(2026, 3, 29),), (dt.date(2026, 10, 25),), (dt.date(2026, 6, 21),)], "day date")
    assert [r["count"] for r in shade.day_samples(days, "Europe/Madrid").groupBy("day").count().orderBy("day").collect()] == [276, 288, 300]


def test_sun_and_projection(spark):
    noon = dt.datetime(2026, 6, 21, 12, 20, tzinfo=dt.UTC).timestamp()
    azimuth, elevation = sun.solar_position(np.array([noon]), np.array([37.88]), np.array([-4.78]))
    assert elevation[0] == pytest.approx(90 - 37.88 + 23.44, abs=0.1) and azimuth[0] == pytest.approx(180, abs=2)
    row = spark.createDataFrame([(dt.datetime(2026, 12, 21, 12, 20), 37.88, -4.78)], "ts timestamp, lat double, lon double")
    s = row.select(sun.solar_position_udf("ts", "lat", "lon").alias("s"), *[c.alias(n) for c, n in zip(sun.sun_at(F.col("ts"), 37.88, -4.78), ("a", "e"), strict=True)]).first()
    assert s.s.elevation == pytest.approx(28.7, abs=0.1) and s.e == pytest.approx(28.7, abs=0.3)
    lon, lat = projection.from_utm(F.lit(341000.0), F.lit(4192000.0), 30)
    got = spark.range(1).select(lon.alias("lon"), lat.alias("lat")).first()
    assert (got.lon, got.lat) == (pytest.approx(-4.80, abs=0.02), pytest.approx(37.87, abs=0.02))


def test_hilbert(spark):
    x, y = np.meshgrid(np.arange(8), np.arange(8))
    ids = projection.hilbert_id(x.ravel(), y.ravel(), 3)
    assert sorted(ids) == list(range(21, 85))
    order = np.argsort(ids)
    steps = np.abs(np.diff(x.ravel()[order])) + np.abs(np.diff(y.ravel()[order]))
    assert (steps == 1).all()  # the curve moves one tile at a time
    df = spark.createDataFrame(list(zip(x.ravel().tolist(), y.ravel().tolist(), ids.tolist(), strict=True)), "x int, y int, id long")
    assert df.where(projection.hilbert_column(F.col("x"), F.col("y"), 3) != F.col("id")).isEmpty()


def test_text(spark):
    lat, lon = text.lat_lon(F.col("s"))
    rows = spark.createDataFrame([("37.5, -4.7",), ("91,0",), ("x",), ("1,2,3",)], "s string").select(lat.alias("a"), lon.alias("o")).collect()
    assert [(r.a, r.o) for r in rows] == [(37.5, -4.7)] + [(None, None)] * 3
    got = spark.range(1).select(text.bytes_text(F.lit(1536)).alias("b"), text.duration_text(F.lit(3725)).alias("d"), text.slug(F.lit("  A b--c! ")).alias("s"), text.ladder_date(F.lit("2024-02-29").cast("date"), 2026).alias("l")).first()
    assert tuple(got) == ("1.5 KB", "1 h 02 m", "a-b-c", dt.date(2026, 2, 28))


def scene(spark, heights, value=2.5):
    dsm = np.zeros((24, 24))
    for r0, r1, c0, c1, h in heights:
        dsm[r0:r1, c0:c1] = h
    return dsm


@pytest.mark.parametrize("tile", [5, 512])
def test_components_do_not_depend_on_tiles(spark, tile):
    rng = np.random.default_rng(tile)
    mask = rng.random((20, 23)) < 0.45
    df = spark.createDataFrame([(int(r), int(c)) for r, c in zip(*np.nonzero(mask), strict=True)], "row int, col int")
    got = {}
    for r in regions.components(df, tile=tile).collect():
        got.setdefault(r.region, set()).add((r.row, r.col))
    todo, want = {(int(r), int(c)) for r, c in zip(*np.nonzero(mask), strict=True)}, []
    while todo:
        part, front = set(), [todo.pop()]
        while front:
            r, c = front.pop()
            part.add((r, c))
            near = {(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & todo
            todo -= near
            front += near
        want.append(part)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    assert all(k == min(r * 2**31 + c for r, c in v) for k, v in got.items())


def test_canopy_rules(spark):
    rng = np.random.default_rng(3)
    dsm = np.zeros((24, 40))
    dsm[2:9, 2:9] = rng.normal(4, 0.5, (7, 7)).clip(2.6)  # a crown
    dsm[5, 5] = 1.0  # with a hole of one cell, which the sieve fills
    dsm[2:4, 12:14] = 4.0  # four cells: too small
    dsm[12:22, 2:14] = 2.6  # a flat slab
    dsm[15, 18:34] = 3 + rng.random(16) * 3  # a hedge: a line
    cover = (dsm > 0).astype(int)
    got = {(r.row, r.col) for r in regions.canopy(plane(spark, dsm, None, cover)).collect()}
    assert got == {(r, c) for r in range(2, 9) for c in range(2, 9)}


def test_declutter(spark):
    dsm = np.zeros((40, 40))
    dsm[10, 5:19] = 10.0  # a cable
    dsm[20:38, 20:38] = 8.0  # a building
    dsm[3:9, 25:33] = 2.0  # an awning over open ground
    cover = np.zeros((40, 40), int)
    cover[20:38, 20:38] = 2
    cells = plane(spark, dsm, None, cover).withColumn("built", F.col("landcover") == 2)
    got = {(r.row, r.col): r.dsm for r in regions.declutter(cells).collect()}
    assert got[(10, 10)] == 0 and got[(30, 30)] == 8 and got[(5, 28)] == 0
    spared = cells.withColumn("built", F.col("row") == 10)
    assert regions.remove_linear(spared).where("row = 10 and col = 10").first().dsm == 10


def test_zones_and_audit(spark):
    cells = plane(spark, np.zeros((30, 30)))
    trees = spark.createDataFrame([(15, 15)], "row int, col int")
    z = {(r.row, r.col): r.zone for r in regions.tree_zones(cells, trees, 4.0, 10.0).collect()}
    assert (z[(15, 19)], z[(15, 20)], z[(22, 22)], z[(23, 23)], z[(15, 25)]) == ("near", "dense", "dense", "none", "dense")
    crowns = spark.createDataFrame([(1, "near"), (1, "dense"), (2, "dense"), (3, "none")], "region int, zone string")
    assert tuple(regions.crown_audit(crowns).first()) == (3, 2)


def test_lines(spark):
    v = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 30.0, 0.0), (1, 2, 30.0, 10.0), (2, 0, 5.0, 5.0), (2, 1, 5.0, 5.0)], "line int, i int, x double, y double")
    got = {(r.line, r.k): (r.x, r.y) for r in lines.samples(v, 25.0).collect()}
    assert got == {(1, 0): (0, 0), (1, 1): (20, 0), (1, 2): (30, 10), (2, 0): (5, 5)}
    p = spark.createDataFrame([(7, 12.0, -3.0), (8, 400.0, 0.0)], "point int, x double, y double")
    assert [tuple(r) for r in lines.snap(p, lines.segments(v), 20.0).collect()] == [(7, 1, 0, 12.0, 3.0)]


def test_as_of(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (1, 30), (2, 5)], "k int, t int")
    right = spark.createDataFrame([(1, 10, 1.0), (1, 20, 2.0)], "k int, t int, v double")
    got = {(r.k, r.t): (r.low_value, r.high_value) for r in lines.as_of(left, right, ["k"], "t", "v").collect()}
    assert got == {(1, 5): (None, 1.0), (1, 10): (1.0, 2.0), (1, 30): (2.0, None), (2, 5): (None, None)}


def dijkstra(n, edges, cost, a, b, length):
    import heapq

    adj = {}
    for e, (u, v) in enumerate(edges):
        adj.setdefault(u, []).append((v, cost[e]))
        adj.setdefault(v, []).append((u, cost[e]))
    (ea, sa), (eb, sb) = a, b
    per = lambda e: cost[e] / length[e]
    adj["a"] = [(edges[ea][0], sa * per(ea)), (edges[ea][1], (length[ea] - sa) * per(ea))]
    for k, w in ((edges[eb][0], sb * per(eb)), (edges[eb][1], (length[eb] - sb) * per(eb))):
        adj.setdefault(k, []).append(("b", w))
    if ea == eb:
        adj["a"].append(("b", abs(sa - sb) * per(ea)))
    best, heap = {"a": 0.0}, [(0.0, 0, "a")]
    while heap:
        d, _, x = heapq.heappop(heap)
        if x == "b":
            return d
        for y, w in adj.get(x, []):
            if d + w < best.get(y, math.inf) - 1e-15:
                best[y] = d + w
                heapq.heappush(heap, (d + w, len(heap) + id(y) % 7, y))
    return math.inf


def test_routes_against_dijkstra():
    rng = np.random.default_rng(42)
    xy = np.array([(100.0 * i, 100.0 * j) for i in range(5) for j in range(5)])
    edges = [(5 * i + j, 5 * i + j + 1) for i in range(5) for j in range(4)] + [(5 * i + j, 5 * i + 5 + j) for i in range(4) for j in range(5)]
    length = np.full(len(edges), 100.0)
    g = network.Graph(pd.DataFrame({"id": range(25), "x": xy[:, 0], "y": xy[:, 1]}), pd.DataFrame({"edge": range(len(edges)), "u": [e[0] for e in edges], "v": [e[1] for e in edges], "len": length}))
    for _ in range(150):
        cost = length * (1 + rng.uniform(0, 3, len(edges)))
        a, b = ((int(rng.integers(len(edges))), float(rng.uniform(0, 100))) for _ in range(2))
        u, v = xy[edges[b[0]][0]], xy[edges[b[0]][1]]
        spans = g.between(a, b, cost, tuple(u + (v - u) * b[1] / 100))
        assert sum(abs(s - t) * cost[e] / length[e] for e, s, t in spans) == pytest.approx(dijkstra(25, edges, cost, a, b, length))
    assert g.between((0, 20.0), (0, 75.0), length, (0, 0)) == [(0, 20.0, 75.0)]
    assert g.between((0, 20.0), (0, 20.0), length, (0, 0)) == []


def test_sun_detour_flips(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 60.0, 0.0), (2, -20.0, 0.0), (3, 80.0, 0.0)], "id int, x double, y double")
    edges = spark.createDataFrame([(0, 2, 0, 20.0, 0.0, 0.0), (1, 0, 1, 60.0, 1.0, 0.0), (2, 0, 1, 100.0, 0.0, 1.0), (3, 1, 3, 20.0, 0.0, 0.0)], "edge int, u int, v int, len double, sun double, veg double")
    asked = spark.createDataFrame([(1, 0, 5.0, 3, 10.0, 70.0, 0.0, a, 0.0) for a in (0.6, 0.7)], "query long, edge_a int, s_a double, edge_b int, s_b double, x_b double, y_b double, alpha double, beta double")
    got = {r.alpha: r for r in network.routes(asked, nodes, edges).collect()}
    assert got[0.6].edges == [0, 1, 3] and got[0.7].edges == [0, 2, 3]  # they flip at 2/3
    assert got[0.6].length == pytest.approx(85) and got[0.6].sun_length == pytest.approx(60) and got[0.7].veg_length == pytest.approx(100)


@pytest.mark.parametrize(("entries", "front"), [([(0, 100, 80), (1, 120, 90), (2, 140, 20), (4, 150, 20)], [80, 20]), ([(.5, 1471.8, 299.2), (1, 1474.2, 294.7), (2, 1572.4, 214.3)], [299.2, 214.3])])
def test_pareto(spark, entries, front):
    df = spark.createDataFrame([(1, float(a), float(n), float(s)) for a, n, s in entries], "query int, alpha double, length double, sun_length double")
    assert [p.sun for p in network.pareto(df).first().front] == front


def test_extract(spark):
    pt = lambda *v: [{"x": float(a), "y": float(b)} for a, b in v]
    nodes = spark.createDataFrame([(i * 10, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (12, 0), (0, 12), (12, 12), (99, 99)])], "node long, x double, y double")
    ways = [(0, 10, pt((0, 0), (12, 0))), (10, 0, pt((12, 0), (0, 0))), (0, 20, pt((0, 0), (0, 12))), (10, 30, pt((12, 0), (12, 12))), (20, 30, pt((0, 12), (12, 12))), (30, 20, pt((12, 12), (6, 18), (0, 12))), (20, 20, pt((0, 12), (1, 12), (0, 12)))]
    n, e = network.extract(nodes, spark.createDataFrame(ways, "u long, v long, geom array<struct<x:double,y:double>>"))
    assert sorted(r.id for r in n.collect()) == [0, 1, 2, 3]
    got = [(r.u, r.v, round(r.len, 3)) for r in e.orderBy("edge").collect()]
    assert got == [(0, 1, 12.0), (0, 2, 12.0), (1, 3, 12.0), (2, 3, 12.0), (2, 3, round(2 * math.hypot(6, 6), 3))]


def test_ladder(spark):
    days = {str(r.day): r.rung for r in ladder.assigned_days(spark).collect()}
    assert len(days) == 365 and all(days[d] == k for k, (d, *_) in enumerate(ladder.RUNGS))
    assert days["2026-08-09"] == 4 and ladder.instants(spark).count() == 83
    first = ladder.instants(spark).where("column = 0").first()
    assert str(first.ts).startswith("2026-02-07 08:00")


def test_polygons(spark):
    square = [[{"x": float(x), "y": float(y)} for x, y in ((1, 1), (5, 1), (5, 5), (1, 5))], [{"x": float(x), "y": float(y)} for x, y in ((2, 2), (4, 2), (4, 4), (2, 4))]]
    df = spark.createDataFrame([(3, square), (1, [square[0]])], f"id long, rings {polygons.RINGS}")
    assert [r.a for r in df.select(polygons.polygon_area(F.col("rings")).alias("a")).collect()] == [12.0, 16.0]
    burnt = {(r.row, r.col): r.id for r in polygons.rasterise(df, Grid(0.0, 8.0, 1.0, 8, 8)).collect()}
    assert len(burnt) == 16 and sum(v == 3 for v in burnt.values()) == 12
    tri = [np.array([(0.1, 0.1), (2.9, 0.1), (0.1, 2.9)])]
    assert len(polygons.touched(Grid(0.0, 4.0, 1.0, 4, 4), tri, True)[0]) > len(polygons.touched(Grid(0.0, 4.0, 1.0, 4, 4), tri, False)[0])


def test_outlines(spark):
    mask = np.zeros((12, 14), bool)
    mask[2:10, 3:12] = True
    mask[4:7, 5:8] = False
    rings = polygons.outline(mask)
    area = lambda q: np.sum(q[:, 0] * np.roll(q[:, 1], -1) - np.roll(q[:, 0], -1) * q[:, 1]) / 2
    assert len(rings) == 2 and abs(sum(area(r) for r in rings)) == mask.sum()
    rows = spark.createDataFrame([(1, int(r), int(c)) for r, c in zip(*np.nonzero(mask), strict=True)] + [(2, 0, 0)], "region long, row int, col int")
    out = polygons.outlines(rows, Grid(0.0, 12.0, 1.0, 12, 14)).collect()
    assert len(out) == 1 and out[0].area == mask.sum() and len(out[0].rings[0]) == 4


def test_distances(spark):
    rng = np.random.default_rng(0)
    mask = rng.random((17, 23)) < 0.1
    at = np.argwhere(mask)
    want = np.array([[np.hypot(*(at - (r, c)).T).min() for c in range(23)] for r in range(17)])
    assert np.allclose(tiles.distance_to(mask), want)
    df = spark.createDataFrame([(r, c, bool(mask[r, c])) for r in range(17) for c in range(23)], "row int, col int, on boolean")
    got = {(r.row, r.col): r.distance for r in tiles.signed_distances(df, "on", 6, tile=8).collect()}
    full = np.clip(tiles.signed_distance(mask), -6, 6)
    assert all(got[(r, c)] == pytest.approx(full[r, c]) for r in range(17) for c in range(23))


COLORS = {0: (0, 0, 0, 0), 1: (10, 20, 30, 128), 2: (1, 2, 3, 200), 3: (9, 9, 9, 90), 255: (0, 0, 0, 0)}


def test_png_and_archive(spark, tmp_path):
    rng = np.random.default_rng(0)
    codes = rng.choice(tiles.STATES, (256, 256)).astype(np.uint8)
    png = tiles.encode_png(codes, COLORS)
    assert (tiles.decode_png(png) == codes).all()
    other = {k: (7, 7, 7, 7) for k in COLORS}
    fresh = tiles.recolored(png, *tiles.palette(other))
    assert (tiles.decode_png(fresh) == codes).all() and dict(tiles.chunks(fresh))[b"tRNS"] == bytes([7] * 5)
    with pytest.raises(ValueError, match="PLTE"):
        tiles.recolored(png, b"123", b"1")
    rows = [(k, png if k % 2 else fresh) for k in range(5, 60)] + [(90, b"x"), (91, b"x")]
    path = str(tmp_path / "a.pmtiles")
    assert tiles.write_archive(path, rows, (-5, 37, -4, 38), (3, 4)) == 57
    assert list(tiles.read_archive(path)) == rows
    many = [(k, str(k).encode()) for k in range(0, 30000, 2)]
    tiles.write_archive(path, many, (-5, 37, -4, 38), (3, 9))
    assert list(tiles.read_archive(path)) == many
    hidden = spark.createDataFrame([([0, 255],), ([0, 1],)], "c array<int>").select(tiles.blank(F.col("c"), COLORS).alias("b")).collect()
    assert [r.b for r in hidden] == [True, False]


def test_render(spark, tmp_path):
    bounds = (-4.80, 37.87, -4.79, 37.88)
    cells = spark.createDataFrame([(r, c, 1 if c >= 5 else 0) for r in range(10) for c in range(10)], "row int, col int, code int")
    drawn = tiles.render(cells, bounds, 16, (10, 10), COLORS)
    got = drawn.collect()
    assert got and all(tiles.decode_png(bytes(r.png)).shape == (256, 256) for r in got)
    assert tiles.archive_rows(drawn, str(tmp_path / "b.pmtiles"), bounds, (16, 16)) == len(got)


def test_audits(spark):
    good = [(s, r, 10, 10, 2, True) for s in range(2) for r in range(30)]
    bad = good + [(0, 98, 10, 10, 255, True), (0, 99, 10, 12, 1, True), (1, 99, 10, 4, 2, True), (1, 97, 5, 0, 255, False)]
    columns = "sector int, row int, q int, q_felled int, blocker int, covered boolean"
    got = {r.sector: r for r in audit.skyline_checks(spark.createDataFrame(bad, columns)).collect()}
    assert (got[0].blockerless, got[0].felled_above, got[1].felled_off, got[1].leaks) == (1, 1, 1, 1)
    assert not any(sum(map(int, r[2:])) for r in audit.skyline_checks(spark.createDataFrame(good, columns)).collect())


def test_chain(spark):
    t = dt.datetime(2026, 1, 1)
    rows = [("c", "area", "done", t, "d1", "e1", False), ("c", "build", "done", t + dt.timedelta(1), "d1", "e1", False), ("c", "graph", "done", t, "d1", "e1", False), ("c", "tiles", "running", None, "d1", "e1", False), ("d", "build", "done", t, "d1", "e0", False), ("d", "tiles", "done", t, "d0", "e0", False)]
    got = {(r.city, r.step): r.verdict for r in chain.staleness(spark.createDataFrame(rows, "city string, step string, status string, finished timestamp, digest string, engine string, alive boolean"), "d1", "e1").collect()}
    assert got == {("c", "area"): "done", ("c", "build"): "done", ("c", "graph"): "stale", ("c", "tiles"): "failed", ("d", "build"): "stale", ("d", "tiles"): "stale"}
    w = spark.range(1).select(cost.fitting_workers(F.lit(10), F.lit(100), F.lit(8)).alias("a"), cost.fitting_workers(F.lit(10000), F.lit(100), F.lit(8)).alias("b")).first()
    assert tuple(w) == (0, 7)


def test_publish(spark):
    t = dt.datetime(2026, 1, 1)
    facts = spark.createDataFrame([("a", [], True, True, True, True, t, t, "e1"), ("b", ["leaks"], True, False, False, False, t, t + dt.timedelta(1), None)], "city string, failed_checks array<string>, has_area boolean, has_coverage boolean, has_manifest boolean, has_basemap boolean, tiles_built timestamp, built timestamp, engine string")
    got = publish.readiness(facts, "e1").where("failure is not null").groupBy("city").count().collect()
    assert [tuple(r) for r in got] == [("b", 5)]


def test_city_file(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("id: cube\nname: Cube  # small\ntimezone: Europe/Madrid\nutm_zone: 30\nbbox: [0, 0, 10, 20]\nreach: 20.0  # metres\n")
    city = read_city(p)
    assert (city.grid.rows, city.grid.cols, city.reach) == (20, 10, 20.0)
    assert edit_city(p, "reach", 30.0).reach == 30.0 and "# metres" in p.read_text()
    with pytest.raises(ValueError):
        edit_city(p, "bbox", 1)
    with pytest.raises(ValueError):
        City("x", "x", "Europe/Madrid", 30, (1, 0, 0, 1))
