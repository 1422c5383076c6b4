"""City files, inventories, metadata, areas and places as they come; the march towards the sun."""

from __future__ import annotations

import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from umbra import engine
from umbra.city import City, read_city, zone_of
from umbra.functions.projection import from_utm
from umbra.operators import horizon
from umbra.operators.rays import ray_cells
from umbra.sources import files


def test_city_files_of_other_words(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text(
        "id: square\nname: Square\ncountry: ES\ntimezone: Europe/Madrid\ncrs:\n  # on its own line\n  EPSG:25831 # zone 31\nbbox: [430241, 4583391, 431741, 4584391]\n"
        "area: areas/square.geojson\nresolution_m: 2.0\nhorizon_sectors: 32\nhorizon_max_distance_m: 400 # metres\nsources:\n  lidar: somewhere\nattribution:\n  - Somebody\n")
    city = read_city(p)
    assert (city.utm_zone, city.resolution, city.sectors, city.reach, city.area) == (31, 2.0, 32, 400, "areas/square.geojson")
    p.write_text(p.read_text().replace("crs:\n  # on its own line\n  EPSG:25831 # zone 31\n", ""))
    with pytest.raises(ValueError, match="utm_zone"):
        read_city(p)
    assert zone_of("EPSG:32630") == zone_of("25830") == 30
    for wrong in ("EPSG:4326", "EPSG:32730", "none"):
        with pytest.raises(ValueError):
            zone_of(wrong)


def test_trees(spark, tmp_path):
    point = lambda *c: {"type": "Feature", "geometry": {"type": "Point", "coordinates": list(c)}, "properties": {}}
    line = {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}}
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": [point(1.5, 2.5), line, point(9, 9, 100), {"type": "Feature", "geometry": None}]}, indent=2))
    (tmp_path / "none.json").write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    assert sorted((r.x, r.y) for r in files.trees(spark, str(tmp_path)).collect()) == [(1.5, 2.5), (9.0, 9.0)]
    assert [(r.x, r.y) for r in files.trees(spark, str(tmp_path), (0, 0, 5, 5)).collect()] == [(1.5, 2.5)]
    (tmp_path / "error.json").write_text("<ExceptionReport/>")
    with pytest.raises(Exception, match="no feature collection"):
        files.trees(spark, str(tmp_path)).collect()


def test_metadata(spark, tmp_path):
    city = City("square", "Square", "Europe/Madrid", 30, (0.0, 0.0, 10.0, 20.0))
    files.write_metadata(str(tmp_path / "metadata.json"), city, dt.datetime(2026, 1, 2, 3, 4), attribution=["Somebody"], engine_version=7, nothing=None)
    r = files.metadata(spark, str(tmp_path / "metadata.json")).first()
    assert (r.city_id, r.built_at, r.digest, list(r.bbox), r.attribution) == ("square", dt.datetime(2026, 1, 2, 3, 4), city.digest, [0.0, 0.0, 10.0, 20.0], ["Somebody"])
    assert [p.name for p in tmp_path.iterdir()] == ["metadata.json"]


def test_area_of_use(spark):
    ring = lambda *v: [[{"x": x, "y": y} for x, y in v]]
    kind = "id long, rings array<array<struct<x:double,y:double>>>"
    here = spark.createDataFrame([(1, ring((-4.8, 37.8), (-4.7, 37.8), (-4.7, 37.9)))], kind)
    got = [files.area_of_use(here, z).first() for z in (30, 31)]
    assert [(r.ok, r.zone) for r in got] == [(True, 30), (False, 30)] and got[0].west == -4.8
    assert not files.area_of_use(here.limit(0), 30).first().ok


def test_parking_places(spark):
    long, short = files.TIMETABLES
    names = [f"C/ Málaga<br>12 PLAZAS EN BATERÍA<br>HORARIO: {long}", f"Avda. 3 PLAZAS 7 PLAZAS EN CORDON HORARIO: {short}", "Calle 4 PLAZAS EN CORDON HORARIO: SIEMPRE", "Otra cosa", None]
    got = [tuple(r)[1:] for r in files.parking_places(spark.createDataFrame([(n,) for n in names], "name string")).collect()]
    assert got[0][:4] == ("ok", "C/ Malaga", 12, "bateria") and [tuple(s) for s in got[0][4]] == [("mo-fr", "09:00", "14:00"), ("mo-fr", "17:00", "21:00"), ("sa", "09:00", "14:00")]
    assert got[1][:4] == ("ok", "Avda. 3 PLAZAS", 7, "cordon") and len(got[1][4]) == 1
    assert got[2][0] == "unknown_timetable" and got[2][2] == 4 and got[3] == got[4] == ("unknown_text", None, None, None, None)


def test_march_against_a_plain_walk(spark):
    rng = np.random.default_rng(5)
    n, sectors, azimuth, elevation = 24, 16, 100.0, 20.0
    dsm, cover = rng.choice([0.0, 0.0, 0.0, 4.0, 9.0], (n, n)), rng.integers(0, 3, (n, n))
    cells = spark.createDataFrame([(r, c, float(dsm[r, c]), 0.0, int(cover[r, c])) for r in range(n) for c in range(n)], "row int, col int, dsm float, dtm float, landcover smallint")
    q = {(r, c): [int(x) for x in rng.integers(0, 5, sectors)] for r in range(n) for c in range(n)}
    sky = spark.createDataFrame([(*k, v) for k, v in q.items()], "row int, col int, q array<smallint>")

    def walk(r, c, at):
        for dr, dc, entry, _ in ray_cells(at, 12.0, 1.0):
            if not (0 <= r + dr < n and 0 <= c + dc < n):
                return None
            if math.degrees(math.atan2(dsm[r + dr, c + dc] - 1.6, entry)) >= elevation:
                return int(cover[r + dr, c + dc]) or None

    # 100 degrees lies between the sectors 4 (90) and 5 (112.5).
    want = {(r, c): walk(r, c, azimuth) or walk(r, c, 90.0 if q[r, c][4] >= q[r, c][5] else 112.5) for r in range(n) for c in range(n)}
    got = {(r.row, r.col): r.blocker for r in horizon.march_blocker(cells, sky, azimuth, elevation, sectors, 12.0, 1.0).collect()}
    assert got == want and any(walk(*k, azimuth) is None and v for k, v in want.items())


def test_area_and_timeline(spark):
    """Cells outside the area cast shade but have no answer."""
    city = City("cube", "Cube", "Europe/Madrid", 30, (341000.0, 4192000.0, 341060.0, 4192080.0), 1.0, 64, 60.0)
    xs, ys = np.meshgrid(np.arange(60) + 0.5, np.arange(80) + 0.5)
    roof = (xs > 20) & (xs < 40) & (ys > 10) & (ys < 30)
    pts = spark.createDataFrame(pd.DataFrame({"x": 341000 + xs.ravel(), "y": 4192000 + ys.ravel(), "z": np.where(roof, 20.0, 0.0).ravel(), "cls": np.where(roof, 6, 2).ravel(), "ret": 1, "withheld": False, "overlap": False}))
    lonlat = lambda x, y: spark.range(1).select(*from_utm(F.lit(341000.0 + x), F.lit(4192000.0 + y), 30)).first()
    ring = [dict(zip("xy", map(float, lonlat(x, y)), strict=True)) for x, y in ((0, 35), (60, 35), (60, 80), (0, 80))]
    sky = engine.build(pts, city, tile=32, area=spark.createDataFrame([(1, [ring])], "id long, rings array<array<struct<x:double,y:double>>>")).cache()
    assert sky.count() == 60 * 45 and sky.agg(F.max("row")).first()[0] == 44
    asked = [(n, *lonlat(x, y)[::-1], dt.date(2026, 12, 21)) for n, x, y in (("north", 33.5, 40.5), ("south", 33.5, 5.5), ("away", 900.0, 0.0))]
    day = spark.createDataFrame(asked, "id string, lat double, lon double, day date")
    got = engine.timeline(day, sky, city, now=dt.datetime(2026, 12, 21, 12, 20)).collect()
    runs = sorted((r for r in got if r.id == "north"), key=lambda r: r.start)
    assert [r.state for r in runs] == ["sun", "shade", "sun"] and {r.status for r in runs} == {"ok"}
    assert {r.shaded_until for r in runs} == {runs[1].end}
    assert sorted((r.id, r.status, r.state) for r in got if r.id != "north") == [("away", "outside", None), ("south", "outside", None)]
    later = engine.timeline(day, sky, city, now=dt.datetime(2026, 12, 22, 12, 20))
    assert {r.shaded_until for r in later.collect()} == {None}
