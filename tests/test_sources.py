"""Readers, writers, streams, and the engine end to end."""

from __future__ import annotations

import datetime as dt
import json
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from umbra import engine
from umbra.city import City
from umbra.operators.rays import RayCells
from umbra.plans import queries
from umbra.sources import files, las
from umbra.streaming import limits, progress


def write_las(path, xyz, cls, fmt=6, minor=4):
    size = 30 if fmt == 6 else 28
    head = bytearray(375 if minor == 4 else 227)
    head[:4] = b"LASF"
    head[24:26] = bytes([1, minor])
    struct.pack_into("<HHHII", head, 90, 32, 2024, len(head), len(head), 0)
    struct.pack_into("<BHI", head, 104, fmt, size, 0 if minor == 4 else len(xyz))
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 0, 0, 0)
    x, y, z = np.array(xyz).T
    struct.pack_into("<6d", head, 179, x.max(), x.min(), y.max(), y.min(), z.max(), z.min())
    if minor == 4:
        struct.pack_into("<Q", head, 247, len(xyz))
    body = b""
    for (a, b, c), k in zip(xyz, cls, strict=True):
        record = bytearray(size)
        struct.pack_into("<3i", record, 0, round(a * 100), round(b * 100), round(c * 100))
        record[14] = 0x11
        if fmt == 6:
            record[15], record[16] = (8 if k == 12 else 0), k
        else:
            record[15] = k
        body += bytes(record)
    path.write_bytes(bytes(head) + body)


def test_las(spark, tmp_path):
    write_las(tmp_path / "a.las", [(1.25, 2.5, 3.0), (9, 9, 1)], [2, 12])
    write_las(tmp_path / "b.LAS", [(11.0, 2.5, 3.0), (19, 9, 1)], [6, 12], fmt=3, minor=2)
    spark.dataSource.register(las.LasSource)
    rows = spark.read.format("las").option("chunk", "1").load(str(tmp_path)).orderBy("x").collect()
    assert [(r.x, r.cls, r.ret, r.overlap, r.file) for r in rows] == [(1.25, 2, 1, False, "a.las"), (9.0, 12, 1, True, "a.las"), (11.0, 6, 1, False, "b.LAS"), (19.0, 12, 1, False, "b.LAS")]
    assert rows[0].created == dt.date(2024, 2, 1)
    found = [str(p) for p in sorted(tmp_path.iterdir())]
    assert len(las.covering(found, (2, 3, 8, 8))) == 1
    with pytest.raises(ValueError, match="no point file"):
        las.covering(found, (2, 3, 30, 8))
    assert las.expected_tiles((1000, 2000, 2000, 3000), 0) == [(1, 3)]


def test_area_and_geojson(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]
    for body, n in (({"type": "Polygon", "coordinates": square}, 1), ({"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}}, 2), ({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": square}}] * 3}, 3)):
        (tmp_path / "a.json").write_text(json.dumps(body))
        assert files.area(spark, str(tmp_path / "a.json")).count() == n
    feature = json.loads(files.geojson(files.area(spark, str(tmp_path / "a.json"))).first().feature)
    assert feature["geometry"]["coordinates"] == [[[float(a), float(b)] for a, b in square[0]]]
    (tmp_path / "a.json").write_text(json.dumps({"type": "Polygon", "coordinates": [[[341000, 4192000], [341001, 4192000], [341000, 4192001]]]}))
    with pytest.raises(Exception, match="not degrees"):
        files.area(spark, str(tmp_path / "a.json")).collect()


def test_cadastre(spark):
    part = lambda k, s: f'<b:BuildingPart gml:id="{k}"><gml:PolygonPatch><gml:exterior><gml:posList>0 0 {s} 0 {s} {s} 0 {s}</gml:posList></gml:exterior></gml:PolygonPatch></b:BuildingPart>'
    page = lambda *p: f'<r xmlns:b="b" xmlns:gml="g">{"".join(p)}</r>'
    df = spark.createDataFrame([(1, page(part("x", 3), part("tiny", 1))), (2, page(part("x", 4), part("y", 5))), (3, "<broken")], "window long, gml string")
    got = {r.id: r.rings[0][2].x for r in files.cadastre(df).collect()}
    assert got == {"x": 4.0, "y": 5.0}
    assert files.request_windows(spark, (10, 10, 990, 400)).count() == 2


def test_viewer(spark):
    line = lambda k: f"var str = [[{k}.0, 1], [{k}.5, 2]];\ncolor: '#{{}}'\n"
    marker = lambda n, i: f"geometry: new ol.geom.Point(ol.proj.fromLonLat([1, 2])), name: '{n}' x src: './marcas/{i}.png'\n"
    html = line(1).format("007bfe") + line(2).format("ff0000") + line(3).format("007BFE") + marker("A<br>ñ", "blue") + line(4).format("007bfe") + marker("other", "red") + line(5).format("007bfe")
    got = files.viewer_zones(spark.createDataFrame([(1, html)], "page int, html string"), "007bfe", "blue").collect()
    assert [(r.name, r.n_lines) for r in got] == [("A<br>ñ", 2)]
    far = line(1).format("007bfe") + "geometry: new ol.geom.Point(" + " " * 5000 + "name: 'Far'," + "x" * 9000 + "src: './marcas/blue.png'"
    assert [(r.name, r.n_lines) for r in files.viewer_zones(spark.createDataFrame([(1, far)], "page int, html string"), "007bfe", "blue").collect()] == [("Far", 1)]
    assert spark.range(1).select(files.plain(F.lit("A<br/>ñ  é"))).first()[0] == "A n e"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, city_id string")
    files.write_verified(df, str(tmp_path / "v"))
    files.replace_city(df, str(tmp_path / "c"))
    files.replace_city(df.where("city_id = 'x'").withColumn("v", F.lit("new")), str(tmp_path / "c"))
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "c")).collect()) == [(1, "new"), (2, "b")]
    m = json.loads(files.manifest(spark.createDataFrame([("2026-01-02", "b"), ("2026-01-01", "a")], "at string, file string"), (0, 0, 1, 1), (12, 19), basemap_url=None))
    assert [i["file"] for i in m["instants"]] == ["a", "b"] and "basemap_url" not in m


def test_event_lines(spark, tmp_path):
    lines = ['{"city":"c","step":"build","kind":"start","at":"2026-01-01T00:00:00Z","done":0,"total":9}', '{"city":"c","step":"build","kind":"tick","at":"2026-01-01T00:01:00Z","done":4,"total":9}', '{"city":"c","st']
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "a.jsonl").write_text("\n".join(lines))
    assert files.events(spark, str(tmp_path / "e")).count() == 2
    q = progress.latest(progress.tail(spark, str(tmp_path / "e"))).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.step, r.kind, r.done) for r in spark.table("latest").collect()] == [("build", "tick", 4)]


def test_rate_limit(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    rows = [(1, "/p", k, t0 + dt.timedelta(seconds=s)) for k, s in enumerate([0, 1, 2, 50, 60.5, 61, 61.5])] + [(2, "/p", 9, t0)]
    hits = spark.createDataFrame(rows, "client long, path string, event_id long, ts timestamp")
    want = {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 6: False, 9: True}
    assert {r.event_id: r.ok for r in limits.accepted(hits, 2, 60).collect()} == want
    hits.coalesce(1).write.parquet(str(tmp_path / "h"))
    stream = spark.readStream.schema(hits.schema).parquet(str(tmp_path / "h"))
    q = limits.accepted_stream(stream, 2, 60).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.event_id: r.ok for r in spark.table("limited").collect()} == want


def test_windows_stream(spark, data, tmp_path):
    batch = progress.windowed(spark.read.parquet(f"{data}/events.parquet"), "1 hour")
    assert batch.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{data}/events.parquet").count()


def test_table_function(spark):
    spark.udtf.register("ray_cells", RayCells)
    assert spark.sql("SELECT d_row, d_col FROM ray_cells(90.0, 2.0, 1.0)").collect() == [(0, 1), (0, 2)]


def test_engine_on_a_cube(spark):
    """A 20 m cube; just north of it lies shade at winter noon, at summer noon it does not."""
    city = City("cube", "Cube", "Europe/Madrid", 30, (341000.0, 4192000.0, 341060.0, 4192080.0), 1.0, 64, 60.0)
    xs, ys = np.meshgrid(np.arange(60) + 0.5, np.arange(80) + 0.5)
    roof = (xs > 20) & (xs < 40) & (ys > 10) & (ys < 30)
    pts = pd.DataFrame({"x": 341000 + xs.ravel(), "y": 4192000 + ys.ravel(), "z": np.where(roof, 20.0, 0.0).ravel(), "cls": np.where(roof, 6, 2).ravel(), "ret": 1, "withheld": False, "overlap": False})
    sky = engine.build(spark.createDataFrame(pts), city, tile=32).cache()
    assert sky.count() == 4800
    from umbra.functions.projection import from_utm

    lonlat = [spark.range(1).select(*from_utm(F.lit(x), F.lit(y), 30)).first() for x, y in ((341033.5, 4192040.5), (341033.5, 4192070.5), (341200.0, 4192000.0))]
    asked = [(f"{n}-{s}", p[1], p[0], at) for (n, p) in zip(("near", "far", "off"), lonlat, strict=True) for s, at in (("winter", dt.datetime(2026, 12, 21, 12, 20)), ("summer", dt.datetime(2026, 6, 21, 12, 20)), ("night", dt.datetime(2026, 6, 21, 0, 0)))]
    q = spark.createDataFrame(asked, "id string, lat double, lon double, at timestamp")
    got = {r.id: (r.status, r.state, r.shade_type) for r in engine.shade_at(q, sky, city).collect()}
    assert got["near-winter"] == ("ok", "shade", "building") and got["near-summer"] == ("ok", "sun", None)
    assert got["far-winter"] == ("ok", "sun", None) and got["near-night"] == ("night", "night", None) and got["off-summer"] == ("outside", None, None)
    day = q.where("id = 'near-winter'").select("id", "lat", "lon", F.lit("2026-12-21").cast("date").alias("day"))
    runs = engine.timeline(day, sky, city).orderBy("start").collect()
    assert [r.state for r in runs] == ["sun", "shade", "sun"] and runs[1].end - runs[1].start > dt.timedelta(hours=2)
    zones = spark.createDataFrame([(z, 0, i, *lonlat["AB".index(z)]) for z in "AB" for i in (0, 1)], "zone string, line int, i int, lon double, lat double")
    parked = engine.parking_nearby(q.where("id = 'near-winter'"), zones, sky, city, 50.0).collect()
    assert [(r.zone, r.state, r.distance) for r in sorted(parked, key=lambda r: r.rank)] == [("A", "shade", 0.0), ("B", "sun", 30.0)]
    until = {r.zone: r.shaded_until for r in parked}
    assert until["B"] is None and until["A"] > dt.datetime(2026, 12, 21, 12, 20)
    again = q.where("id = 'near-winter'").withColumn("at", F.lit(until["A"]))
    assert engine.shade_at(again, sky, city).first().state != "shade"


def test_engine_routes(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 100.0, 0.0)], "id int, x double, y double")
    edges = spark.createDataFrame([(0, 0, 1, 100.0, 1.0, 0.0)], "edge int, u int, v int, len double, sun double, veg double")
    shape = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 100.0, 0.0)], "line int, i int, x double, y double")
    asked = spark.createDataFrame([(1, 10.0, 5.0, 80.0, 0.0, 1.0, 0.0), (2, 9000.0, 0.0, 80.0, 0.0, 1.0, 0.0)], "id long, x_a double, y_a double, x_b double, y_b double, alpha double, beta double")
    got = engine.shaded_routes(asked, nodes, edges, shape).collect()
    assert sorted((r.query, r.status, r.alpha, r.length) for r in got) == [(1, "ok", 0.0, 70.0), (1, "ok", 1.0, 70.0), (2, "no_snap", 1.0, None)]


def test_driver_contract(spark):
    assert driver.entry(spark).limit(5).count() == 5
    assert set(driver.oracle_sql()) <= set(driver.queries()) and len(queries.QUERIES) >= 60
