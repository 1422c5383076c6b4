from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbra.functions.projection import to_utm
from umbra.operators import resample
from umbra.operators.binning import hillshade
from umbra.plans import machine, registry


def field(spark, values):
    return spark.createDataFrame([(r, c, float(values[r, c])) for r in range(values.shape[0]) for c in range(values.shape[1])], "row int, col int, v double")


def test_resample(spark):
    ramp = np.add.outer(np.arange(8.0) * 10, np.arange(8.0))
    cells = field(spark, ramp)
    coarse = {(r.px, r.py): r.v for r in resample.resample(cells, "v", (F.col("col") + 0.5) / 2, (F.col("row") + 0.5) / 2, 2.0).collect()}
    assert coarse[(0, 0)] == pytest.approx(5.5) and len(coarse) == 16
    fine = {(r.px, r.py): r.v for r in resample.resample(cells, "v", (F.col("col") + 0.5) * 4, (F.col("row") + 0.5) * 4, 0.25).collect()}
    for px, py in ((10, 10), (13, 18), (20, 9)):  # away from the edges a plane stays a plane
        assert fine[(px, py)] == pytest.approx((py + 0.5) / 4 * 10 - 5 + (px + 0.5) / 4 - 0.5)
    labels = {(r.px, r.py): r.v for r in resample.nearest(cells, "v", (F.col("col") + 0.5) * 4, (F.col("row") + 0.5) * 4, 0.25).collect()}
    assert labels[(9, 13)] == ramp[3, 2]


def test_blur_keeps_constants(spark):
    got = resample.blur(field(spark, np.full((6, 7), 3.0)), "v", 1.0).collect()
    assert all(r.blurred == pytest.approx(3.0) for r in got)


def test_hillshade_of_a_slope(spark):
    east = np.tile(np.arange(5.0), (5, 1))  # rises to the east by 45 degrees
    lit = {(r.row, r.col): r.light for r in hillshade(field(spark, east), "v", 1.0, azimuth=270.0, altitude=45.0).collect()}
    assert all(v == pytest.approx(1.0) for v in lit.values())  # faces the light


def test_bounds(spark):
    b = resample.projected_bounds((-4.82, 37.86, -4.76, 37.90), lambda x, y: to_utm(x, y, 30), spark)
    assert b[0] < b[2] and b[1] < b[3] and 330000 < b[0] < 350000


def test_machine_and_registry(spark, tmp_path):
    (tmp_path / "meminfo").write_text("MemTotal: 9 kB\nMemAvailable: 1000 kB\n")
    (tmp_path / "memory.max").write_text("600000")
    (tmp_path / "memory.current").write_text("500000")
    (tmp_path / "memory.stat").write_text("inactive_file 200000\nanon 1\n")
    (tmp_path / "cpu.max").write_text("200000 100000")
    m = machine.discover(tmp_path, tmp_path)
    assert m.memory == 300000 and m.cores <= 2
    assert machine.admit(m, 100000, 2)[0] and not machine.admit(m, 200000, 2)[0] and machine.admit(m, 10**9, 1)[0]
    cities = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 1)], "city string, epsg int")
    built = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], "city string, epsg int")
    graphs = spark.createDataFrame([("a", True)], "city string, coherent boolean")
    got = {r.city: (r.verdict, r.routes) for r in registry.registry(cities, built, graphs).collect()}
    assert got == {"a": ("serve", True), "b": ("abort", False), "c": ("serve", False), "d": ("skip", False)}
    assert registry.reconciled({"basemap_url": "x", "k": 1}, False) == {"k": 1}


def test_horizon_sweep_runs_the_kernel(spark, data, monkeypatch):
    """The query is the tile kernel, and its codes are those of the relational skyline."""
    from pyspark.sql import functions as F

    from umbra.functions import angles
    from umbra.operators import horizon
    from umbra.plans import queries

    sky = horizon.angles(horizon.relational(queries._eye_cells(spark, data), queries.SECTORS16, queries.REACH, 1.0, 6))
    code = lambda c: angles.quantise_angle(F.col(c)).cast("int")
    want = sky.groupBy("row", "col").agg(F.sum(code("angle")), F.max(code("angle")), F.sum(code("angle_felled"))).collect()
    monkeypatch.setattr(horizon, "relational", None)
    got = queries.horizon_sweep(spark, data)
    assert [f.dataType.simpleString() for f in got.schema][2:] == ["bigint", "int", "bigint"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
