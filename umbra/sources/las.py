"""LAS point files as a Spark data source: one input partition for each file and range of points."""

from __future__ import annotations

import datetime
import glob
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "x double, y double, z float, cls tinyint, ret tinyint, withheld boolean, overlap boolean, synthetic boolean, file string, created date"
CHUNK = 2_000_000


def header(path: str) -> dict:
    """The public header block."""
    with open(path, "rb") as f:
        raw = f.read(375)
    if raw[:4] != b"LASF":
        raise ValueError(f"{path} is no LAS file")
    major, minor = raw[24], raw[25]
    day, year = struct.unpack_from("<HH", raw, 90)
    start = struct.unpack_from("<I", raw, 96)[0]
    kind, length, count = struct.unpack_from("<BHI", raw, 104)
    if kind & 0x80:
        raise ValueError(f"{path} is compressed; uncompressed LAS or Parquet points are read")
    scale, offset = struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155)
    x1, x0, y1, y0 = struct.unpack_from("<4d", raw, 179)
    if (major, minor) >= (1, 4) and not count:
        count = struct.unpack_from("<Q", raw, 247)[0]
    created = datetime.date(year, 1, 1) + datetime.timedelta(day - 1) if year and day else None
    return {"version": (major, minor), "start": start, "format": kind, "length": length, "count": count, "scale": scale, "offset": offset, "box": (x0, y0, x1, y1), "created": created}


def points(path: str, first: int, n: int) -> pa.RecordBatch:
    """Points first..first+n of a file."""
    h = header(path)
    with open(path, "rb") as f:
        f.seek(h["start"] + first * h["length"])
        raw = np.frombuffer(f.read(n * h["length"]), np.uint8).reshape(-1, h["length"])
    at = lambda i, kind: np.ascontiguousarray(raw[:, i:i + np.dtype(kind).itemsize]).view(kind).ravel()
    xyz = [at(4 * k, "<i4") * h["scale"][k] + h["offset"][k] for k in range(3)]
    if h["format"] >= 6:
        ret, flags, cls = raw[:, 14] & 15, raw[:, 15], raw[:, 16]
        overlap, withheld, synthetic = flags & 8, flags & 4, flags & 1
    else:  # the older formats have no overlap flag; class 12 says it
        ret, cls, flags = raw[:, 14] & 7, raw[:, 15] & 31, raw[:, 15]
        overlap, withheld, synthetic = np.zeros(len(raw)), flags & 128, flags & 32
    size = len(raw)
    return pa.RecordBatch.from_arrays(
        [pa.array(xyz[0]), pa.array(xyz[1]), pa.array(xyz[2].astype(np.float32)), pa.array(cls.astype(np.int8)), pa.array(ret.astype(np.int8)), pa.array(withheld > 0), pa.array(overlap > 0), pa.array(synthetic > 0), pa.array([os.path.basename(path)] * size), pa.array([h["created"]] * size, pa.date32())],
        names=[c.split()[0] for c in SCHEMA.split(", ")])


class _Range(InputPartition):
    def __init__(self, path: str, first: int, n: int):
        self.path, self.first, self.n = path, first, n


class _Reader(DataSourceReader):
    def __init__(self, options):
        found = sorted(glob.glob(os.path.join(options["path"], "*.[lL][aA][sS]"))) if os.path.isdir(options["path"]) else [options["path"]]
        box = options.get("box")
        self.files = covering(found, tuple(map(float, box.split(",")))) if box else found
        self.chunk = int(options.get("chunk", CHUNK))

    def partitions(self):
        return [_Range(p, k, min(self.chunk, header(p)["count"] - k)) for p in self.files for k in range(0, header(p)["count"], self.chunk)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        yield points(partition.path, partition.first, partition.n)


class LasSource(DataSource):
    """spark.dataSource.register(LasSource); spark.read.format('las').option('box', 'x0,y0,x1,y1').load(folder)"""

    @classmethod
    def name(cls):
        return "las"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def covering(files: list[str], box: tuple[float, float, float, float], slack: float = 1.0) -> list[str]:
    """The files whose header box meets the box; raises unless together they cover it (each grown by ``slack``)."""
    x0, y0, x1, y1 = box
    boxes = {p: header(p)["box"] for p in files}
    met = [p for p, (a, b, c, d) in boxes.items() if a <= x1 and c >= x0 and b <= y1 and d >= y0]
    xs = sorted({x0, x1, *(min(max(v, x0), x1) for p in met for v in (boxes[p][0] - slack, boxes[p][2] + slack))})
    ys = sorted({y0, y1, *(min(max(v, y0), y1) for p in met for v in (boxes[p][1] - slack, boxes[p][3] + slack))})
    for u, v in zip(xs, xs[1:], strict=False):
        for s, t in zip(ys, ys[1:], strict=False):
            mx, my = (u + v) / 2, (s + t) / 2
            if not any(boxes[p][0] - slack <= mx <= boxes[p][2] + slack and boxes[p][1] - slack <= my <= boxes[p][3] + slack for p in met):
                raise ValueError(f"no point file covers ({mx:.1f}, {my:.1f})")
    return met


def expected_tiles(box: tuple[float, float, float, float], buffer: float, km: int = 1) -> list[tuple[int, int]]:
    """(easting, northing) kilometres of the north-west corners of the tiles a padded box meets."""
    size = 1000 * km
    span = lambda low, high: range(int((low - buffer) // size), -int(-(high + buffer) // size))
    return [(e * km, (n + 1) * km) for e in span(box[0], box[2]) for n in span(box[1], box[3])]
