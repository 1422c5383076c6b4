"""Map tiles: paletted PNG, archives of tiles, resampling, and distance fields."""

from __future__ import annotations

import gzip
import json
import math
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from umbra.functions.projection import hilbert_id
from umbra.operators.shade import state_code

SIDE = 256
#: Fixed by the file format: the position of each state in the palette.
STATES = (0, 1, 2, 3, 255)
RELIEF = (0, 1, 2, 3, 4)
SIGNATURE = b"\x89PNG\r\n\x1a\n"


# PNG

def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def palette(colors: dict[int, tuple[int, int, int, int]], states: tuple[int, ...] = STATES) -> tuple[bytes, bytes]:
    """(RGB entries, alphas) in the order of the states."""
    return b"".join(bytes(colors[s][:3]) for s in states), bytes(colors[s][3] for s in states)


def encode_png(states_of: np.ndarray, colors: dict[int, tuple[int, int, int, int]], states: tuple[int, ...] = STATES) -> bytes:
    """A tile of state codes as an 8-bit paletted image."""
    index = np.zeros(256, np.uint8)
    index[list(states)] = range(len(states))
    rows, cols = states_of.shape
    lines = np.zeros((rows, cols + 1), np.uint8)
    lines[:, 1:] = index[states_of]
    rgb, alpha = palette(colors, states)
    head = struct.pack(">IIBBBBB", cols, rows, 8, 3, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"PLTE", rgb) + _chunk(b"tRNS", alpha) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(png):
        n = struct.unpack_from(">I", png, at)[0]
        yield png[at + 4:at + 8], png[at + 8:at + 8 + n]
        at += n + 12


def decode_png(png: bytes, states: tuple[int, ...] = STATES) -> np.ndarray:
    """State codes of an image that ``encode_png`` made."""
    parts = list(chunks(png))
    cols, rows = struct.unpack_from(">II", parts[0][1])
    lines = np.frombuffer(zlib.decompress(b"".join(b for k, b in parts if k == b"IDAT")), np.uint8).reshape(rows, cols + 1)
    return np.array(states, np.uint8)[lines[:, 1:]]


def recolored(png: bytes, rgb: bytes, alpha: bytes) -> bytes:
    """The same pixels under another palette of the same size."""
    fresh = {b"PLTE": rgb, b"tRNS": alpha}
    parts = list(chunks(png))
    for kind, body in fresh.items():
        if [len(b) for k, b in parts if k == kind] != [len(body)]:
            raise ValueError(f"the image needs one {kind.decode()} chunk of {len(body)} bytes")
    return SIGNATURE + b"".join(_chunk(k, fresh.get(k, b)) for k, b in parts)


def recolor(tiles: DataFrame, colors: dict[int, tuple[int, int, int, int]], states: tuple[int, ...] = STATES) -> DataFrame:
    """Tiles (.., png) under another palette."""
    rgb, alpha = palette(colors, states)

    @F.pandas_udf("binary")
    def change(png: pd.Series) -> pd.Series:
        return png.map(lambda x: recolored(bytes(x), rgb, alpha))

    return tiles.withColumn("png", change("png"))


def blank(codes: Column, colors: dict[int, tuple[int, int, int, int]]) -> Column:
    """Whether nothing of an array of codes is visible under a palette."""
    seen = [s for s, c in colors.items() if c[3] > 0]
    return ~F.exists(codes, lambda v: v.isin(*seen)) if seen else F.lit(True)


# Archives (PMTiles version 3, as published)

def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _varints(data: bytes) -> list[int]:
    out, value, shift = [], 0, 0
    for b in data:
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(value)
            value = shift = 0
    return out


def _directory(entries: list[tuple[int, int, int, int]]) -> bytes:
    """(tile id, run, length, offset) rows, packed."""
    last, parts, ids = 0, [_varint(len(entries))], []
    for tile, *_ in entries:
        ids.append(_varint(tile - last))
        last = tile
    offsets = [_varint(0 if i and e[3] == entries[i - 1][3] + entries[i - 1][2] else e[3] + 1) for i, e in enumerate(entries)]
    return gzip.compress(b"".join(parts + ids + [_varint(e[1]) for e in entries] + [_varint(e[2]) for e in entries] + offsets), mtime=0)


def _entries(data: bytes) -> list[tuple[int, int, int, int]]:
    v = _varints(gzip.decompress(data))
    n = v[0]
    ids, runs, sizes, offs = (v[1 + k * n:1 + (k + 1) * n] for k in range(4))
    out, tile = [], 0
    for i in range(n):
        tile += ids[i]
        offset = out[-1][3] + out[-1][2] if offs[i] == 0 else offs[i] - 1
        out.append((tile, runs[i], sizes[i], offset))
    return out


LEAF = 4096
_HEAD = "<7sB" + "Q" * 11 + "6B" + "4i" + "B2i"


def write_archive(path: str, tiles: Iterable[tuple[int, bytes]], bounds: tuple[float, float, float, float], zooms: tuple[int, int], metadata: dict | None = None) -> int:
    """Tiles in order of their ids into one file, complete or not at all; equal neighbours share bytes."""
    entries: list[tuple[int, int, int, int]] = []
    body, seen, n, at = [], {}, 0, 0
    for tile, data in tiles:
        n += 1
        where = seen.get(data)
        if where is None:
            where = seen[data] = at
            body.append(data)
            at += len(data)
        last = entries[-1] if entries else None
        if last and last[3] == where and last[0] + last[1] == tile:
            entries[-1] = (last[0], last[1] + 1, last[2], where)
        else:
            entries.append((tile, 1, len(data), where))
    leaves = b""
    root = _directory(entries)
    if len(root) > 16384 - 127:
        tops = []
        for k in range(0, len(entries), LEAF):
            leaf = _directory(entries[k:k + LEAF])
            tops.append((entries[k][0], 0, len(leaf), len(leaves)))
            leaves += leaf
        root = _directory(tops)
    meta = gzip.compress(json.dumps(metadata or {}).encode(), mtime=0)
    start = 127 + len(root) + len(meta)
    w, s, e, north = (round(b * 1e7) for b in bounds)
    low, high = zooms
    head = struct.pack(_HEAD, b"PMTiles", 3, 127, len(root), 127 + len(root), len(meta), start, len(leaves), start + len(leaves), at, n, len(entries), len(body), 1, 2, 1, 2, low, high, w, s, e, north, (low + high) // 2, (w + e) // 2, (s + north) // 2)
    partial = f"{path}.partial"
    with open(partial, "wb") as f:
        f.write(head + root + meta + leaves)
        f.writelines(body)
    os.replace(partial, path)
    return n


def read_archive(path: str) -> Iterator[tuple[int, bytes]]:
    """(tile id, bytes) in order."""
    with open(path, "rb") as f:
        data = f.read()
    head = struct.unpack_from(_HEAD, data)
    if head[0] != b"PMTiles":
        raise ValueError(f"{path} is no tile archive")
    root_at, root_n, _, _, leaf_at, _, tile_at = head[2:9]

    def walk(part: bytes) -> Iterator[tuple[int, bytes]]:
        for tile, run, size, offset in _entries(part):
            if run == 0:
                yield from walk(data[leaf_at + offset:leaf_at + offset + size])
            for k in range(run):
                yield tile + k, data[tile_at + offset:tile_at + offset + size]

    yield from walk(data[root_at:root_at + root_n])


def archive_rows(tiles: DataFrame, path: str, bounds: tuple[float, float, float, float], zooms: tuple[int, int]) -> int:
    """A DataFrame (tile_id, png) into an archive: sorted by range on the executors, streamed to the one file by the driver."""
    ordered = tiles.select("tile_id", "png").repartitionByRange("tile_id").sortWithinPartitions("tile_id")
    return write_archive(path, ((r["tile_id"], bytes(r["png"])) for r in ordered.toLocalIterator(prefetchPartitions=True)), bounds, zooms)


# Resampling to tiles

def _pixels(cells: DataFrame, bounds: tuple[float, float, float, float], zoom: int, shape: tuple[int, int]) -> tuple[DataFrame, Column, Column]:
    """Each cell with the pixels it bears on: (cells spread to px, py; weight; squared distance).

    Along an axis on which pixels are wider than cells a cell bears on the pixel its centre
    lies in; where they are narrower, on those within a cell's width, by distance (a tent).
    """
    n = float(1 << zoom) * SIDE
    west, south, east, north = bounds
    height, width = shape
    lon = F.lit(west) + (F.col("col") + 0.5) * ((east - west) / width)
    lat = F.lit(north) - (F.col("row") + 0.5) * ((north - south) / height)
    down = lambda v: (1 - math.log(math.tan(math.radians(v)) + 1 / math.cos(math.radians(v))) / math.pi) / 2 * n
    wide, high = (east - west) / 360 * n / width, (down(south) - down(north)) / height  # pixels a cell
    at = cells.withColumn("_u", (lon + 180) / 360 * n).withColumn("_w", (1 - F.log(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / math.pi) / 2 * n)

    def span(c: str, size: float) -> Column:
        if size <= 1:
            return F.array(F.floor(c))
        return F.sequence(F.ceil(F.col(c) - 0.5 - size).cast("long"), F.floor(F.col(c) - 0.5 + size).cast("long"))

    tent = lambda p, c, size: F.lit(1.0) if size <= 1 else F.greatest(F.lit(0.0), 1 - F.abs(F.col(p) + 0.5 - F.col(c)) / size)
    spread = at.withColumn("px", F.explode(span("_u", wide))).withColumn("py", F.explode(span("_w", high)))
    across, along = F.col("px") + 0.5 - F.col("_u"), F.col("py") + 0.5 - F.col("_w")
    return spread, tent("px", "_u", wide) * tent("py", "_w", high), across * across + along * along


def pixel_codes(cells: DataFrame, bounds: tuple[float, float, float, float], zoom: int, shape: tuple[int, int]) -> DataFrame:
    """(px, py, code) of one zoom from cells (row, col, margin, margin_felled, blocker_at, canopy, covered).

    The margins (sun over skyline, with and without trees) are resampled first, by mean where
    pixels are wider than cells and else bilinearly, over covered cells; what is a label comes
    from the nearest cell; the state is decided last, so that no state has a say by its number.
    """
    spread, weight, square = _pixels(cells, bounds, zoom, shape)
    lit = F.coalesce("covered", F.lit(False))
    mean = lambda c: F.sum(F.when(lit, F.col("k") * F.col(c))) / F.sum(F.when(lit & F.col(c).isNotNull(), F.col("k")))
    near = F.min_by(F.struct("blocker_at", "canopy", "covered"), F.struct(square, "row", "col"))
    fields = spread.withColumn("k", weight).where("k > 0").groupBy("px", "py").agg(mean("margin").alias("margin"), mean("margin_felled").alias("felled"), near.alias("near"))
    judged = state_code(fields.select("px", "py", F.lit(0.0).alias("elevation"), (-F.col("margin")).alias("horizon"), (-F.col("felled")).alias("horizon_felled"), "near.*"))
    return judged.select("px", "py", "code")


def nearest_codes(cells: DataFrame, bounds: tuple[float, float, float, float], zoom: int, shape: tuple[int, int]) -> DataFrame:
    """(px, py, code) of one zoom from cells (row, col, code): each pixel shows its nearest cell."""
    spread, weight, square = _pixels(cells, bounds, zoom, shape)
    return spread.where(weight > 0).groupBy("px", "py").agg(F.min_by("code", F.struct(square, "row", "col")).alias("code"))


def draw(pixels: DataFrame, zoom: int, colors: dict[int, tuple[int, int, int, int]], states: tuple[int, ...] = STATES, keep_blank: bool = False) -> DataFrame:
    """(tile_id, x, y, png) from (px, py, code); tiles that show nothing are left out unless kept."""
    placed = pixels.select(F.floor(F.col("px") / SIDE).alias("x"), F.floor(F.col("py") / SIDE).alias("y"), (F.col("px") % SIDE).cast("int").alias("i"), (F.col("py") % SIDE).cast("int").alias("j"), F.col("code").cast("int").alias("code"))
    visible = {s for s, c in colors.items() if c[3] > 0}

    def paint(key, block: pd.DataFrame) -> pd.DataFrame:
        plane = np.full((SIDE, SIDE), states[-1], np.uint8)
        plane[block["j"], block["i"]] = block["code"].astype(np.uint8)
        if not keep_blank and not visible & set(np.unique(plane).tolist()):
            return pd.DataFrame({"tile_id": [], "x": [], "y": [], "png": []})
        tile = int(hilbert_id(np.array([key[0]]), np.array([key[1]]), zoom)[0])
        return pd.DataFrame({"tile_id": [tile], "x": [key[0]], "y": [key[1]], "png": [encode_png(plane, colors, states)]})

    return placed.groupBy("x", "y").applyInPandas(paint, "tile_id long, x long, y long, png binary")


def render(cells: DataFrame, bounds: tuple[float, float, float, float], zoom: int, shape: tuple[int, int], colors: dict[int, tuple[int, int, int, int]], states: tuple[int, ...] = STATES, keep_blank: bool = False) -> DataFrame:
    """(tile_id, x, y, png) of one zoom, from margins where cells have them, else from codes."""
    codes = pixel_codes if "margin" in cells.columns else nearest_codes
    return draw(codes(cells, bounds, zoom, shape), zoom, colors, states, keep_blank)


def pyramid(cells: DataFrame, bounds: tuple[float, float, float, float], zooms: range, shape: tuple[int, int], colors: dict[int, tuple[int, int, int, int]], states: tuple[int, ...] = STATES) -> DataFrame:
    """(zoom, tile_id, x, y, png) of all zooms; the lowest keeps its blank tiles, so that every map has an image."""
    levels = [render(cells, bounds, z, shape, colors, states, keep_blank=z == zooms[0]).withColumn("zoom", F.lit(z)) for z in zooms]
    return reduce(DataFrame.unionByName, levels)


def pyramid_totals(tiles: DataFrame, bounds: tuple[float, float, float, float], zooms: range) -> DataFrame:
    """(zoom, written, blank): how many tiles of the bounds are in the pyramid, and how many were left out."""
    west, south, east, north = bounds

    def count(zoom: int) -> int:
        n = 1 << zoom
        down = lambda v: (1 - math.log(math.tan(math.radians(v)) + 1 / math.cos(math.radians(v))) / math.pi) / 2 * n
        return (math.ceil((east + 180) / 360 * n) - math.floor((west + 180) / 360 * n)) * (math.ceil(down(south)) - math.floor(down(north)))

    whole = tiles.sparkSession.createDataFrame([(z, count(z)) for z in zooms], "zoom int, n long")
    written = tiles.groupBy("zoom").agg(F.count("*").alias("written"))
    return whole.join(written, "zoom", "left").select("zoom", F.coalesce("written", F.lit(0)).alias("written"), (F.col("n") - F.coalesce("written", F.lit(0))).alias("blank"))


# Distances

def envelope(f: np.ndarray) -> np.ndarray:
    """min over j of (i - j)**2 + f[j] for every i: the lower envelope of parabolas (infinite f: none there)."""
    live, x = np.flatnonzero(np.isfinite(f)), np.arange(len(f), dtype=float)
    if not len(live):
        return np.full(len(f), np.inf)
    v, z = [int(live[0])], [-np.inf]
    for q in live[1:].tolist():
        while True:
            s = (f[q] + q * q - f[v[-1]] - v[-1] * v[-1]) / (2 * (q - v[-1]))
            if s > z[-1]:
                break
            v.pop()
            z.pop()
        v.append(q)
        z.append(s)
    near = np.array(v)[np.searchsorted(z, x, side="right") - 1]
    return (x - near) ** 2 + f[near]


def distance_to(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance in cells to the nearest True cell (infinite if none): columns first, then rows."""
    rows = len(mask)
    down = np.where(mask, 0.0, np.inf)
    for r in range(1, rows):
        down[r] = np.minimum(down[r], down[r - 1] + 1)
    for r in range(rows - 2, -1, -1):
        down[r] = np.minimum(down[r], down[r + 1] + 1)
    return np.sqrt(np.stack([envelope(f) for f in down * down])) if rows else down


def signed_distance(mask: np.ndarray) -> np.ndarray:
    """Positive inside, negative outside, in cells."""
    return distance_to(~mask) - distance_to(mask)


def distances(cells: DataFrame, value: str) -> DataFrame:
    """(row, col, distance) of a boolean, exact at any distance; infinite where there is only one value.

    Separable: the nearest cell of each value in a column by windows, then the lower envelope
    of each row.  What a task holds is a column or a row; cells may be missing from the grid.
    """
    extent = cells.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    if extent[0] is None:
        return cells.select("row", "col", F.lit(0.0).alias("distance"))
    r0, r1, c0, c1 = extent
    on = F.col("on")
    grid = cells.sparkSession.range(c0, c1 + 1).select(F.col("id").cast("int").alias("col"), F.explode(F.sequence(F.lit(int(r0)), F.lit(int(r1)))).alias("row"))
    whole = grid.join(cells.select("row", "col", F.col(value).alias("on")), ["row", "col"], "left")
    before, after = (W.partitionBy("col").orderBy("row").rowsBetween(*b) for b in ((W.unboundedPreceding, 0), (0, W.unboundedFollowing)))

    def near(flag: Column) -> Column:
        here = F.when(flag, F.col("row"))
        return F.least(F.col("row") - F.last(here, ignorenulls=True).over(before), F.first(here, ignorenulls=True).over(after) - F.col("row"))

    columns = whole.select("row", "col", "on", near(on).alias("to_on"), near(~on).alias("to_off"))

    def across(key, line: pd.DataFrame) -> pd.DataFrame:
        line = line.sort_values("col")
        to = {}
        for name in ("to_on", "to_off"):
            f = line[name].to_numpy(float)
            to[name] = np.sqrt(envelope(np.where(np.isnan(f), np.inf, f * f)))
        known = line["on"].notna().to_numpy()
        inside = line["on"].fillna(False).to_numpy(bool)
        d = np.where(inside, to["to_off"], -to["to_on"])
        return pd.DataFrame({"row": line["row"].to_numpy()[known], "col": line["col"].to_numpy()[known], "distance": d[known]})

    return columns.groupBy("row").applyInPandas(across, "row int, col int, distance double")


def signed_distances(cells: DataFrame, value: str, reach: int, tile: int = 256) -> DataFrame:
    """(row, col, distance) of a boolean where only what lies within ``reach`` cells matters: cut there, by tiles
    with a halo.  ``distances`` is the whole field."""
    span = lambda c: F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile))
    spread = cells.select("row", "col", F.col(value).alias("on")).withColumn("tr", F.explode(span("row"))).withColumn("tc", F.explode(span("col")))
    wanted = cells.select(F.floor(F.col("row") / tile).alias("tr"), F.floor(F.col("col") / tile).alias("tc")).distinct()

    def kernel(key, block: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(key[0]) * tile - reach, int(key[1]) * tile - reach
        size = tile + 2 * reach
        r, c = block["row"].to_numpy() - r0, block["col"].to_numpy() - c0
        inside = (r >= 0) & (r < size) & (c >= 0) & (c < size)
        on, off = np.zeros((size, size), bool), np.zeros((size, size), bool)
        flags = block["on"].to_numpy(bool)
        on[r[inside & flags], c[inside & flags]] = True
        off[r[inside & ~flags], c[inside & ~flags]] = True
        d = np.clip(np.where(on, distance_to(off), -distance_to(on)), -reach, reach)
        at = np.nonzero((on | off)[reach:reach + tile, reach:reach + tile])
        return pd.DataFrame({"row": at[0] + r0 + reach, "col": at[1] + c0 + reach, "distance": d[reach:reach + tile, reach:reach + tile][at]})

    return spread.join(wanted, ["tr", "tc"], "left_semi").groupBy("tr", "tc").applyInPandas(kernel, "row int, col int, distance double")
