"""Polygons as rings of points: areas, rasterising, outlines of masks, simplification."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions.grid import Grid

RINGS = "array<array<struct<x:double,y:double>>>"


def ring_area(ring: Column) -> Column:
    """Shoelace area of a closed or open ring, without sign."""
    n = F.size(ring)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ring, i)["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * F.get(ring, i)["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)) / 2


def polygon_area(rings: Column) -> Column:
    """The first ring less the holes."""
    return ring_area(F.get(rings, F.lit(0))) - F.aggregate(F.transform(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), ring_area), F.lit(0.0), lambda s, v: s + v)


def inside(x: np.ndarray, y: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Even-odd rule over all rings."""
    odd = np.zeros(len(x), bool)
    for ring in rings:
        px, py = ring[:, 0], ring[:, 1]
        for (x1, y1), (x2, y2) in zip(zip(px, py, strict=True), zip(np.roll(px, -1), np.roll(py, -1), strict=True), strict=True):
            if y1 != y2:
                crosses = (y1 > y) != (y2 > y)
                odd ^= crosses & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return odd


def touched(grid: Grid, rings: list[np.ndarray], all_touched: bool) -> tuple[np.ndarray, np.ndarray]:
    """(rows, cols) of the cells whose centre is inside; or also those that an edge passes through."""
    shell = np.concatenate(rings)
    c0, c1 = (int(np.clip(math.floor((v - grid.x_min) / grid.res), -1, grid.cols)) for v in (shell[:, 0].min(), shell[:, 0].max()))
    r0, r1 = (int(np.clip(math.floor((grid.y_max - v) / grid.res), -1, grid.rows)) for v in (shell[:, 1].max(), shell[:, 1].min()))
    rows, cols = np.meshgrid(np.arange(max(r0, 0), min(r1, grid.rows - 1) + 1), np.arange(max(c0, 0), min(c1, grid.cols - 1) + 1), indexing="ij")
    rows, cols = rows.ravel(), cols.ravel()
    on = inside(grid.x_min + (cols + 0.5) * grid.res, grid.y_max - (rows + 0.5) * grid.res, rings)
    if all_touched and len(rows):
        hit = {(int(r), int(c)) for r, c in zip(rows[on], cols[on], strict=True)}
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
                u1, v1, u2, v2 = (x1 - grid.x_min) / grid.res, (grid.y_max - y1) / grid.res, (x2 - grid.x_min) / grid.res, (grid.y_max - y2) / grid.res
                cuts = {0.0, 1.0}
                for a, b in ((u1, u2), (v1, v2)):
                    if a != b:
                        cuts |= {(k - a) / (b - a) for k in range(math.ceil(min(a, b)), math.floor(max(a, b)) + 1)}
                ts = sorted(t for t in cuts if 0 <= t <= 1)
                for s, t in zip(ts, ts[1:], strict=False):
                    m = (s + t) / 2
                    r, c = math.floor(v1 + m * (v2 - v1)), math.floor(u1 + m * (u2 - u1))
                    if 0 <= r < grid.rows and 0 <= c < grid.cols:
                        hit.add((r, c))
        at = np.array(sorted(hit), int).reshape(-1, 2)
        return at[:, 0], at[:, 1]
    return rows[on], cols[on]


def rasterise(polygons: DataFrame, grid: Grid, all_touched: bool = False) -> DataFrame:
    """(row, col, id): cells of each polygon (id, rings); where several lie the highest id burns last."""

    def burn(batches):
        for batch in batches:
            for p in batch.itertuples():
                rings = [np.array([(v["x"], v["y"]) for v in ring], float) for ring in p.rings]
                r, c = touched(grid, rings, all_touched)
                yield pd.DataFrame({"row": r, "col": c, "id": p.id})

    # Burning is much work on little data: dealt out evenly, whatever the files were.
    dealt = polygons.select("id", "rings").repartition(2 * polygons.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInPandas(burn, "row int, col int, id long").groupBy("row", "col").agg(F.max("id").alias("id"))


def simplified(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker, with a stack instead of recursion."""
    keep = np.zeros(len(line), bool)
    keep[[0, -1]] = True
    todo = [(0, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = line[b] - line[a]
        off = line[a + 1:b] - line[a]
        length = math.hypot(*d)
        far = np.abs(d[0] * off[:, 1] - d[1] * off[:, 0]) / length if length else np.hypot(off[:, 0], off[:, 1])
        k = int(np.argmax(far))
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return line[keep]


def outline(mask: np.ndarray) -> list[np.ndarray]:
    """Rings (row, col of corners) around a mask, 4-connected; holes are rings too."""
    padded = np.pad(mask, 1)
    after: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in zip(*np.nonzero(padded), strict=True):
        r, c = int(r), int(c)
        for dr, dc, a, b in ((-1, 0, (r, c), (r, c + 1)), (0, 1, (r, c + 1), (r + 1, c + 1)), (1, 0, (r + 1, c + 1), (r + 1, c)), (0, -1, (r + 1, c), (r, c))):
            if not padded[r + dr, c + dc]:
                after.setdefault(a, []).append(b)
    rings = []
    while after:
        start = min(after)
        ring, at, came = [start], start, None
        while True:
            ways = after[at]
            if len(ways) > 1 and came is not None:  # cells that touch at a corner stay apart: turn right
                heading = (at[0] - came[0], at[1] - came[1])
                right = (heading[1], -heading[0])
                ways.sort(key=lambda w: (w[0] - at[0], w[1] - at[1]) != right)
            to = ways.pop(0)
            if not ways:
                del after[at]
            came, at = at, to
            if at == start:
                break
            ring.append(at)
        points = np.array(ring, float) - 1
        back, fore = points - np.roll(points, 1, axis=0), np.roll(points, -1, axis=0) - points
        rings.append(points[(back * fore[:, ::-1] * [1, -1]).sum(axis=1) != 0])
    return rings


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull, counter-clockwise, by two monotone chains."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def chain(order):
        kept: list[np.ndarray] = []
        for p in order:
            while len(kept) > 1 and np.linalg.det(np.array([kept[-1] - kept[-2], p - kept[-1]])) <= 0:
                kept.pop()
            kept.append(p)
        return kept[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def dominant_angle(ring: np.ndarray) -> float:
    """The direction, modulo 90 degrees, of the smallest rectangle around the ring.

    A rectangle answers for the whole shape; edges of a staircase all run along the grid.
    """
    around = hull(np.asarray(ring, float))
    if len(around) < 3:
        return 0.0
    d = np.roll(around, -1, axis=0) - around
    best = (math.inf, 0.0)
    for angle in np.arctan2(d[:, 1], d[:, 0]):
        turned = around @ np.array([[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]])
        best = min(best, (round(float(np.prod(np.ptp(turned, axis=0))), 9), math.degrees(angle) % 90))
    return best[1]


def _area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y) / 2)


def _meet(p: np.ndarray, u: np.ndarray, q: np.ndarray, v: np.ndarray) -> np.ndarray | None:
    """Where two lines (a point and a direction each) cross; None if they are parallel."""
    cross = u[0] * v[1] - u[1] * v[0]
    if abs(cross) < 1e-9:
        return None
    return p + ((q - p)[0] * v[1] - (q - p)[1] * v[0]) / cross * u


def regularised(ring: np.ndarray, tolerance: float = 1.0, snap: float = 25.0, free: float = 3.0, drift: float = 0.4, main: float | None = None) -> np.ndarray:
    """An outline with walls along its main direction (that of ``ring`` unless given).

    Simplified first; edges shorter than ``free``, and those within ``snap`` degrees of the main
    direction or its normal, are turned onto it, runs of walls that head the same way become one, and neighbours are
    intersected anew (where they run parallel, their common corner stays).  Walls that head
    opposite ways are the two faces of something thin and never become one.  If the area
    moves by more than ``drift`` the simplified outline stands.
    """
    base = simplified(np.vstack([ring, ring[:1]]), tolerance)[:-1]
    if len(base) < 4:
        return base
    main = dominant_angle(ring) if main is None else main
    walls: list[list] = []  # heading, a point on the wall, length, the corner it ends in
    for a, b in zip(base, np.roll(base, -1, axis=0), strict=True):
        length, angle = math.hypot(*(b - a)), math.degrees(math.atan2(b[1] - a[1], b[0] - a[0]))
        axis = main + 90 * round((angle - main) / 90)
        heading = math.radians(axis if length < free or abs(angle - axis) <= snap else angle)
        walls.append([np.array([math.cos(heading), math.sin(heading)]), (a + b) / 2, length, b])
    same = lambda a, b: float(a[0] @ b[0]) > 1 - 1e-9
    runs: list[list] = []
    for wall in walls:
        if runs and same(runs[-1][-1], wall):
            runs[-1].append(wall)
        else:
            runs.append([wall])
    if len(runs) > 2 and same(runs[-1][-1], runs[0][0]):
        runs[0] = runs.pop() + runs[0]
    if len(runs) < 3:
        return base
    whole = [(run[0][0], sum(w[1] * w[2] for w in run) / sum(w[2] for w in run), run[-1][3]) for run in runs]
    corners = [at if (at := _meet(p, u, q, v)) is not None else end for (u, p, end), (v, q, _) in zip(whole, whole[1:] + whole[:1], strict=True)]
    out = np.array(corners)
    return out if abs(abs(_area(out)) - abs(_area(ring))) <= drift * abs(_area(ring)) and out.size else base


def pulled_in(ring: np.ndarray, by: float, solid_left: bool) -> np.ndarray | None:
    """The ring with every wall moved into the solid by a distance, corners kept sharp.

    Of what falls apart the largest piece stays; None if nothing is left.
    """
    d = np.roll(ring, -1, axis=0) - ring
    length = np.hypot(d[:, 0], d[:, 1])
    ring, d, length = ring[length > 0], d[length > 0], length[length > 0]
    if len(ring) < 3:
        return None
    heading = d / length[:, None]
    inward = np.column_stack([-heading[:, 1], heading[:, 0]]) * (by if solid_left else -by)
    moved = [at if (at := _meet(ring[k - 1] + inward[k - 1], heading[k - 1], ring[k] + inward[k], heading[k])) is not None else ring[k] + inward[k] for k in range(len(ring))]
    sign = math.copysign(1, _area(ring))
    # Walls that come to lie on each other are moved apart by a millionth, so that they cross or don't.
    apart = np.sin(np.arange(2 * len(moved)).reshape(-1, 2) + 1) * 1e-6 * by
    pieces = [p for p in simple_pieces(np.array(moved) + apart) if _area(p) * sign > 1e-3 * by * by]
    return max(pieces, key=lambda p: abs(_area(p))) if pieces else None


def simple_pieces(ring: np.ndarray) -> list[np.ndarray]:
    """A ring that crosses itself as rings that don't; a piece of opposite sense is turned inside out."""
    todo, done = [ring], []
    while todo:
        ring = todo.pop()
        n, cut = len(ring), None
        for i in range(n):
            a, b = ring[i], ring[(i + 1) % n]
            for j in range(i + 2, n - (i == 0)):
                c, d = ring[j], ring[(j + 1) % n]
                at = _meet(a, b - a, c, d - c)
                if at is None:
                    continue
                s, t = (float((at - p) @ (q - p)) / max(float((q - p) @ (q - p)), 1e-30) for p, q in ((a, b), (c, d)))
                if 1e-9 < s < 1 - 1e-9 and 1e-9 < t < 1 - 1e-9:
                    cut = i, j, at
                    break
            if cut:
                break
        if not cut:
            done.append(ring)
            continue
        i, j, at = cut
        todo += [np.vstack([at[None], ring[i + 1:j + 1]]), np.vstack([ring[:i + 1], at[None], ring[j + 1:]])]
    return [r for r in done if len(r) > 2]


def outlines(regions: DataFrame, grid: Grid, least_area: float = 20.0, pull: float = 0.5) -> DataFrame:
    """(region, rings, area): the regularised outline of every region of cells, small ones left out.

    A cell is in a region when something in it is, so outlines stand half a cell too far out
    on the average: walls are pulled in by ``pull`` cells.  ``area`` is that of the cells.
    A region whose outline vanishes is left out; holes (patios) are straightened along with it.
    """

    def trace(key, cells: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = cells["row"].min(), cells["col"].min()
        mask = np.zeros((cells["row"].max() - r0 + 1, cells["col"].max() - c0 + 1), bool)
        mask[cells["row"] - r0, cells["col"] - c0] = True
        area = float(mask.sum()) * grid.res**2
        if area < least_area:
            return pd.DataFrame({"region": pd.Series([], dtype="int64"), "rings": pd.Series([], dtype=object), "area": pd.Series([], dtype=float)})
        traced = [np.column_stack([grid.x_min + (q[:, 1] + c0) * grid.res, grid.y_max - (q[:, 0] + r0) * grid.res]) for q in outline(mask)]
        largest = max(traced, key=lambda q: abs(_area(q)))
        main, outer = dominant_angle(largest), math.copysign(1, _area(largest))
        drawn = [pulled_in(regularised(q, grid.res, main=main), pull * grid.res, outer > 0) if pull else regularised(q, grid.res, main=main) for q in traced]
        rings = [[{"x": float(x), "y": float(y)} for x, y in q] for q in drawn if q is not None]
        if not any(q is not None and _area(q) * outer > 0 for q in drawn):
            return pd.DataFrame({"region": pd.Series([], dtype="int64"), "rings": pd.Series([], dtype=object), "area": pd.Series([], dtype=float)})
        return pd.DataFrame({"region": [key[0]], "rings": [rings], "area": [area]})

    return regions.select("region", "row", "col").groupBy("region").applyInPandas(trace, f"region long, rings {RINGS}, area double")
