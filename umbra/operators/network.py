"""The walking network: extraction, exposure of its edges, and routes over it."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from umbra.operators.numbering import numbered
from umbra.operators.shade import OUTSIDE, SHADE_BOTH, SHADE_VEGETATION, SUN

ALPHAS = (0.0, 0.5, 1.0, 2.0, 4.0, 8.0)
SUN_GAIN = 0.05
SHORTEST_EDGE = 0.01


def extract(nodes: DataFrame, ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, x, y) and edges (edge, u, v, len, geom) of (node, x, y) and (u, v, geom).

    ``geom`` is an array of (x, y).  Edges run from the lower to the higher node; the same
    line in both directions counts once, parallel ones stay; loops and edges under 1 cm
    go, and nodes without edges; ids are renumbered from 0 in order.
    """
    turned = F.col("u") > F.col("v")
    rounded = F.transform("geom", lambda p: F.struct(F.round(p["x"], 9).alias("x"), F.round(p["y"], 9).alias("y")))
    steps = F.transform(F.sequence(F.lit(1), F.size("geom") - 1), lambda i: F.sqrt(F.pow(F.get("geom", i)["x"] - F.get("geom", i - 1)["x"], F.lit(2)) + F.pow(F.get("geom", i)["y"] - F.get("geom", i - 1)["y"], F.lit(2))))
    once = (
        ways.where("u <> v")
        .select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), F.when(turned, F.reverse("geom")).otherwise(F.col("geom")).alias("geom"))
        .withColumn("key", rounded).dropDuplicates(["a", "b", "key"])
        .withColumn("len", F.when(F.size("geom") > 1, F.aggregate(steps, F.lit(0.0), lambda s, v: s + v)).otherwise(0.0))
        .where(F.col("len") >= SHORTEST_EDGE)
    )
    used = once.select(F.col("a").alias("node")).union(once.select(F.col("b").alias("node"))).distinct()
    used = numbered(used, ["node"], "id")
    ends = once.join(used.select(F.col("node").alias("a"), F.col("id").alias("u")), "a").join(used.select(F.col("node").alias("b"), F.col("id").alias("v")), "b")
    edges = numbered(ends, ["u", "v", "len", "key"], "edge").select(F.col("edge").cast("int").alias("edge"), "u", "v", F.col("len").cast("float").alias("len"), "geom")
    return nodes.join(used, "node").select("id", "x", "y"), edges


def both_ways(edges: DataFrame) -> DataFrame:
    """Directed arcs (edge, head, tail, forward, ...) of undirected edges."""
    rest = [c for c in edges.columns if c not in ("u", "v")]
    return edges.select(*rest, F.col("u").alias("head"), F.col("v").alias("tail"), F.lit(True).alias("forward")).unionByName(
        edges.select(*rest, F.col("v").alias("head"), F.col("u").alias("tail"), F.lit(False).alias("forward")))


def at_instants(samples: DataFrame, states: DataFrame, keys: list[str], most: int = 1000) -> DataFrame:
    """Every sample at every instant: the instants are the fixed ladder (83), gathered in one row and exploded."""
    found = states.select(*keys).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} instants")
    fields = states.select(*keys).schema
    ladder = F.array(*[F.struct(*[F.lit(r[k]).cast(fields[k].dataType).alias(k) for k in keys]) for r in found]) if found else F.array().cast(f"array<{fields.simpleString()}>")
    return samples.withColumn("_k", F.explode(ladder)).select(*samples.columns, *[F.col(f"_k.{k}").alias(k) for k in keys])


def edge_fractions(samples: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """Share of an edge's samples in sun and under crowns, quantised; unknown places are sun.

    ``samples``: edge, row, col; ``states``: row, col, ``keys``, code.
    """
    met = at_instants(samples, states, keys).join(states, [*keys, "row", "col"], "left")
    sun = F.coalesce(F.col("code").isin(SUN, OUTSIDE), F.lit(True)).cast("double")
    trees = F.coalesce(F.col("code").isin(SHADE_VEGETATION, SHADE_BOTH), F.lit(False)).cast("double")
    q = lambda v: F.rint(F.avg(v) * 255).cast("smallint")
    return met.groupBy("edge", *keys).agg(q(sun).alias("sun_q"), q(trees).alias("veg_q"))


def fully_covered(samples: DataFrame, covered: DataFrame) -> DataFrame:
    """Edges all of whose samples lie on covered cells."""
    met = samples.join(covered.select("row", "col", F.lit(True).alias("ok")), ["row", "col"], "left")
    return met.groupBy("edge").agg(F.every(F.coalesce("ok", F.lit(False))).alias("all_covered")).where("all_covered").select("edge")


def edge_cost(length: Column, sun: Column, veg: Column, alpha: Column, beta: Column) -> Column:
    """Felt length: sun costs alpha, shade other than trees costs beta; never below the length."""
    other = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - sun - veg))
    return length * (1 + alpha * sun + beta * other)


class Graph:
    """Compact adjacency for path search, made once for each task."""

    def __init__(self, nodes: pd.DataFrame, edges: pd.DataFrame):
        nodes, edges = nodes.sort_values("id"), edges.sort_values("edge")
        self.xy = nodes[["x", "y"]].to_numpy(float)
        self.u, self.v, self.length = edges["u"].to_numpy(int), edges["v"].to_numpy(int), edges["len"].to_numpy(float)
        head = np.concatenate([self.u, self.v])
        order = np.argsort(head, kind="stable")
        self.to = np.concatenate([self.v, self.u])[order]
        self.edge = np.tile(np.arange(len(self.u)), 2)[order]
        self.first = np.searchsorted(head[order], np.arange(len(self.xy) + 1))

    def search(self, starts: list[tuple[int, float]], goals: dict[int, float], target: tuple[float, float], cost: np.ndarray) -> tuple[float, list[int], int | None]:
        """A*: (cost, edges, first node) from entry nodes with their costs to a goal node with its remaining cost."""
        remaining = lambda n: math.hypot(self.xy[n, 0] - target[0], self.xy[n, 1] - target[1])
        best = {}
        came: dict[int, tuple[int, int]] = {}
        heap: list[tuple[float, int, int]] = []
        for n, c in starts:
            if c < best.get(n, math.inf):
                best[n] = c
                heapq.heappush(heap, (c + remaining(n), 1, n))
        done = set()
        finish, last = math.inf, None
        while heap:
            bound, _, n = heapq.heappop(heap)
            if bound >= finish:  # equal bounds: the target comes first
                break
            if n in done:
                continue
            done.add(n)
            if n in goals and best[n] + goals[n] < finish:
                finish, last = best[n] + goals[n], n
            for k in range(self.first[n], self.first[n + 1]):
                m, e = int(self.to[k]), int(self.edge[k])
                c = best[n] + cost[e]
                if c < best.get(m, math.inf) - 1e-12:
                    best[m] = c
                    came[m] = (n, e)
                    heapq.heappush(heap, (c + remaining(m), 1, m))
        if last is None:
            return math.inf, [], None
        path, n = [], last
        while n in came:
            n, e = came[n]
            path.append(e)
        return finish, path[::-1], n

    def between(self, a: tuple[int, float], b: tuple[int, float], cost: np.ndarray, point: tuple[float, float]) -> list[tuple[int, float, float]] | None:
        """Spans (edge, from, to) between two places (edge, metres along it); None: no way; []: same place."""
        (ea, sa), (eb, sb) = a, b
        if ea == eb and abs(sa - sb) <= 1e-6:
            return []
        per = lambda e: cost[e] / self.length[e]
        starts = [(int(self.u[ea]), sa * per(ea)), (int(self.v[ea]), (self.length[ea] - sa) * per(ea))]
        goals: dict[int, float] = {}
        for n, c in ((int(self.u[eb]), sb * per(eb)), (int(self.v[eb]), (self.length[eb] - sb) * per(eb))):
            goals[n] = min(c, goals.get(n, math.inf))
        total, path, first = self.search(starts, goals, point, cost)
        if ea == eb and abs(sa - sb) * per(ea) <= total:
            return [(ea, sa, sb)]
        if first is None:
            return None
        spans = [(ea, sa, 0.0 if first == self.u[ea] else float(self.length[ea]))]
        if self.u[ea] == self.v[ea]:
            spans = [(ea, sa, 0.0 if sa <= self.length[ea] - sa else float(self.length[ea]))]
        n = first
        for e in path:
            forward = self.u[e] == n
            spans.append((e, 0.0, float(self.length[e])) if forward else (e, float(self.length[e]), 0.0))
            n = int(self.v[e] if forward else self.u[e])
        spans.append((eb, 0.0 if n == self.u[eb] else float(self.length[eb]), sb))
        return [s for s in spans if abs(s[1] - s[2]) >= 1e-9]


SPANS = "array<struct<edge:int,s_from:double,s_to:double>>"
ROUTE = f"query long, alpha double, status string, edges array<int>, cost double, length double, sun_length double, veg_length double, spans {SPANS}"
MOST_BYTES = 1 << 30


def exposures(fractions: DataFrame, n_edges: int) -> np.ndarray:
    """(2, columns, edges) bytes: sun and crown shares of every edge at every column; what is not told is sun."""
    told = fractions.groupBy("edge").agg(F.array_sort(F.collect_list(F.struct("column", "sun_q", "veg_q"))).alias("c")).select("edge", *[F.col(f"c.{n}").alias(n) for n in ("column", "sun_q", "veg_q")]).toArrow()
    flat = {n: told[n].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(int) for n in ("column", "sun_q", "veg_q")}
    edge = np.repeat(told["edge"].to_numpy().astype(int), [len(c) for c in told["column"]])
    out = np.zeros((2, int(flat["column"].max(initial=0)) + 1, n_edges), np.uint8)
    out[0] = 255
    for plane, name in enumerate(("sun_q", "veg_q")):
        out[plane, flat["column"], edge] = flat[name]
    return out


def at_share(plane: np.ndarray, low: int, high: int, share: float) -> np.ndarray:
    """One exposure between two columns, in single precision."""
    one, w = np.float32(1 / 255), np.float32(share)
    return (np.float32(1) - w) * (plane[low].astype(np.float32) * one) + w * (plane[high].astype(np.float32) * one)


def routes(queries: DataFrame, nodes: DataFrame, edges: DataFrame, fractions: DataFrame | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """For every query and alpha the least costly way, as edges and as spans (edge, from, to) in walking order.

    ``queries``: query, edge_a, s_a, edge_b, s_b, x_b, y_b (of the place on the network),
    alpha, beta; ``edges``: edge (0, 1, ...), u, v, len, and either sun and veg, or
    ``fractions`` (edge, column, sun_q, veg_q) for queries with low_column, high_column,
    share and up (at night nothing is in sun or under crowns).

    The graph of a city goes to every executor.  Its bytes are counted first (a city has some
    10**5 edges and 83 columns: 20 MB) and a larger one is refused.
    """
    n_edges, n_nodes = edges.count(), nodes.count()
    columns = 0 if fractions is None else (fractions.agg(F.max("column")).first()[0] or 0) + 1
    size = n_edges * (48 + 2 * columns) + n_nodes * 24
    if size > most_bytes:
        raise ValueError(f"a network of {size} bytes is too much for one task's memory; split it by city")
    graph = queries.sparkSession.sparkContext.broadcast((nodes.select("id", "x", "y").toPandas(), edges.toPandas(), None if fractions is None else exposures(fractions, n_edges)))
    names = [c.split()[0] for c in ROUTE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node_rows, edge_rows, planes = graph.value
        g = Graph(node_rows, edge_rows)
        by = edge_rows.sort_values("edge")
        dark = np.zeros(len(by))
        sun, veg = (by["sun"].to_numpy(float), by["veg"].to_numpy(float)) if planes is None else (dark, dark)
        for batch in batches:
            out = []
            for q in batch.itertuples():
                if planes is not None:
                    sun, veg = (at_share(p, q.low_column, q.high_column, q.share).astype(float) for p in planes) if q.up else (dark, dark)
                cost = g.length * (1 + q.alpha * sun + q.beta * np.clip(1 - sun - veg, 0, 1))
                spans = g.between((q.edge_a, q.s_a), (q.edge_b, q.s_b), cost, (q.x_b, q.y_b))
                if spans is None:
                    out.append((q.query, q.alpha, "no_route", None, None, None, None, None, None))
                    continue
                walked = [(e, abs(s - t)) for e, s, t in spans]
                told = [{"edge": int(e), "s_from": float(s), "s_to": float(t)} for e, s, t in spans]
                out.append((q.query, q.alpha, "ok" if spans else "same_spot", [e for e, _ in walked], sum(w * cost[e] / g.length[e] for e, w in walked), sum(w for _, w in walked), sum(w * sun[e] for e, w in walked), sum(w * veg[e] for e, w in walked), told))
            yield pd.DataFrame(out, columns=names)

    return queries.mapInPandas(run, ROUTE)


def spread_alphas(queries: DataFrame, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """Each query with every alpha, its own included, and beta at the same ratio."""
    ratio = F.when(F.col("alpha") > 0, F.col("beta") / F.col("alpha")).otherwise(0.0)
    all_ = F.array_distinct(F.array_append(F.array(*[F.lit(a) for a in alphas]), F.col("alpha")))
    return queries.withColumn("_ratio", ratio).withColumn("alpha", F.explode(all_)).withColumn("beta", F.col("_ratio") * F.col("alpha")).drop("_ratio")


def distinct_routes(found: DataFrame) -> DataFrame:
    """Of equal ways (the same spans, to the millimetre) the one with the smallest alpha."""
    mm = lambda c: F.round(c, 3)
    same = F.transform("spans", lambda x: F.struct(x["edge"].alias("edge"), mm(x["s_from"]).alias("s_from"), mm(x["s_to"]).alias("s_to")))
    w = W.partitionBy("query", same).orderBy("alpha")
    return found.where("status = 'ok'").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pareto(found: DataFrame, gain: float = SUN_GAIN) -> DataFrame:
    """query, front: by length, each way kept that cuts the sun of the last kept by the gain (an ordered fold)."""
    entries = F.array_sort(F.collect_list(F.struct(F.col("length"), F.col("sun_length").alias("sun"), "alpha")))
    kind = "struct<best:double,front:array<struct<length:double,sun:double,alpha:double>>>"
    start = F.struct(F.lit(math.inf).alias("best"), F.array().cast("array<struct<length:double,sun:double,alpha:double>>").alias("front")).cast(kind)

    def keep(state, entry):
        margin = F.when(F.size(state["front"]) == 0, 1e-6).otherwise(F.greatest(F.lit(1e-6), gain * state["best"]))
        better = (F.size(state["front"]) == 0) | (entry["sun"] <= state["best"] - margin)
        return F.when(better, F.struct(entry["sun"].alias("best"), F.array_append(state["front"], entry).alias("front"))).otherwise(state)

    return found.groupBy("query").agg(entries.alias("entries")).select("query", F.aggregate("entries", start, keep)["front"].alias("front"))
