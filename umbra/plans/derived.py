"""City-shaped relations derived from the general test tables, for the registered queries.

Each relation exists twice: as a DataFrame, and as a common table expression of the SQL
twin.  The operators under test are applied to these relations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions.grid import Grid
from umbra.functions.sun import sun_at
from umbra.operators.binning import bin_points, clean_points, finish_cells, locate

GRID = Grid(0.0, 40.0, 1.0, 40, 40)
LAT, LON = 37.88, -4.78
SECTORS16, REACH = 16, 6.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        (F.col("l_partkey") % 40 + 0.5).cast("double").alias("x"), (F.col("l_orderkey") % 40 + 0.5).cast("double").alias("y"), F.col("l_quantity").alias("z"),
        (F.col("l_linenumber") % 3 + 1).cast("int").alias("ret"),
        F.when(F.col("l_returnflag") == "A", 6).when(F.col("l_returnflag") == "N", 2).otherwise(4).alias("cls"),
        ((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 7)).alias("withheld"), F.lit(False).alias("overlap"),
        F.concat(F.lit("f"), (F.col("l_suppkey") % 4).cast("string")).alias("file"),
    )


def cells(spark, sf) -> DataFrame:
    """Binned cells; where a cell has no ground the city's mean stands in."""
    raw = points(spark, sf)
    binned = bin_points(raw, GRID)
    mean = locate(clean_points(raw), GRID).agg(F.avg(F.when(F.col("cls") == 2, F.col("z"))).cast("float").alias("mean"))
    terrain = binned.join(F.broadcast(mean)).select("row", "col", F.coalesce("ground", "mean").alias("dtm"))  # one row
    return finish_cells(binned, terrain)


def skylines(spark, sf) -> DataFrame:
    """vec_id with q, q_felled, blocker arrays of 64 sectors and a covered flag."""
    emb = table(spark, sf, "embeddings")
    q = F.transform("embedding", lambda e: F.least(F.lit(255), F.rint(F.abs(e.cast("double")) * 255)).cast("int"))
    kind = F.transform("embedding", lambda e, i: F.element_at(F.array(F.lit(255), F.lit(1), F.lit(2), F.lit(0)), ((i + F.col("label")) % 4 + 1).cast("int")))
    rows = emb.select("vec_id", q.alias("q"), kind.alias("blocker"), (F.col("vec_id") % 9 != 0).alias("covered"))
    return rows.withColumn("q_felled", F.zip_with("q", "blocker", lambda a, k: F.when(k == 1, F.floor(a * 3 / 5).cast("int")).otherwise(a)))


def suns(spark, sf) -> DataFrame:
    """Each event as a question: its instant's sun over one of the skylines."""
    ev, n = table(spark, sf, "events"), table(spark, sf, "embeddings").count()
    azimuth, elevation = sun_at(F.col("ts"), LAT, LON)
    return ev.select("event_id", "ts", "user_id", (F.col("event_id") % n).alias("vec_id"), azimuth.alias("azimuth"), elevation.alias("elevation"), (F.col("event_id") % 7 == 0).alias("canopy"))


def nodes(spark, sf) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(k.cast("long").alias("node"), (k % 5 * 100.0).alias("x"), (F.floor(k / 5) * 100.0).alias("y"))


def ways(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    at = lambda k: F.struct((k % 5 * 100.0).alias("x"), (F.floor(k / 5) * 100.0).alias("y"))
    u, v = F.col("c_nationkey").cast("long"), F.col("c_custkey").cast("long") % 25
    a, b = at(u), at(v)
    middle = F.struct(((a["x"] + b["x"]) / 2 + 30.0).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"))
    return c.select(u.alias("u"), v.alias("v"), F.when(F.col("c_custkey") % 3 == 0, F.array(a, middle, b)).otherwise(F.array(a, b)).alias("geom"))


def vertices(spark, sf) -> DataFrame:
    """Every order as a line through its items."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("line"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("i"),
        (F.col("l_partkey") % 100).cast("double").alias("x"), (F.col("l_suppkey") % 100 + F.col("l_quantity") * 2).cast("double").alias("y"))


def edge_samples(spark, sf) -> DataFrame:
    """Points as samples of walking edges over the grid."""
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_suppkey") % 50).alias("edge"), (F.lit(39) - F.col("l_orderkey") % 40).cast("int").alias("row"), (F.col("l_partkey") % 40).cast("int").alias("col"))


def states(spark, sf) -> DataFrame:
    """(row, col, column, code): a state of each cell at three instants."""
    pick = F.element_at(F.array(*map(F.lit, (0, 1, 2, 4, 255))), ((F.col("row") * 3 + F.col("col") * 7 + F.col("column") * 11) % 5 + 1).cast("int"))
    return cells(spark, sf).where((F.col("row") + F.col("col")) % 13 != 0).withColumn("column", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select("row", "col", "column", pick.alias("code"))


SUN_SQL = """
  SELECT event_id, ts, user_id, vec_id, canopy, degrees(asin(sin(radians({lat})) * sin(delta) + cos(radians({lat})) * cos(delta) * cos(h))) AS elevation,
         ((180 + degrees(atan2(sin(h), cos(h) * sin(radians({lat})) - tan(delta) * cos(radians({lat}))))) % 360 + 360) % 360 AS azimuth
  FROM (SELECT *, radians((hours + ({lon}) / 15.0::DOUBLE + 229.18::DOUBLE * (0.000075::DOUBLE + 0.001868::DOUBLE * cos(b) - 0.032077::DOUBLE * sin(b) - 0.014615::DOUBLE * cos(2 * b) - 0.040849::DOUBLE * sin(2 * b)) / 60 - 12) * 15) AS h,
               0.006918::DOUBLE - 0.399912::DOUBLE * cos(b) + 0.070257::DOUBLE * sin(b) - 0.006758::DOUBLE * cos(2 * b) + 0.000907::DOUBLE * sin(2 * b) - 0.002697::DOUBLE * cos(3 * b) + 0.00148::DOUBLE * sin(3 * b) AS delta
        FROM (SELECT event_id, ts, user_id, event_id % (SELECT count(*) FROM embeddings) AS vec_id, event_id % 7 = 0 AS canopy,
                     2 * pi() * (dayofyear(ts) - 1) / 365 AS b, hour(ts) + minute(ts) / 60.0::DOUBLE + second(ts) / 3600.0::DOUBLE AS hours FROM events))
""".format(lat=LAT, lon=LON)

#: name: (SQL, names it needs)
CTE: dict[str, tuple[str, tuple[str, ...]]] = {
    "points": ("SELECT (l_partkey % 40 + 0.5)::DOUBLE AS x, (l_orderkey % 40 + 0.5)::DOUBLE AS y, l_quantity AS z, (l_linenumber % 3 + 1)::INT AS ret, CASE l_returnflag WHEN 'A' THEN 6 WHEN 'N' THEN 2 ELSE 4 END AS cls, l_linestatus = 'O' AND l_linenumber = 7 AS withheld, 'f' || (l_suppkey % 4) AS file FROM lineitem", ()),
    "binned": ("SELECT floor(40 - y)::INT AS row, floor(x)::INT AS col, max(z) FILTER (WHERE ret = 1)::FLOAT AS dsm, avg(z) FILTER (WHERE cls = 2)::FLOAT AS ground, max(z) FILTER (WHERE ret = 1 AND cls = 6)::FLOAT AS roof, max(z) FILTER (WHERE ret = 1 AND cls IN (3, 4, 5))::FLOAT AS crown, count(*) AS n_points FROM points WHERE NOT withheld AND cls NOT IN (7, 12, 18) GROUP BY 1, 2", ("points",)),
    "filled": ("SELECT row, col, dsm, coalesce(ground, (SELECT (avg(z) FILTER (WHERE cls = 2))::FLOAT FROM points WHERE NOT withheld)) AS dtm, roof, crown FROM binned", ("binned",)),
    "cells": ("SELECT row, col, greatest(coalesce(dsm, dtm), dtm) AS dsm, dtm, CASE WHEN dsm IS NULL THEN 0 WHEN roof >= dsm - 1 THEN 2 WHEN crown >= dsm THEN 1 ELSE 0 END AS landcover FROM filled", ("filled",)),
    "skyline": ("SELECT vec_id, i AS sector, least(255, round_even(abs(embedding[i + 1]::DOUBLE) * 255, 0))::INT AS q, CASE (i + label) % 4 WHEN 0 THEN 255 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS blocker, vec_id % 9 <> 0 AS covered FROM embeddings, range(64) AS r(i)", ()),
    "horizon": ("SELECT *, CASE WHEN blocker = 1 THEN floor(q * 3 / 5.0::DOUBLE)::INT ELSE q END AS q_felled FROM skyline", ("skyline",)),
    "suns": (SUN_SQL, ()),
    "seen": ("""
  SELECT s.*, (1 - f) * (lo.q * (90.0::DOUBLE / 255)) + f * (hi.q * (90.0::DOUBLE / 255)) AS horizon, (1 - f) * (lo.q_felled * (90.0::DOUBLE / 255)) + f * (hi.q_felled * (90.0::DOUBLE / 255)) AS horizon_felled,
         CASE WHEN lo.q >= hi.q THEN lo.blocker ELSE hi.blocker END AS blocker_at, lo.covered
  FROM (SELECT *, azimuth / 5.625::DOUBLE - floor(azimuth / 5.625::DOUBLE) AS f, floor(azimuth / 5.625::DOUBLE)::INT % 64 AS low FROM suns) s
  JOIN horizon lo ON lo.vec_id = s.vec_id AND lo.sector = low JOIN horizon hi ON hi.vec_id = s.vec_id AND hi.sector = (low + 1) % 64""", ("suns", "horizon")),
    "judged": ("""
  SELECT *, CASE WHEN elevation <= 0 THEN 'night' WHEN canopy OR elevation < horizon THEN 'shade' ELSE 'sun' END AS state,
         CASE WHEN elevation <= 0 THEN NULL WHEN canopy OR (elevation < horizon AND blocker_at = 1) THEN CASE WHEN elevation < horizon_felled THEN 'both' ELSE 'vegetation' END WHEN elevation < horizon AND blocker_at = 2 THEN 'building' END AS shade_type
  FROM seen""", ("seen",)),
    "coded": ("""
  SELECT *, CASE WHEN NOT covered THEN 255 WHEN canopy AND elevation < horizon_felled THEN 4 WHEN canopy THEN 2 WHEN elevation >= horizon THEN 0 WHEN elevation >= horizon_felled THEN 2 WHEN blocker_at = 1 THEN 4 WHEN blocker_at = 2 THEN 1 ELSE 3 END AS code FROM seen""", ("seen",)),
    "ways": ("SELECT least(u, v) AS a, greatest(u, v) AS b, mid, sqrt((ax - bx) * (ax - bx) + (ay - b_y) * (ay - b_y)) AS direct, sqrt(((ax + bx) / 2 + 30 - ax) * ((ax + bx) / 2 + 30 - ax) + ((ay + b_y) / 2 - ay) * ((ay + b_y) / 2 - ay)) AS l1, sqrt((bx - (ax + bx) / 2 - 30) * (bx - (ax + bx) / 2 - 30) + (b_y - (ay + b_y) / 2) * (b_y - (ay + b_y) / 2)) AS l2 FROM (SELECT *, a % 5 * 100.0::DOUBLE AS ax, a // 5 * 100.0::DOUBLE AS ay, b % 5 * 100.0::DOUBLE AS bx, b // 5 * 100.0::DOUBLE AS b_y FROM (SELECT c_nationkey AS u, c_custkey % 25 AS v, least(c_nationkey, c_custkey % 25) AS a, greatest(c_nationkey, c_custkey % 25) AS b, c_custkey % 3 = 0 AS mid FROM customer)) WHERE u <> v", ()),
    "links": ("SELECT a, b, CASE WHEN mid THEN l1 + l2 ELSE direct END AS len FROM (SELECT DISTINCT a, b, mid, direct, l1, l2 FROM ways) WHERE CASE WHEN mid THEN l1 + l2 ELSE direct END >= 0.01", ("ways",)),
    "used": ("SELECT node, (row_number() OVER (ORDER BY node) - 1)::INT AS id FROM (SELECT a AS node FROM links UNION SELECT b FROM links)", ("links",)),
    "edges": ("SELECT (row_number() OVER (ORDER BY ua.id, ub.id, len) - 1)::INT AS edge, ua.id AS u, ub.id AS v, len FROM links JOIN used ua ON ua.node = a JOIN used ub ON ub.node = b", ("links", "used")),
    "vertices": ("SELECT l_orderkey AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i, (l_partkey % 100)::DOUBLE AS x, (l_suppkey % 100 + l_quantity * 2)::DOUBLE AS y FROM lineitem", ()),
    "segments": ("SELECT *, coalesce(sum(len) OVER (PARTITION BY line ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS arc0 FROM (SELECT line, i::INT AS seg, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2, sqrt((lead(x) OVER w - x) * (lead(x) OVER w - x) + (lead(y) OVER w - y) * (lead(y) OVER w - y)) AS len FROM vertices WINDOW w AS (PARTITION BY line ORDER BY i)) WHERE x2 IS NOT NULL", ("vertices",)),
    "edge_samples": ("SELECT l_suppkey % 50 AS edge, (39 - l_orderkey % 40)::INT AS row, (l_partkey % 40)::INT AS col FROM lineitem", ()),
    "states": ("SELECT row, col, k AS \"column\", [0, 1, 2, 4, 255][((row * 3 + col * 7 + k * 11) % 5 + 1)::INT] AS code FROM cells, range(3) AS r(k) WHERE (row + col) % 13 <> 0", ("cells",)),
}


def with_sql(body: str, *names: str, extra: str = "", recursive: bool = False) -> str:
    """``body`` behind the common table expressions it needs."""
    done: list[str] = []

    def add(name: str) -> None:
        if name not in done:
            for n in CTE[name][1]:
                add(n)
            done.append(name)

    for n in names:
        add(n)
    parts = [f"{n} AS MATERIALIZED ({CTE[n][0]})" for n in done] + ([extra] if extra else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}" if parts else body
