"""The steps of a city's build and which of them are stale."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

#: Order of the steps and what each needs.
STEPS = ["area", "basemap", "build", "graph", "tiles", "publish"]
NEEDS = {"build": ["area"], "graph": ["build"], "tiles": ["build"], "publish": ["tiles", "graph", "basemap"]}


def staleness(steps: DataFrame, digest: str, engine: str) -> DataFrame:
    """city, step, verdict from city, step, status, finished, digest, engine, alive.

    A running step whose process is gone has failed; a finished one is stale if the
    configuration changed, the engine changed (build only), or what it needs finished later.
    """
    pairs = steps.sparkSession.createDataFrame([(s, n) for s, ns in NEEDS.items() for n in ns], "step string, need string")
    newest = (
        pairs.join(steps.select("city", F.col("step").alias("need"), F.col("finished").alias("before")), "need")
        .groupBy("city", "step").agg(F.max("before").alias("needed"))
    )
    met = steps.join(newest, ["city", "step"], "left")
    verdict = (
        F.when((F.col("status") == "running") & ~F.col("alive"), "failed").when(F.col("status") != "done", F.col("status"))
        .when((F.col("digest") != digest) | ((F.col("step") == "build") & (F.col("engine") != engine)), "stale")
        .when(F.col("needed") > F.col("finished"), "stale").otherwise("done")
    )
    return met.select("city", "step", verdict.alias("verdict"))


def latest(events: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The newest event of each key."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("x")).select(*keys, "x.*")


def newest(rows: DataFrame, keys: list[str], at: str, keep: int) -> DataFrame:
    """The newest ``keep`` rows of each key; the rest may be pruned."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(at).desc()))).where(F.col("_n") <= keep).drop("_n")
