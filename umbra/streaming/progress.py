"""Progress events: windows, and the newest of each key, batch or streaming alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = "city string, step string, kind string, at timestamp, done long, total long"


def windowed(events: DataFrame, width: str, watermark: str | None = None) -> DataFrame:
    """start, event_type, n, total of tumbling windows; streams need a watermark."""
    if events.isStreaming or watermark:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark or "10 minutes")
    w = F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def tail(spark, folder: str) -> DataFrame:
    """A stream of the JSON lines in a folder; half-written lines lack fields and are dropped."""
    return spark.readStream.schema(EVENT).json(folder).where("city is not null and step is not null and at is not null")


def latest(events: DataFrame) -> DataFrame:
    """The newest milestone of every city and step."""
    return events.groupBy("city", "step").agg(F.max_by(F.struct("kind", "done", "total"), "at").alias("x"), F.max("at").alias("at")).select("city", "step", "x.*", "at")


def live(questions: DataFrame, skylines: DataFrame) -> DataFrame:
    """A stream of suns against the static skylines: a stream-static join."""
    from umbra.operators.shade import read_skyline, verdict

    return verdict(read_skyline(questions.join(skylines, "vec_id")))
