"""The year as seven rungs of equal declination, and the hours shown on each."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from umbra.functions.sun import declination_of
from umbra.functions.text import ladder_date

#: Fixed values of the data model: rung date, first and last civil hour.
RUNGS = [("2026-02-07", 9, 18), ("2026-03-01", 8, 18), ("2026-03-21", 8, 19), ("2026-04-10", 8, 20), ("2026-05-04", 8, 21), ("2026-06-21", 8, 21), ("2026-12-21", 9, 17)]
YEAR = 2026


def rungs(spark: SparkSession) -> DataFrame:
    """rung, date, first_hour, last_hour, declination (degrees)."""
    import datetime

    rows = [(k, datetime.date.fromisoformat(d), a, b, math.degrees(declination_of(datetime.date.fromisoformat(d).timetuple().tm_yday))) for k, (d, a, b) in enumerate(RUNGS)]
    return spark.createDataFrame(rows, "rung int, date date, first_hour int, last_hour int, declination double")


def assigned_days(spark: SparkSession) -> DataFrame:
    """Each day of the ladder's year with its rung: the nearest declination, equal: the first rung."""
    from umbra.functions.sun import declination

    days = spark.range(365).select(F.date_add(F.lit(f"{YEAR}-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    days = days.withColumn("own", F.degrees(declination(F.dayofyear("day").cast("double"))))
    # Seven rungs: a fixed-size side.
    met = days.join(F.broadcast(rungs(spark).select("rung", "declination")))
    return met.groupBy("day").agg(F.min_by("rung", F.struct(F.round(F.abs(F.col("own") - F.col("declination")), 9), "rung")).alias("rung"))


def covers(days: DataFrame) -> DataFrame:
    """(rung, start, end): runs of days with one rung."""
    w = W.orderBy("day")
    new = F.when(F.col("rung") == F.lag("rung").over(w), 0).otherwise(1)
    return days.withColumn("new", new).withColumn("run", F.sum("new").over(w)).groupBy("run", "rung").agg(F.min("day").alias("start"), F.max("day").alias("end")).drop("run")


def instants(spark: SparkSession, zone: str = "Europe/Madrid") -> DataFrame:
    """column, rung, local, ts: the hours of every rung in the city's clock and in UTC."""
    hours = rungs(spark).withColumn("hour", F.explode(F.sequence("first_hour", "last_hour")))
    local = F.to_timestamp_ntz(F.concat(F.col("date").cast("string"), F.lit(" "), F.lpad(F.col("hour").cast("string"), 2, "0"), F.lit(":00:00")))
    return (
        hours.withColumn("column", F.row_number().over(W.orderBy("rung", "hour")) - 1).withColumn("local", local)
        .withColumn("ts", F.to_utc_timestamp(local.cast("timestamp"), zone)).select("column", "rung", "hour", "local", "ts")
    )


def rung_of(rows: DataFrame, day: str, covers_: DataFrame) -> DataFrame:
    """Adds ``rung`` to rows by their date: an interval join with the few cover ranges."""
    dated = rows.withColumn("_day", ladder_date(F.col(day), YEAR))
    ranges = F.broadcast(covers_.select("rung", "start", "end"))  # under twenty ranges
    return dated.join(ranges, (F.col("_day") >= F.col("start")) & (F.col("_day") <= F.col("end"))).drop("_day", "start", "end")


def columns_at(rows: DataFrame, at: str, zone: str) -> DataFrame:
    """Adds low_column, high_column and share: where an instant (UTC) lies between the hours of its date's rung.

    Before the first hour and after the last that hour holds alone.
    """
    spark = rows.sparkSession
    hours = instants(spark, zone).groupBy("rung").agg(F.array_sort(F.collect_list(F.struct((F.col("hour") * 60.0).alias("minute"), F.col("column").alias("column")))).alias("_hours"))
    local = rows.withColumn("_local", F.from_utc_timestamp(at, zone))
    met = rung_of(local.withColumn("_date", F.col("_local").cast("date")), "_date", covers(assigned_days(spark))).join(F.broadcast(hours), "rung")  # seven rows
    minute = F.hour("_local") * 60.0 + F.minute("_local") + F.floor(F.second("_local")) / 60.0
    met = met.withColumn("_m", minute)
    low = F.element_at(F.filter("_hours", lambda h: h["minute"] <= F.col("_m")), -1)
    high = F.get(F.filter("_hours", lambda h: h["minute"] > F.col("_m")), F.lit(0))
    met = met.withColumn("_low", F.when(F.exists("_hours", lambda h: h["minute"] <= F.col("_m")), low)).withColumn("_high", high)
    low, high = F.coalesce("_low", "_high"), F.coalesce("_high", "_low")
    share = F.when(high["minute"] > low["minute"], (F.col("_m") - low["minute"]) / (high["minute"] - low["minute"])).otherwise(0.0)
    return met.select(*rows.columns, "rung", low["column"].cast("int").alias("low_column"), high["column"].cast("int").alias("high_column"), share.cast("double").alias("share"))
