"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.operators.store import cut, shared_dir

__all__ = ["WORD", "cut", "shared_dir", "table", "training_row"]

#: Runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def training_row(doc_id: Column, modulus: int) -> Column:
    """True for the rows whose crc32 of the id as text leaves a remainder; null ids train."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus != 0, F.lit(True))
