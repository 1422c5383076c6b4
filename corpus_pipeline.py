"""From raw documents to a mixed training corpus, in five stages.

Each stage gets what the one before kept, written as Parquet and read again:

1. ``quality``: documents that the quality rules reject go;
2. ``near_duplicates``: one document of each group of near copies stays (the least id), by
   five-word shingles and a fingerprint budget that stands for a similarity of 0.8;
3. ``decontaminate``: documents that hold a benchmark window go;
4. ``secrets``: secrets are replaced by a mark, the documents stay;
5. ``mix``: of each source the words up to its budget are taken; rows tell how many.

In every stage null and empty texts, null ids and repeated rows are ordinary rows (stage 1
rejects texts of under 50 words, stage 2 keeps one of several equal rows), an empty table
stays empty, and columns other than those of ``documents`` are left out.

All stages but the last return the columns of ``documents``; the last adds the sizes, the
source's target and the words taken, and leaves out documents of which none are.
SQL can't express the fingerprints, so there is no SQL twin; the tests compare every stage
with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm.common import cut, table
from umbra.llm.op2_simhash import survivors
from umbra.llm.op5_secrets import redact
from umbra.llm.op6_quality import keep_documents
from umbra.llm.op8_decontaminate import clean_documents
from umbra.llm.op10_mix import mix_budgets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; a null or empty text fails them."""
    return keep_documents(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the least id, null ids last; blank texts are copies of each other."""
    return survivors(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window; null and empty texts, and all texts where the benchmark is empty, stay."""
    return clean_documents(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; a null text stays null."""
    return redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with how many; empty texts take none and go."""
    mixed = mix_budgets(docs.select(*COLUMNS), keep=COLUMNS)
    return mixed.where("taken > 0").select("kept.*", "size", "source_size", "target", "taken")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("mix", mix)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
