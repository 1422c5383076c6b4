"""Mixing sources to target weights by hash-random keys and distributed prefix sums.

Every document gets a pseudo-random key (MD5 of its id).  Within each source the
documents are ordered by that key; prefix sums of their sizes say where the source's
word budget is cut.  A budget above the source's size repeats whole epochs first.

Scale: the key space of every source is cut into equal buckets, whose sizes come from one
aggregate.  Their prefix sums tell in which bucket the budget ends: rows of the buckets
before are taken whole, those of the buckets after not at all, and only the rows of that
one bucket are ordered, by ranges over their whole sort key, so that rows which share an id
don't meet in one task.  A row needs one line for its source, which is broadcast while
sources are counted to be at most ``BROADCAST_SOURCES``; beyond, sources are dealt over
salts.  Texts are not shuffled but for those of the buckets that are cut.

Defined cases: a null or empty text has size 0 and takes 0; a null source is a source
of its own, ordered last; null and repeated ids are ordinary rows (rows that share a key
are ordered by id, size and the hash of the text, so reruns agree); a source of size 0 has
target 0; an empty table gives an empty result.  Columns to keep come back in a struct of
their own, so their names may be any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from umbra.llm.common import WORD, cut, table
from umbra.operators.numbering import numbered, running

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKET_DIGITS = 3
#: Lines that may be broadcast, one a source.
BROADCAST_SOURCES = 100_000
SOURCE = ["no_source", "src"]


def sized(docs: DataFrame, bucket_digits: int = BUCKET_DIGITS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.col(source_col).isNull().alias("no_source"),
        F.coalesce(F.col(source_col), F.lit("")).alias("src"),
        key.alias("key"),
        F.xxhash64(text_col).alias("tie"),
        *([F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] if keep else []),
    ).withColumn("bucket", F.substring("key", 1, bucket_digits))


def targets(buckets: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(no_source, src, source_size, target) from rows (no_source, src, size).

    Sources in code-point order (null last) get the weights in turn.  A target stops at
    ``max_epochs`` sizes; what is above is shared again by weight.  In order of size per
    weight the capped sources are a prefix, so one pass of running sums finds them all.
    """
    turn = F.col("turn") % len(weights)
    weight = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        weight = F.when(turn == i, w).otherwise(weight)
    sources = (
        numbered(buckets.groupBy(*SOURCE).agg(F.sum("size").alias("source_size")), SOURCE, "turn")
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("per_weight", F.col("cap") / F.col("weight"))
        .select(*SOURCE, "source_size", "weight", "cap", "per_weight")
    )
    order = ["per_weight", *SOURCE]
    filled = running(sources, order, {"cap_before": F.col("cap"), "weight_before": F.col("weight")})
    total = filled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    share = (F.lit(total["size"] or 0) - F.col("cap_before")) / (F.lit(total["weight"] or 0) - F.col("weight_before"))
    shared = filled.withColumn("share", share).withColumn("capped", F.col("per_weight") <= F.col("share"))
    # Where the first source stays below its cap, all that is left is shared by weight.
    level = shared.where(~F.col("capped")).agg(F.min_by("share", F.struct(*order))).first()[0]
    uncapped = F.least(F.col("weight") * F.lit(level).cast("double"), F.col("cap").cast("double"))
    return shared.select(*SOURCE, "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(uncapped).alias("target"))


def mix_budgets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, bucket_digits: int = BUCKET_DIGITS, keep: list[str] | None = None, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """doc_id, size, source_size, target, taken (and no_source, src, key, the struct ``kept``) for every row."""
    rows = cut(sized(docs, bucket_digits, keep=keep), "mix")
    buckets = cut(rows.groupBy(*SOURCE, "bucket").agg(F.sum("size").alias("size")), "buckets")
    whole = F.coalesce(F.expr("floor(target) div nullif(source_size, 0)"), F.lit(0))
    budgets = targets(buckets, weights, max_epochs).withColumn("epochs", whole).withColumn("rest", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size"))
    before = W.partitionBy(*SOURCE).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    placed = buckets.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))).join(budgets.select(*SOURCE, "rest"), SOURCE)
    ends = placed.where(F.col("offset") + F.col("size") > F.col("rest")).groupBy(*SOURCE).agg(F.min(F.struct("bucket", "offset")).alias("end"))
    lines = cut(budgets.join(ends, SOURCE, "left").select(*SOURCE, "source_size", "target", "epochs", "rest", F.col("end.bucket").alias("end_bucket"), F.col("end.offset").alias("end_offset")), "sources")
    if lines.count() <= broadcast_sources:
        joined = rows.join(F.broadcast(lines), SOURCE)
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(255))).alias("salt")
        joined = rows.withColumn("salt", F.pmod("tie", F.lit(256)).cast("int")).join(lines.select("*", salts), [*SOURCE, "salt"]).drop("salt")
    extra = ["kept"] if keep else []
    result = lambda took: ["doc_id", "size", *SOURCE, "key", "source_size", "target", (F.col("epochs") * F.col("size") + took).alias("taken"), *extra]
    here = F.col("bucket") == F.col("end_bucket")
    plain = joined.where(~F.coalesce(here, F.lit(False))).select(*result(F.when(F.col("end_bucket").isNull() | (F.col("bucket") < F.col("end_bucket")), F.col("size")).otherwise(0)))
    ordered = running(joined.where(here), [*SOURCE, "key", "doc_id", "size", "tie"], {"at": F.col("size")})
    start = F.col("end_offset") + F.col("at") - F.col("first_at")
    firsts = ordered.groupBy(*SOURCE).agg(F.min("at").alias("first_at"))
    firsts = F.broadcast(firsts) if lines.count() <= broadcast_sources else firsts
    last = ordered.join(firsts, SOURCE).select(*result(F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start))))
    return plain.unionByName(last)


def op10_mix(spark, sf_dir: str) -> DataFrame:
    return mix_budgets(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         source IS NULL AS no_source, coalesce(source, '') AS src, md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
named AS (
  SELECT no_source, src, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY no_source, src) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY no_source, src),
caps AS (SELECT *, source_size * 3 AS cap, (source_size * 3)::DOUBLE / weight AS per_weight, sum(source_size) OVER ()::BIGINT AS total FROM named),
fill AS (
  SELECT *, (total - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS left_words,
         (sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS left_weight
  FROM caps WINDOW f AS (ORDER BY per_weight, no_source, src)),
level AS (SELECT min(left_words / left_weight) FILTER (WHERE per_weight > left_words / left_weight) AS v FROM
          (SELECT * FROM fill WHERE per_weight > left_words / left_weight ORDER BY per_weight, no_source, src LIMIT 1)),
targets AS (
  SELECT no_source, src, source_size,
         CASE WHEN per_weight <= left_words / left_weight THEN cap::DOUBLE ELSE least(weight * (SELECT v FROM level), cap::DOUBLE) END AS target
  FROM fill),
placed AS (
  SELECT d.*, t.source_size, t.target,
         coalesce(sum(size) OVER (PARTITION BY d.no_source, d.src ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
         coalesce(floor(target)::BIGINT // nullif(t.source_size, 0), 0)::BIGINT AS epochs
  FROM sized d JOIN targets t USING (no_source, src))
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - start)))::BIGINT AS taken
FROM placed
"""
