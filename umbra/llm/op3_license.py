"""License scans by canonical digests (native DataFrame functions only).

A text is made canonical: lower case, copyright lines removed, punctuation and white
space folded to one space, equivalent spellings replaced.  Its SHA-256 is looked up by a
hash join among the digests of known licence texts, which are made by the same
expressions.  Both the entire text and each entire line (licence notices are lines of
larger documents) are looked up.

The built-in digests (``license_texts``: short texts and notices in full, longer texts by
digest) are a few dozen rows, which is the size bound behind the broadcast; ``scan`` takes
a table of further digests, which is joined as its size asks.  Documents are read once and
never shuffled with their text.

Defined cases: a null or empty text has the digest of the empty text, which is no
licence; repeated rows and null ids each keep a row; several notices are listed once
each, sorted.  Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm.common import table
from umbra.llm.license_texts import DIGESTS, EQUIVALENT, LICENSES, NOTICES

COPYRIGHT_LINE = r"(?m)^[^\n\p{L}\p{N}]*(copyright\b|\(c\)|©|all rights reserved)[^\n]*$"
FOLDED = r"[^\p{L}\p{N}\n]+"


def canonical(text: Column) -> Column:
    """Canonical text with its line structure: every word is followed and preceded by a space."""
    c = F.lower(F.coalesce(text, F.lit("")))
    c = F.regexp_replace(c, COPYRIGHT_LINE, "")
    c = F.concat(F.lit(" "), F.replace(F.regexp_replace(c, FOLDED, " "), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for old, new in EQUIVALENT:
        c = F.replace(c, F.lit(f" {old} "), F.lit(f" {new} "))
    return c


def digest(canonical_: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(canonical_, r"\s+", " ")), 256)


def known_digests(spark: SparkSession) -> DataFrame:
    """(digest, license_id) of the fixed texts, digests and notices."""
    rows = [(k, t) for k, texts in (LICENSES | {}).items() for t in texts] + [(k, t) for k, texts in NOTICES.items() for t in texts]
    known = spark.createDataFrame(rows, "license_id string, text string")
    longer = spark.createDataFrame([(d, k) for k, digests in DIGESTS.items() for d in digests], "digest string, license_id string")
    return known.select(digest(canonical(F.col("text"))).alias("digest"), "license_id").unionAll(longer).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: DataFrame | None = None) -> DataFrame:
    """doc_id, text_sha256, license_id (entire text, or null), n_notices, notices.

    ``digests`` (digest, license_id) are looked up besides the built-in ones; where both
    hold a digest, theirs counts.  A digest is ``digest(canonical(text))`` of a licence text.
    """
    known, held = known_digests(docs.sparkSession), F.broadcast
    if digests is not None:
        own = digests.where("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id"))
        known, held = known.join(own, "digest", "left_anti").unionByName(own), lambda table: table
    base = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), canonical(F.col(text_col)).alias("c"))
    # Inside a canonical line single spaces stand between words, so trimming completes it; an empty line is no notice.
    units = base.select("doc_id", "row", digest(F.col("c")).alias("text_sha256"), F.split("c", "\n").alias("lines"))
    units = units.select("doc_id", "row", "text_sha256", F.explode("lines").alias("line")).withColumn("line_sha256", F.sha2(F.trim("line"), 256))
    lines = held(known.select(F.col("digest").alias("line_sha256"), F.col("license_id").alias("notice")))
    whole = held(known.select(F.col("digest").alias("text_sha256"), "license_id"))
    return (
        units.join(lines, "line_sha256", "left")
        .groupBy("row", "doc_id", "text_sha256").agg(F.array_sort(F.collect_set("notice")).alias("ids"))
        .join(whole, "text_sha256", "left")
        .select("doc_id", "text_sha256", "license_id", F.size("ids").cast("long").alias("n_notices"), F.array_join("ids", ",").alias("notices"))
    )


def op3_license(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    def canon(x: str) -> str:
        c = rf"regexp_replace(lower(coalesce({x}, '')), '(?m)^[^\n\p{{L}}\p{{N}}]*(copyright\b|\(c\)|©|all rights reserved)[^\n]*$', '', 'g')"
        c = rf"' ' || regexp_replace(regexp_replace({c}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), '\n', chr(32) || chr(10) || chr(32), 'g') || ' '"
        for old, new in EQUIVALENT:
            c = f"replace({c}, ' {old} ', ' {new} ')"
        return c

    def sha(x: str) -> str:
        return rf"sha256(trim(regexp_replace({x}, '\s+', ' ', 'g')))"

    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(k)}, {quote(t)})" for group in (LICENSES, NOTICES) for k, texts in group.items() for t in texts)
    return f"""
WITH texts(license_id, text) AS (VALUES {values}),
known AS (SELECT digest, min(license_id) AS license_id FROM (SELECT {sha('c')} AS digest, license_id FROM (SELECT license_id, {canon('text')} AS c FROM texts)) GROUP BY digest),
base AS (SELECT row_number() OVER () AS r, doc_id, {canon('text')} AS c FROM documents),
found AS (SELECT r, license_id FROM (SELECT r, {sha('line')} AS digest FROM (SELECT r, unnest(string_split(c, chr(10))) AS line FROM base) WHERE len(trim(line)) > 0) JOIN known USING (digest)),
notices AS (SELECT r, count(DISTINCT license_id) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids FROM found GROUP BY r)
SELECT doc_id, {sha('c')} AS text_sha256, known.license_id, coalesce(n, 0)::BIGINT AS n_notices, coalesce(ids, '') AS notices
FROM base LEFT JOIN notices USING (r) LEFT JOIN known ON known.digest = {sha('c')}
"""


OP3_SQL = _sql()
