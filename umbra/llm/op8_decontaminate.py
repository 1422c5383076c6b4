"""Benchmark decontamination by a hash set of normalised test n-grams (native).

A window is ``n`` consecutive words of a benchmark item, or the whole of a shorter
item.  Every document is read once: its words become 64-bit hashes, each window of
hashes is tested against a bitmap of the benchmark's window hashes inside the same
projection, and only the few windows that pass are exploded, compared word for word
with the benchmark's windows (an exact hash join) and counted.  Text is not shuffled;
only verified hits are grouped by document.

The bitmap is a literal of 64 bits a window, two of them set, within ``BITMAP_BITS``; it
only screens.  The table of windows is broadcast when its measured size is at most
``BROADCAST_BYTES``; beyond that the hits meet it in a shuffled join.

Defined cases: null or empty texts have no words and no hits; items without words are
ignored, and an empty benchmark hits nothing; documents with a null id, and repeated ids
or rows, each keep their own row; equal windows of several items count for each of them.
Extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import cut, table

WINDOW = 10
#: Least and most bits of a screening bitmap, as powers of two: 8 KB to 2 MB in the plan.
BITMAP_BITS = (16, 24)
BROADCAST_BYTES = 32 << 20
#: Digests of contaminated texts that may be broadcast.
BROADCAST_ROWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words, before lowering: A-Z belong to words.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text in their own case; separators at the ends leave no empty word."""
    parts = F.split(F.coalesce(text, F.lit("")), SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(gram, n_words, items): each distinct window with the sorted ids of its items."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), words(lowered(F.col(text_col))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
    grams = rows.select("item", F.least(F.size("w"), F.lit(n)).alias("n_words"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))).alias("gram"))
    return grams.groupBy("gram", "n_words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def window_hash(hashes: str, at: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(F.col(hashes), at + k) for k in range(n)])


def screen_hash(grams: DataFrame, n: int) -> DataFrame:
    h = grams.where(F.col("n_words") == n).withColumn("h", F.transform(F.split("gram", " "), lambda w: F.xxhash64(F.lower(w))))
    return h.select(window_hash("h", F.lit(0), n).alias("hash"))


def bitmap_bits(windows: int) -> int:
    return min(max(math.ceil(math.log2(64 * max(windows, 1))), BITMAP_BITS[0]), BITMAP_BITS[1])


def probes(hash_: Column, bits: int) -> tuple[Column, Column]:
    """Two places of a hash in the bitmap, from its upper and its lower bits."""
    return F.shiftrightunsigned(hash_, 64 - bits), hash_.bitwiseAND(F.lit((1 << bits) - 1))


def bitmap(grams: DataFrame, n: int, bits: int) -> list[int]:
    """2**bits bits as longs; at most 2**(bits-6) rows reach the driver."""
    slots = screen_hash(grams, n).select(F.explode(F.array(*probes(F.col("hash"), bits))).alias("slot"))
    rows = (
        slots.select(F.shiftright("slot", 6).cast("int").alias("at"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
        .groupBy("at").agg(F.bit_or("bit").alias("bits")).collect()
    )
    longs = [0] * (1 << (bits - 6))
    for r in rows:
        longs[r["at"]] = r["bits"]
    return longs


def long_array(values: list[int]) -> Column:
    """A constant array<long>, decoded once while the plan is made (constant folding)."""
    joined = ",".join(map(str, values))
    return F.from_json(F.lit(f"[{joined}]"), "array<bigint>")


def passes(bits_: Column, hash_: Column, bits: int) -> Column:
    upper, lower = (F.getbit(F.get(bits_, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1 for at in probes(hash_, bits))
    return upper & lower


def screened_windows(bits_: Column, n: int, bits: int) -> Column:
    """array<struct<at, n, gram>> of the windows of n words whose hash is in the bitmap."""
    hashes = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: window_hash("h", i, n))
    at = F.array_compact(F.transform(hashes, lambda x, i: F.when(passes(bits_, x, bits), i)))
    gram = lambda i: lowered(F.array_join(F.slice("w", i + 1, F.lit(n)), " "))
    return F.transform(at, lambda i: F.struct(i.cast("int").alias("at"), F.lit(n).alias("n"), gram(i).alias("gram")))


def verified_hits(docs: DataFrame, benchmark: DataFrame, keep: list[str], n: int = WINDOW) -> DataFrame:
    """The columns ``keep`` of every row with n_words, n_hit and its items (sorted ids as strings)."""
    grams = benchmark_windows(benchmark, n).cache()
    weight = F.sum(F.octet_length("gram") + F.aggregate("items", F.lit(0).cast("long"), lambda a, i: a + F.octet_length(i) + 32) + 64)
    sizes = {r["n_words"]: r for r in grams.groupBy("n_words").agg(F.count("*").alias("windows"), weight.alias("bytes")).collect()}  # at most n rows
    base = (
        docs.select(*keep, words(F.col("text")).alias("w"))
        .withColumn("h", F.transform("w", lambda w: F.xxhash64(F.lower(w))))
    )
    hit = "array<struct<at:int,n:int,gram:string>>"
    found = F.array().cast(hit)
    for size in sorted(sizes):
        bits = bitmap_bits(sizes[size]["windows"])
        rows = screened_windows(long_array(bitmap(grams, size, bits)), size, bits)
        found = F.concat(found, F.when(F.size("w") >= size, rows).otherwise(F.array().cast(hit)))
    screened = base.select(*keep, F.monotonically_increasing_id().alias("row"), F.size("w").cast("long").alias("n_words"), found.alias("found"))
    spread = screened.select(*keep, "row", "n_words", F.explode_outer("found").alias("x")).select(*keep, "row", "n_words", "x.at", "x.n", "x.gram")
    table_ = grams.select("gram", "items")
    if sum(r["bytes"] for r in sizes.values()) <= BROADCAST_BYTES:
        table_ = F.broadcast(table_)
    span = F.when(F.col("items").isNotNull(), F.sequence("at", F.col("at") + F.col("n") - 1))
    return (
        spread.join(table_, "gram", "left")
        .groupBy("row", *keep, "n_words")
        .agg(F.collect_list(span).alias("spans"), F.collect_set("items").alias("sets"))
        .select(
            *keep, "n_words",
            F.size(F.array_distinct(F.flatten("spans"))).cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten("sets"))).alias("items"),
        )
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """The documents that hold no benchmark window, unchanged.

    The verdict belongs to the text, so contaminated texts are known by digest.  Counted few
    enough, the digests are broadcast and no text is shuffled; beyond, the documents meet
    them in a shuffled anti join, in which texts without words (never contaminated) have a
    key each.  Null and empty texts, null ids and repeated rows stay; columns may have any
    names but those starting with ``_umbra``.
    """
    mark = "_umbra_digest"
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    found = verified_hits(docs.select("text", digest.alias(mark)), benchmark, [mark], n)
    bad = cut(found.where("n_hit > 0").select(mark).distinct(), "contaminated")
    if bad.count() <= BROADCAST_ROWS:
        return docs.withColumn(mark, digest).join(F.broadcast(bad), mark, "left_anti").drop(mark)
    blank = F.coalesce(F.length("text"), F.lit(0)) == 0
    key = F.when(blank, F.monotonically_increasing_id().cast("string")).otherwise(digest)
    return docs.withColumn(mark, key).join(bad, mark, "left_anti").drop(mark)


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = verified_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
grams AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS gram
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM grams),
windows AS (
  SELECT r, pos, n, array_to_string(w[pos:pos + n - 1], ' ') AS gram
  FROM docs, sizes, unnest(range(1, len(w) - n + 2)) AS u(pos)),
hits AS (SELECT r, pos, windows.n, item FROM windows JOIN grams USING (gram)),
n_hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(range(pos, pos + n)) AS u(p) GROUP BY r),
ids AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN n_hit USING (r) LEFT JOIN ids USING (r)
"""
