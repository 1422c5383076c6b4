"""LM scoring with an Elias-Fano n-gram trie, sharded by context.

The model is a bigram model smoothed over its unigrams: absolute discounting leaves mass
for one unknown word at the unigram level, and a Dirichlet prior of weight ``MU`` ties each
context to it.  Probabilities of seen bigrams and back-off weights are quantised and lie in
trie levels of one memory map (``elias_fano``); a pair is looked up by a successor search
relative to its context.

No model is gathered anywhere: the trie is cut into shards of about ``SHARD_TOKENS`` tokens,
and the questions go to the shards.

1. Texts become blocks of about ``BLOCK_BYTES``: word codes, the block's distinct word hashes
   and their training counts.  Written to the shared folder; texts aren't read again.
2. Each block sends its distinct words, with counts, to word shards (by hash); these add
   the counts up, number the words, and answer in the order asked.
3. Each block then knows id and count of all its words: it sums the base score and sends
   its pairs, grouped, to the shards of their contexts.  A context above a shard's share is
   dealt over several by its next word, so that no word makes a hot shard.
4. A shard adds up the pairs' training counts, builds its part of the trie, answers every
   pair by lookup, and returns one partial sum for each text.
5. Partial sums meet by block.

Words are known by their 64-bit XXH64; at 10**9 distinct words the chance that any two
meet is about 3 %.

Defined cases: a null or empty text is the end token alone; null ids train (nothing says they
are held out) and keep their rows; repeated rows count each time; without training rows every
count is 0 and the score is that of a uniform choice between the unknown word and the end.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import cut, table, training_row
from umbra.llm.elias_fano import TrieLevel
from umbra.llm.tokens import slices, split_words

FOLDS = 10
BLOCK_BYTES = 8 << 20
SHARD_WORDS = 2_000_000
SHARD_TOKENS = 2_000_000
#: Weight of the unigram prior in each context, in tokens.
MU = 200.0
BEGIN, END, FIRST = 0, 1, 2  #: ids: before the text, its end, and the first word's
ADD = 0.1


def pack(**arrays: np.ndarray) -> bytes:
    """Compressed arrays; wide items are stored byte plane by byte plane, whose high planes are nearly constant."""
    planes = {k: (a.dtype.str, np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T) if a.itemsize > 1 else a) for k, a in ((k, np.ascontiguousarray(a)) for k, a in arrays.items())}
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(planes, protocol=5))


def unpack(data: bytes) -> dict[str, np.ndarray]:
    planes = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
    return {k: np.ascontiguousarray(a.T).reshape(-1).view(d) if a.ndim == 2 else a for k, (d, a) in planes.items()}


def gaps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Steps between values that rise within runs; the first of a run is kept."""
    out = values.copy()
    out[1:] -= values[:-1]
    out[starts] = values[starts]
    return narrow(out)


def ungaps(steps: np.ndarray, runs: np.ndarray) -> np.ndarray:
    total = np.cumsum(steps, dtype=np.int64)
    starts = np.cumsum(runs) - runs
    before = np.where(starts > 0, total[starts - 1], 0)
    return total - np.repeat(before, runs)


def narrow(a: np.ndarray) -> np.ndarray:
    """The same non-negative values in the narrowest unsigned type."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def _batch(names: str, rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names.split())


# 1. Blocks

BLOCK = "block long, n_tokens long, n_train_docs long, n_words long, docs binary, words binary, counts binary"


def to_blocks(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~training_row(F.col("doc_id"), folds)).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, "text", BLOCK_BYTES):
                words = split_words(batch.column("text"), lower_ascii=True)
                names = [w.encode() for w in words.vocabulary.to_pylist()]
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
                order = np.lexsort((hashes, -np.bincount(words.codes, minlength=len(names))))  # frequent words get small codes
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                codes = place[words.codes] if len(order) else words.codes.astype(np.int64)
                held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                lengths = np.diff(words.offsets)
                train = np.repeat(~held, lengths)
                counts = np.bincount(codes[train], minlength=len(order))
                ids = batch.column("doc_id")
                packed = pack(ids=ids.fill_null(0).to_numpy(zero_copy_only=False), null=ids.is_null().to_numpy(zero_copy_only=False), held=held, lengths=narrow(lengths), codes=narrow(codes))
                yield _batch("block n_tokens n_train_docs n_words docs words counts", [(block, len(codes) + len(held), int((~held).sum()), len(order), packed, hashes[order].tobytes(), pack(counts=narrow(counts)))], [pa.int64()] * 4 + [pa.binary()] * 3)
                block += 1

    return cut(rows.mapInArrow(run, BLOCK), "lm-blocks")


# 2. Vocabulary

ANSWER = "block long, shard int, answer binary, tokens long, known long, once long, twice long"
_ANSWER = [pa.int64(), pa.int32(), pa.binary()] + [pa.int64()] * 4


def vocabulary(blocks: DataFrame, n_shards: int) -> DataFrame:
    """Answers (block, shard, ids and counts in the order of the block's words), and one row of totals a shard (block -1)."""

    def ask(batches):
        for batch in batches:
            for block, words, counts in zip(*(batch.column(c) for c in ("block", "words", "counts")), strict=True):
                hashes, n = np.frombuffer(words.as_py(), np.uint64), unpack(counts.as_py())["counts"]
                shard = (hashes % np.uint64(n_shards)).astype(np.int64)
                rows = [(s, block.as_py(), hashes[at].tobytes(), pack(n=n[at])) for s in range(n_shards) if len(at := np.flatnonzero(shard == s))] if n_shards <= 64 else [
                    (int(shard[at[0]]), block.as_py(), hashes[at].tobytes(), pack(n=n[at])) for at in _runs(shard)]
                yield _batch("shard block words n", rows, [pa.int32(), pa.int64(), pa.binary(), pa.binary()])

    def answer(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        shard = group.column("shard")[0].as_py()
        asked = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("words")]
        counts = np.concatenate([unpack(x.as_py())["n"].astype(np.int64) for x in group.column("n")])
        distinct, back = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(back, counts, len(distinct)).astype(np.int64)
        rank = np.empty(len(distinct), np.int64)
        rank[np.lexsort((distinct, -total))] = np.arange(len(distinct))  # frequent words get small ids
        ids = rank * n_shards + shard + FIRST
        rows, at = [], 0
        for block, words in zip(group.column("block").to_pylist(), asked, strict=True):
            these = back[at:at + len(words)]
            at += len(words)
            rows.append((block, shard, pack(ids=narrow(ids[these]), counts=narrow(total[these])), 0, 0, 0, 0))
        rows.append((-1, shard, None, int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum())))
        return pa.Table.from_batches([_batch("block shard answer tokens known once twice", rows, _ANSWER)])

    asked = blocks.select("block", "words", "counts").mapInArrow(ask, "shard int, block long, words binary, n binary")
    return cut(asked.groupBy("shard").applyInArrow(answer, ANSWER), "lm-words")


def _runs(key: np.ndarray) -> list[np.ndarray]:
    """Indices of each distinct key, in their order."""
    if not len(key):
        return []
    order = np.argsort(key, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(key[order])) + 1)


# 3. Questions of a block

QUESTION = "shard int, block long, kind int, body binary"
_QUESTION = [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a.astype(np.uint64) + np.uint64(1)) * _MIX
    h = (h ^ (h >> np.uint64(29)) ^ (b.astype(np.uint64) + np.uint64(1))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def unigram(count: np.ndarray, totals: dict) -> np.ndarray:
    """Discounted relative frequencies; what the discount frees is the unknown word's."""
    n, v = totals["tokens"], totals["known"]
    if not n:
        return np.full(np.shape(count), 0.5)
    d = totals["discount"]
    return np.where(count > 0, (count - d) / n, d * v / n)


def questions(blocks: DataFrame, answers: DataFrame, totals: dict, n_word_shards: int, n_shards: int) -> DataFrame:
    """Rows for the shards: pairs with what the block knows of them (kind 1), results so far (kind 0)."""
    n, v = totals["tokens"], totals["known"]

    def ask(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([_batch("shard block kind body", [], _QUESTION)])
        block = left.column("block")[0].as_py()
        docs = unpack(left.column("docs")[0].as_py())
        hashes = np.frombuffer(left.column("words")[0].as_py(), np.uint64)
        shard = (hashes % np.uint64(n_word_shards)).astype(np.int64)
        ids, counts = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(n_word_shards + 1))
        for s, body in zip(right.column("shard").to_pylist(), right.column("answer").to_pylist(), strict=True):
            got, at = unpack(body), order[bounds[s]:bounds[s + 1]]
            ids[at], counts[at] = got["ids"], got["counts"]
        lengths = docs["lengths"].astype(np.int64)
        n_docs = len(lengths)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        ends = starts + lengths
        size = int(lengths.sum()) + n_docs
        small = np.int32 if max(int(ids.max(initial=0)), int(counts.max(initial=0)), totals["ends"], size) < 1 << 31 else np.int64
        word, count = np.full(size, END, small), np.full(size, totals["ends"], small)
        inner = np.ones(size, bool)
        inner[ends] = False
        word[inner], count[inner] = ids.astype(small)[docs["codes"]], counts.astype(small)[docs["codes"]]
        del inner, hashes, shard, order
        base = np.add.reduceat(np.log10((count + ADD) / (n + ADD * (v + 1))), starts)
        known = np.add.reduceat(count > 0, starts, dtype=np.int64)
        context, seen = np.empty(size, small), np.empty(size, small)
        context[1:], seen[1:] = word[:-1], count[:-1]
        context[starts], seen[starts] = BEGIN, totals["ends"]
        doc = np.repeat(np.arange(n_docs, dtype=np.int32), lengths + 1)
        train = np.repeat(~docs["held"], lengths + 1)
        # A context with more tokens than a shard's share is dealt over several by the next word.
        deal = np.zeros(size, np.int32)
        large = np.flatnonzero(seen >= SHARD_TOKENS)
        deal[large] = _mixed(word[large], word[large]) % (1 + seen[large] // SHARD_TOKENS).astype(np.uint64)
        to = (_mixed(context, deal) % np.uint64(n_shards)).astype(np.int32)
        del deal, large
        rows = [(int(_mixed(np.array([block]), np.array([7]))[0] % np.uint64(n_shards)), block, 0, pack(ids=docs["ids"], null=docs["null"], held=docs["held"], n_tokens=narrow(lengths + 1), n_known=narrow(known), base=base))]
        del docs
        by = np.lexsort((word, context, to))
        to_, context_, word_ = to[by], context[by], word[by]
        del to, context, word
        fresh = np.concatenate([[True], (context_[1:] != context_[:-1]) | (word_[1:] != word_[:-1]) | (to_[1:] != to_[:-1])])
        kinds = np.flatnonzero(fresh)
        cuts = np.append(kinds, size)
        trained = np.add.reduceat(train[by], kinds, dtype=np.int64)
        del train
        ranges = np.flatnonzero(np.concatenate([[True], np.diff(to_[kinds]) != 0]))
        for a, b in zip(ranges, np.append(ranges[1:], len(kinds)), strict=True):
            first, k = kinds[a], kinds[a:b]
            touched, doc_at = np.unique(doc[by[first:cuts[b]]], return_inverse=True)
            c = context_[k]
            head = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            at = by[k]
            table_, one = np.unique(word_[k], return_index=True)
            top = np.zeros(1, np.int64)
            body = pack(
                contexts=gaps(c[head], top), seen=narrow(seen[at][head]), runs=narrow(np.diff(np.append(head, b - a))), words=gaps(word_[k], head),
                table=gaps(table_, top), counts=narrow(count[at[one]]), trained=narrow(trained[a:b]), times=narrow(np.diff(cuts[a:b + 1])), touched=gaps(touched, top), docs=narrow(doc_at),
            )
            rows.append((int(to_[first]), block, 1, body))
        return pa.Table.from_batches([_batch("shard block kind body", rows, _QUESTION)])

    left = blocks.select("block", "docs", "words").groupBy("block")
    right = answers.where("block >= 0").select("block", "shard", "answer").groupBy("block")
    return left.cogroup(right).applyInArrow(ask, QUESTION)


# 4. Shards of the trie

def answered(asked: DataFrame, totals: dict, mu: float = MU) -> DataFrame:
    """The shards' partial sums (kind 1) and, as they came, the blocks' own results (kind 0)."""

    def solve(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        kinds, blocks, bodies = (group.column(c).to_pylist() for c in ("kind", "block", "body"))
        shard = group.column("shard")[0].as_py()
        rows = [(shard, b, 0, body) for k, b, body in zip(kinds, blocks, bodies, strict=True) if k == 0]
        asks = [(b, unpack(body)) for k, b, body in zip(kinds, blocks, bodies, strict=True) if k == 1]
        del bodies, group
        if asks:
            pairs = [_pairs(a, totals) for _, a in asks]
            context, word, trained, seen, prior = (np.concatenate(x) for x in zip(*pairs, strict=True))
            level = trie(context, word, trained, seen, prior, mu)
            del context, word, trained, seen, prior
            for (block, a), (context, word, _, _, prior) in zip(asks, pairs, strict=True):
                found, log_p, weight = level.lookup(context, word)
                each = np.repeat(np.where(found, log_p, weight + np.log10(prior)), a["times"])
                rows.append((shard, block, 1, pack(touched=a["touched"], sums=np.bincount(a["docs"], each, len(a["touched"])))))
        return pa.Table.from_batches([_batch("shard block kind body", rows, _QUESTION)])

    return asked.groupBy("shard").applyInArrow(solve, QUESTION)


def _pairs(a: dict[str, np.ndarray], totals: dict) -> tuple[np.ndarray, ...]:
    """(context, word, training count, count of the context, unigram probability) of a block's pairs."""
    runs = a["runs"].astype(np.int64)
    words = ungaps(a["words"], runs)
    count = a["counts"][np.searchsorted(np.cumsum(a["table"], dtype=np.int64), words)]
    fits = np.uint32 if len(words) and words.max() < 1 << 32 else np.int64
    context = np.cumsum(a["contexts"], dtype=np.int64)
    context = context.astype(np.uint32) if len(context) and context.max() < 1 << 32 else context
    return np.repeat(context, runs), words.astype(fits), a["trained"].astype(np.int32), np.repeat(a["seen"], runs), unigram(count.astype(float), totals).astype(np.float32)


def trie(context: np.ndarray, word: np.ndarray, trained: np.ndarray, seen: np.ndarray, prior: np.ndarray, mu: float) -> TrieLevel:
    """The trie of the pairs with training counts; ``prior`` is the unigram probability of the word."""
    live = np.flatnonzero(trained > 0)
    live = live[np.lexsort((word[live], context[live]))]
    c, w = context[live], word[live]
    first = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])])) if len(live) else live
    count = np.add.reduceat(trained[live], first, dtype=np.int64) if len(first) else trained[:0]
    at = live[first]
    log_p = np.log10((count + mu * prior[at].astype(float)) / (seen[at] + mu))
    contexts = np.flatnonzero(np.concatenate([[True], c[first][1:] != c[first][:-1]])) if len(first) else first
    return TrieLevel.build(c[first].astype(np.uint64), w[first], log_p, np.log10(mu / (seen[at][contexts] + mu)))


# 5. Results

RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def results(partial: DataFrame, totals: dict) -> DataFrame:
    def merge(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("kind", "shard", "body")), strict=True), key=lambda r: r[:2])
        own = unpack(rows[0][2])
        score = np.zeros(len(own["ids"]))
        for _, _, body in rows[1:]:
            got = unpack(body)
            score[np.cumsum(got["touched"], dtype=np.int64)] += got["sums"]
        return pa.Table.from_arrays([
            pa.array(own["ids"], pa.int64(), mask=own["null"]), pa.array(own["held"]), pa.array(own["n_tokens"].astype(np.int64)), pa.array(own["n_known"].astype(np.int64)),
            pa.array(np.full(len(score), totals["tokens"])), pa.array(own["base"]), pa.array(score)], names=[c.split()[0] for c in RESULT.split(", ")])

    return partial.groupBy("block").applyInArrow(merge, RESULT)


def score_texts(docs: DataFrame, folds: int = FOLDS, mu: float = MU) -> DataFrame:
    blocks = to_blocks(docs, folds)
    sizes = blocks.agg(F.sum("n_tokens").alias("tokens"), F.sum("n_words").alias("words"), F.sum("n_train_docs").alias("ends")).first()
    n_word_shards = math.ceil((sizes["words"] or 1) / SHARD_WORDS)
    n_shards = math.ceil((sizes["tokens"] or 1) / SHARD_TOKENS)
    answers = vocabulary(blocks, n_word_shards)
    sums = answers.where("block < 0").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "known", "once", "twice")]).first()
    ends = sizes["ends"] or 0
    totals = {"ends": ends, "tokens": sums["tokens"] + ends, "known": sums["known"] + (ends > 0)}
    totals["discount"] = min(0.95, max(0.05, sums["once"] / max(1, sums["once"] + 2 * sums["twice"])))
    asked = questions(blocks, answers, totals, n_word_shards, n_shards)
    return results(answered(asked, totals, mu), totals)


def op1_lm(spark, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
