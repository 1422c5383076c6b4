"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL-proximal.

Features are hashed into 2**BITS slots: word unigrams and bigrams, the same of word
shapes (letter case, digits and punctuation patterns), bigrams marked by whether their
words are equal, and trigrams marked by how often they occur in their text.  A text is the relative frequency of its features, so its score
is one sparse dot product.

The model is fitted on at most ``MAX_TRAIN`` labelled documents (those with the least hash of
their id and text), by one task, in an order fixed by that hash; its weights are a constant
1 MB, which is the bound behind the broadcast.  Scoring is one pass over all whole texts.

Defined cases: null and empty texts have no features and score by the bias; rows with a
null label, and labels without a document, are not learned from and take no place in the
sample; rows of equal id and text are learned from once, an id with several labels has its
least; without any labelled row every score is 0.5; repeated rows and null ids each get
their row; ids may be of any type; extra columns and labels, lang, source and ids are never
inputs of a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import table, training_row
from umbra.llm.tokens import Words, slices, split_words

BITS = 18
#: Labelled rows to learn from, at most.
MAX_TRAIN = 4000
EPOCHS = 4
#: Folds: rows whose crc32 of the id leaves no remainder are held out.
FOLDS = 5
CUTOFF = 0.3
#: A text's relative frequencies are multiplied by this.
SCALE = 20.0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_SHAPE = bytes.maketrans(bytes(range(256)), bytes(88 if 65 <= b <= 90 else 120 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)))
_RUN = re.compile(rb"(.)\1+", re.S)


def _vocabulary_hashes(vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each word and of its shape."""
    words = [w.encode() for w in vocabulary.to_pylist()]
    digest, seen = xxhash.xxh64_intdigest, {}
    shapes = []
    for w in words:
        s = w.translate(_SHAPE)
        h = seen.get(s)
        if h is None:
            h = seen[s] = digest(_RUN.sub(rb"\1", s), 7)
        shapes.append(h)
    return np.array([digest(w, 3) for w in words], np.uint64), np.array(shapes, np.uint64)


def _slot(h: np.ndarray, space: int) -> np.ndarray:
    return (((h ^ np.uint64(space)) * _M3) >> np.uint64(64 - BITS)).astype(np.int64)


def features(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text index, slot) of every feature occurrence, one namespace at a time."""
    if not len(words.codes):
        return
    text = np.repeat(np.arange(len(words.offsets) - 1), np.diff(words.offsets))
    of_word, of_shape = _vocabulary_hashes(words.vocabulary)
    pair = text[1:] == text[:-1]
    for space, hashes in ((1, of_word), (2, of_shape)):
        h = hashes[words.codes]
        yield text, _slot(h, space)
        yield text[1:][pair], _slot(h[:-1] * _M1 + h[1:] * _M2, space + 10)[pair]
        yield text[1:][pair], _slot((h[:-1] == h[1:]).astype(np.uint64), space + 20)[pair]
    h = of_word[words.codes]
    if len(h) > 2:
        triple = pair[1:] & pair[:-1]
        key = (((h[:-2] * _M1 + h[1:-1]) * _M2 + h[2:]) * _M1 + text[2:].astype(np.uint64) * _M2)[triple]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        yield text[2:][triple], _slot(np.minimum(count[inverse], 4).astype(np.uint64), 30)


def scores(words: Words, weights: np.ndarray, bias: float) -> np.ndarray:
    n = len(words.offsets) - 1
    dot, total = np.zeros(n), np.zeros(n)
    for text, slot in features(words):
        dot += np.bincount(text, weights[slot], n)
        total += np.bincount(text, minlength=n)
    return 1 / (1 + np.exp(-np.clip(bias + SCALE * dot / np.maximum(total, 1), -40, 40)))


def sparse_rows(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text: distinct slots and their values."""
    parts = list(features(words))
    n = len(words.offsets) - 1
    text = np.concatenate([p[0] for p in parts] or [np.empty(0, np.int64)])
    slot = np.concatenate([p[1] for p in parts] or [np.empty(0, np.int64)])
    key, count = np.unique(text << BITS | slot, return_counts=True)
    bounds = np.searchsorted(key >> BITS, np.arange(n + 1))
    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
        yield (key[s:e] & ((1 << BITS) - 1)).astype(np.int32), (SCALE * count[s:e] / max(1, count[s:e].sum())).astype(np.float32)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias from (label, slots, values), by FTRL-proximal in the order given."""
    size = (1 << BITS) + 1  # the last is the bias
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        zi, ni = z[at], n[at]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    rows = [(y, np.append(i, size - 1), np.append(v, np.float32(1))) for y, i, v in rows]
    for _ in range(epochs):
        for y, at, x in rows:
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            ni = n[at]
            z[at] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
    w = weights(np.arange(size))
    return w[:-1].astype(np.float32), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> tuple[np.ndarray, float]:
    order = ["key", "doc_id", "tie"]
    known = labels.where(F.col("quality").isin(0, 1) & training_row(F.col("doc_id"), FOLDS)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    ids = docs.select("doc_id", F.xxhash64("text").alias("tie")).join(known, "doc_id").distinct()
    sample = ids.withColumn("key", F.xxhash64("doc_id")).orderBy(*order).limit(most)  # ids, hashes and labels of at most `most` documents
    found = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).join(F.broadcast(sample), ["doc_id", "tie"])
    chosen = found.groupBy(*order).agg(F.first("quality").alias("quality"), F.first("text").alias("text"))
    fields = f"key long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, tie long, quality int"

    def featurise(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = list(sparse_rows(split_words(batch.column("text"))))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:4], pa.array([i.tobytes() for i, _ in rows], pa.binary()), pa.array([v.tobytes() for _, v in rows], pa.binary())],
                    names=[*order, "quality", "slots", "values"],
                )

    def learn(batches):
        rows = [(y, np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for b in batches for y, i, v in zip(b.column("quality").to_pylist(), b.column("slots").to_pylist(), b.column("values").to_pylist(), strict=True)]
        weights, bias = train(rows)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])

    sparse = chosen.mapInArrow(featurise, f"{fields}, slots binary, values binary")
    model = sparse.repartition(1).sortWithinPartitions(*order).mapInArrow(learn, "weights binary, bias double").first()
    if model is None:
        return np.zeros(1 << BITS, np.float32), 0.0
    return np.frombuffer(model["weights"], np.float32), model["bias"]


def classify(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))
    rows = docs.select("doc_id", (~training_row(F.col("doc_id"), FOLDS)).alias("held_out"), "text")

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                got = scores(split_words(batch.column("text")), *model.value)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(got), pa.array((got >= CUTOFF).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def op4_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, *fit(docs, table(spark, sf_dir, "labels")))
