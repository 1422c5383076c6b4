"""Vectorised word splitting for Arrow string columns.

Words are maximal runs of characters other than ASCII white space.  A batch becomes flat
codes into its own dictionary, so per-word work is done once for each distinct word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Words(NamedTuple):
    codes: np.ndarray  #: int32, all words of all texts
    offsets: np.ndarray  #: int64, n_texts + 1
    vocabulary: pa.Array  #: distinct words, as code -> word


def split_words(texts: pa.Array, lower_ascii: bool = False) -> Words:
    """Words of each text (null: none); with ``lower_ascii`` A-Z alone are lowered."""
    texts = pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    if lower_ascii:  # after trimming, which makes a new array: lowering a slice in place misreads its offsets
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    offsets = offsets - offsets[0]
    empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # a blank text splits into one empty word
        kept = np.concatenate([[0], np.cumsum(~empty)])
        offsets, flat = kept[offsets], flat.filter(pa.array(~empty))
    coded = flat.dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), offsets, coded.dictionary)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``most_bytes`` of text (one row at least)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
