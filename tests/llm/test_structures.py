"""The succinct structures, and what the plans of native operators are made of."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from umbra.llm.elias_fano import EliasFano, TrieLevel
from umbra.llm.html_blocks import blocks
from umbra.llm.op3_license import op3_license
from umbra.llm.op8_decontaminate import op8_decontaminate
from umbra.llm.tokens import slices, split_words


@pytest.mark.parametrize("top", [2, 50, 1000, 10**6, 2**40])
def test_elias_fano(top):
    rng = np.random.default_rng(top)
    for n in (1, 2, 63, 64, 65, 200):
        values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        ef = EliasFano.build(values)
        assert (ef.access(np.arange(n)) == values).all()
        asked = np.concatenate([rng.integers(0, top + 5, 50).astype(np.uint64), values])
        assert (ef.successor(asked) == np.searchsorted(values, asked)).all()


@pytest.mark.parametrize("mapped", [False, True])
def test_trie_level(tmp_path, mapped):
    rng = np.random.default_rng(1)
    for n in (0, 1, 300):
        keys = np.unique(rng.integers(0, 20, n) * 100 + rng.integers(0, 30, n))
        context, word = keys // 100, keys % 100
        log_p, back = -8 * rng.random(len(keys)), -rng.random(len(np.unique(context)))
        level = TrieLevel.build(context.astype(np.uint64), word.astype(np.uint64), log_p, back, str(tmp_path / "level") if mapped else None)
        c, w = rng.integers(0, 22, 400), rng.integers(0, 31, 400)
        found, p, b = level.lookup(c.astype(np.uint64), w.astype(np.uint64))
        place = {k: i for i, k in enumerate(keys.tolist())}
        first = {k: i for i, k in enumerate(np.unique(context).tolist())}
        for i in range(400):
            k = int(c[i] * 100 + w[i])
            assert found[i] == (k in place)
            assert not found[i] or abs(p[i] - log_p[place[k]]) < 2e-4
            assert abs(b[i] - (back[first[c[i]]] if c[i] in first else 0)) < 2e-4


def test_words_are_split_at_ascii_blanks_only():
    texts = ["a\x1cb\x85c\xa0d \x0b e", " ", "", None, "\x00 x É\tÉ", "A  a"]
    for array in (pa.array(texts), pa.array(["zz", *texts])[1:]):
        got = split_words(array, lower_ascii=True)
        words = [got.vocabulary[int(i)].as_py() for i in got.codes]
        want = [[w.decode() for w in (t or "").encode().lower().split()] for t in texts]
        assert [words[a:b] for a, b in zip(got.offsets[:-1], got.offsets[1:], strict=True)] == want


def test_slices_hold_every_row():
    batch = pa.RecordBatch.from_pydict({"t": ["x" * n for n in (5, 90, 0, 7, 300, 1)] + [None]})
    parts = list(slices(batch, "t", 100))
    assert sum(p.num_rows for p in parts) == 7 and max(p.num_rows for p in parts) < 7


@pytest.mark.parametrize("query", [op3_license, op8_decontaminate])
def test_native_plans_have_no_python(spark, data, query):
    plan = query(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "CartesianProduct" not in plan


@pytest.mark.parametrize(("page", "texts"), [
    ("<p>for <math><mi>x</mi><mo>=</mo><mn>1</mn></math> all</p><p>next</p>", ["for x=1 all", "next"]),
    ("<p>see <svg viewBox='0 0 1 1'><g><path d='M0'/><text>A</text><text>B</text></g></svg> here</p><p>next</p>", ["see A B here", "next"]),
    ("<p>film <object data='a.swf'>a fallback</object> or <canvas>a drawing</canvas>.</p>", ["film a fallback or a drawing ."]),
    ("<template><p>held</p></template><p>next</p>", ["held", "next"]),
    ("<p>one <svg><path d='M0'>two</p><p>three</p>", ["one two", "three"]),
    ("<p>one<math><mi>x<p>two</p><p>three</p>", ["onex", "two", "three"]),
    ("<p>one</p><object data='x'><p>two</p>", ["one", "two"]),
    ("<p>one</p><noscript><p>two</p>", ["one", "two"]),
    ("<p>one</p><script>var a = 1;<p>two</p>", ["one", "two"]),
    ("<title>T</title><p>one<style>p{}</style> two</p><script>x</script>", ["one two"]),
    ("<svg><foreignObject><div><p>in</p></div></foreignObject></svg><p>out</p>", ["in", "out"]),
    ("<svg><title>icon</title><path d='M0'/></svg><p>out</p>", ["out"]),
])
def test_blocks_keep_foreign_and_fallback_text(page, texts):
    assert [b.text for b in blocks(page)] == texts


def test_open_raw_tags_are_linear():
    assert blocks("<iframe>" * 100_000 + "end")[-1].text == "end"
