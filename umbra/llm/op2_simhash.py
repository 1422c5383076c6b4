"""SimHash near-dedup by a binary-trie self-join.

Fingerprint: the words of a text in shingles; a bit is 1 where it is set in over half of
the shingles' XXH64.  Equal fingerprints collapse first (one row each, with the smallest
id), so copies cost one aggregate.  Distinct fingerprints within ``BUDGET`` differing
bits are found by traversing a binary trie against itself: pairs of nodes go down
together, every bit in which they part costs one, and a pair is dropped as soon as the
budget is spent.

Scale: fingerprints within 3 bits agree in at least one of 4 bands of 16 bits, so every
fingerprint goes to 4 subtrees (band, value), each traversed by itself.  A subtree above
``SPLIT`` fingerprints is cut again by the same argument on its remaining 48 bits (4 sub-bands
of 12), which keeps the join exact.  A subtree emits a spanning forest of its
links, never all pairs.  Components are found by alternating large-star and small-star
steps over those links, each written to the shared folder.

``survivors`` is the same join over wider fingerprints, for near copies by five-word shingles:
512 bits, 32 bands of 16, and a budget of 82.  So many bits may touch every band, so pairs of
blocks of fingerprints are compared as well (``rest_links``): no pair within the budget is lost.

Defined cases: a null or empty text has fingerprint zero and is linked like any other;
repeated rows are copies; a null id is a row like others and names no component (a
component of null ids alone has a null component_id); extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import cut, table
from umbra.llm.tokens import slices, split_words

SHINGLE = 3
SEED = 42
BUDGET = 3
#: The pipeline's stage: five words, and a Hamming budget that stands for a Jaccard similarity of
#: 0.8 on wide fingerprints.  At 0.8 a bit differs with probability 0.152 (78 of 512 bits).
STAGE_SHINGLE, STAGE_WIDE, STAGE_BUDGET = 5, 8, 82
#: Rows that may be broadcast: 8 bytes each, some 32 MB as a hash table.
BROADCAST_ROWS = 1_000_000
#: No key of a shuffled join holds more than this part of all rows.
HOT = 64
#: Groups and frontiers above this size look for whole classes first.
LEADERS = 256
SPLIT = 50_000
#: Node pairs that one step of the traversal holds; more are taken in two halves.
FRONTIER = 1 << 20
#: All pairs: blocks there should be, rows a block has at least and at most, and rows that are compared with rows at once.
BLOCKS, BLOCK_ROWS, TILE = 8, (4096, 1 << 18), (1024, 4096)


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    norm = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_intdigest(norm, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(words) - k + 1
    for i in range(0, n, 65536):
        j = min(n, i + 65536)
        hashes = np.array([digest(norm[s:e], SEED) for s, e in zip(starts[i:j].tolist(), ends[i + k - 1:j + k - 1].tolist(), strict=True)], "<u8")
        counts += bit_counts(hashes[:, None])
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many rows of ``hashes`` (uint64, a column for every 64 bits) have each bit set."""
    counts = np.zeros(64 * hashes.shape[1], np.int64)
    for i in range(0, len(hashes), 255):  # what a byte can count
        counts += np.unpackbits(hashes[i:i + 255].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return counts


def wide_prints(texts: pa.Array, k: int, wide: int) -> np.ndarray:
    """Fingerprints of 64 * ``wide`` bits over the distinct k-word shingles of each text, a row of longs a text."""
    words = split_words(texts, lower_ascii=True)
    named = np.fromiter((xxhash.xxh64_intdigest(w.encode(), SEED) for w in words.vocabulary.to_pylist()), np.uint64, len(words.vocabulary))
    own = named[words.codes]
    out = np.zeros((len(texts), wide), "<u8")
    lanes = np.arange(1, wide + 1, dtype=np.uint64) * _STEP
    for t, (start, end) in enumerate(zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True)):
        if start == end:
            continue
        n = max(1, end - start - k + 1)
        h = np.zeros(n, np.uint64)
        for j in range(min(k, end - start)):
            h = _mixed(h + own[start + j:start + j + n])
        h = np.unique(h)
        counts = sum(bit_counts(_mixed(h[i:i + 4080, None] + lanes)) for i in range(0, len(h), 4080))
        out[t] = np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")
    return out


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(docs: DataFrame, carry: list[str], k: int = SHINGLE, text_col: str = "text") -> DataFrame:
    """The columns ``carry`` with ``fp``, the fingerprint as a signed long."""
    rows = docs.select(*carry, *([] if text_col in carry else [text_col]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(x.as_py(), k) for x in batch.column(text_col)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(carry)], pa.array(prints.view(np.int64))], names=[*carry, "fp"])

    return rows.mapInArrow(run, f"{fields}, fp long")


def trie_links(prints: np.ndarray, groups: np.ndarray, budget: int = BUDGET, frontier: int = FRONTIER) -> tuple[np.ndarray, np.ndarray]:
    """(member, representative) indices: a spanning forest of the links inside each group.

    ``prints`` (unsigned, one column for every 64 bits) are sorted within ``groups`` (bounds
    of each group).  A trie node is a range of the sorted values; bit by bit the range falls
    into its 0 and 1 child.  Pairs of nodes that are one class already are left out.
    """
    prints = prints if prints.ndim == 2 else prints[:, None]
    n, bits = len(prints), 64 * prints.shape[1]
    label = np.arange(n)
    if n < 2:
        return label[:0], label[:0]

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1) <= budget

    ones = {}  # per bit: how many of the first i values have it set

    def set_below(depth: int) -> np.ndarray:
        if depth not in ones:
            bit = (prints[:, depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
        return ones[depth]

    lo, hi = groups[:-1], groups[1:]
    for s, e in zip(lo[hi - lo > LEADERS].tolist(), hi[hi - lo > LEADERS].tolist(), strict=True):
        own = np.arange(s, e)
        for leader in np.linspace(s, e - 1, 8).astype(np.int64).tolist():  # a few stars first: most of a large class is then known
            star = own[near(np.full(e - s, leader), own)]
            _union(label, np.full(len(star), leader), star)
    more = hi - lo > 1
    pairs = np.stack([lo[more], hi[more], lo[more], hi[more], np.zeros(more.sum(), np.int64)])
    todo = [(0, pairs)]
    while todo:
        depth, pairs = todo.pop()
        alone = (pairs[1] - pairs[0] == 1) & (pairs[3] - pairs[2] == 1)
        if alone.any():
            a, b = pairs[0][alone], pairs[2][alone]
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            linked = near(a, b)
            _union(label, a[linked], b[linked])
            pairs = pairs[:, ~alone]
        if depth == bits:
            if pairs.shape[1]:  # equal values, within the budget of each other
                _union(label, np.repeat(pairs[0], pairs[1] - pairs[0]), _ranges(pairs[0], pairs[1]))
                _union(label, np.repeat(pairs[2], pairs[3] - pairs[2]), _ranges(pairs[2], pairs[3]))
                _union(label, pairs[0], pairs[2])
            continue
        if pairs.shape[1] > LEADERS:
            change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
            one = (change[pairs[1] - 1] == change[pairs[0]]) & (change[pairs[3] - 1] == change[pairs[2]]) & (label[pairs[0]] == label[pairs[2]])
            pairs = pairs[:, ~one]
        if not pairs.shape[1]:
            continue
        if pairs.shape[1] > frontier:
            half = pairs.shape[1] // 2
            todo += [(depth, pairs[:, half:]), (depth, pairs[:, :half])]
            continue
        below = set_below(depth)
        alo, ahi, blo, bhi, cost = pairs
        amid, bmid = ahi - (below[ahi] - below[alo]), bhi - (below[bhi] - below[blo])
        other = alo != blo
        children = np.concatenate([
            np.stack([alo, amid, blo, bmid, cost]),
            np.stack([amid, ahi, bmid, bhi, cost]),
            np.stack([alo, amid, bmid, bhi, cost + 1]),
            np.stack([amid, ahi, blo, bmid, cost + 1])[:, other],
        ], axis=1)
        size_a, size_b = children[1] - children[0], children[3] - children[2]
        live = (size_a > 0) & (size_b > 0) & (children[4] <= budget) & ((children[0] != children[2]) | (size_a > 1))
        todo.append((depth + 1, children[:, live]))
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    size = hi - lo
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - lo, size)


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of a[i] and b[i]; every label is the least index of its class."""
    while len(a):
        x, y = label[a], label[b]
        live = x != y
        if not live.any():
            return
        a, b, x, y = a[live], b[live], x[live], y[live]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            above = label[label]
            if (above == label).all():
                break
            label[:] = above


def links(prints: DataFrame, split: int = SPLIT) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect every near pair."""
    sub = lambda value, width: [F.shiftrightunsigned(value, width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(4)]
    bands = prints.select("fp", F.posexplode(F.array(*sub(F.col("fp"), 16))).alias("band", "value"))
    # What is left of a fingerprint without its band, as 48 bits.
    low = F.expr("fp & (shiftleft(1L, 16 * band) - 1)")
    high = F.expr("case when band = 3 then 0L else shiftleft(shiftrightunsigned(fp, 16 * band + 16), 16 * band) end")
    large = bands.groupBy("band", "value").count().where(F.col("count") > split).select("band", "value", F.lit(True).alias("large"))
    keyed = bands.join(large, ["band", "value"], "left").withColumn("rest", low.bitwiseOR(high))
    subs = F.when(F.col("large"), F.array(*[F.struct(F.lit(i).alias("s"), v.alias("v")) for i, v in enumerate(sub(F.col("rest"), 12))])).otherwise(F.array(F.struct(F.lit(-1).alias("s"), F.lit(0).cast("long").alias("v"))))
    keyed = keyed.select("fp", "band", "value", F.explode(subs).alias("x")).select(F.col("fp").alias("node"), F.expr("unhex(lpad(hex(fp), 16, '0'))").alias("fp"), "band", "value", "x.s", "x.v")
    return _solved(keyed, ["band", "value", "s", "v"], BUDGET)


def wide_links(nodes: DataFrame, budget: int, wide: int) -> DataFrame:
    """(a, b): links between the nodes (node, fp as 8 * ``wide`` bytes) that connect every pair
    whose fingerprints differ in ``budget`` bits at most: those with an equal band by the trie,
    and, as no equal band need exist above a budget of 4 * ``wide`` - 1, the rest by all pairs."""
    found = band_links(nodes, budget, wide)
    return found if budget < 4 * wide else found.unionByName(rest_links(nodes, budget, nodes.count())).distinct()


def band_links(nodes: DataFrame, budget: int, wide: int) -> DataFrame:
    """(a, b): links that connect every pair with an equal band of 16 bits and ``budget`` differing bits at most."""
    bands = F.transform(F.sequence(F.lit(1), F.lit(8 * wide - 1), F.lit(2)), lambda i: F.conv(F.hex(F.substring("fp", i, F.lit(2))), 16, 10).cast("int"))
    return _solved(nodes.select("node", "fp", F.posexplode(bands).alias("band", "value")), ["band", "value"], budget)


def rest_links(nodes: DataFrame, budget: int, n: int) -> DataFrame:
    """(a, b): links that connect every pair of the ``n`` nodes within ``budget``, by comparing all pairs of blocks.

    Every node goes to the pairs of its block with each block; a pair of blocks is a task and
    emits a spanning forest.  Work grows with the square of ``n`` (a pair costs a few
    nanoseconds), the shuffle with ``n`` times the number of blocks.
    """
    block = min(max(-(-n // BLOCKS), BLOCK_ROWS[0]), BLOCK_ROWS[1])
    count = max(1, -(-n // block))
    own = nodes.select("node", "fp", F.pmod(F.xxhash64("node"), F.lit(count)).alias("block"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<long>")))
    paired = other.select("node", "fp", "block", (F.least("block", "other") * count + F.greatest("block", "other")).alias("pair"))

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        ids, prints = rows.column("node").to_numpy(), np.frombuffer(b"".join(rows.column("fp").to_pylist()), ">u8").reshape(rows.num_rows, -1).astype(np.uint64)
        first, second = divmod(key[0].as_py(), count)
        blocks = rows.column("block").to_numpy()
        left, right = np.flatnonzero(blocks == first), np.flatnonzero(blocks == second)
        member, root = block_links(prints, left, right, budget)
        return pa.table({"a": pa.array(ids[member], pa.int64()), "b": pa.array(ids[root], pa.int64())})

    return paired.groupBy("pair").applyInArrow(run, "a long, b long")


def block_links(prints: np.ndarray, left: np.ndarray, right: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, representative) indices: a spanning forest of the links from ``left`` to ``right`` (the same: inside it)."""
    lanes = prints.shape[1]
    # So many lanes that unrelated fingerprints are beyond the budget; their bits as +1 and -1 make distances one product.
    head = next((k for k in range(1, lanes) if 32 * k - 20 * k ** 0.5 >= budget), lanes)
    label, one = np.arange(len(prints)), len(left) == len(right) and (left == right).all()

    def signs(rows: np.ndarray) -> np.ndarray:
        return np.unpackbits(np.ascontiguousarray(prints[rows, :head]).view(np.uint8), axis=1).astype(np.float32) * 2 - 1

    for start in range(0, len(right), TILE[1]):
        cols = right[start:start + TILE[1]]
        across = signs(cols).T
        for top in range(0, min(len(left), start + len(cols)) if one else len(left), TILE[0]):
            rows = left[top:top + TILE[0]]
            close = np.flatnonzero(signs(rows) @ across >= 64 * head - 2 * budget)
            for k in range(0, len(close), TILE[1]):
                i, j = np.divmod(close[k:k + TILE[1]], len(cols))
                i, j = rows[i], cols[j]
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
                near = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1, dtype=np.int64) <= budget
                _union(label, i[near], j[near])
    member = np.flatnonzero(label != np.arange(len(prints)))
    return member, label[member]


def _solved(keyed: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """(a, b): the links inside each group of rows (node, fp as big-endian bytes, keys)."""
    grouped = keyed.select("node", "fp", *keys).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []  # rows of the last group, which may go on in the next batch

        def solve(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            nodes, prints, key = (np.concatenate(x) for x in zip(*parts, strict=True))
            group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]).any(axis=1))])
            size = np.bincount(group)
            many = size[group] > 1
            nodes, prints, group = nodes[many], prints[many], group[many]
            order = np.lexsort((*prints.T[::-1], group))
            nodes, prints, group = nodes[order], prints[order], group[order]
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(nodes)]])
            member, root = trie_links(prints, bounds, budget)
            return pa.RecordBatch.from_arrays([pa.array(nodes[member]), pa.array(nodes[root])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            prints = np.frombuffer(b"".join(batch.column("fp").to_pylist()), ">u8").reshape(batch.num_rows, -1).astype(np.uint64)
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            key = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[2:]], axis=1)
            other = np.flatnonzero((key != key[-1]).any(axis=1))
            last = other[-1] + 1 if len(other) else 0
            if last:
                yield solve([*kept, (nodes[:last], prints[:last], key[:last])])
                kept = []
            elif kept and (kept[0][2][0] != key[0]).any():
                yield solve(kept)
                kept = []
            kept.append((nodes[last:], prints[last:], key[last:]))
        if kept:
            yield solve(kept)

    return grouped.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root: the least node.

    Large-star: the neighbours above a node are joined to the least of its surroundings;
    small-star: so are the node and the neighbours below it.  Alternating both ends in
    stars; each round is written to the shared folder.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:  # a step that changes nothing is the last; stars halve what is unsettled
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(floor.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut(small, "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint, component_id for every row."""
    prints = cut(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"], k), "docprints")
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "prints")
    roots = components(links(nodes.select("fp"))).select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    found = cut(rooted.join(ids, "root").select("fp", "component_id", "n"), "classes")
    # Fingerprints that hold more than a HOT-th of all rows: fewer than HOT of them, so they are broadcast, and no other key is hot.
    hot = F.broadcast(found.where(F.col("n") * HOT > prints.count()).select("fp", "component_id"))
    named = prints.join(hot, "fp").unionByName(prints.join(hot, "fp", "left_anti").join(found.select("fp", "component_id"), "fp"))
    return named.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def survivors(docs: DataFrame, k: int = STAGE_SHINGLE, wide: int = STAGE_WIDE, budget: int = STAGE_BUDGET) -> DataFrame:
    """One document of each group of near copies (the least id; of equal ids one row), all columns.

    Near copies: fingerprints of 64 * ``wide`` bits over the distinct k-word shingles differ in
    ``budget`` bits at most.  Rows are known by the digest of id and text, and the table is read again at the end: it is neither written nor, while
    the rows to drop are few enough to broadcast (``BROADCAST_ROWS``, counted), shuffled.

    Null ids come last; null and blank texts are copies of each other; of rows with equal id
    and text the least by its other columns stays; an empty table stays empty; the columns
    may have any names but those starting with ``_umbra``.
    """
    fields, key = docs.columns, "_umbra_key"
    text_or = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x02"))
    keyed = docs.withColumn(key, F.unhex(F.md5(F.concat(text_or("doc_id"), F.lit("\x01"), text_or("text")))))
    slim = keyed.select(key, "doc_id", F.monotonically_increasing_id().alias("row"), "text")
    schema = f"{key} binary, doc_id {docs.schema['doc_id'].dataType.simpleString()}, row long, fp binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                prints = wide_prints(batch.column("text"), k, wide).astype(">u8")
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([p.tobytes() for p in prints], pa.binary())], names=[key, "doc_id", "row", "fp"])

    prints = cut(slim.mapInArrow(run, schema), "docprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key)).alias("first")
    nodes = cut(prints.groupBy("fp").agg(F.min("row").alias("node"), first), "prints")
    roots = components(wide_links(nodes.select("node", "fp"), budget, wide))
    kept = nodes.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first")).select(F.col(f"first.{key}").alias(key), F.lit(True).alias("stays"))
    rows = cut(prints.groupBy(key).agg(F.count("*").alias("n")).join(kept, key, "left").where("stays is null or n > 1"), "dropped")
    gone, again = rows.select(key), rows.where("stays").select(key)  # one of several equal rows comes back

    def sized(some: DataFrame) -> DataFrame:
        return F.broadcast(some) if some.count() <= BROADCAST_ROWS else some

    left = keyed.join(sized(gone), key, "left_anti").select(fields)
    if again.isEmpty():
        return left
    back = keyed.join(sized(again), key, "left_semi").groupBy(key).agg(F.min(F.struct(fields)).alias("doc")).select("doc.*")
    return left.unionByName(back)


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
