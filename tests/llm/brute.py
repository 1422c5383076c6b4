"""Plain, slow versions of operators, for comparison on small inputs."""

from __future__ import annotations

import hashlib
import re

import xxhash

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def simhash(text, k=3):
    w = BLANK.findall(lower(text))
    if not w:
        return 0
    grams = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


MASK = (1 << 64) - 1


def mixed(h):
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & MASK
    h = (h ^ h >> 27) * 0x94D049BB133111EB & MASK
    return h ^ h >> 31


def shingles(text, k=5):
    w = BLANK.findall(lower(text))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def wide_simhash(text, k=5, wide=8):
    """The fingerprint as ``wide`` numbers of 64 bits."""
    hashes = set()
    for gram in shingles(text, k):
        h = 0
        for w in gram:
            h = mixed((h + xxhash.xxh64(w.encode(), seed=42).intdigest()) & MASK)
        hashes.add(h)
    lanes = []
    for lane in range(1, wide + 1):
        own = [mixed((h + lane * 0x9E3779B97F4A7C15) & MASK) for h in hashes]
        lanes.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own)))
    return lanes


def wide_components(rows, budget=82):
    """[(doc_id, text)] -> [(doc_id, least doc_id reachable)]: an equal band of 16 bits, and few differing bits."""
    prints = [wide_simhash(t) for _, t in rows]

    def near(a, b):
        different = [x ^ y for x, y in zip(a, b, strict=True)]
        return sum(d.bit_count() for d in different) <= budget and any(d >> 16 * i & 0xFFFF == 0 for d in different for i in range(4))

    return grouped([d for d, _ in rows], lambda i, j: near(prints[i], prints[j]))


def simhash_components(rows, budget=3):
    """[(doc_id, fingerprint)] -> [(doc_id, component_id)] by comparing all pairs."""
    return grouped([d for d, _ in rows], lambda i, j: (rows[i][1] ^ rows[j][1]).bit_count() <= budget)


def grouped(ids, linked):
    label = list(range(len(ids)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, least.get(root(i))) for i, d in enumerate(ids)]


def base_secrets(text):
    text = text or ""
    found = []
    for kind, rank, pattern, least in (
        ("assign", 0, r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
        ("access", 1, r"(AKIA[A-Z0-9]+)", 16),
        ("hex", 2, r"([0-9a-f]+)", 32),
    ):
        for m in re.finditer(pattern, text):
            if len(m[1]) >= least:
                found.append((m.start(), rank, m.end(), kind))
    found.sort()
    joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)
    count = lambda kind: sum(k == kind for *_, k in found)
    return count("assign"), count("access"), count("hex"), hashlib.sha256(joined.encode()).hexdigest(), {f"{k}:{s}:{e}" for s, _, e, k in found}


def bigram_scores(rows, mu, folds=10):
    """[(doc_id, text)] -> [(doc_id, held_out, n_tokens, n_known, train_tokens, base, score)]."""
    import zlib
    from collections import Counter
    from math import log10

    rows = [(d, [*BLANK.findall(lower(t)), None], d is not None and zlib.crc32(str(d).encode()) % folds == 0) for d, t in rows]
    c, pairs = Counter(), Counter()
    for _, w, held in rows:
        if not held:
            c.update(w)
            pairs.update(zip(["<s>", *w[:-1]], w, strict=True))
    n, v, starts = sum(c.values()), len(c), sum(not held for *_, held in rows)
    once, twice = (sum(k == x for w, k in c.items() if w is not None) for x in (1, 2))
    d = min(0.95, max(0.05, once / max(1, once + 2 * twice)))
    p1 = lambda w: 0.5 if not n else (c[w] - d) / n if c[w] else d * v / n

    def p2(a, w, first):
        return (pairs[(a, w)] + mu * p1(w)) / ((starts if first else c[a]) + mu)

    return [
        (i, held, len(w), sum(c[x] > 0 for x in w), n, sum(log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w),
         sum(log10(p2("<s>" if k == 0 else w[k - 1], x, k == 0)) for k, x in enumerate(w)))
        for i, w, held in rows
    ]


def lowered_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def ftrl(rows, epochs, alpha, beta, l1, l2):
    """[(label, {feature: value})] -> (weights, bias), one feature after another as the published rule says."""
    from math import copysign, exp, sqrt

    z, n = {}, {}

    def weight(f):
        if abs(z.get(f, 0.0)) <= l1:
            return 0.0
        return -(z[f] - copysign(l1, z[f])) / ((beta + sqrt(n[f])) / alpha + l2)

    for _ in range(epochs):
        for y, x in rows:
            x = {**x, "bias": 1.0}
            w = {f: weight(f) for f in x}
            p = 1 / (1 + exp(-sum(w[f] * v for f, v in x.items())))
            for f, v in x.items():
                g = (p - y) * v
                old = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (sqrt(old + g * g) - sqrt(old)) / alpha * w[f]
                n[f] = old + g * g
    return {f: weight(f) for f in z if f != "bias"}, weight("bias")


def gram_features(text):
    """The classifier's features of a text, as readable tuples with their counts."""
    from collections import Counter

    w = BLANK.findall(text or "")

    def shape(x):
        kinds = "".join("X" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "x" * len(c.encode()) if c > "\x7f" or "a" <= c <= "z" else c for c in x)
        return re.sub(r"(.)\1+", r"\1", kinds, flags=re.S)

    found = Counter()
    for space, seq in (("w", w), ("s", [shape(x) for x in w])):
        found.update((space, x) for x in seq)
        found.update((space, 2, a, b) for a, b in zip(seq, seq[1:], strict=False))
        found.update((space, "same", a == b) for a, b in zip(seq, seq[1:], strict=False))
    triples = Counter(zip(w, w[1:], w[2:], strict=False))
    found.update(("t", min(triples[t], 4)) for t in zip(w, w[1:], w[2:], strict=False))
    return found
