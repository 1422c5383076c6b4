"""Secret scans by assignment-aware lexing, over a base of three plain patterns.

The lexer (``assignments``) reads source and configuration syntax into names and what they
are assigned: strings of any quote, bare values, block scalars, elements; with sigils and
types; joined by ``+`` or standing side by side.  A name that stands in a value means its
binding before, or else the first one after it; a later binding ends an earlier one, also
when its value isn't known.  The finding lies where the literal is written.  A target is
scored by how sensitive its name is, plus the shape of the joined literals (length, mixed
classes, entropy), less for placeholders; from ``THRESHOLD`` on its literals are findings
of kind ``lex``.  Base findings always stay.  Neither lengths nor parts have a limit.

Every text is scanned alone and whole: one pass, no shuffle.

Defined cases: a null or empty text has no findings (and the digest of the empty string);
repeated rows and null ids each get their row; extra columns are not read; findings that
tie on their start are ordered by kind, then end.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.assignments import LIVE, Reader, Summary, Values
from umbra.llm.common import table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Runs are maximal, so a run below the least length can't hold a longer one.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGNED = 8
KINDS = ("assign", "access", "hex", "lex")

#: Sensitivity of target names, by the words they are made of.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 0.9, "token": 0.8, "apikey": 1.0,
    "credential": 0.8, "credentials": 0.8, "auth": 0.6, "bearer": 0.8, "private": 0.5, "access": 0.4, "client": 0.2,
    "key": 0.5, "api": 0.4, "signing": 0.4, "encryption": 0.4, "session": 0.3, "cookie": 0.3, "salt": 0.5, "connection": 0.3, "dsn": 0.6,
}
#: Words in names that speak of a secret rather than hold one.
HARMLESS = {"length", "count", "url", "uri", "path", "file", "name", "type", "policy", "hint", "expiry", "expires", "ttl", "limit", "max", "min", "size", "regex", "field", "label"}
PLACEHOLDER = re.compile(r"^(?:changeme|example|sample|dummy|test|todo|none|null|true|false|undefined|your[-_ ].*|x{4,}|\*{3,}|\.{3,}|<.*>|\$\{.*\}|\{\{.*\}\}|%\w+%)$", re.I | re.A)
THRESHOLD = 1.5

_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def name_score(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    if "api" in parts and "key" in parts:
        parts.append("apikey")
    if not parts or parts[-1] in HARMLESS:
        return 0.0
    return min(1.5, sum(SENSITIVE.get(p, 0.0) for p in set(parts)))


def harmless(literal: str) -> bool:
    return bool(PLACEHOLDER.match(literal))


def literal_score(value: Summary) -> float:
    counts = value.counts
    n = sum(counts.values())
    if n < LEAST_ASSIGNED or value.harmless or any(c.isspace() for c in counts):
        return -2.0
    kinds = {"lower" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "digit" if "0" <= c <= "9" else "other" for c in counts}
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    return 0.3 * value.quoted + 0.25 * (len(kinds) - 1) + 0.15 * min(entropy, 4.0) + (0.1 if n >= 16 else 0.0)


def lexed_spans(text: str) -> list[tuple[int, int, str]]:
    if not LIVE.search(text):
        return []
    bindings = Reader(text).bindings
    targets = [(i, s) for i, b in enumerate(bindings) if b.parts and (s := name_score(b.name)) >= 0.5]
    if not targets:
        return []
    values, found = Values(text, bindings, harmless), set()
    for i, sensitive in targets:
        value = values.summary(i)
        if value and sensitive + literal_score(value) >= THRESHOLD:
            found |= {(s, e, "lex") for s, e in values.spans(i)}
    return sorted(found)


def scan_text(text: str | None) -> tuple[int, int, int, str, str, list[tuple[int, int, str]]]:
    """n_assign, n_access, n_hex, base_sha256, spans (joined), spans."""
    text = text or ""
    order = lambda x: (x[0], KINDS.index(x[2]), x[1])
    base = sorted(base_spans(text), key=order)
    spans = sorted({*base, *lexed_spans(text)}, key=order)
    join = lambda xs: ",".join(f"{k}:{s}:{e}" for s, e, k in xs)
    n = Counter(k for _, _, k in base)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(join(base).encode()).hexdigest(), join(spans), spans


def redacted(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every finding (overlapping ones as one) replaced by ``mark``."""
    spans = scan_text(text)[-1]
    if not spans:
        return text
    out, done = [], 0
    start, end = spans[0][:2]
    for s, e, _ in [*spans[1:], (len(text) + 1, 0, "")]:
        if s < end:
            end = max(end, e)
            continue
        out += [text[done:start], mark]
        done, start, end = end, s, e
    return "".join(out) + text[done:]


FINDINGS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def secrets(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    rows = docs.select(*carry, F.col(text_col).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [scan_text(x.as_py())[:5] for x in batch.column("_text")]
            columns = [pa.array([g[i] for g in got], pa.int64() if i < 3 else pa.string()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return rows.mapInArrow(run, f"{fields}, {FINDINGS}")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with their secrets replaced; other columns unchanged."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = names.index(text_col)
            fixed = pa.array([redacted(x.as_py()) for x in batch.column(i)], batch.column(i).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:i], fixed, *batch.columns[i + 1:]], names=names)

    return docs.mapInArrow(run, fields)


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"), ["doc_id"])
