"""Source and configuration text as assignments: lexemes, statements, and constants.

``Reader`` lexes a text into strings, names, numbers, operators and line ends, and reads
from them who is assigned what: ``name = x``, ``name: x``, ``name := x``, ``"name": "x"``,
``a["name"] = "x"``, ``name: T = x``, ``T name = x``, ``name T = x``, ``<name>x</name>``,
``#define name x``, ``key="name" value="x"``, with sigils, block scalars (``name: |``) and
values on the next line.  Strings may be quoted by ``"``, ``'``, a backtick, or three
quotes; what they hold is read once more, as it may be code or configuration itself.

A value is a chain of parts: literals, and names that stand for other values.  What a name
means is settled after reading: the binding before the mention, else the first one after
it.  Bindings point at each other, so that a value of any number of parts is held once;
every binding of a name ends the one before, also when its value isn't known.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple


class Lexeme(NamedTuple):
    kind: str  #: string, name, number, operator, other
    start: int
    end: int
    body: tuple[int, int]  #: what a string holds, or the lexeme itself


class Part(NamedTuple):
    start: int
    end: int
    quoted: bool
    name: str | None = None  #: the text may be the name of a constant
    literal: bool = True  #: the text may be a literal


class Binding(NamedTuple):
    name: str
    at: int
    parts: list[Part]
    binds: bool


_LEXEME = re.compile(r"""
    (?P<space>(?:[ \t\r\f\v]|\\\r?\n)+)
  | (?P<line>\n)
  | (?P<lifetime>(?<=[&<])'[a-z_]\w*(?!'))
  | (?P<quote>(?:[rbufRBUF]{1,2}(?=["']))?(?:\"\"\"|'''|["'`])|\\["'])
  | (?P<name>\$\{[A-Za-z_]\w*\}|[$@]*[A-Za-z_]\w*(?:[.-]\w+)*)
  | (?P<number>\d\w*)
  | (?P<other>::|://|[!<>~*/%^&-]=+|=~|->|[^\x00-\x7F]+)
  | (?P<operator>:=|=>|={1,3}|[+.?]=|\|\|=|:)
  | (?P<rest>.)
""", re.X | re.A | re.S)
#: What a string of each quote holds; it ends where its quote must follow.
_BODY = {q: re.compile(p, re.S) for q, p in {
    '"': r'(?:[^"\\\n]|\\.)*+', "'": r"(?:[^'\\\n]|\\.)*+", "`": r"(?:[^`\\]|\\.)*+",
    '"""': r'(?:[^"\\]|\\.|"(?!""))*+', "'''": r"(?:[^'\\]|\\.|'(?!''))*+",
    '\\"': r'(?:[^"\\\n]|\\[^"\n])*+', "\\'": r"(?:[^'\\\n]|\\[^'\n])*+"}.items()}
_LONG = frozenset(("`", '"""', "'''"))
#: Lines without any of these assign nothing.
LIVE = re.compile(r"[=:]|<[/A-Za-z]|#[ \t]*define\b")
_QUOTE = re.compile(r"""(?:[rbufRBUF]{1,2}(?=["']))?(?:\"\"\"|'''|["'`])|\\["']""")
_REFERENCE = re.compile(r"[$@]+([A-Za-z_][\w.]*)|\$\{([A-Za-z_]\w*)\}", re.A)
#: Signs of equality end a bare word, unless they end it as padding.
_BARE = re.compile(r"[\w$+/.@!%^&*~#-]+(?:=+(?!\w))?", re.A)
_IDENTIFIERS = re.compile(r"[A-Za-z_][\w.]*(?:\+[A-Za-z_][\w.]*)*\Z", re.A)
#: A dotted path of plain names is code, and so are letters before these.
_PATH = re.compile(r"[A-Za-z_]+(?:\.[A-Za-z_]+)+\Z")
_JOIN = re.compile(r"[ \t]*(?:\+(?!=)|\.\.|\.|&(?=[ \t]))[ \t]*(?:\\?\r?\n[ \t]*)?(?=[\"'`$@A-Za-z_\\])", re.A)
_SPACE = re.compile(r"(?:[ \t\r\f\v]|\\\r?\n)*")
_BREAK = re.compile(r"[ \t\r]*\n([ \t]*)")
_BLANK = re.compile(r"\s*")
_LINE_END = re.compile(r"[ \t]*(?:[;,]|\r?\n|\Z)")
_BLOCK = re.compile(r"[|>][-+\d]*[ \t]*(?:#[^\n]*)?\r?\n")
_KEY = re.compile(r"[$@\w. -]{1,200}\Z", re.A)
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*)>\s*([^<>]*+)</")
_TYPES = re.compile(r"(?:std\.)?(?:w?string|str|n?(?:var)?char2?|text|bytes?|rune|any|object)\Z", re.I | re.A)
_MODIFIERS = frozenset("mut dyn const readonly unsigned final static".split())
_KEYWORDS = frozenset("var const let val static final declare dim public private protected readonly my our local".split())
_TYPE_MARKS = frozenset("<>[]|&?.,*!(){}")


class Reader:
    """The assignments of one text, in ``bindings``; all places are code points of that text."""

    def __init__(self, text: str):
        self.text = text
        self.bindings: list[Binding] = []
        self._hopeless: dict[str, int] = {}
        todo = [(0, len(text), True)]
        while todo:
            todo += self._read(*todo.pop())
        self.bindings.sort(key=lambda b: b.at)

    # Lexemes

    def _string(self, quote: str, at: int, stop: int) -> int | None:
        """Where the body of a string ends that begins at ``at``; None if its quote does not follow."""
        if at < self._hopeless.get(quote, -1):
            return None
        end = _BODY[quote].match(self.text, at, stop).end()
        if self.text.startswith(quote, end, stop):
            return end
        # Until there, this quote opens nothing: so every character is looked at once.
        self._hopeless[quote] = stop if quote in _LONG else end
        return None

    def _quoted(self, at: int, stop: int) -> Lexeme | None:
        m = _QUOTE.match(self.text, at, stop)
        if not m:
            return None
        quote = m[0].lstrip("rbufRBUF")
        end = self._string(quote, m.end(), stop)
        return None if end is None else Lexeme("string", at, end + len(quote), (m.end(), end))

    def _line(self, at: int, stop: int) -> tuple[list[Lexeme], int]:
        """The lexemes of a line, which strings may carry over line ends, and where the next one begins."""
        text, found = self.text, []
        while at < stop:
            m = _LEXEME.match(text, at, stop)
            kind, end = m.lastgroup, m.end()
            if kind == "line":
                return found, end
            if kind == "quote":
                apostrophe = m[0] == "'" and at and text[at - 1].isalnum()
                lexeme = None if apostrophe else self._quoted(at, stop)
                if lexeme is None:
                    end = m.end() if m[0][0] in "\"'`\\" else m.end() - len(m[0].lstrip("rbufRBUF"))
                    lexeme = Lexeme("other" if m[0][0] in "\"'`\\" else "name", at, end, (at, end))
                found.append(lexeme)
                end = lexeme.end
            elif kind != "space":
                found.append(Lexeme(kind if kind in ("name", "number", "operator") else "other", at, end, (at, end)))
            at = end
        return found, stop

    # Statements

    def _read(self, at: int, stop: int, binds: bool) -> Iterator[tuple[int, int, bool]]:
        """Read what lies between; yields what its strings hold."""
        text, label = self.text, None
        while m := LIVE.search(text, at, stop):
            if "\n\n" in text[at:m.start()]:
                label = None
            start = max(at, text.rfind("\n", at, m.start()) + 1)
            line, at = self._line(start, stop)
            closes = self._brackets(line)
            taken: set[int] = set()
            for i, lexeme in enumerate(line):
                if lexeme.kind == "string":
                    s, e = lexeme.body
                    if e - s > 4 and LIVE.search(text, s, e):
                        quote = text[s - 1] if text[s - 1] in "`" or text[s - 3:s] in _LONG else ""
                        yield s, e, binds and bool(quote)
                elif lexeme.kind == "operator":
                    if i not in taken:
                        label = self._assignment(line, i, closes, taken, start, stop, binds, label)
                elif text[lexeme.start] == "<":
                    element = _ELEMENT.match(text, lexeme.start, stop)
                    if element and text.startswith(element[1] + ">", element.end()):
                        value = element[2].rstrip()
                        self._bind(element[1], lexeme.start, [Part(element.start(2), element.start(2) + len(value), True)], binds)
                elif lexeme.kind == "name" and i == 1 and text[lexeme.start:lexeme.end] == "define" and text[line[0].start] == "#" and len(line) > 3:
                    self._bind(self._name(line[2]), line[2].start, self._value(line[2].end, stop, "any")[0], binds)

    def _brackets(self, line: list[Lexeme]) -> dict[int, int]:
        """The index of the opening bracket for that of each closing one."""
        found, opened = {}, []
        for i, lexeme in enumerate(line):
            c = self.text[lexeme.start] if lexeme.kind == "other" else ""
            if c in ("(", "["):
                opened.append((c, i))
            elif opened and (opened[-1][0], c) in (("(", ")"), ("[", "]")):
                found[i] = opened.pop()[1]
        return found

    def _name(self, lexeme: Lexeme) -> str:
        return self.text[lexeme.body[0]:lexeme.body[1]].strip("$@{}")

    def _bind(self, name: str, at: int, parts: list[Part], binds: bool) -> None:
        self.bindings.append(Binding(name, at, parts, binds))

    def _targets(self, line: list[Lexeme], i: int, closes: dict[int, int]) -> list[Lexeme]:
        """The lexemes left of the operator at ``i`` that name what is assigned."""
        text, j = self.text, i - 1
        if j > 0 and text[line[j].start] in "?!" and line[j - 1].kind == "name":
            j -= 1
        if j < 0:
            return []
        own = line[j]
        if own.kind == "string":
            return [own] if _KEY.match(text, *own.body) else []
        if j in closes:
            k = closes[j]
            if text[own.start] == "]":
                inside = line[k + 1:j]
                if len(inside) == 1 and inside[0].kind == "string":  # a["name"] =
                    return [inside[0]] if _KEY.match(text, *inside[0].body) else []
                return [line[k - 1]] if k and line[k - 1].kind == "name" else []
            return [line[k - 2]] if k > 1 and line[k - 1].kind == line[k - 2].kind == "name" else []  # name varchar(64) =
        if own.kind != "name":
            return []
        if j and line[j - 1].kind == "name" and "\n" not in text[line[j - 1].end:own.start]:
            before = line[j - 1]
            if self._name(before).lower() == "as" and j > 1:  # name As String =
                return [line[j - 2]]
            if text[line[i].start] == "=" or line[i].end - line[i].start == 2:
                if _TYPES.match(self._name(own)):  # name string =
                    return [before]
                if j > 1 and self._name(line[j - 2]).lower() in _KEYWORDS:
                    return [own, before]
        return [own]

    def _type(self, line: list[Lexeme], i: int) -> int | None:
        """For ``name: T = x`` the index of ``=``; None where no type stands there."""
        text, depth, names, many = self.text, 0, 0, False
        for k in range(i + 1, len(line)):
            lexeme = line[k]
            word = text[lexeme.start:lexeme.end]
            if lexeme.kind == "operator":
                closed = lexeme.start > line[k - 1].end or text[lexeme.end:lexeme.end + 1] in ("\"", "'", "`")
                return k if word == "=" and k > i + 1 and not many and closed else None
            if lexeme.kind == "name":
                if not depth and word not in _MODIFIERS:
                    names += 1
                    many |= names > 1
            elif lexeme.kind == "other":
                if word in ("<", "[", "("):
                    depth += 1
                elif word in (">", "]", ")"):
                    depth -= 1
                elif word in ("|", "&", ".", "::"):
                    names = 0
                elif word not in _TYPE_MARKS and word[0] != "'":
                    return None
            elif lexeme.kind == "string" or not depth and lexeme.kind == "number" and k == i + 1:
                return None
        return None

    def _assignment(self, line: list[Lexeme], i: int, closes: dict[int, int], taken: set[int], start: int, stop: int, binds: bool, label: tuple[str, int] | None) -> tuple[str, int] | None:
        """Bind what the operator at ``i`` assigns; returns the label that a ``value`` after it may go by."""
        text, operator = self.text, line[i]
        word = text[operator.start:operator.end]
        targets = self._targets(line, i, closes)
        if not targets:
            return label
        names = [self._name(t) for t in targets]
        sigil = text[targets[0].start] in "$@" and targets[0].kind == "name"
        at = operator.end
        if word == ":" and (k := self._type(line, i)) is not None:
            kind = text[line[i + 1].start:line[k - 1].end]
            if any(c.isdigit() for c in kind):  # rather a value than a type: both readings stand
                parts, end = self._value(at, stop, "any")
                for name in names:
                    self._bind(name, end, parts, binds)
            if text[at].isspace() or _TYPES.match(kind):
                taken.add(k)
            at, word = line[k].end, "="
        mode = "none" if sigil and word != ":" else "any"
        parts, end = self._value(at, stop, mode, word, start)
        for name in names:
            own = [Part(operator.start, operator.start, False, name, False), *parts] if word in ("+=", ".=") else parts
            # A comparison says what a name may be, and binds nothing.
            self._bind(name, end, own, binds and word not in ("==", "==="))
        last = names[0].lower()
        if last in ("key", "name", "id") and len(parts) == 1 and parts[0].literal and parts[0].end - parts[0].start <= 200:
            return text[parts[0].start:parts[0].end], end
        if last in ("value", "val", "content", "default") and label:
            if text.count("\n", label[1], operator.start) <= 1:
                self._bind(label[0], end, parts, False)
            return None
        return label

    # Values

    def _value(self, at: int, stop: int, mode: str, operator: str = "=", line_start: int = 0) -> tuple[list[Part], int]:
        """The parts that the expression at ``at`` joins, and where it ends.

        ``mode``: which bare words may be literals; ``any``, ``line`` (those that have a line to themselves) or ``none``.
        """
        text = self.text
        at = _SPACE.match(text, at, stop).end()
        if operator == ":" and (block := _BLOCK.match(text, at, stop)):
            return self._block(block.end(), stop, line_start)
        broken = _BREAK.match(text, at, stop)
        if broken:
            indent = self._indent(line_start)
            at = broken.end()
            if at - broken.start(1) <= indent and text[at:at + 1] not in ("\"", "'", "`", "("):
                return [], at
            mode = "none" if mode == "none" else "line"
        elif text.startswith("\n", at - 1) and mode == "any":  # after a backslash
            mode = "line"
        if text[at:at + 1] in ("&", "*", "[", "?"):
            return [], at
        within = False
        while text.startswith("(", at):
            inner = _BLANK.match(text, at + 1, stop).end()
            if text[inner:inner + 1] not in ("\"", "'", "`", "("):
                break
            at, within = inner, True
        parts: list[Part] = []
        while at < stop:
            lexeme = self._quoted(at, stop)
            if lexeme:
                if broken and not parts and re.match(r"[ \t]*[:=]", text[lexeme.end:lexeme.end + 20]):
                    return [], lexeme.end  # the key of the next line
                parts.append(Part(*lexeme.body, True))
                at = lexeme.end
            elif r := _REFERENCE.match(text, at, stop):
                if text.startswith(("(", "[", "->"), r.end()):
                    break
                parts.append(Part(r.start(), r.end(), False, r[1] or r[2], False))
                at = r.end()
            elif b := _BARE.match(text, at, stop):
                word, end = b[0], b.end()
                after = text[end:end + 1]
                called = bool(_IDENTIFIERS.match(word)) and after != "" and after in "(["
                code = called or bool(_PATH.match(word)) or word.isalpha() and after != "" and after in ").<"
                alone = bool(_LINE_END.match(text, end)) and not re.search(r"[=:]", word.rstrip("="))
                if operator == ":" and broken and (word.isalpha() or ":" in text[end:end + 1]):
                    alone = False
                literal = not parts and not code and (mode == "any" or mode == "line" and alone)
                if called or not (literal or _IDENTIFIERS.match(word)):
                    break
                parts.append(Part(at, end, False, word if _IDENTIFIERS.match(word) else None, literal))
                at = end
            else:
                break
            gap = (_BLANK if within else _SPACE).match(text, at, stop).end()
            if join := _JOIN.match(text, at, stop):
                at = join.end()
            elif parts[-1].quoted and _QUOTE.match(text, gap, stop) and text[gap - 1:gap].isspace():
                at = gap  # strings side by side are one
            else:
                break
        return parts, at

    def _indent(self, start: int) -> int:
        return _SPACE.match(self.text, start).end() - start

    def _block(self, at: int, stop: int, line_start: int) -> tuple[list[Part], int]:
        """The lines of a block scalar: those after ``at`` that are blank or lie deeper than its key."""
        text, indent, parts = self.text, self._indent(line_start), []
        while at < stop:
            end = text.find("\n", at, stop)
            end = stop if end < 0 else end
            first = _SPACE.match(text, at, end).end()
            if first < end:
                if first - at <= indent:
                    break
                last = first + len(text[first:end].rstrip())
                parts.append(Part(first, last, True))
            at = end + 1
        return parts, at


class Summary(NamedTuple):
    """What a value is made of, added up over its parts."""

    counts: Counter  #: characters
    quoted: bool  #: whether its first literal is
    harmless: bool  #: whether all its literals are placeholders


class Values:
    """What the bindings of a text stand for, settled as far as someone asks."""

    def __init__(self, text: str, bindings: list[Binding], harmless) -> None:
        self.text, self.bindings, self.harmless = text, bindings, harmless
        self.places: dict[str, list[int]] = {}
        self.owners: dict[str, list[int]] = {}
        for i, b in enumerate(bindings):
            if b.binds:
                self.places.setdefault(b.name, []).append(b.at)
                self.owners.setdefault(b.name, []).append(i)
        self._summaries: dict[int, Summary | None] = {}
        self._literals: dict[tuple[int, int], tuple[Counter, bool]] = {}
        self._marked: set[int] = set()

    def _owner(self, name: str, at: int) -> int | None:
        """The binding that a mention at ``at`` means."""
        places = self.places.get(name)
        if not places:
            return None
        k = bisect_left(places, at + 1) - 1
        return self.owners[name][max(k, 0)]

    def parts(self, i: int) -> Iterator[int | Part]:
        """The parts of a binding: others by number, and literals."""
        for part in self.bindings[i].parts:
            if part.name:
                owner = self._owner(part.name, part.start)
                if owner is not None:
                    yield owner
                    continue
                names = part.name.split("+")
                owners = [self._owner(n, part.start) for n in names] if len(names) > 1 else [None]
                if None not in owners:
                    yield from owners
                    continue
            if part.literal and part.end > part.start:
                yield part

    def summary(self, i: int) -> Summary | None:
        """None: not known to hold any literal.  A value that mentions itself is settled without that mention."""
        done, todo, open_ = self._summaries, [i], set()
        while todo:
            k = todo[-1]
            if k in done:
                todo.pop()
                continue
            if k not in open_:
                open_.add(k)
                todo += [p for p in self.parts(k) if isinstance(p, int) and p not in done and p not in open_]
                continue
            todo.pop()
            counts, quoted, harmless, known = Counter(), False, True, False
            for p in self.parts(k):
                if isinstance(p, int):
                    own = done.get(p)
                    if own is None:
                        continue
                    own_counts, own_quoted, own_harmless = own
                else:
                    key = (p.start, p.end)
                    if key not in self._literals:
                        value = self.text[p.start:p.end]
                        self._literals[key] = Counter(value), self.harmless(value)
                    (own_counts, own_harmless), own_quoted = self._literals[key], p.quoted
                quoted = quoted if known else own_quoted
                for c, n in own_counts.items():
                    counts[c] += float(n)
                if counts and max(counts.values()) > 1e200:  # only shares matter by then
                    counts = Counter({c: n * 1e-100 for c, n in counts.items()})
                harmless &= own_harmless
                known = True
            done[k] = Summary(counts, quoted, harmless) if known else None
        return done[i]

    def spans(self, i: int) -> Iterator[tuple[int, int]]:
        """The literals below a binding that weren't given before."""
        todo = [i]
        while todo:
            k = todo.pop()
            if k in self._marked:
                continue
            self._marked.add(k)
            for p in self.parts(k):
                if isinstance(p, int):
                    todo.append(p)
                else:
                    yield p.start, p.end
