"""Secret scans: three base patterns, and an assignment-aware lexer of source and configuration syntax.

The lexer splits a text into strings (prefixes, triple quotes and escapes included), names, operators, brackets and line starts, and
reads them into name-literal pairs: assignments (`=`, `:=`, `=>`, `?=`, `:`) to dotted, indexed, annotated and quoted names, keys of nested
braces, indented blocks and sections, arguments that follow a name given as a string (`set("password", "...")`), XML attributes and
elements, command line flags. A value is a concatenation of strings, bare words and names; `f"..."`, backtick strings and
`${...}` hold names too. A second pass carries constants through names, whether they are assigned before their use or after
it, and scores each value by how sensitive the name is that it ends up in: the last name of its path, or, where that is as general as
`value`, one before it. The literals of a value that scores `level` or more are spans of kind `lexed`, unless base spans cover all of
them. Spans are in code points, end exclusive; a base span is the whole match.

Defined results: a null or empty text has no spans; texts of any length are scanned whole; names that refer to each other in a circle
have no value; repeated rows give equal rows; an empty table gives an empty result; other columns pass through `redact` untouched and are ignored by `scan`.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

# The base kinds, in their order, and their patterns.
KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

STRING = r"""(?<![\w'"`])[A-Za-z]{0,2}(?:\"{3}(?:[^\\]|\\.)*?\"{3}|'{3}(?:[^\\]|\\.)*?'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)"""
IDENT = r"[A-Za-z_$][\w$]*"
TOKEN = re.compile(rf"""(?s)(?P<string>{STRING})|(?P<flag>(?<!\S)--[A-Za-z][\w-]*)|(?P<tag><[A-Za-z][\w:.-]*)|(?P<name>{IDENT}(?:(?:\.|->|::|-){IDENT})*)|(?P<op>[=!<>]=|:=|=>|[?+]=|=|:(?![:/]))|(?P<mark>[{{}}()\[\],;/])|(?P<line>\n[ \t]*(?:-[ \t]+)?)""")
BARE = re.compile(r"""[^\s,;"'`(){}\[\]<>]+""")
VALUE = re.compile(rf"(?s){STRING}")
GAP = re.compile(r"(?:[ \t]|\\\n)*")
OPEN = re.compile(r"[ \t]*\([ \t\n]*(?=[A-Za-z]{0,2}[\"'])")
PLUS = re.compile(r"(?:[ \t\n]|\\\n)*+(?:\+|\.(?=[ \t]))(?:[ \t\n]|\\\n)*+")
NEXT_STRING = re.compile(r"(?:[ \t\n]|\\\n)*+(?=[A-Za-z]{0,2}[\"'])")
HOLE = re.compile(rf"\$?\{{({IDENT})\}}")
SHELL_NAME = re.compile(rf"\$(?:\{{({IDENT})\}}|({IDENT}))\Z")
NAME = re.compile(rf"{IDENT}(?:\.{IDENT})*\Z")
KEY = re.compile(r"[A-Za-z_$][\w$. -]{0,63}\Z")
ATTRIBUTES = re.compile(r"""([A-Za-z_:][\w:.-]*)\s*=\s*(?:"([^"<]*)"|'([^'<]*)')""")
TAG_END = re.compile(r"[^<>]*>")
ELEMENT = re.compile(r"([^<>\s]+)</([A-Za-z][\w:.-]*)>")
SCHEME = re.compile(r"(?i)(?:bearer|basic|token|apikey)[ \t]+(?=\S)")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
# Type names between a name and its value, names that say nothing by themselves, attributes that hold a name or its value.
TYPES = frozenset("str string String text bytes char const var let final static".split())
GENERAL = frozenset("value val values data text string default plain plaintext raw content current literal stringvalue".split())
NAME_ATTRIBUTES, VALUE_ATTRIBUTES = frozenset("key name id property".split()), frozenset("value content default val".split())
# How sensitive a part of a name is; a key counts with a qualifier beside it.
WEIGHTS = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "pass": 0.8, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "auth": 0.6, "authorization": 0.7, "signature": 0.6, "salt": 0.6, "pin": 0.6}
KEY_QUALIFIERS = frozenset({"api", "access", "private", "secret", "signing", "encryption", "auth", "master", "client", "account", "shared", "session", "service", "crypt"})
PLACEHOLDERS = re.compile(r"(?i)\A(?:none|null|nil|true|false|undefined|changeme|change_me|example|placeholder|redacted|todo|your[_-].*|x+|\*+|\.+|\$\{.*|\$\(.*|<.*|%\(.*|\{\{.*|os\.environ.*|env\..*|process\.env.*|getenv.*)\Z")
# A sensitive name holds one of these; a pair, one of those.
SENSITIVE = ("pass", "pwd", "secret", "token", "apikey", "credential", "bearer", "auth", "signature", "salt", "pin", "key")
ASSIGNING = ("=", ":", "<", "(", "--")
MIN_LITERAL = 6
DEEP = 8  # outer names that a path holds
DEPTH = 16  # names that a value is carried through
LEVEL = 0.5

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_LITERAL]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def name_weight(name: str) -> float:
    parts = [p.lower() for p in PARTS.findall(name)]
    joined = "".join(parts)
    best = max([WEIGHTS.get(p, 0.0) for p in parts] + [WEIGHTS.get(joined, 0.0)], default=0.0)
    if any(p in ("key", "keys") and (set(parts) & KEY_QUALIFIERS) for p in parts):
        best = max(best, 0.9)
    return best


def literal_weight(literal: str) -> float:
    """0 for what can't be a secret, more with length and variety."""
    if len(literal) < MIN_LITERAL or any(c.isspace() for c in literal) or PLACEHOLDERS.match(literal):
        return 0.0
    n = len(literal)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    kinds = sum(any(f(c) for c in literal) for f in (str.isdigit, str.islower, str.isupper, lambda c: not c.isalnum()))
    return min(1.0, 0.2 * min(bits, 4) + 0.1 * kinds)


class Pair(NamedTuple):
    """path: names from the outermost on; value: literals (start, end) and names (text, start, end) in their order."""

    path: tuple[str, ...]
    at: int
    value: tuple


class Reader:
    """Reads a text into name-literal pairs."""

    def __init__(self, text: str) -> None:
        self.text, self.pairs = text, []
        self.tokens = [(m.lastgroup, m.start(), m.end()) for m in TOKEN.finditer(text)]
        self.braces: list[tuple[str, ...]] = []  # names that open brackets add to a path
        self.blocks: list[tuple[int, str]] = []  # indented blocks: indent and name
        self.section: tuple[str, ...] = ()
        self.end = 0  # of the last value: no operator inside it assigns anything

    def read(self) -> list[Pair]:
        text, indent, pending = self.text, 0, ()
        for i, (kind, a, b) in enumerate(self.tokens):
            if kind == "line":
                indent = b - a - 1
                while self.blocks and not self.blank(b) and self.blocks[-1][0] >= indent:
                    self.blocks.pop()
            elif kind == "op" and a >= self.end and text[a:b] in ("=", ":", ":=", "=>", "?=", "+="):
                key = self.key(i)
                if key:
                    pending = (b, key)
                    if text[a] == ":" and self.blank(b) and not self.braces:
                        self.blocks.append((indent, key[-1]))
                    else:
                        self.add(key, b)
            elif kind == "mark" and text[a] in "{([":
                inherits = text[a] != "(" and pending and not text[pending[0] : a].strip()
                self.braces.append(((self.braces[-1] if self.braces else ()) + (pending[1] if inherits else ()))[-DEEP:])
                if text[a] == "[" and not self.braces[:-1] and (not i or self.tokens[i - 1][0] == "line"):
                    end = text.find("]", a, a + 80)
                    if 0 < end and KEY.match(text[b:end]) and self.blank(end + 1):
                        self.section = tuple(text[b:end].split("."))
            elif kind == "mark" and text[a] in "})]":
                if self.braces:
                    self.braces.pop()
            elif kind == "mark" and text[a] == "," and i > 1 and self.tokens[i - 1][0] == "string" and text[self.tokens[i - 2][1]] in "(,":
                name = self.string_key(*self.tokens[i - 1][1:])
                if name and NEXT_STRING.match(text, b):
                    self.add((name,), b)
            elif kind == "flag" and text[b : b + 1] in (" ", "\t"):
                self.add((text[a + 2 : b],), b, quick=True)
            elif kind == "tag":
                self.tag(a, b)
        return self.pairs

    def blank(self, at: int) -> bool:
        """Whether the line is empty from here on, but for a comment."""
        m = GAP.match(self.text, at)
        return m.end() == len(self.text) or self.text[m.end()] in "\n#"

    def string_key(self, a: int, b: int) -> str:
        inner = self.text[a:b].strip("\"'`")
        return inner if KEY.match(inner) else ""

    def key(self, i: int) -> tuple[str, ...]:
        """The name before operator i, empty if there is none."""
        text, tokens = self.text, self.tokens
        start = tokens[i][1]
        if not i or text[tokens[i - 1][2] : start].strip(" \t?"):
            return ()
        kind, a, b = tokens[i - 1]
        if kind == "string":
            name = self.string_key(a, b)
            return (name,) if name else ()
        if kind == "name":
            name = text[a:b]
            before = tokens[i - 2] if i > 1 else ("", 0, 0)
            if before[0] == "op" and text[before[1]] == ":" and i > 2 and tokens[i - 3][0] == "name" and "\n" not in text[tokens[i - 3][1] : b]:
                name = text[tokens[i - 3][1] : tokens[i - 3][2]]  # name: type = value
            elif name in TYPES and before[0] == "name":
                name = text[before[1] : before[2]]
            return tuple(p for p in re.split(r"\.|->|::", name) if p)
        if text[a] == "]" and i > 3 and tokens[i - 2][0] == "string" and text[tokens[i - 3][1]] == "[":
            name = self.string_key(*tokens[i - 2][1:])
            return (name,) if name else ()
        if kind == "flag":
            return (text[a + 2 : b],)
        return ()

    def add(self, key: tuple[str, ...], at: int, quick: bool = False) -> None:
        value = self.value(at, quick)
        if value:
            outer = (self.braces[-1] if self.braces else ()) or [n for _, n in self.blocks[-DEEP:]]
            self.pairs.append(Pair((*self.section, *outer, *key), at, value))

    def value(self, at: int, quick: bool) -> tuple:
        """The pieces of the value that begins at a place: to the end of a concatenation, of adjacent strings, or of a bare word."""
        text, out = self.text, []
        at = GAP.match(text, at).end()
        m = OPEN.match(text, at)
        inside = bool(m)
        at = m.end() if m else at
        while True:
            m = VALUE.match(text, at)
            if m:
                out += self.pieces(at, m.end())
                at = m.end()
                follows = NEXT_STRING.match(text, at) if inside else None
            else:
                m = BARE.match(text, at)
                if not m:
                    break
                skip = SCHEME.match(text, at)
                if skip and not out:
                    at = skip.end()
                    continue
                end = at + len(m[0].rstrip(".:"))
                whole = text[at:end]
                if "+" in whole and all(map(NAME.match, whole.split("+"))):
                    end = at + whole.index("+")
                if end == at or text[m.end() : m.end() + 1] in ("(", "["):
                    break
                out.append((text[at:end], at, end))
                self.end = max(self.end, end)
                at, follows = end, None
            follows = follows or (None if quick else PLUS.match(text, at))
            if not follows or follows.end() == at:
                break
            at = follows.end()
        return tuple(out)

    def pieces(self, a: int, b: int) -> list[tuple]:
        """A string as literals and the names in it, without quotes and without the scheme of a credential."""
        text = self.text
        open_ = next(k for k in range(a, b) if text[k] in "\"'`")
        mark = text[open_]
        wide = 3 if text.startswith(mark * 3, open_) and b - open_ >= 6 else 1
        lo, hi = open_ + wide, b - wide
        m = SCHEME.match(text, lo, hi)
        lo = m.end() if m else lo
        if "f" not in text[a:open_].lower() and mark != "`" and "${" not in text[lo:hi]:
            return [(lo, hi)]
        out = []
        for m in HOLE.finditer(text, lo, hi):
            out += [(lo, m.start()), (m[1], m.start(), m.start())]
            lo = m.end()
        return [*out, (lo, hi)]

    def tag(self, a: int, b: int) -> None:
        """Attributes that name each other's value, and a word in an element of its own."""
        text = self.text
        m = TAG_END.match(text, b)
        if not m:
            return
        found = [(x[1].lower().split(":")[-1], x.span(2) if x[2] is not None else x.span(3)) for x in ATTRIBUTES.finditer(text, b, m.end())]
        names = [text[slice(*p)] for k, p in found if k in NAME_ATTRIBUTES]
        for k, p in found:
            if k in VALUE_ATTRIBUTES:
                self.pairs += [Pair((n,), a, (p,)) for n in names if KEY.match(n)]
        inner = ELEMENT.match(text, m.end())
        if inner and inner[2] == text[a + 1 : b]:
            self.pairs.append(Pair((inner[2].split(":")[-1],), a, (inner.span(1),)))


def resolved(pair: Pair, text: str, known: dict[str, tuple[list[int], list[Pair]]], depth: int = DEPTH) -> list[tuple[int, int]]:
    """The literals that a value consists of, each once, names replaced by what was last assigned to them before, or else first after."""
    out: dict[tuple[int, int], None] = {}
    seen, level = {id(pair)}, [pair]
    for _ in range(depth + 1):
        follow = []
        for one in level:
            for piece in one.value:
                if len(piece) == 2:
                    out[piece] = None
                    continue
                word, a, b = piece
                shell = SHELL_NAME.match(word)
                name = (shell[1] or shell[2]) if shell else word
                places, made = known.get(name.split(".")[-1], ((), ()))
                at = bisect.bisect_left(places, a) - 1
                at -= at >= 0 and made[at] is one
                at = at if at >= 0 else next((k for k in range(min(2, len(made))) if made[k] is not one), -1)
                if at >= 0:
                    if id(made[at]) not in seen:
                        seen.add(id(made[at]))
                        follow.append(made[at])
                elif not shell and not (NAME.match(word) and word.replace(".", "").replace("_", "").isalpha()):
                    out[a, b] = None
        level = follow
    return [(a, b) for a, b in out if b > a]


def path_weight(path: tuple[str, ...]) -> float:
    """How sensitive the last name is that says anything."""
    for name in reversed(path):
        if "".join(PARTS.findall(name)).lower() not in GENERAL:
            return name_weight(name)
    return 0.0


def lexed_spans(text: str, level: float = LEVEL) -> list[Span]:
    """Spans of literals that reach a sensitive name."""
    if not any(x in text for x in ASSIGNING):
        return []
    low = text.lower()
    if not any(x in low for x in SENSITIVE):  # no name can reach the level
        return []
    pairs = Reader(text).read()
    known: dict[str, tuple[list[int], list[Pair]]] = {}
    for p in sorted(pairs, key=lambda p: p.at):
        places, made = known.setdefault(p.path[-1], ([], []))
        places.append(p.at)
        made.append(p)
    found: dict[tuple[int, int], None] = {}
    for p in pairs:
        weight = path_weight(p.path)
        if weight >= level:
            places = resolved(p, text, known)
            if weight * literal_weight("".join(text[a:b] for a, b in places)) >= level:
                found |= dict.fromkeys(places)
    return [(a, b, "lexed") for a, b in sorted(found)]


def covered(start: int, end: int, base: list[Span]) -> bool:
    """Whether base spans, by start, cover all from start to end."""
    for a, b, _ in base:
        if a > start:
            break
        start = max(start, b)
    return start >= end


def spans(text: str | None, level: float = LEVEL) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start and then kind as listed."""
    if not text:
        return [], []
    order = lambda x: (x[0], KINDS.index(x[2]), x[1])
    base = sorted(base_spans(text), key=order)
    more = [x for x in lexed_spans(text, level) if not covered(x[0], x[1], base)]
    return base, sorted(base + more, key=order)


def joined(found: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


SCAN_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: float = LEVEL) -> DataFrame:
    """One row a document: doc_id, the number of base spans of each kind, base_sha256, and all spans."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in text_batches(whole, 1):
                rows = []
                for text in batch.column(1).to_pylist():
                    base, every = spans(text, level)
                    count = Counter(kind for _, _, kind in base)
                    rows.append((count["assign"], count["access"], count["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(work, SCAN_SCHEMA)


def masked(text: str | None, mark: str = "[SECRET]", level: float = LEVEL) -> str | None:
    """text with each maximal run of overlapping spans replaced by `mark`."""
    out, at, start, end = [], 0, -1, -1
    for a, b, _ in [*spans(text, level)[1], (1 << 60, 1 << 60, "")]:
        if a >= end:
            if end >= 0:
                out += [text[at:start], mark]
                at = end
            start, end = a, b
        else:
            end = max(end, b)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", level: float = LEVEL) -> DataFrame:
    """docs with every span of `text_col` replaced by `mark`; no row goes and all columns stay."""
    place = docs.columns.index(text_col)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in text_batches(whole, place):
                text = pa.array([masked(t, mark, level) for t in batch.column(place).to_pylist()], batch.schema.field(place).type)
                yield pa.RecordBatch.from_arrays([text if i == place else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(work, docs.schema)
