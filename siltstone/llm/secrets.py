"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class.

Candidate strings are runs of key-like characters. In each, for each character class, a
window slides over the class's runs; counts of its characters are kept as it moves, so
that each step changes two counts and the entropy follows from a running sum of c*log2(c).
Windows over the class's threshold that hold the class's required kinds of characters are
united to spans. An allow-listed string takes its segment (between / = _ -) out of the
candidate; the rest is scanned.

Defined results: a null or empty text has no spans; repeated rows give repeated results;
columns of the input other than the id and the text are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame

_any_case = lambda word: "".join(f"[{c.upper()}{c}]" for c in word)
#: The stated base patterns and their least lengths.
ASSIGN = re.compile(
    "(" + "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _any_case("api") + "_?" + _any_case("key") + ")"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_lower", "entropy_upper", "entropy_mixed")
CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{20,}")
BORDER = re.compile("[/=_-]")

#: Strings that look random and are none.
ALLOWED = re.compile(
    r"(?i:example|test[_-]?only|placeholder|dummy|changeme|0123456789abcdef|abcdefghijklmnop)"
    r"|^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
    r"|^(.)\1+$"
)


@dataclass(frozen=True)
class CharClass:
    """A class's characters, its window's length, the bits a window needs, and kinds of characters it must hold."""

    kind: str
    characters: str
    window: int
    bits: float
    needs: tuple[str, ...]


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    CharClass("entropy_hex", _DIGITS + "abcdefABCDEF", 20, 3.0, (_DIGITS, "abcdefABCDEF")),
    CharClass("entropy_base64", _DIGITS + _LOWER + _UPPER + "+/=_-", 24, 4.0, (_DIGITS, _LOWER, _UPPER)),
    # one case alone needs more bits than with digits, since long compound words come near; the last class takes keys shorter than a base64 window
    CharClass("entropy_lower", _DIGITS + _LOWER, 20, 3.6, (_DIGITS, _LOWER)),
    CharClass("entropy_lower", _LOWER, 20, 3.75, ()),
    CharClass("entropy_upper", _DIGITS + _UPPER, 20, 3.6, (_DIGITS, _UPPER)),
    CharClass("entropy_upper", _UPPER, 20, 3.75, ()),
    CharClass("entropy_mixed", _DIGITS + _LOWER + _UPPER, 20, 3.9, (_LOWER, _UPPER)),
)
#: Kinds whose spans are left out where another span covers them.
WITHIN = ("entropy_lower", "entropy_upper", "entropy_mixed")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping per kind."""
    found = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return found


def entropy_spans(candidate: str, cls: CharClass) -> Iterator[tuple[int, int]]:
    """Spans of `candidate` that windows of the class over its threshold cover."""
    w = cls.window
    allowed = set(cls.characters)
    member = [tuple(i for i, chars in enumerate(cls.needs) if c in chars) if c in allowed else None for c in candidate]
    floor = w * (log2(w) - cls.bits)  # the sum of c*log2(c) that a window may have
    clog = [0.0, *(c * log2(c) for c in range(1, w + 1))]
    counts: dict[str, int] = {}
    kinds = [0] * len(cls.needs)
    held, run, spans = 0.0, 0, []
    for i, c in enumerate(candidate):
        if member[i] is None:
            counts, kinds, held, run = {}, [0] * len(cls.needs), 0.0, 0
            continue
        if run == w:
            old = candidate[i - w]
            n = counts[old]
            held += clog[n - 1] - clog[n]
            counts[old] = n - 1
            for k in member[i - w]:
                kinds[k] -= 1
        else:
            run += 1
        n = counts.get(c, 0)
        held += clog[n + 1] - clog[n]
        counts[c] = n + 1
        for k in member[i]:
            kinds[k] += 1
        if run == w and held <= floor and all(kinds):
            if spans and i - w + 1 <= spans[-1][1]:
                spans[-1][1] = i + 1
            else:
                spans.append([i - w + 1, i + 1])
    return ((a, b) for a, b in spans)


def unlisted(run: str, allowed: re.Pattern) -> Iterator[tuple[int, str]]:
    """What is left of a candidate, with its place, without the segments that allow-listed strings touch."""
    at, borders = 0, [-1, *(m.start() for m in BORDER.finditer(run)), len(run)]
    for m in allowed.finditer(run):
        a = borders[bisect_left(borders, m.start()) - 1] + 1
        b = borders[bisect_left(borders, m.end())]
        if a > at:
            yield at, run[at:a]
        at = max(at, b)
    yield at, run[at:]


class Cover:
    """Whether one of some spans covers another: by starts in order, with the greatest end so far."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        ordered = sorted(spans)
        self.starts = [s[0] for s in ordered]
        self.ends = list(accumulate((s[1] for s in ordered), max))

    def holds(self, a: int, b: int) -> bool:
        i = bisect_right(self.starts, a)
        return i > 0 and self.ends[i - 1] >= b


def find_spans(text: str | None, classes: tuple[CharClass, ...] = CLASSES, allowed: re.Pattern = ALLOWED) -> list[tuple[int, int, str]]:
    """All spans by start, then kind as listed in KINDS; ends are exclusive, positions are code points.

    Entropy spans that lie inside a base span are left out: the base span reports them. So are
    those of the kinds in WITHIN that lie inside any span found before.
    """
    if not text:
        return []
    found = base_spans(text)
    base = Cover(found)
    for m in CANDIDATE.finditer(text):
        for at, piece in unlisted(m[0], allowed):
            if len(piece) < 20 or piece.isdigit():
                continue
            own: list[tuple[int, int, str]] = []
            for cls in classes:
                before = Cover(own if cls.kind in WITHIN else [])
                for a, b in entropy_spans(piece, cls):
                    a, b = a + at + m.start(), b + at + m.start()
                    if not base.holds(a, b) and not before.holds(a, b):
                        own.append((a, b, cls.kind))
            found += own
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(found, key=lambda s: (s[0], order[s[2]], s[1]))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redacted(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each span, united where they overlap, replaced by its first kind's mark."""
    if not spans:
        return text
    out, at, open_end = [], 0, -1
    for a, b, kind in spans:
        if a >= open_end:
            out += [text[at:a], f"[{kind}]"]
            open_end = b
        open_end = max(open_end, b)
        at = open_end
    return "".join(out) + text[at:]


SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, counts of base spans, a digest of them, and all spans as text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            rows = [[], [], [], [], []]
            for text in batch.column(1):
                spans = find_spans(text.as_py())
                base = [s for s in spans if s[2] in KINDS[:3]]
                for column, kind_ in zip(rows, KINDS[:3], strict=False):
                    column.append(sum(s[2] == kind_ for s in base))
                rows[3].append(hashlib.sha256(listed(base).encode()).hexdigest())
                rows[4].append(listed(spans))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(r, t) for r, t in zip(rows, types, strict=True))],
                [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select(id_col, text_col).mapInArrow(scan, f"`{id_col}` {kind}, {SCHEMA}")


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns, each found span replaced by its kind in brackets.

    Where a text changes, `length_col` (if the table has it) is set to its new length.
    """
    names = docs.columns
    at = names.index(text_col)
    length_at = names.index(length_col) if length_col in names else None

    def scan(batches):
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [redacted(t, find_spans(t)) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, columns[at].type)
            if length_at is not None:
                kept = columns[length_at].to_pylist()
                columns[length_at] = pa.array([k if a == b else len(b) for k, a, b in zip(kept, old, new, strict=True)], columns[length_at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(scan, docs.schema)
