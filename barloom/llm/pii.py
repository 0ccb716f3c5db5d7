"""Personal data in texts, disguised or not, with offsets into the source."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.labels import LABELS
from barloom.llm.tables import unused

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# The domain is sought first and the name read backwards from it: linear in any text.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NAME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
# A match starts where a run of digits starts, or nowhere in the run.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for match in _DOMAIN.finditer(text):
        start = match.start()
        while start > done and text[start - 1] in _NAME:
            start -= 1
        if start < match.start():
            done = match.end()
            yield start, done


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for match in _IP.finditer(text):
        parts = [p.lstrip("0") for p in match[0].split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            yield match.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for match in _CARD.finditer(text):
        digits = match[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield match.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for match in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(match[0])) <= 15:
            yield match.span()


def identifiers(text: str) -> list[Span]:
    """(kind, start, end) of plain identifiers, leftmost and non-overlapping in each kind."""
    found: list[Span] = []
    if "@" in text:
        found += (("email", *s) for s in _emails(text))
    if _DIGIT.search(text):
        found += (("ip", *s) for s in _ips(text))
        found += (("card", *s) for s in _cards(text))
        if "+" in text:
            found += (("phone", *s) for s in _phones(text))
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# Letters of other scripts that look like a Latin one, and the Latin ones.
_CYRILLIC = "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝһ"
_CYRILLIC_AS = "ABESIJKMHOPCTYXaesijopcyxdqwh"
_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανιρ"
_GREEK_AS = "ABEZHIKMNOPTYXoavip"
# Further signs for @ . - + and the space, and signs without width.
_SIGNS = {"﹫": "@", "․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹢": "+", " ": " ", " ": " ", " ": " "}
_NO_WIDTH = "­​‌‍⁠﻿"
# The names of the digits.
_NAMES = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


def _lookalikes() -> dict[str, str]:
    table = dict(zip(_CYRILLIC + _GREEK, _CYRILLIC_AS + _GREEK_AS, strict=True)) | _SIGNS
    table |= dict.fromkeys(_NO_WIDTH, "")
    table |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}  # full width
    for code in range(0x80, 0x20000):
        if unicodedata.category(chr(code)) == "Nd":
            table[chr(code)] = str(unicodedata.digit(chr(code)))
    return table


_PLAIN = _lookalikes()
_ODD = re.compile("[" + "".join(map(re.escape, _PLAIN)) + "]")
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_BRACKET_DOT = rf"\s{{0,3}}{_OPEN}\s{{0,3}}(?:dot|\.)\s{{0,3}}{_CLOSE}\s{{0,3}}"
_DOTTED = rf"(?:{_BRACKET_DOT}|\s{{1,3}}dot\s{{1,3}})"
_DIGIT_NAME = r"\b(?:" + "|".join(_NAMES) + r")\b"
_PLUS = rf"\bplus[ -](?=[0-9]|{_DIGIT_NAME})"
# Last labels of a domain told with plain words; other words after a plain "dot" are prose. After a dot in brackets any word counts.
_LAST = "|".join(sorted(LABELS))
# Labels that are also English words; after a determiner ("at the dot to the left") they are prose.
_PROSE = r"(?:the|an?|this|that|each|every)\s{1,3}dot\s{1,3}(?:am|as|by|do|is|me|my|no|now|one|so|to)\b"
_HOST = rf"(?!{_PROSE})[a-z0-9-]{{1,63}}(?:{_DOTTED}[a-z0-9-]{{1,63}}){{0,4}}(?:{_DOTTED}(?:{_LAST})|{_BRACKET_DOT}[a-z]{{2,63}})\b"
_DISGUISE = re.compile(
    rf"(?P<at>\s{{0,3}}{_OPEN}\s{{0,3}}(?:at|@)\s{{0,3}}{_CLOSE}\s{{0,3}}"
    rf"|(?<=[a-z0-9])\s{{1,3}}at\s{{1,3}}(?={_HOST}))"
    rf"|(?P<dot>(?<=[a-z0-9]){_DOTTED}(?=[a-z0-9]))"
    rf"|(?P<plus>{_PLUS})"
    rf"|(?P<digits>{_DIGIT_NAME}(?:[ -]{{1,2}}{_DIGIT_NAME}){{2,}})",
    re.IGNORECASE,
)
_BRACKETED = re.compile(rf"{_OPEN}\s{{0,3}}(?:at|@|dot|\.)\s{{0,3}}{_CLOSE}", re.IGNORECASE)
_PLUSSED = re.compile(_PLUS, re.IGNORECASE)
_NAMED = re.compile(_DIGIT_NAME, re.IGNORECASE)


def _disguised(text: str) -> bool:
    """Whether a transducer could change the text; cheap substring tests first."""
    low = text.lower().replace("-", " ")
    if "dot" in low or any(f" {name} " in low for name in _NAMES):
        return True
    if "plus " in low and _PLUSSED.search(text):
        return True
    return any(c in text for c in "[({<") and bool(_BRACKETED.search(text))


class Normalised:
    """A text with disguises undone, and where each of its characters came from.

    Two transducers run one after the other: single lookalike characters, then disguised at and
    dot signs and spelled digits. Both emit runs (target start, source start, source end, kept): kept
    runs copy the source, the others replace it as a whole, so offsets survive composition.
    """

    def __init__(self, text: str, changes: list[tuple[int, int, str]]):
        self.runs, parts, at, to = [], [], 0, 0
        for start, end, new in changes:
            if start > at:
                self.runs.append((to, at, start, True))
                parts.append(text[at:start])
                to += start - at
            if new:
                self.runs.append((to, start, end, False))
                parts.append(new)
                to += len(new)
            at = end
        if at < len(text):
            self.runs.append((to, at, len(text), True))
            parts.append(text[at:])
        self.text, self.starts = "".join(parts), [r[0] for r in self.runs]

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source characters behind a span."""
        return self._at(start)[0], self._at(end - 1)[1]

    def _at(self, i: int) -> tuple[int, int]:
        to, first, last, kept = self.runs[bisect_right(self.starts, i) - 1]
        return (first + i - to, first + i - to + 1) if kept else (first, last)


def _spelled(match: re.Match) -> list[tuple[int, int, str]]:
    """Changes of one disguise: spelled digits one by one, with what separates them; others as one sign."""
    if match.lastgroup != "digits":
        return [(*match.span(), {"at": "@", "dot": ".", "plus": "+"}[match.lastgroup])]
    names = list(_NAMED.finditer(match[0]))
    ends = [m.start() for m in names[1:]] + [len(match[0])]
    base = match.start()
    # Separators belong to the digit before them, except after the last one.
    return [
        (base + m.start(), base + end, str(_NAMES.index(m[0].lower()))) for m, end in zip(names, ends, strict=True)
    ]


def disguised_identifiers(text: str, plain: list[Span]) -> list[Span]:
    """Further spans that show only once disguises are undone; none lies inside a plain one of its kind.

    Refused as prose: the plain word "at" unless the words after it are labels joined by "dot" that end in a
    known last label (LABELS), or in any word of two or more letters after a dot in brackets; a determiner
    and "dot" before a label that is an English word ("at the dot to"). Labels with digits or hyphens
    ("xn--...") are no last label here. An "at" in brackets counts before any label.
    """
    odd = [] if text.isascii() else [(m.start(), m.end(), _PLAIN[m[0]]) for m in _ODD.finditer(text)]
    first = Normalised(text, odd) if odd else None
    seen = first.text if first else text
    second = None
    if _disguised(seen):
        changes = [c for m in _DISGUISE.finditer(seen) for c in _spelled(m)]
        second = Normalised(seen, changes) if changes else None
    if not first and not second:
        return []
    found = []
    for kind, start, end in identifiers(second.text if second else seen):
        for view in (second, first):
            if view:
                start, end = view.source(start, end)
        while end > start and text[end - 1] in " -":
            end -= 1
        if not any(k == kind and a <= start and end <= b for k, a, b in plain):
            found.append((kind, start, end))
    return found


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])


_SPANS = T.ArrayType(
    T.StructType()
    .add("kind", T.StringType())
    .add("start", T.LongType())
    .add("end", T.LongType())
    .add("base", T.BooleanType())
)


@F.arrow_udf(_SPANS)
def spans(texts: pa.Array) -> pa.Array:
    """Spans of a whole text in order of start, then kind; ``base`` marks those found without undoing disguises."""
    rows = []
    for text in texts:
        text = text.as_py() or ""
        plain = identifiers(text)
        hidden = set(disguised_identifiers(text, plain))
        rows.append(
            [
                {"kind": s[0], "start": s[1], "end": s[2], "base": s not in hidden}
                for s in in_order([*plain, *hidden])
            ]
        )
    return pa.array(rows, pa.list_(_SPAN))


@F.arrow_udf(T.StringType())
def _masked(texts: pa.Array, found: pa.Array) -> pa.Array:
    out = []
    for text, places in zip(texts.to_pylist(), found.to_pylist(), strict=True):
        parts, at = [], 0
        for place in sorted(places or (), key=lambda p: (p["start"], -p["end"])):
            if place["end"] > at:
                if place["start"] >= at:
                    parts += [text[at : place["start"]], f"[{place['kind'].upper()}]"]
                at = place["end"]
        out.append(text if not parts else "".join(parts) + text[at:])
    return pa.array(out, pa.string())


def find(docs: DataFrame, *, text_col: str = "text", name: str = "spans") -> DataFrame:
    """Adds the array ``spans`` of (kind, start, end, base): code points, end exclusive.

    NULL and empty texts have an empty array. Rows are judged one by one, so repeated rows and
    further columns pass through; a column called like the new one is replaced.
    """
    return docs.withColumn(name, spans(F.col(text_col)))


def mask(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Texts with every span replaced by its kind in brackets; NULL stays NULL. Columns as they were."""
    name = unused("_spans", docs)
    found = find(docs, text_col=text_col, name=name)
    return found.withColumn(text_col, _masked(F.col(text_col), F.col(name))).select(*docs.columns)


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )
