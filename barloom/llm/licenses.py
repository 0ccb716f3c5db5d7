"""Licence scan: a generalised suffix automaton over licence notices, matching statistics, and chains of long matches."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.license_texts import PHRASES, TEMPLATES

#: Words that a match needs, words that may stand between two matches of one span, and the share of a notice that a
#: span has to cover.
LEAST_MATCH, MOST_GAP, LEAST_SHARE = 4, 40, 0.6
#: Words hold digits, a-z (after lower-casing) and everything outside ASCII; all else parts them.
_APART = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").lower().translate(_APART).split()


class Span(NamedTuple):
    """Words ``first`` to ``last`` hold ``covered`` words of a notice in their order, ``share`` of all it has."""

    label: str
    template: int
    first: int
    last: int
    covered: int
    share: float


class Automaton:
    """All word sequences inside a set of templates; states are classes of sequences that end at the same places."""

    def __init__(self, templates: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for number, words in enumerate(templates):
            last = 0
            for place, word in enumerate(words):
                last = self._extended(last, word, ends)
                ends[last].append((number, place))
        # A sequence also ends where any longer one of which it is the tail ends.
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                ends[self.link[state]] += ends[state]
        self.ends = [sorted(set(e)) for e in ends]

    def _state(self, length: int, follow: dict[int, int], link: int, ends: list) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        ends.append([])
        return len(self.length) - 1

    def _split(self, parent: int, word: int, ends: list) -> int:
        """The state of the sequences of ``parent`` followed by ``word``, parted from longer ones."""
        child = self.next[parent][word]
        if self.length[child] == self.length[parent] + 1:
            return child
        copy = self._state(self.length[parent] + 1, dict(self.next[child]), self.link[child], ends)
        self.link[child] = copy
        while parent >= 0 and self.next[parent].get(word) == child:
            self.next[parent][word] = copy
            parent = self.link[parent]
        return copy

    def _extended(self, last: int, word: int, ends: list) -> int:
        if word in self.next[last]:
            return self._split(last, word, ends)
        new = self._state(self.length[last] + 1, {}, 0, ends)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word, ends)
        return new

    def statistics(self, words: Sequence[int]) -> Iterator[tuple[int, int]]:
        """For every word: (state, length) of the longest sequence that ends there and stands in a template."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield state, length

    def pairs(self, words: Sequence[int]) -> Iterator[tuple[int, int, int, int]]:
        """(place, template, end in it, length) of every match of LEAST_MATCH or more words, in order of places."""
        for place, (state, length) in enumerate(self.statistics(words)):
            seen: set[tuple[int, int]] = set()
            while length >= LEAST_MATCH:
                for end in self.ends[state]:
                    if end not in seen:
                        seen.add(end)
                        yield place, *end, length
                state = self.link[state]
                length = self.length[state]


class Scanner:
    """Notices and phrases, ready to be looked for. Built from the fixed texts, so its size does not depend on the data."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.vocabulary: dict[bytes, int] = {}
        self.labels = [label for label, _ in templates]
        self.templates = [self._ids(text) for _, text in templates]
        self.phrases = [(label, self._ids(text)) for label, text in phrases]
        self.automaton = Automaton(self.templates)

    def _ids(self, text: str) -> list[int]:
        return [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words, 0 for those that no notice has."""
        known = self.vocabulary.get
        return np.fromiter((known(w, 0) for w in words), np.int32, len(words))

    def places(self, ids: np.ndarray) -> list[tuple[str, np.ndarray]]:
        """(label, starts) of every phrase."""
        found = []
        for label, phrase in self.phrases:
            size = max(len(ids) - len(phrase) + 1, 0)
            hit = np.ones(size, bool)
            for offset, word in enumerate(phrase):
                hit &= ids[offset : offset + size] == word
            found.append((label, np.flatnonzero(hit)))
        return found

    def spans(self, ids: np.ndarray) -> list[Span]:
        """Chained matches of every notice, whatever their share."""
        matched: dict[int, set[tuple[int, int]]] = {}
        known = np.flatnonzero(np.diff((ids > 0).astype(np.int8), prepend=0, append=0))
        for start, stop in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if stop - start >= LEAST_MATCH:
                for place, template, end, length in self.automaton.pairs(ids[start:stop].tolist()):
                    held = matched.setdefault(template, set())
                    place_in = start + place
                    # The words before the last one are there already if a match ended one word earlier.
                    new = 1 if (place_in - 1, end - 1) in held else length
                    held.update((place_in - k, end - k) for k in range(new))
        return [span for template, held in sorted(matched.items()) for span in self._chained(template, held)]

    def _chained(self, template: int, held: set[tuple[int, int]]) -> Iterator[Span]:
        """Groups of matches without a gap of more than MOST_GAP words, each with its longest increasing chain."""
        # Later template places first, so that a word of the text takes one place only.
        held = sorted(held, key=lambda pair: (pair[0], -pair[1]))
        cuts = [0, *(k for k in range(1, len(held)) if held[k][0] - held[k - 1][0] > MOST_GAP), len(held)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            tails, at, before = [], [], []
            for number in range(a, b):
                place = held[number][1]
                rank = bisect_left(tails, place)
                before.append(at[rank - 1] if rank else None)
                tails[rank : rank + 1], at[rank : rank + 1] = [place], [number]
            first = at[-1]
            while before[first - a] is not None:
                first = before[first - a]
            share = len(tails) / len(self.templates[template])
            yield Span(self.labels[template], template, held[first][0], held[at[-1]][0], len(tails), share)

    def judged(self, spans: list[Span]) -> list[Span]:
        """Spans that cover enough of their notice and are not for the most part inside one that covers more words."""
        kept: list[Span] = []
        for span in sorted(spans, key=lambda s: (-s.covered, -s.share, s.template, s.first)):
            half = (span.last - span.first + 1) / 2
            if span.share >= LEAST_SHARE and all(min(span.last, k.last) - max(span.first, k.first) + 1 <= half for k in kept):
                kept.append(span)
        return sorted(kept, key=lambda s: (s.first, s.template))


_SPAN = T.StructType()
for _name, _kind in zip(Span._fields, (T.StringType(), T.IntegerType(), T.LongType(), T.LongType(), T.LongType(), T.DoubleType()), strict=True):
    _SPAN.add(_name, _kind)
_PLACE = T.StructType().add("label", T.StringType()).add("word", T.LongType())
FOUND = T.StructType().add("n_words", T.LongType()).add("places", T.ArrayType(_PLACE)).add("spans", T.ArrayType(_SPAN)).add("score", T.DoubleType())
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("places", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))),
        ("spans", pa.list_(pa.struct(list(zip(Span._fields, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True))))),
        ("score", pa.float64()),
    ]
)


def found_in(scanner: Scanner, text: str | None) -> dict:
    """What one text holds: words, places of phrases, spans of notices, and the largest share of either."""
    words = words_of(text or "")
    ids = scanner.ids(words)
    places = spans = ()
    if np.count_nonzero(ids) > 1:
        places = sorted((int(w), label) for label, starts in scanner.places(ids) for w in starts)
        spans = scanner.spans(ids)
    return {
        "n_words": len(words),
        "places": [{"label": label, "word": word} for word, label in places],
        "spans": [s._asdict() for s in scanner.judged(list(spans))],
        # A phrase is a notice that stands there in full.
        "score": 1.0 if places else max((s.share for s in spans), default=0.0),
    }


def scan(docs: DataFrame, *, text_col: str = "text", name: str = "found", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """Adds one struct column ``name``: ``n_words``, ``places`` (label and first word of each phrase), ``spans``
    (label, template, first and last word, words covered, share of the notice) and ``score`` (0 to 1).

    Words are numbered from 0 in the lower-cased text. NULL and empty texts have no words and score 0. Every row is
    judged by itself in one pass over its words, repeated rows alike; all other columns stay as they are, and a
    column called ``name`` is refused. Notices that share text compete: a span inside one that covers more words goes.
    """
    if name in docs.columns:
        raise ValueError(f"the table has a column {name} already")
    held: list[Scanner] = []

    def judged(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Scanner(templates, phrases))
        return pa.array([found_in(held[0], t.as_py()) for t in texts], _ARROW)

    return docs.withColumn(name, F.arrow_udf(judged, FOUND)(F.col(text_col)))


def labels_of(found) -> tuple:
    """(labels of phrases, labels of phrases and spans), each distinct, sorted and joined by commas."""
    base = F.transform(found["places"], lambda p: p["label"])
    spans = F.transform(found["spans"], lambda s: s["label"])
    return tuple(F.array_join(F.array_sort(F.array_distinct(x)), ",") for x in (base, F.concat(base, spans)))
