"""Phrase collocations: suffix pointers routed by leading words, multikey three-way quicksort, scores of cuts."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.tables import stored

DEPTH = 5
#: Words that are sorted and routed together: bounds what a worker holds, and word numbers fit 21 bits.
CHUNK_WORDS = 1 << 20
_BITS = 21
#: Most ranges that suffixes are dealt to, samples drawn for each boundary, and characters of a sample.
MOST_RANGES, SAMPLES, SAMPLE_CHARS = 1 << 16, 16, 128
UNKNOWN_LANG = "und"
#: Ends a piece; no word can hold it.
_END = b"."
_PIECES = bytes(ord(_END) if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))


def tokens(text: str) -> list[bytes]:
    """Words of the lower-cased text; ``.`` stands where a piece ends."""
    return text.encode("utf-8").lower().translate(_PIECES).replace(_END, b" . ").split()


class _Numbers(dict):
    """Numbers words as they come; a piece end is 0."""

    def __init__(self):
        super().__init__({_END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def suffixes(ids: np.ndarray, starts: int) -> list[np.ndarray]:
    """Columns of the first DEPTH words of the first ``starts`` suffixes, 0 from where their piece ends."""
    padded = np.concatenate([ids, np.zeros(DEPTH, ids.dtype)])
    columns = [padded[:starts]]
    for depth in range(1, DEPTH):
        columns.append(np.where(columns[-1] == 0, 0, padded[depth : depth + starts]))
    return columns


def _distinct(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Suffixes in order, each once, and how often they occur; piece ends go."""
    wide = [c.astype(np.int64) for c in columns]
    head = (wide[0] << 2 * _BITS) | (wide[1] << _BITS) | wide[2]
    tail = (wide[3] << _BITS) | wide[4]
    order = np.lexsort((tail, head))
    order = order[np.searchsorted(head[order], 1 << 2 * _BITS) :]
    head, tail = head[order], tail[order]
    new = np.ones(len(order), bool)
    new[1:] = (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])
    first = np.flatnonzero(new)
    return [c[order[first]] for c in columns], np.diff(np.append(first, len(order)))


def _positions(columns: list[np.ndarray], words: list[bytes], boundaries: list[tuple[bytes, ...]]) -> list[int]:
    """Where ordered suffixes reach each boundary. ``words`` are in order, their numbers start at 1."""
    found = []
    for boundary in boundaries:
        low, high = 0, len(columns[0])
        for depth, word in enumerate(boundary):
            column = columns[depth][low:high]
            rank = bisect_left(words, word) + 1
            low, high = low + int(np.searchsorted(column, rank)), low + int(np.searchsorted(column, rank + 1))
            if rank > len(words) or words[rank - 1] != word:
                # No suffix holds the word; those with greater ones start at its rank.
                high = low
            if low == high:
                break
        found.append(low)
    return found


def _block(columns: list[np.ndarray], words: list[bytes], counts: np.ndarray) -> bytes:
    """Suffixes as numbers of the words they use, packed."""
    used = np.zeros(len(words) + 1, bool)
    for column in columns:
        used[column] = True
    used[0] = False
    chosen = np.flatnonzero(used)
    number = np.zeros(len(words) + 1, np.uint32)
    number[chosen] = np.arange(1, len(chosen) + 1)
    kind = np.uint16 if len(chosen) < 1 << 16 else np.uint32
    text = b" ".join(words[k - 1] for k in chosen.tolist())
    wide = np.int64 if counts.max() > 0xFFFF else np.uint16
    sizes = np.array([len(text), len(counts), np.dtype(kind).itemsize, np.dtype(wide).itemsize], np.int64)
    parts = [sizes.tobytes(), text, *(number[c].astype(kind).tobytes() for c in columns), counts.astype(wide).tobytes()]
    return zstandard.compress(b"".join(parts), 1)


def _unpacked(block: bytes) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    data = zstandard.decompress(block)
    size, rows, kind, wide = np.frombuffer(data, np.int64, 4).tolist()
    at = 32 + size
    columns = []
    for _ in range(DEPTH):
        columns.append(np.frombuffer(data, f"u{kind}", rows, at))
        at += rows * kind
    return data[32 : 32 + size].split(), columns, np.frombuffer(data, np.int64 if wide == 8 else np.uint16, rows, at).astype(np.int64)


def _routed(lang: str, found: list[bytes], starts: int, boundaries: list[tuple[bytes, ...]]) -> Iterator[tuple[str, int, bytes]]:
    """(lang, range, block) of a chunk whose first ``starts`` tokens begin suffixes."""
    numbers = _Numbers()
    ids = np.fromiter(map(numbers.__getitem__, found), np.int64, len(found))
    del numbers[_END]
    words = sorted(numbers)
    rank = np.zeros(len(words) + 1, np.int32)
    rank[np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))] = np.arange(1, len(words) + 1)
    columns, counts = _distinct(suffixes(rank[ids], starts))
    cuts = [0, *_positions(columns, words, boundaries), len(counts)]
    for number, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if a < b:
            yield lang, number, _block([c[a:b] for c in columns], words, counts[a:b])


def _router(boundaries: dict[str, list[tuple[bytes, ...]]]):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[bytes]] = {}
        held = 0

        def flushed(lang: str, keep: int) -> Iterator[pa.RecordBatch]:
            found = waiting.pop(lang)
            rows = list(_routed(lang, found, len(found) - keep, boundaries.get(lang, [])))
            if keep:
                waiting[lang] = found[-keep:]
            for row in rows:
                yield pa.record_batch([pa.array([v], k) for v, k in zip(row, (pa.string(), pa.int32(), pa.binary()), strict=True)], names=["lang", "range", "block"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = tokens(text.as_py())
                held += len(found) + 1
                # A long text comes in parts; a part's last suffixes wait for the words that follow.
                for at in range(0, len(found), CHUNK_WORDS):
                    waiting.setdefault(lang, []).extend(found[at : at + CHUNK_WORDS])
                    if len(waiting[lang]) >= CHUNK_WORDS:
                        held -= len(waiting[lang])
                        yield from flushed(lang, DEPTH - 1)
                        held += DEPTH - 1
                waiting.setdefault(lang, []).append(_END)
                if held > 2 * CHUNK_WORDS:
                    for other in list(waiting):
                        yield from flushed(other, 0)
                    held = 0
        for lang in list(waiting):
            yield from flushed(lang, 0)

    return route


def quicksorted(columns: list[np.ndarray], counts: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(row, depth, count) of every run of ``depth`` words that ``least`` suffixes begin with; a row shows the words.

    Three-way partitions by the word at the current depth: the equal part is the run of that word and goes on one word
    deeper, the lesser and greater parts go on at the same depth. A part with fewer suffixes than ``least`` holds no
    frequent run and is abandoned.
    """
    stack = [(np.arange(len(counts)), 0)]
    while stack:
        rows, depth = stack.pop()
        words = columns[depth][rows]
        pivot = sorted((words[0], words[len(words) // 2], words[-1]))[1]
        equal = words == pivot
        lesser = words < pivot
        for side in (lesser, ~(equal | lesser)):
            part = rows[side]
            if len(part) and counts[part].sum() >= least:
                stack.append((part, depth))
        # 0 is the end of a piece: nothing follows.
        if pivot:
            part = rows[equal]
            total = int(counts[part].sum())
            if total >= least:
                yield int(part[0]), depth + 1, total
                if depth + 1 < DEPTH:
                    stack.append((part, depth + 1))


def _counter(boundaries: dict[str, list[tuple[bytes, ...]]], least: int):
    kinds = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])

    def count(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        lang, number = (k.as_py() for k in key)
        numbers = _Numbers()
        blocks: list[list[np.ndarray]] = [[] for _ in range(DEPTH + 1)]
        for value in group.column("block"):
            words, columns, counts = _unpacked(value.as_py())
            known = np.zeros(len(words) + 1, np.int32)
            known[1:] = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
            for held, column in zip(blocks, columns, strict=False):
                held.append(known[column])
            blocks[DEPTH].append(counts)
        *columns, counts = (np.concatenate(b) for b in blocks)
        words = list(numbers)
        bounds = boundaries.get(lang, [])
        # Runs that a boundary cuts are counted in several ranges, whatever their count in this one.
        cut = {b[:d] for b in bounds[max(number - 1, 0) : number + 1] for d in range(1, len(b) + 1)}
        rows = [(None, int(counts.sum()))]
        for phrase in sorted(cut):
            if all(w in numbers for w in phrase):
                hit = np.ones(len(counts), bool)
                for column, word in zip(columns, phrase, strict=False):
                    hit &= column == numbers[word]
                rows.append((b" ".join(phrase), int(counts[hit].sum())))
        for row, depth, total in quicksorted(columns, counts, least):
            phrase = tuple(words[c[row]] for c in columns[:depth])
            if phrase not in cut:
                rows.append((b" ".join(phrase), total))
        rows = [r for r in rows if r[1]]
        return pa.table(
            [pa.array([lang] * len(rows)), pa.array([p and p.decode("utf-8") for p, _ in rows], pa.string()), pa.array([f for _, f in rows], pa.int64())],
            schema=kinds,
        )

    return count


def boundaries_of(texts: DataFrame, ranges: int) -> dict[str, list[tuple[bytes, ...]]]:
    """At most ``ranges`` boundaries between suffixes, in order, by lang.

    They come from SAMPLES suffixes for each, drawn by length of text; about MOST_RANGES times SAMPLES short strings
    reach the driver at most, however large the table. Boundaries decide where suffixes are counted, never what is counted.
    """
    ranges = min(ranges, MOST_RANGES)
    size = F.length("text")
    total = texts.agg(F.sum(size.cast("long"))).first()[0] or 0
    chosen = F.rand(7) * total < size * (ranges * SAMPLES)
    at = (F.rand(11) * size).cast("int") + 1
    rows = texts.filter(chosen).select("lang", F.substring("text", at, F.lit(SAMPLE_CHARS)).alias("piece")).collect()
    samples: dict[str, list[tuple[bytes, ...]]] = {}
    for row in rows:
        # The first token may have lost its start.
        words = tokens(row.piece)[1 : 1 + DEPTH]
        words = words[: words.index(_END)] if _END in words else words
        if words:
            samples.setdefault(row.lang, []).append(tuple(words))
    found = {}
    for lang, drawn_here in samples.items():
        drawn_here.sort()
        number = max(1, ranges * len(drawn_here) // len(rows))
        found[lang] = sorted({drawn_here[k * len(drawn_here) // number] for k in range(1, number)})
    return found


def phrase_counts(docs: DataFrame, *, text_col: str = "text", part_col: str = "lang", least: int = 100, ranges: int | None = None) -> DataFrame:
    """(lang, phrase, f): phrases of 1 to 5 words with at least ``least`` occurrences; NULL phrase: all words.

    Suffixes of at most five words are numbered, ordered and counted in chunks of CHUNK_WORDS words, and dealt to ranges
    of their order by leading words (``ranges``: twice the shuffle partitions of the session). A range is sorted in one
    task by :func:`quicksorted`. A suffix that makes up a large share of the corpus arrives as one row of a block per
    chunk; leading words shared by many different suffixes are cut into several ranges, and the runs
    across a boundary (at most five per boundary) are summed. NULL texts are empty, NULL parts are ``und``.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.coalesce(F.col(part_col).cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    boundaries = boundaries_of(texts, ranges or 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = texts.mapInArrow(_router(boundaries), "lang string, range int, block binary")
    counted = blocks.groupBy("lang", "range").applyInArrow(_counter(boundaries, least), "lang string, phrase string, f bigint")
    summed = counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return stored(summed.filter((F.col("f") >= least) | F.col("phrase").isNull()), "phrases")


def _words(phrase: Column) -> Column:
    return F.split(phrase, " ")


def collocations(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two and more words, from :func:`phrase_counts`.

    ``score`` is floor(1000 a n / (l r)) at the cut with the least floored score, the earliest of them. Products are decimals of 38
    digits: exact up to n of 10^17. A phrase goes if it lies inside one that is as frequent: then it lies inside
    such a phrase with just one more word, since a phrase is at least as frequent as any that holds it.
    """
    known = counts.filter("phrase is not null")
    total = counts.filter("phrase is null").select("lang", F.col("f").cast("decimal(18,0)").alias("n"))
    several = known.withColumn("words", _words(F.col("phrase"))).filter(F.size("words") > 1)

    def inner(start, size):
        return F.array_join(F.slice("words", start, size), " ")

    count = F.size("words")
    shorter = F.array(inner(F.lit(1), count - 1), inner(F.lit(2), count - 1))
    inside = several.filter(count > 2).select("lang", F.explode(shorter).alias("phrase"), "f").distinct()
    candidates = several.join(inside, ["lang", "phrase", "f"], "left_anti")
    cuts = candidates.select("lang", "phrase", "f", "words", F.explode(F.sequence(F.lit(1), count - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "f", "k", inner(F.lit(1), F.col("k")).alias("left"), inner(F.col("k") + 1, count - F.col("k")).alias("right")
    )
    left = known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    joined = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(total, "lang")
    # a n <= 10^36 and l r <= 10^36; the thousand comes last, with the whole part and the rest apart.
    top, bottom = F.col("f").cast("decimal(18,0)") * F.col("n"), F.col("l").cast("decimal(18,0)") * F.col("r").cast("decimal(18,0)")
    whole = F.expr("top div bottom")
    score = whole * 1000 + F.expr("((top % bottom) * 1000BD) div bottom")
    scored = joined.withColumns({"top": top, "bottom": bottom}).withColumn("score", score.cast("long"))
    best = scored.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", F.col("f").alias("a"), "l", "r", F.col("n").cast("long").alias("n"))).alias("cut")
    )
    return best.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")


def ranked(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` phrases of every lang with their rank: by score, then ``a``, then bytes of the phrase."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
