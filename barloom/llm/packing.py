"""Packing tokens into windows by minimum bin slack."""

from __future__ import annotations

import functools
import os
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.tables import stored

WINDOW = 2048
END_ID = 1
#: Words and word cores whose ids a worker remembers, and the longest word it remembers.
CACHE_WORDS, CACHE_BYTES = 1 << 19, 48
#: Latin letters with closing punctuation: one or two pre-tokens whose ids do not depend on each other.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)")
#: Parts that the ranking within one length is cut into.
RANK_PARTS = 4096
_BLOCK = 1 << 20
_SPACE = b" \t\n\x0b\x0c\r"


class WordTokenizer:
    """Token ids of whole texts for a tokenizer that lower-cases, drops white space and never joins words over it.

    A text's ids are those of its words one after the other, and those of a plain word are the ids
    of its lower-case core and of its closing punctuation. Each distinct core is tokenized
    once per worker and looked up from then on; all other words are tokenized as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}
        self.cores: dict[str, bytes] = {"": b""}

    def forget(self) -> None:
        """Give the memory of all words back."""
        self.words, self.cores = {}, {"": b""}
        pa.default_memory_pool().release_unused()

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return b"".join(self._parts((text or "").encode("utf-8")))

    def _parts(self, data: bytes) -> Iterator[bytes]:
        for block in blocks(data):
            words = block.split()
            if len(self.words) > CACHE_WORDS:
                self.words = {}
            if len(self.cores) > CACHE_WORDS:
                self.cores = {"": b""}
            new = [w for w in set(words) if w not in self.words]
            self._learn(new)
            yield b"".join(map(self.words.__getitem__, words))
            for word in new:
                if len(word) > CACHE_BYTES:
                    del self.words[word]

    def _learn(self, words: list[bytes]) -> None:
        plain, other = {}, []
        for word in words:
            match = PLAIN.fullmatch(word.decode())
            if match:
                plain[word] = match[1].lower(), match[2]
            else:
                other.append(word)
        cores = [c for c in {c for pair in plain.values() for c in pair} if c not in self.cores]
        if cores:
            # Every core is one pre-token, so the word numbers tell the cores apart.
            found = self.tokenizer.encode(" ".join(cores), add_special_tokens=False)
            ids: list[list[int]] = [[] for _ in cores]
            for number, value in zip(found.word_ids, found.ids, strict=True):
                ids[number].append(value)
            self.cores.update((c, _packed(i)) for c, i in zip(cores, ids, strict=True))
        self.words.update((w, self.cores[core] + self.cores[end]) for w, (core, end) in plain.items())
        encoded = self.tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False)
        self.words.update((w, _packed(e.ids)) for w, e in zip(other, encoded, strict=True))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@functools.cache
def tokenizer_at(path: str) -> WordTokenizer:
    """One per worker process, so that later tasks find the words of earlier ones."""
    return WordTokenizer(path)


def blocks(data: bytes) -> Iterator[bytes]:
    """Slices of about a megabyte, cut at white space only."""
    at = 0
    while at < len(data):
        end = at + _BLOCK
        while end < len(data) and data[end] not in _SPACE:
            end += 1
        yield data[at:end]
        at = end


def pieces(
    docs: DataFrame, tokenizer_path: str, *, window: int = WINDOW, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text", remember: bool = True,
) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): documents cut into windows, the last one shorter.

    ``ids`` are little-endian unsigned 32-bit integers; every document ends with ``end_id``. NULL
    and empty texts are that id alone; repeated rows are documents of their own; ids may be
    NULL; further columns are not read. ``tokenizer_path`` must exist on every machine. With
    ``remember`` a worker keeps the words of a task for the next one; an idle worker holds them for as long as it lives.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(frames):
        tokenizer = tokenizer_at(tokenizer_path)
        for batch in frames:
            rows, starts, totals, parts = [], [], [], []
            for row, text in enumerate(batch.column(1)):
                data = tokenizer.ids(text.as_py()) + end_id.to_bytes(4, "little")
                for at in range(0, len(data), 4 * window):
                    rows.append(row)
                    starts.append(at // 4)
                    totals.append(len(data) // 4)
                    parts.append(data[at : at + 4 * window])
            lengths = pa.array([len(p) // 4 for p in parts], pa.int64())
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.record_batch(
                [ids, pa.array(starts, pa.int64()), lengths, pa.array(totals, pa.int64()), pa.array(parts, pa.binary())],
                names=["doc_id", "start", "length", "doc_tokens", "ids"],
            )
        if not remember:
            tokenizer.forget()

    schema = f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, ids binary"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def padding(fill: int, window: int) -> int:
    """Padding of a sequence: none at a power of two."""
    return 0 if fill & (fill - 1) == 0 else window - fill


def least_slack(counts: dict[int, int], window: int) -> dict[int, int]:
    """The multiset of lengths that fills one window with least padding around the longest one.

    Subset sums of the remaining lengths are bits of an integer; a length that occurs k times enters
    as 1, 2, 4, ... copies. The states before each entry are kept, and walking them back from the
    chosen sum gives how often each length is used.
    """
    seed = max(counts)
    room, reach, full, steps = window - seed, 1, (1 << (window - seed + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left = min(counts[length] - (length == seed), room // length)
        copies = 1
        while left > 0 and not reach >> room & 1:
            used = min(copies, left)
            steps.append((length, used, reach))
            reach |= (reach << (used * length)) & full
            left, copies = left - used, copies * 2
        if reach >> room & 1:
            break
    sums = [room] if reach >> room & 1 else [t for t in range(room + 1) if reach >> t & 1]
    rest = min(sums, key=lambda t: (padding(seed + t, window), -t))
    chosen = {seed: 1}
    for length, used, before in reversed(steps):
        if not before >> rest & 1:
            chosen[length] = chosen.get(length, 0) + used
            rest -= used * length
    return chosen


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first, last, copies, sequence, offset): where the pieces of each length go.

    A pattern is used as often as its lengths last, so each uses up at least one length: the
    number of patterns follows the window, not the corpus. Pieces of a length with ranks
    ``first`` to ``last`` (exclusive) fill sequences from ``sequence`` on, ``copies`` in each, from ``offset``.
    """
    counts, taken, rows, sequence = dict(counts), {}, [], 0
    while counts:
        chosen = least_slack(counts, window)
        times = min(counts[length] // copies for length, copies in chosen.items())
        offset = 0
        for length, copies in sorted(chosen.items(), reverse=True):
            first = taken.get(length, 0)
            taken[length] = first + times * copies
            rows.append((length, first, taken[length], copies, sequence, offset))
            offset += length * copies
            counts[length] -= times * copies
            if not counts[length]:
                del counts[length]
        sequence += times
    return rows


def place(cut: DataFrame, *, window: int = WINDOW, parts: int = RANK_PARTS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to every piece.

    Only the counts of each length, at most ``window`` rows, reach the driver, which plans with them.
    A piece finds its place by its rank among the pieces of its length. Ranks are counted over
    ``parts`` hash parts first, so full windows, the most frequent length, are not one group.
    Pieces that agree in all ranking columns are alike and may swap places. Columns that do not rank, such as the
    tokens themselves, are not sorted with the others: they come in at the end by the number of the stored piece.
    """
    spark = cut.sparkSession
    ties = [c for c in ("doc_id", "start", "doc_tokens", "ids_crc32") if c in cut.columns]
    further = [c for c in cut.columns if c not in (*ties, "length")]
    number = ["_piece"] if further else []
    columns = cut.columns
    cut = stored(cut.withColumn("_piece", F.monotonically_increasing_id()) if further else cut, "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    schema = "length bigint, first bigint, last bigint, copies bigint, sequence bigint, base bigint"
    places = spark.createDataFrame(plan(counts, window), schema)
    keyed = cut.select("length", *ties, *number).withColumn("_part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        keyed.groupBy("length", "_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carry"))
    )
    inside = Window.partitionBy("length", "_part").orderBy(*ties)
    ranked = keyed.withColumn("_rank", F.row_number().over(inside) - 1).join(carried, ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_carry"))
    # The plan's size is bounded by the window, so it is broadcast.
    joined = ranked.join(
        F.broadcast(places.withColumnRenamed("length", "_length")),
        (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("last")),
    )
    index = F.col("_rank") - F.col("first")
    slot = index % F.col("copies")
    found = [
        (F.col("sequence") + F.floor(index / F.col("copies"))).alias("sequence_id"),
        (F.col("base") + slot * F.col("length")).alias("offset"),
    ]
    if not further:
        return joined.select(*columns, *found)
    return cut.join(joined.select("_piece", *found).hint("shuffle_hash"), "_piece").select(*columns, "sequence_id", "offset")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the pieces of each window joined, at most one window each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return joined.select("sequence_id", "n_tokens", ids.alias("ids"))
