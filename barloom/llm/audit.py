"""How filters overlap: count-weighted decision diagrams of failure masks, reordered level by level."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import factorial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.tables import stored

#: A: too few words. B: too few distinct words. C: too many capitals. D: symbols. E: a copy of an earlier text.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
_CAPITALS, _SYMBOLS = bytes(range(65, 91)), frozenset(b"#$%&*|")
_LATER_BYTES = bytes(range(0x80, 0xC0))
_COPY = 1 << FILTERS.index("E")


def text_mask(data: bytes) -> int:
    """Which of the filters A to D a text fails, A in the lowest bit. Words end at space and \\t \\n \\x0B \\f \\r."""
    words = data.split()
    points = len(data.translate(None, _LATER_BYTES))
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    fails = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < LEAST_DISTINCT * len(words),
        100 * capitals > MOST_CAPITALS * points,
        not _SYMBOLS.isdisjoint(data),
    )
    return sum(1 << k for k, failed in enumerate(fails) if failed)


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks, digests = [], []
        for value in batch.column(2):
            data = value.as_py()
            masks.append(text_mask(data))
            digests.append(hashlib.sha256(data).digest())
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())],
            names=["doc_id", "part", "mask", "digest"],
        )


def failures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask, n): the filters that documents fail, ``n`` counting repeated rows.

    NULL texts are empty, NULL parts the empty string. Filter E fails where a smaller id holds the same text (by
    SHA-256), in any part; rows of one id do not precede each other, and NULL ids come after all others. Further
    columns are not read. Copies are told apart by (text, id), so a text that a third
    of all documents repeat is spread over all tasks.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )
    kind = docs.schema[id_col].dataType.simpleString()
    masked = rows.mapInArrow(_masked, f"doc_id {kind}, part string, mask int, digest binary")
    known = stored(masked.groupBy("digest", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n")), "masks")
    least = known.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least"))
    firsts = least.select(F.col("digest").alias("_d"), F.col("least.doc_id").alias("_id"), F.lit(True).alias("_first"))
    marked = known.join(firsts, (F.col("digest") == F.col("_d")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    mask = F.when(F.col("_first"), F.col("mask")).otherwise(F.col("mask").bitwiseOR(F.lit(_COPY)))
    return marked.select("doc_id", "part", mask.alias("mask"), "n")


def mask_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each failure mask, at most 2 to the number of filters rows a part.

    A document is good (toxic) if any of its label rows says so; documents without labels are neither.
    """
    told = labels.groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"),
    )
    joined = failed.join(told, "doc_id", "left")
    return joined.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        *[F.sum(F.coalesce(F.col("n") * F.col(c), F.lit(0))).alias(c) for c in ("good", "toxic")],
    )


class Diagram:
    """A decision diagram with one level per filter; equal parts are shared, and every node knows the weight below it.

    A node is a number; its low child holds what passes the level's filter, its high child what fails it.
    ``order[level]`` is the filter a level asks about.
    """

    def __init__(self, weights: dict[int, tuple[int, ...]], filters: int, width: int):
        self.order = list(range(filters))
        self.weight: list[tuple[int, ...]] = []
        self.children: list[tuple[int, int] | None] = []
        self._known: dict[tuple, int] = {}
        nothing = (0,) * width
        below = [self._interned(("leaf", weights.get(mask, nothing)), weights.get(mask, nothing), None) for mask in range(1 << filters)]
        # Bits of a mask count from the first level, so the last level joins masks that differ in the highest bit.
        while len(below) > 1:
            half = len(below) // 2
            below = [self._node(below[k], below[k + half]) for k in range(half)]
        self.root = below[0]

    def _interned(self, key, weight, children) -> int:
        if key not in self._known:
            self._known[key] = len(self.weight)
            self.weight.append(weight)
            self.children.append(children)
        return self._known[key]

    def _node(self, low: int, high: int) -> int:
        total = tuple(a + b for a, b in zip(self.weight[low], self.weight[high], strict=True))
        return self._interned((low, high), total, (low, high))

    def swap(self, level: int) -> None:
        """Exchange a level with the one below it; only nodes on and above the level are made anew."""
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]
        done: dict[tuple[int, int], int] = {}

        def rebuilt(node: int, depth: int) -> int:
            if (node, depth) not in done:
                low, high = self.children[node]
                if depth == level:
                    (a, b), (c, d) = self.children[low], self.children[high]
                    done[node, depth] = self._node(self._node(a, c), self._node(b, d))
                else:
                    done[node, depth] = self._node(rebuilt(low, depth + 1), rebuilt(high, depth + 1))
            return done[node, depth]

        self.root = rebuilt(self.root, 0)

    def steps(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(filter, weight kept, weight removed) along the path on which everything passes."""
        node = self.root
        for asked in self.order:
            low, high = self.children[node]
            yield asked, self.weight[low], self.weight[high]
            node = low


def plain_changes(size: int) -> list[int]:
    """Positions whose swap with the next one walks through all orders, each once."""
    if size < 2:
        return []
    inner, swaps = plain_changes(size - 1), []
    for turn in range(factorial(size - 1)):
        down = turn % 2 == 0
        swaps += range(size - 2, -1, -1) if down else range(size - 1)
        if turn < len(inner):
            # The walking element now stands at one end; the others are shifted if that is the front.
            swaps.append(inner[turn] + (1 if down else 0))
    return swaps


def orders(weights: dict[int, tuple[int, ...]], filters: str = FILTERS) -> list[dict]:
    """Every order of the filters, step by step, from the weights (documents, good, toxic) of the failure masks."""
    diagram = Diagram(weights, len(filters), 3)
    walked = [(list(diagram.order), list(diagram.steps()))]
    for level in plain_changes(len(filters)):
        diagram.swap(level)
        walked.append((list(diagram.order), list(diagram.steps())))
    # A filter removes all that fails it where it comes first, and only what nothing else removes where it comes last.
    fails, alone, summed = {}, {}, dict.fromkeys(range(len(filters)), 0)
    for _, path in walked:
        fails[path[0][0]], alone[path[-1][0]] = path[0][2][0], path[-1][2][0]
        for asked, _, removed in path:
            summed[asked] += removed[0]
    return [
        {
            "filter_order": "".join(filters[k] for k in order),
            "step": step,
            "kept": kept[0],
            "removed": removed[0],
            "redundant": fails[asked] - removed[0],
            "unique_fails": alone[asked],
            "good_lost": removed[1],
            "toxic_lost": removed[2],
            "shapley": summed[asked],
        }
        for order, path in walked
        for step, (asked, kept, removed) in enumerate(path, start=1)
    ]


_STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def _audited(frame: pd.DataFrame) -> pd.DataFrame:
    rows = frame[["mask", "n", "good", "toxic"]].itertuples(index=False)
    found = pd.DataFrame(orders({int(m): (int(n), int(g), int(t)) for m, n, g, t in rows}))
    found.insert(0, "part", frame["part"].iloc[0])
    return found


def audit(counts: DataFrame) -> DataFrame:
    """All orders and steps of every part, from :func:`mask_counts`; a part is one group of at most 32 rows.

    No parts, no rows: an empty table has an empty result.
    """
    return counts.groupBy("part").applyInPandas(_audited, _STEPS)
