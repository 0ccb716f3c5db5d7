"""Removal of byte strings repeated across documents, by prefix doubling over sampled positions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.tables import Stored, stored

LENGTH = 50
#: Bytes named at a sampled position, and positions that compete for the sample in one window.
GRAM, SPAN = 24, 27
#: Names that one task compares at a time, on average.
BUCKET_NAMES = 1 << 20
#: Classes of ambiguous names whose strings are compared at once, and into how many slices of names they are dealt at most.
SLICE_CLASSES, SLICES = 1 << 18, 8
_CHUNK = 1 << 20
_LAST_ID = (1 << 63) - 1
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53]


def _pair(left: np.ndarray, right: np.ndarray, step: int) -> np.ndarray:
    """A name for each pair of names, as sorting the pairs and ranking them would give, up to 64-bit chance."""
    name = left * np.uint64(_ODD[step]) + right
    name ^= name >> np.uint64(31)
    name *= np.uint64(_ODD[-1 - step])
    return name


def names(data: np.ndarray) -> np.ndarray:
    """Name of the GRAM bytes at every position: prefix doubling of names at offsets 1, 2, 4, 8, then 16 with 8."""
    name, eight = data.astype(np.uint64) + np.uint64(1), None
    for step in range(4):
        width = 1 << step
        name = _pair(name[:-width], name[width:], step)
        eight = name if step == 2 else eight
    return _pair(name[: len(eight) - 16], eight[16:], 4)


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, name, first, last): sampled positions, and the run of LENGTH-byte strings that sample them.

    Every string samples the leftmost of its least names, which its own bytes decide, so equal strings
    sample the same place of themselves wherever they stand.
    """
    found: list[tuple] = []
    raw = np.frombuffer(data, np.uint8)
    for base in range(0, max(0, len(raw) - LENGTH + 1), _CHUNK - LENGTH):
        part = raw[base : base + _CHUNK]
        if len(part) < LENGTH:
            break
        name = names(part)
        low = np.uint64(_CHUNK - 1)
        least = (name & ~low) | np.arange(len(name), dtype=np.uint64)
        for width in (1, 2, 4, 8):
            least = np.minimum(least[:-width], least[width:])
        least = np.minimum(least[: len(least) - SPAN + 16], least[SPAN - 16 :])
        count = min(len(part) - LENGTH + 1, _CHUNK - LENGTH)
        at = (least[:count] & low).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], count) - 1
        found.append((at[first] + base, name[at[first]], first + base, last + base))
    if not found:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _packed(buckets: int):
    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Names of every text with the text's key, packed by bucket: few rows, eight bytes a value."""
        for batch in frames:
            keys, every = batch.column(0).to_numpy(), []
            for key, text in zip(keys, batch.column(1), strict=True):
                own = np.unique(anchors((text.as_py() or "").encode())[1])
                every.append((own, np.full(len(own), key, np.int64)))
            if not every:
                continue
            name, key = (np.concatenate(c) for c in zip(*every, strict=True))
            bucket = (name % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            name, key, bucket = name[order], key[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = [*cuts[1:], len(bucket)]
            rows = [(int(bucket[a]), name[a:b].tobytes(), key[a:b].tobytes()) for a, b in zip(cuts, ends, strict=True)]
            number, packed, packed_keys = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch(
                [pa.array(number, pa.int64()), pa.array(packed, pa.binary()), pa.array(packed_keys, pa.binary())],
                names=["bucket", "names", "keys"],
            )

    return pack


def _shared(frame: pd.DataFrame) -> pd.DataFrame:
    """(key, names): the names that texts share with other texts, by text."""
    name = np.frombuffer(b"".join(frame["names"]), np.uint64)
    key = np.frombuffer(b"".join(frame["keys"]), np.int64)
    order = np.lexsort((key, name))
    name, key = name[order], key[order]
    first = np.flatnonzero(np.diff(name, prepend=~name[:1]) != 0) if len(name) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(name)) - 1 if len(first) else first
    several = key[first] != key[last]
    kept = np.repeat(several, last - first + 1)
    name, key = name[kept], key[kept]
    order = np.argsort(key, kind="stable")
    name, key = name[order], key[order]
    cuts = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0) if len(key) else []
    ends = [*cuts[1:], len(key)] if len(cuts) else []
    return pd.DataFrame({"key": key[cuts] if len(cuts) else [], "names": [name[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]})


def _contexts(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every shared position with all bytes that a LENGTH-byte string around it can hold."""
    for batch in frames:
        columns, contexts = [], []
        for number, (text, shared) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            data = text.as_py().encode()
            wanted = np.frombuffer(b"".join(shared.as_py()), np.uint64)
            at, name, first, last = anchors(data)
            chosen = np.isin(name, wanted)
            at, name, first, last = at[chosen], name[chosen], first[chosen], last[chosen]
            starts = np.maximum(at - (LENGTH - GRAM), 0)
            contexts += [data[a:b] for a, b in zip(starts.tolist(), (at + LENGTH).tolist(), strict=True)]
            columns.append((np.full(len(at), number), name.view(np.int64), first - starts, last - starts, starts, at - starts))
        if not columns:
            continue
        rows, name, *places = (np.concatenate(c) for c in zip(*columns, strict=True))
        rows = pa.array(rows, pa.int64())
        lo, hi, base, off = (pa.array(c, k) for c, k in zip(places, (pa.int32(), pa.int32(), pa.int64(), pa.int32()), strict=True))
        yield pa.record_batch(
            [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(name), pa.array(contexts, pa.binary()), lo, hi, base, off],
            names=["ord", "key", "name", "context", "lo", "hi", "base", "off"],
        )


def _merged(row: np.ndarray, a: np.ndarray, b: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, a, b): ranges of each row that overlap or touch as one, sorted; none ends past ``longest``."""
    if not len(row):
        return row, a, b
    # On one line, rows lie further apart than any range reaches.
    step = np.int64(longest + 2)
    order = np.argsort(row * step + a, kind="stable")
    start, reach = (row * step + a)[order], np.maximum.accumulate((row * step + b)[order])
    first = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
    last = np.append(first[1:], len(start)) - 1
    row = row[order][first]
    return row, start[first] - row * step, reach[last] - row * step


def _removed(texts: pa.Array, whole: pa.Array, ranges: pa.Array) -> pa.Array:
    """Merged spans and what is left of each text; a batch at a time, since ranges are many."""
    texts, count = pc.fill_null(texts, "").cast(pa.large_binary()), len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + count + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    sizes = np.diff(ends)
    parts = ranges.flatten()
    row = np.repeat(np.arange(count), pc.fill_null(pc.list_value_length(ranges), 0).to_numpy(zero_copy_only=False))
    a, b = (pc.struct_field(parts, k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("a", "b"))
    gone = pc.fill_null(whole, False).to_numpy(zero_copy_only=False).astype(bool) & (sizes >= LENGTH)
    single, all_ = ~gone[row], np.flatnonzero(gone)
    row, a, b = (np.concatenate(c) for c in ((row[single], all_), (a[single], 0 * all_), (b[single], sizes[all_])))
    row, a, b = _merged(row, a, b, int(sizes.max(initial=0)))
    # +1 where a span begins, -1 where one ends: the running sum tells which bytes go.
    turns = np.zeros(len(data) + 1, np.int8)
    turns[ends[row] + a] += 1
    turns[ends[row] + b] -= 1
    kept = data[np.cumsum(turns[:-1], dtype=np.int8) == 0]
    removed = np.bincount(row, b - a, count).astype(np.int64)
    spans = pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    cuts = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=count))))
    left = np.concatenate(([0], np.cumsum(sizes - removed)))
    bytes_left = pa.Array.from_buffers(pa.large_binary(), count, [None, pa.py_buffer(left), pa.py_buffer(kept)]).cast(pa.binary())
    columns = [pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans), bytes_left]
    return pa.StructArray.from_arrays(columns, fields=list(_RESULT))


_RESULT = pa.struct(
    [("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("kept", pa.binary())]
)
_RANGES = T.ArrayType(T.StructType().add("a", T.LongType()).add("b", T.LongType()))
_removed = F.arrow_udf(T.StructType().add("n_bytes", T.LongType()).add("spans", _RANGES).add("kept", T.BinaryType()))(_removed)


def _half_shared(contexts: DataFrame, label: list[str]) -> DataFrame:
    """Classes that share a doubling step of half the reach with a class of another id: ``left`` or ``right`` of the name.

    A LENGTH-byte string holds at least half of the other bytes on one side of the name, so
    classes that share neither half share no string.
    """
    half = (LENGTH - GRAM) // 2
    left = F.when(F.col("off") >= half, F.xxhash64(F.substring("context", F.col("off") - half + 1, F.lit(half))))
    right = F.when(
        F.octet_length("context") >= F.col("off") + GRAM + half,
        F.xxhash64(F.substring("context", F.col("off") + GRAM + 1, F.lit(half))),
    )
    sides = contexts.withColumns({"_left": left, "_right": right})

    def shared(side: str) -> DataFrame:
        found = sides.groupBy("name", f"_{side}").agg(F.min("least").alias("a"), F.max("least").alias("b"))
        return found.filter("a < b").select("name", f"_{side}", F.lit(True).alias(side)).hint("shuffle_hash")

    marked = sides.join(shared("left"), ["name", "_left"], "left").join(shared("right"), ["name", "_right"], "left")
    marked = marked.na.fill(False, ["left", "right"]).filter("left or right")
    return marked.select(*label, "least", "context", "lo", "hi", "off", "left", "right")


def _resolved(contexts: DataFrame, label: list[str]) -> DataFrame:
    """(class, firsts): strings of a class that also start in another id's class, and the least such id, itself included."""
    eligible = _half_shared(contexts, label)
    strings = eligible.select(*label, "least", F.explode(F.sequence("lo", "hi")).alias("at"), "context", "off", "left", "right")
    half = (LENGTH - GRAM) // 2
    before_gram = F.col("off") - F.col("at")
    strings = strings.filter((F.col("left") & (before_gram >= half)) | (F.col("right") & (before_gram <= half)))
    strings = strings.select(*label, "least", "at", F.xxhash64(F.substring("context", F.col("at") + 1, F.lit(LENGTH))).alias("sk"))
    before = strings.groupBy("name", "sk").agg(F.min("least").alias("first"), F.max("least").alias("last")).filter("first < last")
    return (
        strings.join(before.drop("last").hint("shuffle_hash"), ["name", "sk"])
        .groupBy(*label)
        .agg(F.collect_set(F.struct("at", "first")).alias("firsts"))
    )


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with ``n_bytes``, ``spans`` (byte ranges removed, end exclusive) and ``kept`` (the bytes left).

    A byte goes if a LENGTH-byte string over it also starts in a document of smaller id; strings are those of the
    input and never cross documents. NULL texts are empty; NULL ids come after all others and do
    not precede each other; rows of equal id do not precede each other; a text equal to that of a smaller
    id goes as a whole, if it holds such a string at all. Further columns are not read.

    Positions that can be part of a repeat are found first: prefix doubling names 24 bytes at every
    position, each 50-byte string samples the position of its least name, and only names that
    occur in two different texts go on; the others are unique. The next doubling step extends each
    such position by 26 bytes to both sides, which is past the threshold: positions that agree in all of it form one
    class with one least id, and only where a name has several classes are their 50-byte strings compared.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST_ID)).alias("ord"), text.alias("text")
    ).withColumns({"key": F.xxhash64("text"), "sha": F.sha2(F.col("text"), 256)})
    known = stored(rows.select("ord", "key", "sha", F.octet_length("text").alias("n")), "texts")
    heads = known.groupBy("sha", "key").agg(F.min("ord").alias("head"))
    total = known.agg(F.sum("n")).first()[0] or 0
    buckets = max(32, -(-2 * total // (SPAN + 1) // BUCKET_NAMES))

    packed = rows.select("key", "text").mapInArrow(_packed(buckets), "bucket bigint, names binary, keys binary")
    shared = packed.groupBy("bucket").applyInPandas(_shared, "key bigint, names binary")
    wanted = shared.groupBy("key").agg(F.collect_list("names").alias("shared"))
    wanted = Stored(wanted, "wanted")
    asked = heads.join(wanted.df, "key").select("sha", F.col("head").alias("ord"), "shared")
    chosen = rows.select("ord", "sha", "key", "text").join(asked, ["ord", "sha"]).select("ord", "key", "text", "shared")
    kinds = "ord bigint, key bigint, name bigint, context binary, lo int, hi int, base bigint, off int"
    places = chosen.mapInArrow(_contexts, kinds).withColumn("class", F.xxhash64("context", "lo", "hi", "off"))
    places = Stored(places, "places")
    wanted.drop()

    # The name and the hash of the context are 128 bits of it.
    label = ["name", "class"]
    classes = Stored(places.df.groupBy(*label).agg(F.min("ord").alias("least"), F.max("ord").alias("most")), "classes")
    several = classes.df.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name")
    several = Stored(classes.df.join(several, "name").select(*label, F.col("least").alias("ord")), "several")
    # One row of each class, that of the least id, brings the bytes.
    brought = places.df.select(*label, "ord", "context", "lo", "hi", "off").join(several.df, [*label, "ord"])
    brought = Stored(brought.withColumnRenamed("ord", "least"), "contexts")
    several.drop()
    # Strings are compared within their name only, so slices of names go one after another, and the shuffle files of one before the next.
    slices = min(SLICES, brought.df.count() // SLICE_CLASSES + 1)
    parts = [brought.df.filter(F.pmod(F.xxhash64("name"), F.lit(slices)) == part) for part in range(slices)]
    resolved = [Stored(_resolved(part, label), "resolved") for part in parts]
    brought.drop()
    judged = places.df.select(*label, "ord", "key", "lo", "hi", "base").join(
        classes.df.filter("least < most").drop("most"), label, "left"
    )
    judged = judged.join(reduce(DataFrame.unionByName, [r.df for r in resolved]), label, "left").filter("least is not null or firsts is not null")
    each = F.transform(
        F.filter("firsts", lambda f: f["first"] < F.col("ord")),
        lambda f: F.struct((F.col("base") + f["at"]).alias("a"), (F.col("base") + f["at"] + LENGTH).alias("b")),
    )
    whole = F.when(
        F.col("least") < F.col("ord"),
        F.array(F.struct((F.col("base") + F.col("lo")).alias("a"), (F.col("base") + F.col("hi") + LENGTH).alias("b"))),
    )
    ranges = judged.select("ord", "key", F.explode(F.coalesce(whole, each)).alias("r"))
    ranges = stored(ranges.groupBy("ord", "key").agg(F.collect_list("r").alias("ranges")), "ranges")
    for done in (places, classes, *resolved):
        done.drop()
    copies = known.join(heads, ["sha", "key"]).filter("ord > head").select("ord", "key").distinct().withColumn("copy", F.lit(True))
    marks = copies.join(ranges, ["ord", "key"], "full")
    found = rows.join(marks, ["ord", "key"], "left").withColumn(
        "r", _removed(F.col("text"), F.coalesce("copy", F.lit(False)), F.col("ranges"))
    )
    return found.select(F.col("id").alias(id_col), "r.n_bytes", "r.spans", "r.kept")
