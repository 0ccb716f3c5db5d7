"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.graph import connected_components
from barloom.llm.tables import Stored, stored

SEED = 42
#: Buckets of up to this many fingerprints compare their members directly.
DIRECT = 64
_CHUNK = 1 << 16
_LANES = np.arange(8, dtype=np.int32) * 256
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a text, in chunks; a text of fewer words is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[width - 1 :] if len(words) > width else ends[-1:]
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    for at in range(0, len(last), _CHUNK):
        to = last[at : at + _CHUNK].tolist()
        spans = zip(starts[at : at + len(to)].tolist(), to, strict=True)
        yield np.fromiter((digest(view[i:j], SEED) for i, j in spans), np.uint64, len(to))


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits; a bit is set if it is set in over half the shingle hashes. No words: 0."""
    lanes, total = np.zeros(2048, np.int64), 0
    for hashes in shingle_hashes(text, width):
        octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _LANES
        lanes += np.bincount(octets.ravel(), minlength=2048)
        total += len(hashes)
    bits = (lanes.reshape(8, 256) @ _BITS).ravel() * 2 > total
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, *, width: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, fp): the fingerprint of every whole text as a signed 64-bit integer."""
    kind = docs.schema[id_col].dataType.simpleString()

    def batches(frames):
        for batch in frames:
            prints = (fingerprint(t.as_py(), width) for t in batch.column(1))
            values = np.fromiter(prints, np.uint64, batch.num_rows).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(values)], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        batches, f"id {kind}, fp bigint"
    )


def covering_masks(free: int, radius: int) -> list[int]:
    """Masks over the bits of ``free`` such that any ``radius`` of them are all left out by some mask.

    Covering family of Pagh (2016): each bit gets a nonzero vector of radius + 1 coordinates, and
    the mask of a nonzero vector v keeps the bits whose vector has an odd product with v. Up to
    ``radius`` vectors span no more than ``radius`` dimensions, so some v is even to them all.
    """
    count = (1 << (radius + 1)) - 1
    places = [i for i in range(64) if free >> i & 1]
    vectors = {place: n % count + 1 for n, place in enumerate(places)}
    return [
        sum(1 << p for p, m in vectors.items() if (m & v).bit_count() % 2) for v in range(1, count + 1)
    ]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _tables(rows: DataFrame, radius: int, level: int) -> DataFrame:
    """Each row once for every mask of this level, over the bits that its mask so far leaves free."""
    return rows.select(
        "fp", "comp", F.explode(_refined(radius, level)).alias("mask")
    ).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def _refined(radius: int, level: int):
    """Full masks of a level, as a lookup by the mask of the level before; an unknown mask is an error."""
    masks = [0]
    for _ in range(level - 1):
        masks = sorted({finer for mask in masks for finer in _finer(mask, radius)})
    pairs = [x for mask in masks for x in (F.lit(_signed(mask)), F.array(*[F.lit(_signed(m)) for m in _finer(mask, radius)]))]
    unknown = F.raise_error(F.concat(F.lit(f"level {level}: no finer masks of "), F.col("mask").cast("string")))
    return F.coalesce(F.create_map(*pairs)[F.col("mask")], unknown)


def _finer(mask: int, radius: int) -> list[int]:
    """Covering masks over the bits a mask leaves free, each with the mask's own bits."""
    return sorted({mask | finer for finer in covering_masks(((1 << 64) - 1) & ~mask, radius)})


def links(prints: DataFrame, *, radius: int = 3) -> DataFrame:
    """Edges (a, b) that connect the same fingerprints as all pairs within ``radius`` bits do.

    ``prints`` holds distinct fingerprints ``fp``. Level 1 puts each into one bucket per covering
    mask. A bucket of up to DIRECT members compares them in place. A larger one is covered again
    over the bits its mask left free, and so is the next level; after three levels at most eight
    free bits remain, so a bucket has at most 256 members whatever the data. At each finer
    level, members within the radius of their new bucket's least member are linked and components
    are merged, and buckets that hold one component only are finished: groups of near copies
    collapse instead of being paired.
    """
    return reduce(DataFrame.unionByName, _linked(prints, radius)[0])


def _linked(prints: DataFrame, radius: int) -> tuple[list[DataFrame], DataFrame, list[DataFrame]]:
    """The tables of edges found; components (node, component) so far; the edges found since.

    A finer level merges components once, over those of the level before and the edges since.
    """
    rows = _tables(prints.select("fp", F.col("fp").alias("comp"), F.lit(0).cast("long").alias("mask")), radius, 1)
    found, known, fresh, level = [], None, [], 1
    while True:
        live = _live(rows)
        direct = live if level == 3 else live.filter(F.col("n") <= DIRECT)
        edges = stored(_direct(direct, radius), "links")
        found.append(edges)
        if not edges.isEmpty():
            fresh.append(edges)
        if level == 3:
            return found, known, fresh
        large = Stored(live.filter(F.col("n") > DIRECT).select("fp", "comp", "mask").distinct(), "large").df
        if large.isEmpty():
            return found, known, fresh
        level += 1
        finer = _tables(large, radius, level)
        least = finer.groupBy("mask", "key").agg(F.min("fp").alias("least"))
        star = (
            finer.join(least, ["mask", "key"])
            .filter((F.col("fp") != F.col("least")) & _near("fp", "least", radius))
            .select(F.col("fp").alias("a"), F.col("least").alias("b"))
            .distinct()
        )
        star = stored(star, "links")
        found.append(star)
        known, fresh = _merged(known, [*fresh, star]), []
        labels = known.withColumnRenamed("node", "fp")
        rows = large.drop("comp").join(labels, "fp", "left").select("fp", F.coalesce("component", "fp").alias("comp"), "mask")
        rows = _tables(rows, radius, level)


def _merged(known: DataFrame | None, fresh: list[DataFrame]) -> DataFrame:
    """Components (node, component) of known ones and further edges."""
    stars = [] if known is None else [known.select(F.col("node").alias("a"), F.col("component").alias("b"))]
    return connected_components(reduce(DataFrame.unionByName, [*stars, *fresh]))


def _live(rows: DataFrame) -> DataFrame:
    """Rows of buckets with more than one component, and the bucket's size."""
    sizes = (
        rows.groupBy("mask", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        .filter("lo <> hi")
        .drop("lo", "hi")
    )
    return rows.join(sizes, ["mask", "key"])


def _near(a: str, b: str, radius: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius


def _direct(rows: DataFrame, radius: int) -> DataFrame:
    member = F.struct("fp", "comp")
    groups = rows.groupBy("mask", "key").agg(F.collect_list(member).alias("members"))
    pairs = groups.select("members", F.explode("members").alias("x")).select(
        F.col("x.fp").alias("a"),
        F.explode(
            F.filter(
                "members",
                lambda y: (y["fp"] < F.col("x.fp"))
                & (y["comp"] != F.col("x.comp"))
                & (F.bit_count(y["fp"].bitwiseXOR(F.col("x.fp"))) <= radius),
            )
        ).alias("y"),
    )
    return pairs.select("a", F.col("y.fp").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, *, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, fp, component): documents linked by fingerprints at ``radius`` or fewer differing bits.

    The component is the least id that any chain of links reaches. Equal fingerprints are reduced
    to one before any comparison, so a group of copies of any size is one row. NULL and empty
    texts have fingerprint 0 and are linked like any other; a NULL id is never a component's
    least id unless the component has no other, and repeated ids keep one row each. Further
    columns are not read.
    """
    prints = stored(fingerprints(docs, width=width, id_col=id_col, text_col=text_col), "prints")
    nodes = prints.groupBy("fp").agg(F.min("id").alias("least_id"))
    found, known, fresh = _linked(nodes, radius)
    # Without any edge the first table, which is empty, stands for them.
    labels = known if known is not None and not fresh else _merged(known, fresh or found[:1])
    named = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least_id", F.coalesce("component", "fp").alias("root")
    )
    named = stored(named, "named")
    roots = named.groupBy("root").agg(F.min("least_id").alias("component"))
    classes = named.join(roots, "root").select("fp", "component")
    return prints.join(classes, "fp").select("id", "fp", "component")
