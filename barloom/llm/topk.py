"""Exact top-k search by inner product: one KD-tree per shard, best-first traversal."""

from __future__ import annotations

import heapq
import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.tables import stored

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 16_384, 1_024, 256
LONG = (1 << 63) - 1
_FOUND = "query_id bigint, vec_id bigint, score bigint"


def _matrix(vectors, scale: float) -> np.ndarray:
    """floor(scale * x) of every component, shorter vectors filled up with zeros."""
    width = max((len(v) for v in vectors), default=0)
    rows = np.zeros((len(vectors), width))
    for row, vector in zip(rows, vectors, strict=True):
        row[: len(vector)] = np.floor(np.asarray(vector, np.float64) * scale)
    return rows


class Tree:
    """Median splits along the widest side; every node knows its tight box and its least id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order, low, high, least, kids, spans = np.argsort(ids, kind="stable"), [], [], [], [], []
        work = [(0, len(ids), -1, 0)]
        while work:
            first, last, parent, side = work.pop()
            node, own = len(spans), order[first:last]
            if parent >= 0:
                kids[parent][side] = node
            box = rows[own]
            low.append(box.min(0))
            high.append(box.max(0))
            least.append(ids[own].min())
            kids.append([-1, -1])
            spans.append((first, last))
            if last - first > LEAF_ROWS:
                middle, axis = (last - first) // 2, int(np.argmax(high[-1] - low[-1])) if rows.shape[1] else 0
                if rows.shape[1]:
                    order[first:last] = own[np.argpartition(box[:, axis], middle)]
                work += [(first, first + middle, node, 0), (first + middle, last, node, 1)]
        self.ids, self.rows = ids[order], rows[order]
        self.low, self.high, self.least = np.array(low), np.array(high), np.array(least)
        self.kids, self.spans = np.array(kids), np.array(spans)

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.__dict__)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        tree = cls.__new__(cls)
        tree.__dict__.update(np.load(io.BytesIO(data)))
        return tree

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, known: np.ndarray) -> list[tuple[int, int, int]]:
        """(query, id, score) of the k best rows of each query that reach the score ``known`` elsewhere.

        Nodes are visited by their bound, the largest product any point of their box can have. A
        search ends when the best bound left is below the k-th score so far, the shard's or the one handed in.
        Equal bounds are followed only into boxes that hold a smaller id.
        """
        width = max(self.rows.shape[1], queries.shape[1])
        rows, low, high, asked = (_widened(m, width) for m in (self.rows, self.low, self.high, queries))
        most = max(np.abs(rows).max(initial=0) * np.abs(asked).max(initial=0) * max(width, 1), 0)
        if not most < 2**53:  # beyond exact doubles: the same with Python integers
            rows, low, high, asked = (_integers(m) for m in (rows, low, high, asked))
        zero = asked * 0
        bounds = np.maximum(asked, zero) @ high.T + np.minimum(asked, zero) @ low.T
        found = []
        for number, query in enumerate(asked):
            best: list[tuple] = []  # a heap of (score, -id), the worst of the k best first
            floor, bound = known[number], bounds[number]
            heap = [(-bound[0], 0)]
            while heap:
                top, node = heapq.heappop(heap)
                top = -top
                if top < floor or len(best) == k and (top < best[0][0] or top == best[0][0] and self.least[node] > -best[0][1]):
                    if top < floor or top < best[0][0]:
                        break
                    continue
                if self.kids[node][0] >= 0:
                    for kid in self.kids[node]:
                        heapq.heappush(heap, (-bound[kid], int(kid)))
                    continue
                first, last = self.spans[node]
                scores, own = rows[first:last] @ query, self.ids[first:last]
                chosen = own != ids[number]
                if len(best) == k:
                    chosen &= scores >= best[0][0]
                scores, own = scores[chosen], own[chosen]
                for i in np.lexsort((own, -scores))[:k]:
                    entry = (scores[i], -int(own[i]))
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
            found += [(int(ids[number]), -i, max(-LONG - 1, min(LONG, int(s)))) for s, i in best]
        return found


def _widened(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _integers(m: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)


def top_k(
    vectors: DataFrame, queries: DataFrame, *, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query with all other rows.

    Both frames need an integer id and an array of numbers; ``floor(scale * x)`` of every component
    enters the products, which are exact (and held at the ends of the long range). Ties go to the smaller id. NULL
    ids, NULL vectors and vectors with NULL or non-finite components take no part. Repeated
    ids count once, with their least vector; missing last components count as 0. Further columns are not read.

    Shards hold about SHARD_ROWS rows by hash of the id, so equal vectors spread, and become one tree
    each. Blocks of queries meet one shard first; the k-th score found there goes along to all others.
    """
    spark = vectors.sparkSession
    rows, asked = (_usable(df, id_col, vector_col) for df in (vectors, queries))
    rows = stored(rows, "vectors")
    asked = stored(asked, "queries")
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))

    def planted(key, frame: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(frame["id"].to_numpy(np.int64), _matrix(frame["vector"], scale))
        return pd.DataFrame({"shard": [key[0]], "tree": [tree.save()]})

    trees = stored(sharded.groupBy("shard").applyInPandas(planted, "shard bigint, tree binary"), "trees")
    blocked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    own = F.pmod(F.col("block"), F.lit(shards))
    # Every block meets every shard: the stated queries against all rows, block by block.
    met = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))

    def searched(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        for data in left["tree"]:
            if len(right):
                tree = Tree.load(data)
                found += tree.search(
                    right["id"].to_numpy(np.int64), _matrix(right["vector"], scale), k, right["known"].to_numpy(float)
                )
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    def search(pairs: DataFrame, who: DataFrame) -> DataFrame:
        return pairs.groupBy("shard", "block").cogroup(who.groupBy("shard", "block")).applyInPandas(searched, _FOUND)

    lowest = F.lit(float("-inf"))
    first = stored(search(met.filter(F.col("shard") == own), blocked.withColumns({"shard": own, "known": lowest})), "first")
    kth = first.groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n"))
    seeded = blocked.join(kth, F.col("id") == F.col("query_id"), "left").select(
        # A double may round the bound up; a step below it stays a bound.
        "id", "vector", "block",
        F.when(F.col("n") >= k, F.col("kth").cast("double") - F.abs("kth") * 1e-15).otherwise(lowest).alias("known"),
    )
    others = seeded.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>"))).filter(
        F.col("shard") != own
    )
    found = first.unionByName(search(met.filter(F.col("shard") != own), others))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), vector.alias("vector")).filter(
        F.col(id_col).isNotNull() & vector.isNotNull() & finite
    )
    return rows.groupBy("id").agg(F.min("vector").alias("vector"))
