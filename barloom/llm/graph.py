"""Connected components as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.tables import Stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an undirected edge list; the component is its least node.

    Large-star and small-star rounds (Kiveris et al., 2014): every node hands its neighbours to the
    least one it knows, until each component is a star around its least node, after a number of
    rounds logarithmic in the size of a component. The least neighbour is a combinable minimum, so a hub with
    millions of neighbours is reduced before the shuffle, and the join that spreads it is one
    that adaptive execution can split. Each round is written to the shared folder and the one
    before it deleted. NULL ends and loops carry no link; repeated edges count once.
    """
    current = Stored(
        _down(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))).distinct(), "edges"
    )
    seen = _checksum(current.df)
    while True:
        after = Stored(_small_star(_large_star(current.df)).distinct(), "edges")
        current.drop()
        current, last, seen = after, seen, _checksum(after.df)
        if seen == last:
            break
    stars = current.df
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _down(edges: DataFrame) -> DataFrame:
    """Every edge from its larger to its smaller end."""
    return edges.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.join(least, "u")
        .filter("v > u")
        .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    spread = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return spread.unionByName(least.select("u", F.col("m").alias("v")))


def _checksum(edges: DataFrame):
    return edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
