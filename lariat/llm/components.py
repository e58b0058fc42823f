"""Connected components of a links table, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lariat.llm.common import discard, materialize, release


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One star step on (a, b): each node's neighbours are tied to the least of them and itself.

    The least neighbour is a sum-like aggregate with partial results, and it comes back by a join, which Spark can
    split where one node has very many neighbours.
    """
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = both.join(least, "a")
    if small:  # a > b here: the lower neighbours and the node itself go to the least
        return tied.select(F.col("b").alias("x"), "m").unionByName(tied.select(F.col("a").alias("x"), "m").distinct()).where("x != m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()
    return tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _state(edges: DataFrame) -> tuple:
    """The number of edges and a sum of their hashes, which tell whether a round has changed them."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links(a, b); a component is its smallest node.

    Alternating large and small star steps; every round is written to the shared folder, and the round before deleted. Null ends and loops are
    passed over. Raises if it hasn't settled after ``rounds`` rounds.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "edges")
    before = _state(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        after = materialize(_stars(_stars(edges, False), True), "stars")
        now = _state(after)
        discard(edges)
        release(edges.sparkSession)
        edges, same, before = after, now == before, now
        if same:
            break
    else:
        raise RuntimeError("components have not settled")
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    out._lariat_path = edges._lariat_path  # for discard
    return out
