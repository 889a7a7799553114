"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of u is tied to the least of u and u's neighbours."""
    both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the least of those."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every end of ``edges`` (a, b: long) except the roots themselves: component is the
    smallest id reachable. Null ends and self-loops are ignored; repeated edges count once.

    Each round shuffles on node ids only, with partial minima before the shuffle, and is written to the
    shared folder; stars of any size are joined, never gathered into one row or task. Ends when a round
    changes nothing (number of edges and checksum)."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, was = scratch.table(e, "edges"), None
    while True:
        # the first rows of the round: what is written below is read for the check as well
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == was or not now[0]:
            return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
        new = scratch.table(_small_star(_large_star(e).distinct()).distinct(), "edges")
        scratch.drop(e)
        e, was = new, now
