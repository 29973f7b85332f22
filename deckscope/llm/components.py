"""Connected components of links by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` of every node of ``links`` (a, b); ``comp`` is the smallest node reachable.

    Each round hangs all neighbours on the smallest one; the table of a round is
    stored, and a round that changes nothing ends it.  The number of rounds
    grows with the logarithm of the longest path.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a")
        small = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(hung.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = stored(small, "edges")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges.groupBy("a").agg(F.min("b").alias("comp")).select(F.col("a").alias("node"), "comp").union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
