"""Distinct counts of a corpus kept as mergeable sketches (D4 and I16 over many documents).

``sketches`` makes one HyperLogLog sketch a group (a day, a category, a
language), ``merged`` unites them into coarser groups without the rows they
came from, ``estimates`` reads them.  Stored as committed batches
(``append_sketches``), a new day costs its own rows only.  A sketch has at most
``2 ** lg_k`` bytes and some, whatever its group holds, so partial aggregation
makes the shuffle one sketch a group and map task, also for a group with a
third of all rows.

Defined cases: NULL values count for nothing; a group of NULL values only has
an empty sketch and the estimate 0; NULL groups are groups; an empty table
gives no rows; repeated rows change ``n_values`` alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckscope.sources.committed import CommittedTable

LG_K = 14


def error_bound(lg_k: int = LG_K) -> float:
    """Four standard errors of a united sketch, as a share of the count."""
    return 4 * 1.04 / 2 ** (lg_k / 2)


def sketches(df: DataFrame, by: list[str], value: str, lg_k: int = LG_K) -> DataFrame:
    """``by``, ``n_values`` (values that are not NULL) and ``sketch``; ``value`` is a string, integer or binary column."""
    return df.groupBy(*by).agg(F.count(value).alias("n_values"), F.hll_sketch_agg(value, lg_k).alias("sketch"))


def merged(found: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups, from sketches."""
    return found.groupBy(*by).agg(F.sum("n_values").alias("n_values"), F.hll_union_agg("sketch").alias("sketch"))


def estimates(found: DataFrame) -> DataFrame:
    """The groups with ``n_values`` and ``n_distinct``, an estimate."""
    return found.withColumn("n_distinct", F.hll_sketch_estimate("sketch")).drop("sketch")


def append_sketches(found: DataFrame, path: str, batch_id: str) -> None:
    """Adds a batch's sketches to the stored ones; a batch that is there already adds nothing."""
    CommittedTable(found.sparkSession, path).append(found, batch_id)


def within_bound(exact: str = "n_exact", estimate: str = "n_distinct", lg_k: int = LG_K):
    """Whether an estimate is as near the exact count as it should be."""
    return F.abs(F.col(estimate) - F.col(exact)) <= F.col(exact) * F.lit(error_bound(lg_k))
