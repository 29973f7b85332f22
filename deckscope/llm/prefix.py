"""Running sums over a global order, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import col, free_name, shuffle_partitions, stored


def prefix_sums(df: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """``df`` with, for each of ``values``, a column: the sum of that value over all rows in front.

    Rows are dealt by range and sorted; each range adds up its own rows, and the
    ranges' totals, one row a shuffle partition, are added up and broadcast.
    Rows that are equal in ``order`` come in the order they are read, so no
    value of it is one large range.  An empty table stays empty.
    """
    names, taken = list(values), [*df.columns, *values]
    tie, part, place = (free_name(taken, x) for x in ("tie", "part", "place"))
    ahead = {n: free_name(taken, f"ahead_{i}") for i, n in enumerate(names)}
    order = [*order, col(tie)]
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).withColumns(values).repartitionByRange(shuffle_partitions(df.sparkSession), *order)
    dealt = stored(dealt.sortWithinPartitions(*order).withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id()}), "ranges")
    front = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(part).agg(*(F.sum(col(n)).alias(n) for n in names))
    totals = totals.select(part, *(F.coalesce(F.sum(col(n)).over(front.orderBy(part)), F.lit(0)).alias(ahead[n]) for n in names))
    inside = front.partitionBy(part).orderBy(place)
    sums = dealt.withColumns({n: F.coalesce(F.sum(col(n)).over(inside), F.lit(0)) for n in names})
    out = sums.join(F.broadcast(totals), part).withColumns({n: col(n) + col(ahead[n]) for n in names})
    return out.select(*(col(c) for c in (*df.columns, *names)))
