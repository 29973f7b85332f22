"""Complete content de-duplication of a stream with bounded reads.

The keys that batches have let through are a committed table of their own,
narrow, in hash buckets and by day.  A batch reads the keys of the last
``days`` days in the buckets that its own keys fall in, and nothing else: what
a batch reads depends on that window, not on how long the stream has run.  A
key that returns after more than ``days`` days is new again (the stated time
to live).  A retried batch does not see its own keys.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckscope.sources.committed import CommittedTable, bucket_of


class SeenKeys:
    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", days: int = 30, buckets: int = 256):
        self.key, self.days, self.buckets = key, days, buckets
        self.table = CommittedTable(spark, path, ["bucket"])

    def new_rows(self, batch: DataFrame, batch_id, today: date, order=()) -> DataFrame:
        """One row per key not seen in the last ``days`` days: the least by ``order`` and then by all other columns.

        Rows without a key all stay.  Columns must be orderable."""
        rest = [c for c in batch.columns if c != self.key and c not in order]
        row = F.struct(*[F.col(c) for c in (*order, *rest)]) if (order or rest) else F.struct(F.lit(0).alias("_"))
        one = batch.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.min(row).alias("_row"))
        one = one.select(*[F.col(c) if c == self.key else F.col(f"_row.`{c}`").alias(c) for c in batch.columns])
        oldest = (today - timedelta(days=self.days)).isoformat()
        seen = self.table.read(lambda m: m["day"] > oldest, without=batch_id)
        if seen is not None:
            used = [r[0] for r in one.select(bucket_of(self.key, self.buckets)).distinct().collect()]   # at most ``buckets``
            seen = seen.filter(F.col("bucket").isin(used)).select(F.col(self.key).alias("_seen")).distinct()
            one = one.join(seen, one[self.key] == seen["_seen"], "left_anti")
        return one.unionByName(batch.filter(F.col(self.key).isNull()))

    def remember(self, rows: DataFrame, batch_id, today: date) -> bool:
        """Commit the keys of a batch's rows, after its results are committed."""
        keys = rows.select(self.key).filter(F.col(self.key).isNotNull()).distinct()
        return self.table.append(keys.withColumn("bucket", bucket_of(self.key, self.buckets)), batch_id, day=today.isoformat())
