"""History numbers kept while batches arrive.

The history is stored per period (a day, or another ``date_format`` pattern),
each period's rows with their position inside the period.  A batch touches
only the periods of its own rows: new ones are numbered by themselves, one
that is there already is read, numbered again with the new rows and
superseded.  The manifests hold each period's folder, row count and dates, so
a row's number over the whole history is the rows of earlier periods (a
prefix sum over one entry per period) plus its position, and a date's frame is its
place among all dates: the past is neither read nor sorted.  Commits are
those of ``sources.committed``: a retried batch adds nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from deckscope.operators.ranking import global_positions
from deckscope.sources.committed import Manifests

OWN = ("period", "position", "version")


class NumberedHistory:
    """``order``: columns that put rows of the whole history in order; the first is the time.

    Rows without a time are refused (they have no place in the sequence).
    """

    def __init__(self, spark: SparkSession, path: str, order=("timestamp", "deck_name"), pattern: str = "yyyy-MM-dd"):
        self.spark, self.path, self.order, self.pattern = spark, path.rstrip("/"), list(order), pattern
        self.manifests = Manifests(spark, path)

    def periods(self) -> dict[str, dict]:
        """period -> ``folder, rows, dates, schema`` of its latest version, in time order (one entry a period)."""
        found: dict[str, dict] = {}
        for m in self.manifests.all():
            found.update({p: {**x, "schema": m["schema"]} for p, x in m["periods"].items()})
        return dict(sorted(found.items()))

    def _read(self, periods: dict[str, dict]) -> DataFrame:
        import json

        schema = StructType.fromJson(json.loads(next(reversed(periods.values()))["schema"]))
        r = self.spark.read.option("basePath", f"{self.path}/data").schema(schema)
        return r.parquet(*[f"{self.path}/{x['folder']}/period={p}" for p, x in periods.items()])

    def append(self, results: DataFrame, batch_id) -> bool:
        """Add a batch; False if it is there already."""
        if self.manifests.has(batch_id):
            return False
        time = F.col(self.order[0])
        batch = results.withColumn("period", F.coalesce(F.date_format(time, self.pattern), F.raise_error(F.lit("a history row needs a time"))))
        have = self.periods()
        touched = [r[0] for r in batch.select("period").distinct().collect()]      # one value a period of the batch
        old = {p: x for p, x in have.items() if p in set(touched)}
        rows = batch
        if old:
            rows = batch.unionByName(self._read(old).drop("position", "version"), allowMissingColumns=True)
        rows = global_positions(rows, [F.col(c) for c in self.order], ["period"], "position")
        version = f"data/version={uuid.uuid4().hex}"
        rows.write.partitionBy("period").parquet(f"{self.path}/{version}")
        told = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{version}").groupBy("period").agg(
            F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(F.date_format(time, "yyyy-MM-dd"))).alias("dates")).collect()
        self.manifests.commit(batch_id, {"schema": rows.schema.json(),
                                         "periods": {r.period: {"folder": version, "rows": r.n, "dates": r.dates} for r in told}})
        return True

    def _between(self, first: str | None, last: str | None) -> dict[str, dict]:
        return {p: x for p, x in self.periods().items() if (first is None or p >= first) and (last is None or p <= last)}

    def numbered(self, out_col: str = "analysis_number", first: str | None = None, last: str | None = None) -> DataFrame | None:
        """Rows (of periods ``first`` to ``last`` only, if given) with their number in the whole history; None if there are none."""
        asked = self._between(first, last)
        if not asked:
            return None
        before, seen = [], 0
        for p, x in self.periods().items():
            before.append((p, seen))
            seen += x["rows"]
        table = self.spark.createDataFrame([b for b in before if b[0] in asked], "period string, _before long")
        rows = self._read(asked).join(F.broadcast(table), "period")               # one row a period
        return rows.withColumn(out_col, F.col("_before") + F.col("position")).drop("_before", *OWN)

    def timeline(self, first: str | None = None, last: str | None = None) -> DataFrame | None:
        """Each (date, deck)'s latest point with the date's frame number, of the periods asked for only."""
        asked = self._between(first, last)
        if not asked:
            return None
        dates = sorted({d for x in self.periods().values() for d in x["dates"]})
        table = self.spark.createDataFrame([(d, i) for i, d in enumerate(dates, 1)], "analysis_date string, frame int")
        rows = self._read(asked).withColumn("analysis_date", F.date_format(self.order[0], "yyyy-MM-dd"))
        point = F.struct("market_potential", "traction_strength", "composite_score", "category")
        latest = rows.groupBy("analysis_date", "deck_name").agg(F.max_by(point, F.struct(F.col("period"), F.col("position"))).alias("p"))
        return latest.join(F.broadcast(table), "analysis_date").select(
            "frame", "analysis_date", "deck_name", F.col("p.market_potential").alias("x"), F.col("p.traction_strength").alias("y"),
            F.col("p.composite_score").alias("size"), F.col("p.category").alias("category"))
