"""Sinks (A4-A10).  Every writer is a plain DataFrame write; nothing is
collected to the driver."""

from __future__ import annotations

import logging

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckscope import lexicons as L
from deckscope.sources.committed import CommittedTable

log = logging.getLogger(__name__)


def write_ranked_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """A4: ranked table as CSV with a header (no index column).
    ``single_file`` coalesces to one part file (small reports only)."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)


def write_result_per_document(df: DataFrame, path: str) -> None:
    """A5: one CSV directory per document (``deck_name=<name>/``), with the
    analysis time stamp as a column."""
    out = df.withColumn("analysis_ts", F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss"))
    out.write.mode("append").option("header", True).partitionBy("deck_name").csv(path)


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON document per result row; timestamps as strings."""
    cols = [F.col(f.name).cast("string").alias(f.name) if f.dataType.typeName() in ("timestamp", "timestamp_ntz", "date")
            else F.col(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*cols)).alias("json"))


def export_json(df: DataFrame, path: str) -> None:
    to_json_rows(df).write.mode("overwrite").text(path)


def scores_long(df: DataFrame, id_col: str = "deck_name") -> DataFrame:
    """(Metric, Score), 8 rows per document, composite first."""
    args = [x for c, label in L.EXPORT_LABELS
            for x in (F.lit(label), F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0))]
    return df.select(id_col, F.stack(F.lit(len(L.EXPORT_LABELS)), *args).alias("Metric", "Score"))


def export_predictions(pred: DataFrame, path: str) -> None:
    """Deck, composite, probability, category as CSV."""
    cols = [c for c in ("deck_name", "composite_score", "success_probability", "category") if c in pred.columns]
    pred.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def append_history(results: DataFrame, path: str, batch_id: str | None = None) -> None:
    """Append results to the history table, partitioned by analysis date.

    With a ``batch_id`` the append is a committed batch (``sources.committed``;
    read it with ``CommittedTable(spark, path, ["analysis_date"]).read()``): a
    retry adds nothing and an append that died shows nothing."""
    out = results
    if "analysis_date" not in out.columns:
        ts = F.col("timestamp") if "timestamp" in out.columns else F.current_timestamp()
        out = out.withColumn("analysis_date", F.to_date(ts))
    if batch_id is not None:
        CommittedTable(results.sparkSession, path, ["analysis_date"]).append(out, batch_id)
        return
    out.write.mode("append").partitionBy("analysis_date").parquet(path)


def report_bundle(df: DataFrame, path: str, builders: dict) -> dict[str, str]:
    """A10: build every named dataset from one persisted input and write each
    as JSON under ``path/<name>``; a failing dataset is logged and skipped.

    ``builders`` maps name -> function(DataFrame) -> DataFrame.  Returns
    name -> 'ok' or the error text."""
    status: dict[str, str] = {}
    src = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for name, build in builders.items():
            try:
                out = build(src)
                if out is None:
                    status[name] = "skipped"
                    continue
                out.write.mode("overwrite").json(f"{path}/{name}")
                status[name] = "ok"
            except Exception as e:  # noqa: BLE001 - isolate one failing dataset
                log.warning("dataset %s failed: %s", name, e)
                status[name] = f"error: {type(e).__name__}"
    finally:
        src.unpersist()
    return status
