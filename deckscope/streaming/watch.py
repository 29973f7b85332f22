"""Folder watching with Structured Streaming.

New files in a folder are read by the file source (its log in the
checkpoint is the durable "seen" set, so a restart never re-processes a
file), scored with the same narrow plan as batch, and written per micro
batch in ``foreachBatch``.  Writes are keyed by batch id and overwrite only
that batch's partition, so a retried batch replaces its own output instead
of duplicating it.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from deckscope.plans.document_plan import analyze, route_errors, with_extraction
from deckscope.sources.committed import CommittedTable, ResultFiles
from deckscope.sources.documents import BINARY_SCHEMA
from deckscope.streaming.seen import SeenKeys
from deckscope.functions.text import deck_name_from_path

PDF_GLOB = "*.[pP][dD][fF]"


def watch_files(spark: SparkSession, directory: str, glob: str = PDF_GLOB,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """P1 (binary): stream of new file facts (path, length, time, name) in
    one folder, non-recursive; contents are not selected."""
    r = (spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("pathGlobFilter", glob)
         .option("recursiveFileLookup", "false"))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    s = r.load(directory)
    return s.select("path", "length", "modificationTime", deck_name_from_path(F.col("path")).alias("deck_name"))


def watch_table(spark: SparkSession, directory: str, schema, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """P1 (table): stream of rows of new files of a text table."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(directory)


def score_stream(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """The batch per-document plan applied to a stream (stateless)."""
    return analyze(stream, text_col)


def dedupe_documents(stream: DataFrame, key: str = "doc_id", event_time: str | None = None,
                     delay: str = "1 day") -> DataFrame:
    """P2 beyond paths: drop repeated documents by a content key.

    The file source already processes every path once (its log lives in the
    checkpoint).  For repeated *content* under new paths, de-duplicate by key
    within an event-time watermark, so the state stays bounded by the delay
    instead of growing with the whole corpus.  Without an event-time column
    there is no such bound: use :func:`drop_written` per micro batch."""
    if event_time is None:
        raise ValueError("de-duplication in the stream needs an event-time column; use drop_written in foreachBatch")
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def drop_written(batch: DataFrame, results_path: str, batch_id: int, key: str = "doc_id") -> DataFrame:
    """P2, complete: one row per key of the batch, without keys that an earlier
    batch has written (anti-join; a retried batch does not see itself).
    Rows without a key all stay."""
    spark = batch.sparkSession
    one = batch.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(batch.where(F.col(key).isNull()))
    try:
        seen = spark.read.parquet(results_path)
    except AnalysisException:  # nothing written so far
        return one
    return one.join(seen.where(F.col("batch_id") < batch_id).select(key).distinct(), key, "left_anti")


def start_scoring(spark: SparkSession, input_dir: str, output_dir: str, checkpoint_dir: str, schema,
                  fmt: str = "parquet", text_col: str = "text", available_now: bool = True,
                  on_result: Callable[[DataFrame, int], None] | None = None,
                  max_files_per_trigger: int | None = None, per_document_csv: bool = False,
                  unique_key: str | None = None, committed: bool = False, seen_days: int = 30) -> StreamingQuery:
    """Watch ``input_dir``; per micro batch write scored rows to
    ``output_dir/results`` and too-short documents to ``output_dir/errors``
    (P5), both partitioned by batch id, then call ``on_result`` (P6).

    ``per_document_csv`` also writes one CSV folder per document under
    ``output_dir/per_document/batch_id=<id>/deck_name=<name>/`` (P4 / A5),
    replaced as a whole when the batch is retried.

    ``unique_key``: documents whose key an earlier batch has written are left
    out.  A batch's scored rows are kept while it is written, so that its
    results, files and callback share one run of the plan.

    ``committed``: results, errors, per-document files (in hash buckets) and
    seen keys are committed batches under ``output_dir`` (``sources.committed``,
    ``streaming.seen``): a batch that died shows nothing, a retried one adds
    nothing, and ``unique_key`` looks at the keys of the last ``seen_days``
    days in the batch's buckets instead of all results."""
    stream = watch_table(spark, input_dir, schema, fmt, max_files_per_trigger)

    def commit_batch(batch: DataFrame, batch_id: int) -> None:
        seen, today = SeenKeys(spark, f"{output_dir}/seen", unique_key or "doc_id", seen_days), date.today()
        if unique_key is not None:
            batch = seen.new_rows(batch, batch_id, today)
        ok, errors = route_errors(with_extraction(batch, text_col))
        scored = analyze(ok.drop("extracted", "extracted_len"), text_col)
        res = scored.drop("text", "full_text", "sections", "extracted", "extracted_len").withColumn("batch_id", F.lit(batch_id))
        results = CommittedTable(spark, f"{output_dir}/results", ["batch_id"])
        CommittedTable(spark, f"{output_dir}/errors", ["batch_id"]).append(errors.withColumn("batch_id", F.lit(batch_id)), batch_id)
        results.append(res, batch_id)
        mine = results.read(lambda m: m["batch"] == str(batch_id))      # what is committed, also after a retry
        if per_document_csv:
            ResultFiles(spark, f"{output_dir}/per_document").append(mine, batch_id)
        if unique_key is not None:
            seen.remember(batch, batch_id, today)
        if on_result is not None:
            on_result(mine, batch_id)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        if committed:
            return commit_batch(batch, batch_id)
        if unique_key is not None:
            batch = drop_written(batch, f"{output_dir}/results", batch_id, unique_key)
        ext = with_extraction(batch, text_col)
        ok, errors = route_errors(ext)
        scored = analyze(ok.drop("extracted", "extracted_len"), text_col)
        cols = [c for c in scored.columns if c not in ("text", "full_text", "sections", "extracted",
                                                        "extracted_len")]
        res = scored.select(*cols).withColumn("batch_id", F.lit(batch_id)).persist(StorageLevel.MEMORY_AND_DISK)
        (res.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id")
         .parquet(f"{output_dir}/results"))
        (errors.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{output_dir}/errors"))
        if per_document_csv:
            flat = res.select(*[c for c in res.columns if c not in ("sections",)])
            (flat.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True)
             .partitionBy("batch_id", "deck_name").csv(f"{output_dir}/per_document"))
        if on_result is not None:
            on_result(res, batch_id)
        res.unpersist()

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
