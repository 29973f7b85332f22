"""The per-document plan (CLI batch path): text -> sections -> scores ->
category, summary, insight, language metrics -> result rows.

Everything here is narrow: one scan, one chain of projections, no shuffle.
Errors (too little text) leave through a complementary filter of the same
plan, so one bad document never stops the others.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from deckscope import lexicons as L
from deckscope.functions import text as T
from deckscope.operators.enrich import enrich
from deckscope.operators.language import language_metrics
from deckscope.operators.scoring import drop_internal, score_documents
from deckscope.operators.sections import sectionize

RESULT_COLUMNS = [
    "deck_name", "word_count", "extraction_method", "category", "summary", "investability_insight",
    "competitive_analysis", "processing_time", "timestamp", *L.DIMENSIONS, "composite_score",
]


def with_extraction(df: DataFrame, text_col: str = "text", method: str = "text") -> DataFrame:
    """Add ``extracted`` (stripped text), its length and ``extraction_method``.

    Table input has a single candidate; ``choose_extraction`` handles the
    three-candidate case."""
    out = df.withColumn("extracted", T.strip_ws(F.coalesce(F.col(text_col), F.lit(""))))
    out = out.withColumn("extracted_len", F.length("extracted"))
    if "extraction_method" not in out.columns:
        out = out.withColumn("extraction_method", F.lit(method))
    return out


def route_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ok rows, error rows).  Error rows carry the fixed message text."""
    short = F.col("extracted_len") < L.MIN_TEXT_LENGTH
    errors = df.filter(short).select(
        *[c for c in ("doc_id", "deck_name") if c in df.columns],
        F.format_string("Could not extract sufficient text (got %d chars, need %d+)",
                        F.col("extracted_len"), F.lit(L.MIN_TEXT_LENGTH)).alias("error"),
    )
    return df.filter(~short), errors


def analyze(df: DataFrame, text_col: str = "text", responses: DataFrame | None = None,
            with_language: bool = False, weights: dict | None = None, keep_text: bool | None = None) -> DataFrame:
    """Full per-document analysis of the rows that pass the length check.

    Keeps the input columns, adds ``full_text``, ``word_count``, ``sections``,
    the scores, ``category``, ``summary``, ``investability_insight``,
    ``competitive_analysis`` and (optionally) the language metrics.

    ``keep_text`` (default: True without responses, False with them) keeps
    the text columns; with a responses table they are dropped before the
    join so the shuffle carries only short per-document rows."""
    if keep_text is None:
        keep_text = responses is None
    ok, _ = route_errors(with_extraction(df, text_col))
    out = sectionize(ok.drop("extracted_len"), "extracted")
    out = score_documents(out, weights=weights, keep_internal=True)
    if with_language:
        out = language_metrics(out)
    out = enrich(out, responses, keep_text=keep_text)
    return drop_internal(out)


def results(df: DataFrame, text_col: str = "text", responses: DataFrame | None = None) -> DataFrame:
    """The result table, one row per processed document (CLI schema).

    ``processing_time`` is NULL (rows are not timed one by one in a
    distributed plan); ``timestamp`` is the query time."""
    a = analyze(df, text_col, responses)
    return a.select(
        "deck_name", "word_count", "extraction_method", "category", "summary", "investability_insight",
        "competitive_analysis", F.lit(None).cast("double").alias("processing_time"),
        F.current_timestamp().alias("timestamp"), *L.DIMENSIONS, "composite_score",
    )


def timed_run(docs: DataFrame, work: Callable[[DataFrame], object], text_col: str = "text") -> tuple[object, dict]:
    """I15 without a second pass: (what ``work`` gives, the run's metrics).

    ``work`` takes the documents and writes what it makes of them; the counts
    are observed in that job while the rows go by, so ``docs`` is read once.
    ``total_seconds`` is the driver's clock around ``work``,
    ``average_seconds`` that over all documents (None without any).  The first
    job that reads all of ``docs`` gives the counts; a stage that is computed
    again after a lost executor may be counted twice, so
    :func:`batch_run_metrics` stays for exact counts."""
    seen = Observation()
    length = F.length(T.strip_ws(F.coalesce(F.col(text_col), F.lit(""))))
    watched = docs.observe(seen, F.count_if(length >= L.MIN_TEXT_LENGTH).alias("succeeded"),
                           F.count_if(length < L.MIN_TEXT_LENGTH).alias("failed"), F.count(F.lit(1)).alias("total"))
    start = time.monotonic()
    out = work(watched)
    seconds = time.monotonic() - start
    counts = {k: int(v or 0) for k, v in seen.get.items()}
    return out, {**counts, "total_seconds": seconds, "average_seconds": seconds / counts["total"] if counts["total"] else None}


def batch_run_metrics(extracted: DataFrame) -> DataFrame:
    """Documents processed / failed / total in a run (one row, one
    pass).  ``extracted`` is the output of :func:`with_extraction`.
    For run time see :func:`timed_run`; the time of one document is not
    measured inside a distributed plan."""
    ok = F.col("extracted_len") >= L.MIN_TEXT_LENGTH
    return extracted.agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"),
                         F.count(F.lit(1)).alias("total"))


def collect_results(*frames: DataFrame) -> DataFrame:
    """L2: gather result rows of several batches into one table; columns
    missing from a batch are NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
