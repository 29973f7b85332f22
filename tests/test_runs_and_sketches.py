"""Run metrics observed in the writing job, joined diagnosis, mergeable distinct counts."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from deckscope.operators import distinct_sketch as DS
from deckscope.operators import extract as EX
from deckscope.operators.ranking import materialize
from deckscope.plans.document_plan import analyze, batch_run_metrics, timed_run, with_extraction
from deckscope.sources import fixtures as FX
from deckscope.sources.committed import CommittedTable
from tests.conftest import SF_SMALL, one


def test_timed_run_counts_in_the_writing_job(spark):
    docs = FX.documents(spark, SF_SMALL)
    out, m = timed_run(docs, lambda d: materialize(analyze(d).select("deck_name", "composite_score")))
    want = one(batch_run_metrics(with_extraction(docs))).asDict()
    assert {k: m[k] for k in want} == want and out.count() == m["succeeded"]
    assert m["total_seconds"] > 0 and m["average_seconds"] == pytest.approx(m["total_seconds"] / m["total"])


def test_timed_run_without_rows_and_with_nulls(spark):
    schema = "doc_id long, deck_name string, text string, total string"
    rows = spark.createDataFrame([(1, "a", None, "x"), (2, "b", "", None), (3, "c", "word " * 30, None)], schema)
    assert {k: v for k, v in timed_run(rows, materialize)[1].items() if "seconds" not in k} == {"succeeded": 1, "failed": 2, "total": 3}
    _, none = timed_run(rows.limit(0), materialize)
    assert none["total"] == 0 and none["average_seconds"] is None


def test_diagnose_first_rule_that_holds(spark):
    mb = 1024 * 1024
    files = spark.createDataFrame([
        (1, "/in/large.pdf", 51 * mb, True, "torn"), (2, "/in/torn.pdf", 5, True, "torn"), (3, "/in/locked.pdf", 5, True, None),
        (4, "/in/none.pdf", 5, None, None), (5, "/in/text.pdf", mb, False, None), (6, "/in/image.pdf", 50 * mb, False, None), (None, None, None, None, None)],
        "doc_id long, path string, length long, encrypted boolean, open_error string")
    pages = spark.createDataFrame([(1, 0, "x" * 60, 0), (2, 0, "x" * 60, 0), (3, 0, "x" * 60, 0), (5, 0, None, 2), (5, 1, " " + "y" * 300, 0),
                                   (5, 2, "z" * 99, 1), (6, 0, "short", 1), (7, 0, "", 0)], "doc_id long, page_no int, text string, n_images int")
    got = {r.doc_id: r for r in EX.diagnose(files, pages).collect()}
    assert {k: (r.status, r.message, r.can_process) for k, r in got.items()} == {
        1: ("warning", "Large file (51.0MB) - may be slow", True), 2: ("error", "Cannot open PDF: torn", False), 3: ("error", "PDF is password protected", False),
        4: ("warning", "No readable content detected", True), 5: ("ok", None, True), 6: ("ok", None, True),
        7: ("warning", "No readable content detected", True), None: ("warning", "No readable content detected", True)}
    assert (got[5].pages, got[5].has_text, got[5].has_images, got[5].text_sample) == (3, True, True, "y" * 200 + "...")
    assert (got[6].has_text, got[6].has_images, got[6].file_size_mb, got[7].filename, got[4].pages, got[1].pages) == (False, True, 50.0, None, 0, None)
    summary = one(EX.diagnosis_summary(EX.diagnose(files, pages)))
    assert (summary.processable, summary.total, summary.ok, summary.warning, summary.error) == (6, 8, 2, 4, 2)
    assert EX.diagnose(files.limit(0), pages.limit(0)).count() == 0
    assert EX.diagnose(files.select("doc_id", "path", "length"), pages).where("status = 'error'").count() == 0


def test_sketches_unite_without_rows(spark):
    ids = spark.range(300_000).select((F.col("id") % 6).alias("day"), F.concat(F.lit("v"), (F.col("id") % 90_000).cast("string")).alias("value"))
    by_day = DS.sketches(ids, ["day"], "value")
    week = one(DS.estimates(DS.merged(by_day.withColumn("week", F.lit(1)), ["week"])))
    assert week.n_values == 300_000 and abs(week.n_distinct - 90_000) <= 90_000 * DS.error_bound()
    for r in DS.estimates(by_day).collect():       # a day's ids are every sixth, so 15,000 values
        assert abs(r.n_distinct - 15_000) <= 15_000 * DS.error_bound()
    assert "Exchange" in by_day._jdf.queryExecution().executedPlan().toString()


def test_stored_sketches_in_batches_equal_one_run(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="deckscope-sketch-"), "sketches")
    ids = spark.range(9_000).select((F.col("id") % 3).alias("day"), (F.col("id") % 2_500).alias("value"))
    for day in range(3):
        found = DS.sketches(ids.where(F.col("day") == day), ["day"], "value")
        DS.append_sketches(found, path, f"day-{day}")
        DS.append_sketches(found, path, f"day-{day}")          # a retry
    stored = CommittedTable(spark, path).read()
    assert stored.count() == 3
    every = lambda s: one(DS.estimates(DS.merged(s.withColumn("of", F.lit("all")), ["of"])))
    assert every(stored) == every(DS.sketches(ids, ["day"], "value")) and abs(every(stored).n_distinct - 2_500) <= 2_500 * DS.error_bound()


def test_sketches_of_nulls_and_nothing(spark):
    rows = spark.createDataFrame([("a", None), ("a", None), (None, "x"), (None, "x"), ("b", ""), ("b", "y")], "n_values string, sketch string")
    got = {r.g: (r.n_values, r.n_distinct) for r in DS.estimates(DS.sketches(rows.select(F.col("n_values").alias("g"), "sketch"), ["g"], "sketch")).collect()}
    assert got["a"] == (0, 0) and got[None] == (2, 1) and got["b"][0] == 2
    assert DS.sketches(rows.limit(0), ["n_values"], "sketch").count() == 0
