import pytest
import os
import shutil
import tempfile

from pyspark.sql import functions as F

from deckscope.plans.document_plan import analyze
from deckscope.sources import fixtures as FX
from deckscope.streaming.watch import start_scoring, watch_files
from tests.conftest import SF_SMALL

KEEP = ["doc_id", "deck_name", "word_count", "category", "composite_score", "investability_insight", "summary"]


def test_stream_equals_batch_and_restart_adds_nothing(spark):
    root = tempfile.mkdtemp(prefix="deckscope-stream-")
    inbox, out, ckpt, stage = (os.path.join(root, x) for x in ("in", "out", "ckpt", "stage"))
    os.makedirs(inbox)
    decks = FX.decks(spark, SF_SMALL)
    decks.repartition(3).write.parquet(stage)
    for i, f in enumerate(sorted(x for x in os.listdir(stage) if x.endswith(".parquet"))):
        shutil.move(os.path.join(stage, f), os.path.join(inbox, f"part-{i}.parquet"))   # atomic moves into the folder
    seen = []
    q = start_scoring(spark, inbox, out, ckpt, decks.schema, on_result=lambda df, bid: seen.append(bid))
    q.awaitTermination(300)
    streamed = spark.read.parquet(os.path.join(out, "results")).select(*KEEP)
    batch = analyze(decks).select(*KEEP)
    assert streamed.count() == batch.count() > 0
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
    assert seen
    n_before = streamed.count()
    q2 = start_scoring(spark, inbox, out, ckpt, decks.schema)
    q2.awaitTermination(300)
    assert spark.read.parquet(os.path.join(out, "results")).count() == n_before


def test_binary_watch_matches_pdf_any_case(spark):
    root = tempfile.mkdtemp(prefix="deckscope-bin-")
    for name in ("a.pdf", "b.PDF", "c.txt"):
        with open(os.path.join(root, name), "wb") as f:
            f.write(b"%PDF-1.4 test")
    s = watch_files(spark, root)
    q = s.writeStream.format("memory").queryName("bin_watch").trigger(availableNow=True).start()
    q.awaitTermination(120)
    names = sorted(r["deck_name"] for r in spark.sql("SELECT deck_name FROM bin_watch").collect())
    assert names == ["a", "b.PDF"]     # '.pdf' removed only in lower case


def test_stream_isolates_short_documents_as_errors(spark):
    root = tempfile.mkdtemp(prefix="deckscope-err-")
    inbox, out, ckpt = (os.path.join(root, x) for x in ("in", "out", "ckpt"))
    rows = [(1, "deck_1", "Our team built a product for this market challenge today and it works well."),
            (2, "deck_2", "too short"), (3, "deck_3", None)]
    df = spark.createDataFrame(rows, "doc_id long, deck_name string, text string")
    df.coalesce(1).write.parquet(inbox)
    q = start_scoring(spark, inbox, out, ckpt, df.schema)
    q.awaitTermination(300)
    ok = [r["doc_id"] for r in spark.read.parquet(os.path.join(out, "results")).collect()]
    err = sorted((r["doc_id"], r["error"]) for r in spark.read.parquet(os.path.join(out, "errors")).collect())
    assert ok == [1]
    assert err == [(2, "Could not extract sufficient text (got 9 chars, need 50+)"),
                   (3, "Could not extract sufficient text (got 0 chars, need 50+)")]


def test_stream_per_document_csv(spark):
    root = tempfile.mkdtemp(prefix="deckscope-perdoc-")
    inbox, out, ckpt = (os.path.join(root, x) for x in ("in", "out", "ckpt"))
    rows = [(i, f"deck_{i}", "Our team built a product for this market challenge today and it works well.") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, deck_name string, text string")
    df.coalesce(1).write.parquet(inbox)
    start_scoring(spark, inbox, out, ckpt, df.schema, per_document_csv=True).awaitTermination(300)
    batches = [d for d in os.listdir(os.path.join(out, "per_document")) if d.startswith("batch_id=")]
    decks = os.listdir(os.path.join(out, "per_document", batches[0]))
    assert sorted(d for d in decks if d.startswith("deck_name=")) == [f"deck_name=deck_{i}" for i in range(3)]


def test_score_stream_and_watermark_dedupe(spark):
    import datetime as dt

    from deckscope.streaming.watch import dedupe_documents, score_stream, watch_table
    root = tempfile.mkdtemp(prefix="deckscope-dedupe-")
    inbox = os.path.join(root, "in")
    t = "Our team built a product for this market challenge today and it works well."
    ts = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, "a", t, ts), (1, "a", t, ts), (2, "b", t, ts)],
                               "doc_id long, deck_name string, text string, event_time timestamp")
    df.coalesce(1).write.parquet(inbox)
    s = dedupe_documents(watch_table(spark, inbox, df.schema), "doc_id", "event_time", "1 hour")
    q = score_stream(s).select("doc_id", "composite_score").writeStream.format("memory").queryName("dedupe_out") \
        .trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert sorted(r["doc_id"] for r in spark.sql("SELECT doc_id FROM dedupe_out").collect()) == [1, 2]
    with pytest.raises(ValueError):
        dedupe_documents(df, "doc_id")
