import os
import tempfile

from pyspark.sql import functions as F

from deckscope import lexicons as L
from deckscope.operators import charts as CH
from deckscope.operators import portfolio as P
from deckscope.operators.ranking import summary_table
from deckscope.sources import fixtures as FX
from deckscope.sources import sinks as SK
from deckscope.sources.documents import assemble_pages, scan_documents
from tests.conftest import SF_SMALL


def test_ranked_csv_round_trip(spark):
    d = tempfile.mkdtemp(prefix="deckscope-csv-")
    st = summary_table(FX.portfolio(spark, SF_SMALL))
    SK.write_ranked_csv(st, os.path.join(d, "ranked"), single_file=True)
    back = spark.read.option("header", True).csv(os.path.join(d, "ranked"))
    assert back.columns == st.columns and back.count() == st.count()


def test_scores_long_has_eight_rows_composite_first(spark):
    pf = FX.portfolio(spark, SF_SMALL).limit(2)
    rows = SK.scores_long(pf).collect()
    assert len(rows) == 16 and rows[0]["Metric"] == "Composite Score"
    assert [r["Metric"] for r in rows[:8]] == [label for _, label in L.EXPORT_LABELS]


def test_history_append_and_json(spark):
    d = tempfile.mkdtemp(prefix="deckscope-hist-")
    h = FX.history(spark, SF_SMALL).limit(50)
    SK.append_history(h, os.path.join(d, "history"))
    SK.append_history(h, os.path.join(d, "history"))
    assert spark.read.parquet(os.path.join(d, "history")).count() == 100
    js = SK.to_json_rows(h.select("deck_name", "timestamp")).first()["json"]
    assert '"timestamp":"' in js


def test_report_bundle_isolates_failures(spark):
    d = tempfile.mkdtemp(prefix="deckscope-bundle-")
    pf = FX.portfolio(spark, SF_SMALL)

    def broken(df):
        return df.select("no_such_column")

    status = SK.report_bundle(pf, d, {"radar": CH.radar_rows, "broken": broken, "risk": P.portfolio_risk})
    assert status["radar"] == "ok" and status["risk"] == "ok" and status["broken"].startswith("error")
    assert spark.read.json(os.path.join(d, "radar")).count() == 5 * 8


def test_scan_documents_and_empty_dir(spark):
    d = tempfile.mkdtemp(prefix="deckscope-scan-")
    for name in ("x.pdf", "y.PDF", "z.pdf"):
        open(os.path.join(d, name), "wb").write(b"data")
    got = sorted(r["deck_name"] for r in scan_documents(spark, d).collect())
    assert got == ["x", "z"]                     # default glob is lower-case '*.pdf', like the batch CLI
    assert scan_documents(spark, os.path.join(d, "missing")).count() == 0


def test_assemble_pages_order_and_skip_empty(spark):
    pages = spark.createDataFrame([(1, 1, "second"), (1, 0, " first"), (1, 2, ""), (2, 0, None)],
                                  "doc_id long, page_no int, text string")
    got = {r["doc_id"]: r["text"] for r in assemble_pages(pages).collect()}
    assert got == {1: "first\nsecond", 2: ""}
    skip = {r["doc_id"]: r["text"] for r in assemble_pages(pages, skip_empty=True).collect()}
    assert skip == {1: "first\nsecond"}


def test_per_document_csv_and_predictions_export(spark):
    d = tempfile.mkdtemp(prefix="deckscope-perdoc-")
    pf = FX.portfolio(spark, SF_SMALL).limit(3)
    SK.write_result_per_document(pf.select("deck_name", "composite_score", "category"), os.path.join(d, "docs"))
    dirs = sorted(x for x in os.listdir(os.path.join(d, "docs")) if x.startswith("deck_name="))
    assert len(dirs) == 3
    pred = pf.withColumn("success_probability", F.lit(0.5))
    SK.export_predictions(pred, os.path.join(d, "pred"))
    back = spark.read.option("header", True).csv(os.path.join(d, "pred"))
    assert back.columns == ["deck_name", "composite_score", "success_probability", "category"] and back.count() == 3


def test_diagnose_files_size_and_encryption(spark):
    from deckscope.operators.extract import diagnose_files, diagnosis_summary
    mb = 1024 * 1024
    files = spark.createDataFrame([("/d/a.pdf", 10 * mb, False), ("/d/big.pdf", 60 * mb, True),
                                   ("/d/locked.PDF", 1 * mb, True), ("/d/edge.pdf", 50 * mb, False)],
                                  "path string, length long, encrypted boolean")
    got = {r["filename"]: (r["status"], r["message"], r["can_process"]) for r in diagnose_files(files).collect()}
    assert got["a.pdf"] == ("ok", None, True)
    assert got["big.pdf"] == ("warning", "Large file (60.0MB) - may be slow", True)   # size checked before encryption
    assert got["locked.PDF"] == ("error", "PDF is password protected", False)
    assert got["edge.pdf"] == ("ok", None, True)                                       # 50 MB is not above the limit
    s = diagnosis_summary(diagnose_files(files)).collect()[0]
    assert (s["processable"], s["total"], s["error"], s["any_processable"]) == (3, 4, 1, True)


def test_portfolio_insights_and_report(spark):
    from deckscope.plans.portfolio_plan import portfolio_insights, write_report
    pf = FX.portfolio(spark, SF_SMALL)
    ins = portfolio_insights(pf)
    assert set(ins) == {"portfolio_summary", "risk_assessment", "investment_recommendations", "market_trends",
                        "due_diligence_flags", "benchmark_analysis"}
    assert ins["portfolio_summary"].collect()[0]["total_analyzed"] == pf.count()
    d = tempfile.mkdtemp(prefix="deckscope-report-")
    status = write_report(pf, d, ["ranked_table", "radar_chart", "hierarchy", "executive_summary"])
    assert status == {"ranked_table": "ok", "radar_chart": "ok", "hierarchy": "ok", "executive_summary": "ok"}
    assert spark.read.json(os.path.join(d, "ranked_table")).count() == pf.count()


def test_cli_batch(spark):
    from deckscope.plans.cli import run_batch
    d = tempfile.mkdtemp(prefix="deckscope-cli-")
    src = os.path.join(d, "docs")
    FX.documents(spark, SF_SMALL).write.parquet(src)
    out = run_batch(spark, src, os.path.join(d, "out"))
    m = out["metrics"]
    assert m["total"] == 200 and m["succeeded"] + m["failed"] == 200
    ranked = spark.read.option("header", True).csv(os.path.join(d, "out", "ranked"))
    assert ranked.count() == m["succeeded"] and ranked.columns[:3] == ["rank", "deck_name", "composite_score"]
    assert out["report"]["ranked_table"] == "ok"
    assert spark.read.parquet(os.path.join(d, "out", "history")).count() == m["succeeded"]
