from pyspark.sql import functions as F

from deckscope import lexicons as L
from deckscope.operators import enrich as E
from deckscope.operators.scoring import score_documents
from deckscope.operators.sections import sectionize


def _col(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "r string")
    return [r["x"] for r in df.select(fn(F.col("r")).alias("x")).collect()]


def test_parse_bullets(spark):
    five = "• one\n- two\n* three\n•four\n- five"
    got = _col(spark, [five, "intro\n- only one", "no bullets here", None, "- \n-   "], E.parse_bullets)
    assert got[0] == "• one\n• two\n• three\n• four"
    assert got[1] == "• only one"
    assert got[2] is None and got[3] is None and got[4] is None


def test_match_category(spark):
    got = _col(spark, ['"Fintech"', "this is a HEALTHTECH play", "'social media' app", "nothing", "fintech and saas"],
               E.match_category)
    assert got == ["Fintech", "HealthTech", "Social Media", None, "Fintech"]


def test_trim_insight(spark):
    long = "x" * 130 + ". rest"
    got = _col(spark, ["  Great deck. More text", long, "no dot at all"], E.trim_insight)
    assert got == ["Great deck", "x" * 117 + "...", "no dot at all"]


def test_fallback_insight_tiers(spark):
    df = spark.createDataFrame([(8.0,), (7.99,), (6.0,), (4.0,), (3.99,)], "s double")
    got = [r["x"] for r in df.select(E.fallback_insight(F.col("s"), F.lit("SaaS")).alias("x")).collect()]
    assert got == ["Strong SaaS opportunity with excellent fundamentals",
                   "Promising SaaS startup with room for improvement",
                   "Promising SaaS startup with room for improvement",
                   "Early-stage SaaS startup needs significant development",
                   "Underdeveloped SaaS pitch requires major improvements"]


def test_enrich_fallbacks_and_guards(spark):
    long = ("The problem is that shops lose money every single day. Our solution is a cloud platform for retail. "
            "The market for this is large and growing quickly now")
    rows = [(1, long), (2, "Short but valid text that is over fifty characters long ok")]
    df = score_documents(sectionize(spark.createDataFrame(rows, "doc_id long, text string")), keep_internal=True)
    out = {r["doc_id"]: r for r in E.enrich(df).collect()}
    s = out[1]["summary"].split("\n")
    assert s[0].startswith("• Problem: The problem is that shops lose money every single day")
    assert s[1].startswith("• Solution: ") and s[2].startswith("• Market: ")
    assert s[3] == "• Section 4: Content analysis pending"
    assert out[1]["category"] == "SaaS"          # cloud, platform
    assert out[1]["competitive_analysis"] == L.COMPETITIVE_MISSING
    assert out[2]["summary"] == L.SUMMARY_SHORT and out[2]["competitive_analysis"] == L.COMPETITIVE_SHORT


def test_enrich_uses_responses(spark):
    text = "Our payment platform helps banks. " * 5
    df = score_documents(sectionize(spark.createDataFrame([(1, text)], "doc_id long, text string")), keep_internal=True)
    resp = spark.createDataFrame([(1, "category", "  EdTech  "), (1, "insight", "Good team. Weak market."),
                                  (1, "summary", "- a\n- b"), (1, "competitive", "")],
                                 "doc_id long, kind string, response string")
    r = E.enrich(df, resp).collect()[0]
    assert r["category"] == "EdTech" and r["investability_insight"] == "Good team"
    assert r["summary"] == "• a\n• b" and r["competitive_analysis"] == L.COMPETITIVE_MISSING


def test_advice_rows(spark):
    dims = ", ".join(f"{d} double" for d in L.DIMENSIONS)
    df = spark.createDataFrame([("a", *[9.0] * 7), ("b", 4.0, *[9.0] * 5, 1.0)], f"deck_name string, {dims}")
    rows = sorted((r["deck_name"], r["pos"], r["area"], r["advice"]) for r in E.improvement_advice(df).collect())
    assert rows == [("a", 0, None, L.NO_WEAK_AREAS), ("b", 0, "Problem Clarity", L.ADVICE[0][1]),
                    ("b", 1, "Overall Confidence", L.ADVICE[6][1])]


def test_failed_model_calls_take_the_rules(spark):
    """A document with an error row takes no answer, however short it is; others keep theirs."""
    from deckscope.operators.enrich import enrich
    text = "We sell software to hospitals. Our market is large and growing. " * 3
    docs = spark.createDataFrame([(1, text), (2, text), (3, "Tiny.")], "doc_id long, full_text string")
    sections = "named_struct(" + ", ".join(f"'{k}', full_text" for k, _ in L.SUMMARY_SECTIONS) + ") as sections"
    docs = docs.selectExpr("*", sections, "cast(6.0 as double) as composite_score")
    answers = spark.createDataFrame([(1, "competitive", "Many rivals"), (1, "insight", "Good. More"), (2, "competitive", "Many rivals"), (2, "insight", "Good. More"),
                                     (2, "error", None), (3, "error", "timeout"), (9, "error", "timeout")], "doc_id long, kind string, response string")
    got = {r.doc_id: r for r in enrich(docs, answers).collect()}
    assert sorted(got) == [1, 2, 3] and "_resp_failed" not in got[1].asDict()
    assert (got[1].competitive_analysis, got[1].investability_insight) == ("Many rivals", "Good")
    assert got[2].competitive_analysis == got[3].competitive_analysis == L.ANALYSIS_FAILED
    assert got[2].investability_insight != "Good" and got[2].summary == got[1].summary and got[3].summary != L.SUMMARY_SHORT
