from pyspark.sql import functions as F

from deckscope import lexicons as L
from deckscope.functions import text as T
from deckscope.operators.sections import sectionize, sentence_sections
from tests.conftest import one


def _clean(spark, s):
    return one(spark.createDataFrame([(s,)], "t string").select(T.clean_text(F.col("t")).alias("c")))["c"]


def test_clean_text_edges(spark):
    assert _clean(spark, None) == ""
    assert _clean(spark, "") == ""
    assert _clean(spark, "     ") == ""
    assert _clean(spark, "short text") == ""          # 10 chars -> dropped
    assert _clean(spark, "short text!") == "short text!"  # 11 chars -> kept
    # whitespace collapsed first; symbols become spaces that are not collapsed again
    assert _clean(spark, "It's a café\n\nprice: $5 #1") == "It s a café price: $5  1"
    # non-breaking space counts as whitespace, accents survive
    assert _clean(spark, "Crème brûlée   costs 5%") == "Crème brûlée costs 5%"


def test_split_sentences_decimal_and_short(spark):
    t = "This is a long enough sentence. Short. It grew 1.5 million users over the year!"
    row = one(spark.createDataFrame([(t,)], "t string").select(T.split_sentences(F.col("t")).alias("s")))
    assert row["s"] == ["This is a long enough sentence", "5 million users over the year"]


def test_word_count(spark):
    row = one(spark.createDataFrame([("a  b c",)], "t string").select(T.word_count(F.col("t")).alias("n")))
    assert row["n"] == 3


def test_multi_label_sections_and_order(spark):
    t = ("Our team built a product for this market challenge today. "
         "Nothing to see in this sentence at all. Revenue growth was strong this quarter")
    df = spark.createDataFrame([(1, t)], "doc_id long, text string")
    s = one(sectionize(df))["sections"].asDict()
    first = "Our team built a product for this market challenge today. "
    assert s["team"] == first and s["solution"] == first and s["market"] == first and s["problem"] == first
    assert s["traction"] == "Revenue growth was strong this quarter. "
    assert s["ask"] == "" and s["business_model"] == ""


def test_substring_semantics_sam_in_same(spark):
    t = "We make the same thing every single day for everyone"
    s = one(sectionize(spark.createDataFrame([(1, t)], "doc_id long, text string")))["sections"]
    assert s["market"].startswith("We make the same thing")   # 'sam' is a substring of 'same'


def test_relational_sections_match_array_form(spark):
    rows = [(1, "Our team built a product for this market challenge today. Revenue growth was strong this quarter"),
            (2, "No keywords are present in this particular long sentence here")]
    df = sectionize(spark.createDataFrame(rows, "doc_id long, text string"), keep_sentences=True)
    rel = {(r["doc_id"], r["pos"], r["section"]) for r in sentence_sections(df).collect()}
    arr = set()
    for r in df.collect():
        for pos, sent in enumerate(r["sentences"]):
            for sec, terms in L.SECTION_TERMS.items():
                if any(k in sent.lower() for k in terms):
                    arr.add((r["doc_id"], pos, sec))
    assert rel == arr and len(rel) == 5


def test_deck_name_and_title_case(spark):
    df = spark.createDataFrame([("/x/y/My.Deck.pdf", "market_potential"), ("/a/B.PDF", "vision_moat")], "p string, d string")
    rows = df.select(T.deck_name_from_path(F.col("p")).alias("n"), T.title_case_dim(F.col("d")).alias("t")).collect()
    assert [r["n"] for r in rows] == ["My.Deck", "B.PDF"]
    assert [r["t"] for r in rows] == ["Market Potential", "Vision Moat"]


def test_missing_sections_and_select_existing(spark):
    from deckscope.operators.extract import missing_sections
    from deckscope.operators.portfolio import select_existing
    t = "Our team built a product for this market challenge today. Revenue growth was strong this quarter"
    df = sectionize(spark.createDataFrame([(1, "d1", t)], "doc_id long, deck_name string, text string"))
    missing = sorted(r["section"] for r in missing_sections(df).collect())
    assert missing == ["ask", "business_model"]
    assert select_existing(df, ["word_count", "nope", "deck_name"]).columns == ["word_count", "deck_name"]


def test_clean_text_is_worked_out_once(spark):
    """The kept text is no second cleaning beside its length test."""
    from pyspark.sql import functions as F

    from deckscope.functions import text as T
    rows = ["a b\n\tc" * 3, "0123456789", "01234567890", "  01234567\n89 ", "", None, "𝒳" * 10, "𝒳" * 11, "*" * 30, "0123456789\n*"]
    df = spark.createDataFrame([(x,) for x in rows], "x string").select("x", T.clean_text(F.col("x")).alias("c"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(T.DROP_CLASS) == 1
    assert [r.c for r in df.collect()] == ["a b ca b ca b c", "", "01234567890", "01234567 89", "", "", "", "𝒳" * 11, "", ""]


def test_sections_by_substring(spark):
    from pyspark.sql import functions as F

    from deckscope.functions import text as T
    terms = {"a": ["c++ (x", "é"], "b": [], "c": ["|", "z.z"]}
    df = spark.createDataFrame([(["uses C++ (X here", "zaz", "É"],)], "s array<string>")
    got = df.select(F.struct(*[c.alias(k) for k, c in T.section_texts(F.col("s"), terms).items()]).alias("r")).first().r
    assert (got.a, got.b, got.c) == ("uses C++ (X here. É. ", "uses C++ (X here. zaz. É. ", "")
