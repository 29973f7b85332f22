"""Frames derived from the driver tables for tests, oracle checks and benches.

* ``decks``     : every ``documents`` row, whole text, followed by business
                  phrases picked by ``doc_id`` (so section routing and scoring
                  see real vocabulary); ``deck_name = 'deck_' || doc_id``.
* ``portfolio`` : one scored result row per ``customer`` (integer arithmetic
                  on the key, exact tenths), for the portfolio plans.
* ``history``   : ``orders`` joined to ``portfolio``: many analyses per deck
                  over time (timestamps from ``o_orderdate``).

All three are plain Spark transformations of the given tables, so their size
grows with the tables.  The same rules are restated in SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deckscope import lexicons as L
from deckscope.sources.tables import read_table

# Test phrases: (pid, text, modulus, remainder).  Phrase p is appended when
# doc_id % modulus == remainder, in pid order.
DECK_PHRASES: list[tuple[int, str, int, int]] = [
    (1, "The current problem is a slow, expensive and outdated process that costs 40% of every order. ", 2, 0),
    (2, "This challenge is specifically difficult for 3 million small shops! ", 5, 1),
    (3, "Our solution is a cloud software platform with an open api and automation. ", 3, 0),
    (4, "The addressable market is $12 billion and growing, the report projected a CAGR of 18%. ", 4, 1),
    (5, "Market opportunity: 5 million buyers in the retail sector. ", 7, 2),
    (6, "Traction so far: 12,000 users, 45% growth and $2 million revenue with low churn. ", 3, 1),
    (7, "Monthly metrics show 900 customers and 80 mrr? ", 6, 3),
    (8, "Our team was led by a former Google director with an MBA and years of experience. ", 4, 2),
    (9, "The founder studied at a university and built two companies. ", 9, 4),
    (10, "The business model is a subscription, pricing is $20 per month, gross margin is high. ", 5, 2),
    (11, "We raise funding to grow, the ask is $3 million for 10%. ", 8, 3),
    (12, "Our vision is to transform payment and credit with a proprietary patent and a network effect. ", 6, 1),
    (13, "The proven and validated method helps every patient and doctor in the hospital. ", 7, 5),
    (14, "Students take a course at school to support learning and education. ", 10, 6),
]

PORTFOLIO_CATEGORIES = ["Fintech", "HealthTech", "SaaS", "AI/ML", "E-commerce", "EdTech", "Gaming", "Other"]

# (column, multiplier of k*k, multiplier of k, constant, first modulus); every
# value is then taken modulo 101 and divided by 10.  Squares are formed on
# k mod m so the arithmetic never overflows, whatever the key range.
PORTFOLIO_RULES: list[tuple[str, int, int, int, int]] = [
    ("problem_clarity", 0, 37, 11, 101),
    ("market_potential", 0, 53, 29, 101),
    ("traction_strength", 1, 7, 0, 101),
    ("team_experience", 0, 71, 5, 103),
    ("business_model", 3, 0, 13, 107),
    ("vision_moat", 0, 19, 47, 109),
    ("overall_confidence", 5, 1, 0, 113),
]


def deck_phrases(doc_id: Column) -> Column:
    parts = [F.when(doc_id % m == r, F.lit(p)).otherwise(F.lit("")) for _, p, m, r in DECK_PHRASES]
    return F.concat(*parts)


def decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.concat(F.lit("deck_"), F.col("doc_id").cast("string")).alias("deck_name"),
        F.concat(F.coalesce("text", F.lit("")), F.lit(". "), deck_phrases(F.col("doc_id"))).alias("text"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.concat(F.lit("deck_"), F.col("doc_id").cast("string")).alias("deck_name"),
        "text",
    )


def _rule(k: Column, a: int, b: int, c: int, m: int) -> Column:
    km = k % m
    v = (km * km * a + km * b + c) % m % 101
    return v.cast("double") / F.lit(10.0)


def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    zero = (k % 97) == 0
    dims = {name: F.when(zero, F.lit(0.0)).otherwise(_rule(k, a, b, c, m)) for name, a, b, c, m in PORTFOLIO_RULES}
    cats = F.array(*[F.lit(c) for c in PORTFOLIO_CATEGORIES])
    out = cust.select(
        k.alias("deck_key"),
        F.col("c_name").alias("deck_name"),
        *[v.alias(n) for n, v in dims.items()],
        F.element_at(cats, (k % 8 + 1).cast("int")).alias("category"),
    )
    total = None
    for d in L.DIMENSIONS:
        t = F.col(d) * F.lit(L.SCORING_WEIGHTS[d])
        total = t if total is None else total + t
    override = (F.col("deck_key") % 89) == 3
    return out.withColumn("composite_score",
                          F.when(override, F.least(F.lit(10.0), total + F.lit(3.0))).otherwise(total))


def user_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's term table, derived from ``benchmark``: every two
    neighbouring words of an item (its section by item number) and its first
    three characters, with weights for the scoring form."""
    b = read_table(spark, sf_dir, "benchmark").select("item_id", F.split("text", " ").alias("w"), "text")
    n = F.size("w")
    pairs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))
    terms = F.concat(F.when(n >= 2, pairs).otherwise(F.array()), F.array(F.substring("text", 1, 3)))
    k = F.col("item_id")
    return b.select("item_id", F.explode(terms).alias("term")).select(
        F.concat(F.lit("s"), (k % 5).cast("string")).alias("section"), "term",
        F.concat(F.lit("d"), (k % 3).cast("string")).alias("dimension"), F.concat(F.lit("c"), (k % 7).cast("string")).alias("component"),
        ((k % 7 + 1) / 2).cast("double").alias("weight"), F.lit(8.0).alias("cap"), ((k % 7 + 1) / 10).cast("double").alias("coef"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    port = portfolio(spark, sf_dir)
    h = orders.join(port, orders.o_custkey == port.deck_key, "inner")
    return h.select(
        F.col("o_orderkey").alias("analysis_id"),
        *[c for c in port.columns],
        F.col("o_orderdate").cast("timestamp_ntz").alias("timestamp"),   # wall-clock time, no zone shift
        F.to_date("o_orderdate").alias("analysis_date"),
    )


# -- derived inputs for the parsing, diagnosis and normalisation operators -------------

RESPONSE_CATEGORIES = ['"Fintech"', "This looks like a HealthTech company", "unknown space",
                       "saas", "'Social Media' app", "BIOTECH", "e-commerce marketplace", ""]


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in answers of an external model, derived from ``documents``:
    summary = the text's lines with bullet marks on two of every three lines
    (one document in four gets no marks), category = one of a few answer
    shapes, insight and competitive = the whole text (empty for one in five)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.split("text", "\n")
    marked = F.array_join(F.transform(lines, lambda l, i: F.when(i % 3 == 0, F.concat(F.lit("• "), l))
                                      .when(i % 3 == 1, F.concat(F.lit("- "), l)).otherwise(l)), "\n")
    cats = F.array(*[F.lit(c) for c in RESPONSE_CATEGORIES])
    k = F.col("doc_id")
    rows = F.array(
        F.struct(F.lit("summary").alias("kind"), F.when(k % 4 == 0, F.col("text")).otherwise(marked).alias("response")),
        F.struct(F.lit("category").alias("kind"),
                 F.element_at(cats, (k % len(RESPONSE_CATEGORIES) + 1).cast("int")).alias("response")),
        F.struct(F.lit("insight").alias("kind"), F.col("text").alias("response")),
        F.struct(F.lit("competitive").alias("kind"),
                 F.when(k % 5 == 0, F.lit("")).otherwise(F.col("text")).alias("response")),
    )
    return docs.select("doc_id", F.inline(rows))


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages from ``conversations``: one conversation = one document, turns in
    order = pages (``turn`` is already 0, 1, 2, ...), image count (conv_id + turn) % 3."""
    conv = read_table(spark, sf_dir, "conversations")
    return conv.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_no"),
                       "text", ((F.col("conv_id") + F.col("turn")) % 3).cast("int").alias("n_images"))


def file_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a conversation, its size grown from its text (some beyond the
    limit), some encrypted or not to be opened, and for every fifth a second
    file without pages."""
    conv = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n"))
    k = F.col("conv_id")
    row = lambda i, n, locked, error: F.struct(i.alias("doc_id"), F.concat(F.lit("/in/deck_"), i.cast("string"), F.lit(".pdf")).alias("path"),
                                               n.alias("length"), locked.alias("encrypted"), error.alias("open_error"))
    own = row(k, F.col("n") * (k % 3) * 100_000, k % 11 == 0, F.when(k % 13 == 0, F.concat(F.lit("bad table "), k.cast("string"))))
    second = row(k + 1_000_000_000, F.col("n"), F.lit(None).cast("boolean"), F.lit(None).cast("string"))
    return conv.select(F.inline(F.when(k % 5 == 0, F.array(own, second)).otherwise(F.array(own))))


def hard_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``portfolio`` with NULL composites, dimensions and categories, names
    that several rows share and, for one category, no score at all."""
    k, p = F.col("deck_key"), portfolio(spark, sf_dir)
    no_score = (k % 7 == 0) | (F.col("category") == PORTFOLIO_CATEGORIES[-1])
    return p.withColumns({
        "composite_score": F.when(~no_score, F.col("composite_score")),
        "market_potential": F.when(k % 6 != 0, F.col("market_potential")),
        "category": F.when(k % 5 != 0, F.col("category")),
        "deck_name": F.concat(F.lit("Deck "), F.floor(k / 3).cast("string"))})


def extraction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three extractor outputs per document, derived from ``documents``:
    the first extractor returns the text for one document in three, the
    second for another third, OCR always; images for even ids."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.col("doc_id")
    return d.select("doc_id", F.when(k % 3 == 0, F.col("text")).otherwise(F.lit("")).alias("c1"),
                    F.when(k % 3 == 1, F.col("text")).alias("c2"), F.col("text").alias("c3"),
                    (k % 2 == 0).alias("has_images"))


def messy_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows with loosely typed fields (strings with symbols, NULLs),
    derived from ``customer`` for the tolerant casts."""
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.col("c_name").alias("deck_name"),
        F.format_string("$%s", F.col("c_acctbal").cast("string")).alias("composite_score"),
        F.col("c_name").alias("problem_clarity"),
        F.col("c_mktsegment").alias("market_potential"),
        F.col("c_acctbal").cast("string").alias("traction_strength"),
        F.concat_ws(".", F.col("c_nationkey").cast("string"), (k % 10).cast("string"), F.lit("5")).alias("team_experience"),
        F.concat(F.lit("-"), F.col("c_nationkey").cast("string"), F.lit("-")).alias("business_model"),
        F.lit(None).cast("string").alias("vision_moat"),
        F.col("c_acctbal").alias("overall_confidence"),
        F.format_string("%d words", F.col("c_nationkey")).alias("word_count"),
        F.when(k % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")).alias("category"),
    )
