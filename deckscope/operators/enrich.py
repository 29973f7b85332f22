"""Category, summary, insight and competitive text per document.

No remote model is called.  Answers of any external batch-inference job can
be supplied as a ``responses`` table ``(doc_id, kind, response)`` with kinds
``summary``, ``category``, ``insight``, ``competitive``; every parser falls
back to the deterministic rule when the answer is missing or unusable.

Order of work for scale: all text-based columns (fallbacks, guards) are
computed first in the narrow per-document projection; only then is the
(optional) responses table joined, after heavy text columns are gone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckscope import lexicons as L
from deckscope.functions import lexicon as LX
from deckscope.functions import text as T

RESPONSE_KINDS = ["summary", "category", "insight", "competitive"]


# -- rule fallbacks -------------------------------------------------------------------

def classify_keywords(full_text: Column, category_terms: dict | None = None) -> Column:
    """E5: category with the most distinct keyword hits on the lower-cased
    text; first listed wins ties; no hit -> 'Other'.

    Self-contained expression (each score appears more than once); on a
    DataFrame prefer :func:`with_rule_category`, which computes every score
    once in its own column."""
    terms = category_terms or L.CATEGORY_TERMS
    lc = F.lower(F.coalesce(full_text, F.lit("")))
    return _pick_category({c: LX.distinct_hits(lc, ts) for c, ts in terms.items()})


def _pick_category(scores: dict) -> Column:
    best = F.greatest(*scores.values()) if len(scores) > 1 else list(scores.values())[0]
    out = F.when(best == 0, F.lit("Other"))
    for c, s in scores.items():
        out = out.when(s == best, F.lit(c))
    return out


def with_rule_category(df: DataFrame, out_col: str = "_rule_category", text_col: str = "full_text",
                       category_terms: dict | None = None) -> DataFrame:
    """E5 as columns: lower-case once, one column per category score, the
    best score, then the pick -- each substring test runs once per row.
    Texts shorter than 50 characters are 'Other'."""
    terms = category_terms or L.CATEGORY_TERMS
    names = [f"_cs_{i}" for i in range(len(terms))]
    if text_col == "full_text" and "_lc_full_text" in df.columns:
        out = df.withColumn("_cs_lc", F.coalesce(F.col("_lc_full_text"), F.lit("")))
    else:
        out = df.withColumn("_cs_lc", F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    out = out.withColumns({n: LX.distinct_hits("_cs_lc", ts) for n, ts in zip(names, terms.values())})
    out = out.withColumn("_cs_best", F.greatest(*[F.col(n) for n in names]) if len(names) > 1 else F.col(names[0]))
    pick = F.when(F.col("_cs_best") == 0, F.lit("Other"))
    for n, c in zip(names, terms):
        pick = pick.when(F.col(n) == F.col("_cs_best"), F.lit(c))
    short = F.length(F.coalesce(F.col(text_col), F.lit(""))) < 50
    out = out.withColumn(out_col, F.when(short, F.lit("Other")).otherwise(pick))
    return out.drop("_cs_lc", "_cs_best", *names)


def fallback_summary(sections: Column) -> Column:
    """Up to four '• Name: first 70 chars...' lines, padded to four."""
    items = F.array(*[F.struct(F.lit(name).alias("name"), sections[key].alias("text"))
                      for key, name in L.SUMMARY_SECTIONS])
    kept = F.filter(items, lambda x: F.length(T.strip_ws(F.coalesce(x["text"], F.lit("")))) > 20)
    lines = F.transform(kept, lambda x: F.concat(
        F.lit("• "), x["name"], F.lit(": "),
        F.when(F.length(x["text"]) > 70, F.concat(F.substring(x["text"], 1, 70), F.lit("..."))).otherwise(x["text"])))
    n = F.size(lines)
    pad = F.when(n < 4, F.transform(F.sequence(n + 1, F.lit(4)),
                                    lambda k: F.format_string(L.SUMMARY_PAD, k))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(lines, pad), "\n")


def fallback_insight(score: Column, category: Column) -> Column:
    """One sentence by composite tier."""
    out = None
    for lo, text in L.INSIGHT_TIERS:
        sentence = F.format_string(text, category)
        if lo == float("-inf"):
            out = out.otherwise(sentence)
        else:
            out = F.when(score >= lo, sentence) if out is None else out.when(score >= lo, sentence)
    return out


# -- response parsers -----------------------------------------------------------------

def parse_bullets(response: Column) -> Column:
    """Bullet lines ('•', '-', '*') re-prefixed '• '; first four; NULL if none."""
    lines = F.transform(F.split(response, "\n"), lambda s: T.strip_ws(s))
    marked = F.filter(lines, lambda s: s.startswith("•") | s.startswith("-") | s.startswith("*"))
    cleaned = F.transform(marked, lambda s: T.strip_ws(F.regexp_replace(s, r"^[•*\- ]+", "")))
    bullets = F.transform(F.filter(cleaned, lambda s: s != ""), lambda s: F.concat(F.lit("• "), s))
    # every bullet starts with '• ', so an empty join means "no bullets" (one
    # reference to the array: a second one would evaluate the lambdas again)
    return F.nullif(F.array_join(F.slice(bullets, 1, 4), "\n"), F.lit(""))


def match_category(response: Column, categories: list[str] | None = None) -> Column:
    """First valid category contained (case-insensitive) in the answer
    with quotes removed; NULL if none."""
    cats = categories or L.MODEL_CATEGORIES
    cleaned = F.lower(F.replace(F.replace(T.strip_ws(response), F.lit('"'), F.lit("")), F.lit("'"), F.lit("")))
    out = None
    for c in cats:
        cond = cleaned.contains(F.lit(c.lower()))
        out = F.when(cond, F.lit(c)) if out is None else out.when(cond, F.lit(c))
    return out


def trim_insight(response: Column) -> Column:
    """Text before the first '.', stripped; over 120 chars -> 117 + '...'."""
    first = T.strip_ws(F.substring_index(response, ".", 1))
    return F.when(F.length(first) > 120, F.concat(F.substring(first, 1, 117), F.lit("..."))).otherwise(first)


def _nonempty(c: Column) -> Column:
    s = T.strip_ws(c)
    return F.when(F.length(s) > 0, s)


# -- the operator ---------------------------------------------------------------------

def parse_responses(responses: DataFrame, id_col: str = "doc_id", order_col: str | None = None) -> DataFrame:
    """One row per document with every answer already parsed (short strings):
    ``_resp_summary`` (<= 4 bullets), ``_resp_category`` (a valid name),
    ``_resp_insight`` (<= 120 chars), ``_resp_competitive`` (stripped answer).

    Each answer row is parsed where it is read (narrow), and only the parsed
    values are grouped by document, so the shuffle carries short strings.
    Of several answers of one kind for a document the last by ``order_col``
    counts; without such a column they are an error, not a silent choice.
    ``_resp_failed`` tells that the document has a row of kind ``error``: the
    model job failed on it, whatever else it answered."""
    kind = F.col("kind")
    r = _nonempty(F.col("response"))
    parsed = responses.select(
        id_col, *([F.col(order_col).alias("_order")] if order_col is not None else []),
        F.when(kind == "summary", parse_bullets(r)).alias("_resp_summary"),
        F.when(kind == "category", match_category(r)).alias("_resp_category"),
        F.when(kind == "insight", trim_insight(r)).alias("_resp_insight"),
        F.when(kind == "competitive", r).alias("_resp_competitive"),
        (kind == "error").alias("_resp_failed"))
    failed = F.coalesce(F.bool_or("_resp_failed"), F.lit(False)).alias("_resp_failed")
    if order_col is not None:
        last = [F.max_by(f"_resp_{k}", F.when(F.col(f"_resp_{k}").isNotNull(), F.col("_order"))).alias(f"_resp_{k}") for k in RESPONSE_KINDS]
        return parsed.groupBy(id_col).agg(*last, failed)
    twice = lambda k: F.raise_error(F.format_string("several %s answers for one document; give order_col", F.lit(k)))
    return parsed.groupBy(id_col).agg(*[
        F.when(F.count(f"_resp_{k}") > 1, twice(k).cast("string")).otherwise(F.max(f"_resp_{k}")).alias(f"_resp_{k}")
        for k in RESPONSE_KINDS], failed)


HEAVY_TEXT = ["text", "extracted", "full_text", "sections", "sentences"]


def enrich(df: DataFrame, responses: DataFrame | None = None, id_col: str = "doc_id",
           category_terms: dict | None = None, keep_text: bool = True) -> DataFrame:
    """Add ``category``, ``summary``, ``investability_insight`` and
    ``competitive_analysis``.  Needs ``full_text``, ``sections`` and
    ``composite_score``.

    Every text-derived input (rule category, summary fallback, length
    guards) is computed first, in the narrow per-document projection.  With
    a ``responses`` table, the answers are parsed on their own side and then
    joined by ``id_col``; pass ``keep_text=False`` to drop the heavy text
    columns before that join so only short per-document rows are shuffled.
    A document with an answer row of kind ``error`` takes none of its answers:
    summary, category and insight are the rule-based ones, without the guards
    for short texts but the category's own, and the competitive text says so."""
    n = F.length(F.coalesce(F.col("full_text"), F.lit("")))
    out = with_rule_category(df, "_rule_category", "full_text", category_terms)
    out = out.withColumns({
        "_fallback_summary": fallback_summary(F.col("sections")),
        "_len_full": n,
    })
    if not keep_text:
        out = out.drop(*[c for c in out.columns if c in HEAVY_TEXT or c.startswith("_lc_")])
    if responses is not None:
        out = out.join(parse_responses(responses, id_col), id_col, "left")
    else:
        out = out.withColumns({f"_resp_{k}": F.lit(None).cast("string") for k in RESPONSE_KINDS} | {"_resp_failed": F.lit(False)})
    failed = F.coalesce("_resp_failed", F.lit(False))
    out = out.withColumns({f"_resp_{k}": F.when(~failed, F.col(f"_resp_{k}")) for k in RESPONSE_KINDS})
    long_enough = F.col("_len_full") >= 100
    out = out.withColumn("category", F.when(F.col("_len_full") < 50, F.lit("Other")).otherwise(
        F.coalesce(F.col("_resp_category"), F.col("_rule_category"))))
    out = out.withColumns({
        "summary": F.when(~long_enough & ~failed, F.lit(L.SUMMARY_SHORT)).otherwise(
            F.coalesce(F.col("_resp_summary"), F.col("_fallback_summary"))),
        "investability_insight": F.coalesce(F.col("_resp_insight"),
                                            fallback_insight(F.col("composite_score"), F.col("category"))),
        "competitive_analysis": F.when(failed, F.lit(L.ANALYSIS_FAILED)).when(~long_enough, F.lit(L.COMPETITIVE_SHORT)).otherwise(
            F.coalesce(F.col("_resp_competitive"), F.lit(L.COMPETITIVE_MISSING))),
    })
    return out.drop("_rule_category", "_fallback_summary", "_len_full", "_resp_failed", *[f"_resp_{k}" for k in RESPONSE_KINDS])


# -- areas and advice -----------------------------------------------------------------

def weak_strong_areas(df: DataFrame) -> DataFrame:
    """Arrays of dimension names scoring < 5 (weak) and >= 8 (strong)."""
    items = F.array(*[F.struct(F.lit(d).alias("name"), F.col(d).cast("double").alias("score"))
                      for d in L.DIMENSIONS if d in df.columns])
    return df.withColumns({
        "weak_areas": F.transform(F.filter(items, lambda x: x["score"] < 5), lambda x: x["name"]),
        "strong_areas": F.transform(F.filter(items, lambda x: x["score"] >= 8), lambda x: x["name"]),
    })


def improvement_advice(df: DataFrame, id_col: str = "deck_name") -> DataFrame:
    """One advice row per weak dimension (broadcast lookup of the 7-row
    advice table); documents with no weak area get the 'strong' line."""
    spark = df.sparkSession
    advice = spark.createDataFrame(L.ADVICE, "area string, advice string")
    areas = weak_strong_areas(df).select(id_col, "weak_areas")
    exploded = areas.select(id_col, F.posexplode_outer("weak_areas").alias("pos", "dim"))
    exploded = exploded.withColumn("area", T.title_case_dim(F.col("dim")))
    joined = exploded.join(F.broadcast(advice), "area", "left")
    return joined.select(
        id_col, F.coalesce("pos", F.lit(0)).alias("pos"), "area",
        F.when(F.col("dim").isNull(), F.lit(L.NO_WEAK_AREAS)).otherwise(F.col("advice")).alias("advice"))


# -- prompts for an external batch job --------------------------------------------------

def build_prompts(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, kind, prompt)`` rows for the documents that need a model
    call (the short-text guards answer the others without one).  Prompts hold
    the whole text; cutting it to a model's window is that job's choice."""
    full = F.coalesce(F.col("full_text"), F.lit(""))
    n = F.length(full)
    cats = ", ".join(L.MODEL_CATEGORIES[:-1])
    areas = with_rule_category(weak_strong_areas(df), "_rule_category")
    rule_cat = F.col("_rule_category")
    join_or_none = lambda a: F.when(F.size(a) > 0, F.array_join(a, ", ")).otherwise(F.lit("None"))
    score1 = (F.rint(F.col("composite_score") * 10) / 10).cast("string")
    rows = F.array(
        F.struct(F.lit("summary").alias("kind"), F.when(n >= 100, F.format_string(
            L.PROMPT_SUMMARY, full)).alias("prompt")),
        F.struct(F.lit("category").alias("kind"), F.when(n >= 50, F.format_string(
            L.PROMPT_CATEGORY, F.lit(cats), full)).alias("prompt")),
        F.struct(F.lit("insight").alias("kind"), F.format_string(
            L.PROMPT_INSIGHT, rule_cat, score1, join_or_none(F.col("strong_areas")),
            join_or_none(F.col("weak_areas")), full).alias("prompt")),
        F.struct(F.lit("competitive").alias("kind"), F.when(n >= 100, F.format_string(
            L.PROMPT_COMPETITIVE, full)).alias("prompt")),
    )
    out = areas.select(id_col, F.inline(rows))
    return out.filter(F.col("prompt").isNotNull())
