"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator family, each over whole tables (or frames Spark derives from them).

``deckscope.plans.oracle`` holds the DuckDB statement for each key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckscope import lexicons as L
from deckscope.functions import text as T
from deckscope.operators import distinct_sketch as DS
from deckscope.operators.enrich import enrich
from deckscope.operators.language import language_metrics
from deckscope.operators.scoring import drop_internal, score_documents
from deckscope.operators.sections import sectionize
from deckscope.plans.document_plan import route_errors, with_extraction
from deckscope.session import ensure_checkpoint_dir
from deckscope.sources import fixtures as FX
from deckscope.sources.tables import read_table, spread

QUERIES: dict = {}


def register(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _decks(spark, sf) -> DataFrame:
    return spread(FX.decks(spark, sf))


def _docs(spark, sf) -> DataFrame:
    return spread(FX.documents(spark, sf))


def _sections_flat(df: DataFrame) -> list:
    return [F.col(f"sections.{s}").alias(f"sec_{s}") for s in L.SECTIONS]


def _scored(spark, sf, raw: bool = False) -> DataFrame:
    base = _docs(spark, sf) if raw else _decks(spark, sf)
    return score_documents(sectionize(base), keep_internal=True)


# -- B: cleaning, sentences, sections -----------------------------------------------------

@register("clean_documents")
def clean_documents(spark: SparkSession, sf: str) -> DataFrame:
    """B5, B6, B8 on the raw documents (whole texts)."""
    d = _docs(spark, sf).withColumn("full_text", T.clean_text(F.col("text")))
    return d.select("doc_id", "full_text", T.word_count(F.col("full_text")).cast("int").alias("word_count"),
                    F.size(T.split_sentences(F.col("full_text"))).alias("n_sentences"))


@register("section_routing")
def section_routing(spark: SparkSession, sf: str) -> DataFrame:
    """B7 on decks: seven section texts per document."""
    s = sectionize(_decks(spark, sf))
    return s.select("doc_id", "word_count", *_sections_flat(s))


@register("error_routing")
def error_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with less than 50 characters of text become error rows."""
    _, errors = route_errors(with_extraction(_docs(spark, sf)))
    return errors


# -- C: scoring ---------------------------------------------------------------------------

@register("score_decks")
def score_decks(spark: SparkSession, sf: str) -> DataFrame:
    """C3-C12 on decks."""
    return _scored(spark, sf).select("doc_id", "deck_name", *L.DIMENSIONS, "composite_score")


@register("score_documents")
def score_raw_documents(spark: SparkSession, sf: str) -> DataFrame:
    """C3-C12 on the raw documents."""
    return _scored(spark, sf, raw=True).select("doc_id", "deck_name", *L.DIMENSIONS, "composite_score")


@register("sentiment_sections")
def sentiment_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sentiment shares of the problem section and the full text."""
    s = _scored(spark, sf)
    return s.select("doc_id", *[F.col(f"_sent_{src}")[k].alias(f"{k}_{src}")
                                for src in ("problem", "full_text") for k in ("pos", "neg", "neu", "compound")])


# -- D: language metrics --------------------------------------------------------------------

@register("language_metrics")
def language_decks(spark: SparkSession, sf: str) -> DataFrame:
    """D1-D7 on decks."""
    lm = language_metrics(sectionize(_decks(spark, sf)))
    return lm.select("doc_id", *[f"{s}_sentiment" for s in L.SENTIMENT_SECTIONS],
                     "confidence_score", "tech_sophistication", "vocabulary_diversity",
                     "avg_sentence_length", "readability_score", "readability_raw")


# -- E: enrichment --------------------------------------------------------------------------

@register("enrich_decks")
def enrich_decks(spark: SparkSession, sf: str) -> DataFrame:
    """E5-E7, E10, E11 (rule fallbacks, no model answers)."""
    e = enrich(_scored(spark, sf))
    return e.select("doc_id", "category", "summary", "investability_insight", "competitive_analysis")


# == portfolio family (over the customer-derived portfolio and the orders history) ==========

from deckscope.operators import portfolio as P  # noqa: E402
from deckscope.operators import ranking as R  # noqa: E402


def _pf(spark, sf) -> DataFrame:
    return FX.portfolio(spark, sf)


def r6(c):
    """Aggregated doubles are rounded to 6 places for engine-independent checks."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


@register("portfolio_stats")
def portfolio_stats(spark, sf):
    """I1."""
    s = P.portfolio_stats(_pf(spark, sf))
    return s.select("n", *[r6(c).alias(c) for c in ("mean", "std", "median", "min", "max")])


@register("dimension_averages")
def dimension_averages(spark, sf):
    """I2."""
    return P.dimension_averages(_pf(spark, sf)).select("dimension", r6("average").alias("average"))


@register("category_distribution")
def category_distribution(spark, sf):
    """I3 (top 5 is the report)."""
    return P.category_distribution(_pf(spark, sf)).select("category", "count", r6("percent").alias("percent"))


@register("category_stats")
def category_stats(spark, sf):
    """I4 (exact medians)."""
    return P.category_stats(_pf(spark, sf))


@register("portfolio_composition")
def portfolio_composition(spark, sf):
    """I5."""
    c = P.portfolio_composition(_pf(spark, sf))
    return c.withColumns({"average_quality": r6("average_quality"), "score_variance": r6("score_variance")})


@register("portfolio_risk")
def portfolio_risk(spark, sf):
    """I6."""
    return P.portfolio_risk(_pf(spark, sf))


@register("market_trends")
def market_trends(spark, sf):
    """I7."""
    return P.market_trends(_pf(spark, sf)).withColumn("value", r6("value"))


@register("benchmark_comparison")
def benchmark_comparison(spark, sf):
    """H1, M3, O6 (gap size)."""
    b = P.benchmark_comparison(_pf(spark, sf))
    return b.withColumns({"percentile_rank": r6("percentile_rank"),
                          "marker_size": F.abs("composite_vs_benchmark")})


@register("benchmark_summary")
def benchmark_summary(spark, sf):
    """I8, K5, G6."""
    s = P.benchmark_summary(P.benchmark_comparison(_pf(spark, sf)))
    return s.withColumns({"avg_vs_benchmark": r6("avg_vs_benchmark"),
                          "categories_analyzed": F.array_join("categories_analyzed", ",")})


@register("executive_summary")
def executive_summary(spark, sf):
    """I9."""
    e = P.executive_summary(_pf(spark, sf))
    return e.select("n_decks", r6("avg_score").alias("avg_score"), "top_deck", "top_score", "bottom_deck",
                    "bottom_score", "top_category", "high_performers", r6("high_pct").alias("high_pct"),
                    "low_performers", r6("low_pct").alias("low_pct"), "summary_text")


@register("batch_summary")
def batch_summary(spark, sf):
    """I10, I16."""
    return P.batch_summary(_pf(spark, sf)).withColumn("portfolio_avg", r6("portfolio_avg"))


@register("category_performance")
def category_performance(spark, sf):
    """I11."""
    return P.category_performance(_pf(spark, sf)).withColumn("mean", r6("mean"))


@register("correlation_matrix")
def correlation_matrix(spark, sf):
    """I12."""
    return P.correlation_matrix(_pf(spark, sf)).withColumn("corr", r6("corr"))


@register("score_histogram")
def score_histogram(spark, sf):
    """I13."""
    h = P.histogram(_pf(spark, sf))
    return h.withColumns({"bin_lo": r6("bin_lo"), "bin_hi": r6("bin_hi")})


@register("tier_hierarchy")
def tier_hierarchy(spark, sf):
    """I14, M4."""
    return P.tier_hierarchy(_pf(spark, sf))


@register("distinct_categories")
def distinct_categories(spark, sf):
    """L3, I16."""
    return _pf(spark, sf).select("category").distinct()


@register("derived_features")
def derived_features(spark, sf):
    """M1."""
    d = P.derived_features(_pf(spark, sf))
    return d.select("deck_name", "market_traction_ratio", "team_execution_score", "business_clarity_score",
                    "overall_strength", "score_variance")


@register("risk_factors")
def risk_factors(spark, sf):
    """M2."""
    return P.risk_factors(_pf(spark, sf))


@register("due_diligence_flags")
def due_diligence_flags(spark, sf):
    """M5."""
    f = P.due_diligence_flags(_pf(spark, sf))
    return f.select("deck_name", "composite_score", F.size("flags").alias("n_flags"),
                    F.array_join("flags", " | ").alias("flags"))


@register("recommendations")
def recommendations(spark, sf):
    """M6, H3, L1, K6."""
    return P.recommendations(_pf(spark, sf))


@register("score_bands")
def score_bands(spark, sf):
    """M4, M7, M8, M9, M10, G3."""
    return P.score_bands(_pf(spark, sf))


@register("summary_table")
def summary_table(spark, sf):
    """J1, K1, G1 (rank on the rounded composite)."""
    return R.summary_table(_pf(spark, sf))


@register("top_performers")
def top_performers(spark, sf):
    """K2 (top 3 of the ranked table)."""
    return R.top_k(R.summary_table(_pf(spark, sf)), 3)


@register("bottom_performers")
def bottom_performers(spark, sf):
    """K3."""
    return R.bottom_k(R.summary_table(_pf(spark, sf)), 3)


@register("ranking_chart")
def ranking_chart(spark, sf):
    """K4, G5."""
    return R.ranking_chart_rows(_pf(spark, sf), 15)


@register("argmax_argmin")
def argmax_argmin(spark, sf):
    """K5."""
    return R.argmax_argmin(_pf(spark, sf))


@register("vs_reference_vector")
def vs_reference_vector(spark, sf):
    """H2."""
    return P.vs_reference_vector(_pf(spark, sf))


# == history, charts, casts, parsing, diagnosis ===============================================

from deckscope.operators import charts as CH  # noqa: E402
from deckscope.operators import enrich as EN  # noqa: E402
from deckscope.operators import extract as EX  # noqa: E402
from deckscope.operators import history as HI  # noqa: E402
from deckscope.operators import term_join as TJ  # noqa: E402
from deckscope.operators import valence_join as VJ  # noqa: E402
from deckscope.operators.normalize import normalize_results  # noqa: E402
from deckscope.operators.sections import sentence_sections as _sentence_sections  # noqa: E402
from deckscope.sources.documents import assemble_pages as _assemble_pages  # noqa: E402


def _hist(spark, sf) -> DataFrame:
    return FX.history(spark, sf)


@register("analysis_number")
def analysis_number(spark, sf):
    """Sequence over the whole history in time order (distributed positions)."""
    h = R.global_positions(_hist(spark, sf), [F.col("timestamp"), F.col("deck_name"), F.col("analysis_id")],
                           None, "analysis_number")
    return h.select("analysis_id", "deck_name", "composite_score", "analysis_number")


def _kept_history(spark, sf):
    """The history appended as four batches: three in time order, and one of rows that come late for the second month-long stretch."""
    h, day = _hist(spark, sf), F.col("analysis_date")
    kept = HI.NumberedHistory(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/history/{uuid.uuid4().hex}", ("timestamp", "deck_name", "analysis_id"), "yyyy-MM")
    late = (F.date_format(day, "yyyy") == "1995") & (F.col("analysis_id") % 3 == 0)
    for name, rows in (("a", day < "1994-07-01"), ("b", (day >= "1994-07-01") & (day < "1996-07-01") & ~late), ("c", (day >= "1996-07-01") & ~late), ("late", late)):
        kept.append(h.filter(rows), name)
    return kept


@register("history_numbers")
def history_numbers(spark, sf):
    """J2 kept incrementally: numbers after four appended batches."""
    return _kept_history(spark, sf).numbered().select("analysis_id", "deck_name", "composite_score", "analysis_number")


@register("history_timeline")
def history_timeline(spark, sf):
    """J3 from the same kept history."""
    return _kept_history(spark, sf).timeline()


@register("timeline_frames")
def timeline_frames(spark, sf):
    """J3 (dates as ISO text)."""
    t = R.timeline_frames(_hist(spark, sf))
    return t.withColumn("analysis_date", F.date_format("analysis_date", "yyyy-MM-dd"))


@register("history_view")
def history_view(spark, sf):
    """G2 + K7: one category, composite >= 5, newest first."""
    return R.history_recent_first(P.filter_history(_hist(spark, sf), "SaaS", 5.0))


@register("radar_rows")
def radar_rows(spark, sf):
    """O1."""
    return CH.radar_rows(_pf(spark, sf))


@register("scatter3d_rows")
def scatter3d_rows(spark, sf):
    """O2."""
    return CH.scatter3d_rows(_pf(spark, sf))


@register("parallel_rows")
def parallel_rows(spark, sf):
    """O3."""
    return CH.parallel_rows(_pf(spark, sf))


@register("matrix_rows")
def matrix_rows(spark, sf):
    """O4."""
    return CH.matrix_rows(_pf(spark, sf))


@register("landscape_rows")
def landscape_rows(spark, sf):
    """O5, M7."""
    return CH.landscape_rows(_pf(spark, sf))


@register("normalize_results")
def normalize_q(spark, sf):
    """F1-F3 on loosely typed rows."""
    return normalize_results(FX.messy_results(spark, sf))


@register("weak_strong_areas")
def weak_strong_areas(spark, sf):
    """E8 (+ F4 labels)."""
    w = EN.weak_strong_areas(_pf(spark, sf))
    return w.select("deck_name", F.array_join("weak_areas", ",").alias("weak_areas"),
                    F.array_join("strong_areas", ",").alias("strong_areas"))


@register("improvement_advice")
def improvement_advice(spark, sf):
    """E9, H4."""
    return EN.improvement_advice(_pf(spark, sf))


@register("enrich_with_responses")
def enrich_with_responses(spark, sf):
    """E2-E4, E10, E11 with model answers (a responses table)."""
    e = EN.enrich(_scored(spark, sf), FX.responses(spark, sf), keep_text=False)
    return e.select("doc_id", "category", "summary", "investability_insight", "competitive_analysis")


@register("enrich_after_errors")
def enrich_after_errors(spark, sf):
    """E11, the path of failed model calls: one document in three has an error row beside its answers."""
    r = FX.responses(spark, sf)
    errors = r.filter((F.col("kind") == "summary") & (F.col("doc_id") % 3 == 0)).withColumns({"kind": F.lit("error"), "response": F.lit("timeout")})
    e = EN.enrich(_scored(spark, sf), r.unionByName(errors), keep_text=False)
    return e.select("doc_id", "category", "summary", "investability_insight", "competitive_analysis")


@register("prompts")
def prompts(spark, sf):
    """Prompt rows for an external batch-inference job."""
    return EN.build_prompts(_scored(spark, sf))


@register("page_diagnosis")
def page_diagnosis(spark, sf):
    """B1 (content part)."""
    return EX.diagnose_pages(FX.page_table(spark, sf))


@register("diagnose")
def diagnose(spark, sf):
    """B1, file and page half in one row."""
    return EX.diagnose(FX.file_table(spark, sf), FX.page_table(spark, sf))


@register("diagnosis_summary")
def diagnosis_summary(spark, sf):
    """B2."""
    return EX.diagnosis_summary(EX.diagnose_pages(FX.page_table(spark, sf)))


@register("choose_extraction")
def choose_extraction(spark, sf):
    """B3 + B4 on three extractor outputs."""
    c = EX.choose_extraction(FX.extraction_candidates(spark, sf))
    return c.select("doc_id", "extraction_method", F.length("text").alias("text_length"),
                    (F.length("text") >= L.MIN_TEXT_LENGTH).alias("sufficient"))


@register("section_preview")
def section_preview(spark, sf):
    """B9, B10."""
    return EX.section_preview(sectionize(_decks(spark, sf)))


@register("assemble_pages")
def assemble_pages(spark, sf):
    """A3: conversation turns as pages -> one text per document."""
    return _assemble_pages(FX.page_table(spark, sf))


@register("deck_names")
def deck_names(spark, sf):
    """A2: names from paths (pages' URLs)."""
    p = read_table(spark, sf, "pages")
    return p.select("page_id", T.deck_name_from_path(F.col("url")).alias("deck_name"))


@register("sentence_sections")
def sentence_sections(spark, sf):
    """H6 / Q5: sentences with the sections they match, exploded."""
    s = sectionize(_decks(spark, sf))
    return _sentence_sections(s)


@register("term_table_sections")
def term_table_sections(spark, sf):
    """H6 / Q1: every sentence of the documents against a term table of any size."""
    d = _docs(spark, sf).withColumn("full_text", T.clean_text(F.col("text")))
    return TJ.sentence_terms(d, FX.user_terms(spark, sf))


@register("term_table_scores")
def term_table_scores(spark, sf):
    """Q1: dimension scores from a user's term table."""
    return TJ.lexicon_scores(_docs(spark, sf), FX.user_terms(spark, sf))


@register("table_sentiment")
def table_sentiment(spark, sf):
    """C10, table-driven: sentiment of the full texts from a valence table."""
    d = _decks(spark, sf).withColumn("full_text", T.clean_text(F.col("text")))
    return VJ.table_sentiment(d, VJ.lexicon_table(spark))


@register("sentiment_labels")
def sentiment_labels(spark, sf):
    """D8."""
    from deckscope.operators.language import sentiment_labels as _sl
    lm = language_metrics(sectionize(_decks(spark, sf)))
    return _sl(lm, "doc_id")


@register("language_profile")
def language_profile(spark, sf):
    """D9."""
    from deckscope.operators.language import language_profile_long
    lm = language_metrics(sectionize(_decks(spark, sf)))
    return language_profile_long(lm, "doc_id")


# == ML (rows-only checks), export, flagship ===================================================

from deckscope.operators import ml as ML  # noqa: E402
from deckscope.plans.document_plan import analyze  # noqa: E402
from deckscope.sources import sinks as SK  # noqa: E402


def _success_model(spark, sf):
    """The forest, fitted anew: some seconds on its bounded sample, and the same for every query."""
    return ML.fit_success_model(_pf(spark, sf))


@register("ml_feature_importance")
def ml_feature_importance(spark, sf):
    """Importances of the success model, top 10."""
    m = _success_model(spark, sf)
    return m.importances(spark).limit(10)


@register("ml_model_scores")
def ml_model_scores(spark, sf):
    """R^2 on train and test rows."""
    m = _success_model(spark, sf)
    train_r2, test_r2 = m.r2()
    return spark.createDataFrame([(float(train_r2), float(test_r2), len(m.feature_names))],
                                 "train_r2 double, test_r2 double, n_features int")


@register("ml_predictions")
def ml_predictions(spark, sf):
    """N8, H5, K9, M9, A8."""
    pf = _pf(spark, sf)
    m = _success_model(spark, sf)
    return ML.prediction_ranking(m.predict(pf))


@register("ml_probability_histogram")
def ml_probability_histogram(spark, sf):
    """I13 (20 bins of the success probability)."""
    pf = _pf(spark, sf)
    m = _success_model(spark, sf)
    return P.histogram(m.predict(pf), ["success_probability"], 20)


@register("ml_clusters")
def ml_clusters(spark, sf):
    """K-means groups named by mean composite."""
    c = ML.cluster_performance(_pf(spark, sf))
    return c.select("deck_name", "composite_score", "cluster", "cluster_name")


@register("ml_projection")
def ml_projection(spark, sf):
    """2-D projection of the clustered rows."""
    return ML.project_2d(ML.cluster_performance(_pf(spark, sf)))


@register("export_scores_long")
def export_scores_long(spark, sf):
    """Eight (Metric, Score) rows per document."""
    return SK.scores_long(_pf(spark, sf))


@register("export_json")
def export_json(spark, sf):
    """One JSON document per result row."""
    return SK.to_json_rows(_pf(spark, sf))


@register("ranked_results")
def ranked_results(spark, sf):
    """Flagship (E-1): documents -> clean -> sections -> scores -> category,
    insight -> ranked summary table (J1 + G1 + K1)."""
    a = analyze(_docs(spark, sf))
    return R.summary_table(a)


@register("batch_run_metrics")
def batch_run_metrics(spark, sf):
    """I15."""
    from deckscope.plans.document_plan import batch_run_metrics as _brm
    return _brm(with_extraction(_docs(spark, sf)))


@register("result_rows")
def result_rows(spark, sf):
    """The result projection of the per-document plan (without the
    run-time stamp and timing columns)."""
    from deckscope.plans.document_plan import results
    return results(_decks(spark, sf)).drop("timestamp", "processing_time")


@register("collect_results")
def collect_results_q(spark, sf):
    """L2: two result batches with different columns in one table."""
    from deckscope.plans.document_plan import collect_results
    a = analyze(_decks(spark, sf)).select("doc_id", "deck_name", "composite_score", "category")
    b = analyze(_docs(spark, sf), with_language=True).select("doc_id", "deck_name", "composite_score",
                                                             "readability_score")
    return collect_results(a.withColumn("batch", F.lit("decks")), b.withColumn("batch", F.lit("documents")))


# -- distinct counts by sketches ------------------------------------------------------------

@register("distinct_decks_by_year")
def distinct_decks_by_year(spark, sf):
    """I16 over the history: sketches by month, united by year, held against
    exact counts (whether each estimate is within its bound)."""
    h = FX.history(spark, sf).select(F.date_format("analysis_date", "yyyy-MM").alias("month"), "deck_name")
    year = F.substring("month", 1, 4).alias("year")
    found = DS.estimates(DS.merged(DS.sketches(h, ["month"], "deck_name").select("*", year), ["year"]))
    exact = h.groupBy(year).agg(F.count_distinct("deck_name").alias("n_exact"))
    return found.join(exact, "year").select("year", "n_values", "n_exact", DS.within_bound().alias("within_bound"))


@register("vocabulary_by_language")
def vocabulary_by_language(spark, sf):
    """D4 over the corpus: distinct words of each language's documents and of
    all, sketches united, held against exact counts."""
    w = _docs_words(spark, sf)
    by_lang = DS.sketches(w, ["lang"], "word")
    found = DS.estimates(by_lang.unionByName(DS.merged(by_lang.withColumn("lang", F.lit("all")), ["lang"])))
    exact = w.distinct().withColumn("lang", F.explode(F.array("lang", F.lit("all")))).groupBy("lang").agg(F.count_distinct("word").alias("n_exact"))
    return found.join(exact, "lang").select("lang", "n_values", "n_exact", DS.within_bound().alias("within_bound"))


def _docs_words(spark, sf) -> DataFrame:
    d = spread(read_table(spark, sf, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), "text"))
    return d.select("lang", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("word"))


# -- the same operators on NULL scores, NULL groups and repeated names -----------------------

def _hard(name: str, build) -> None:
    QUERIES[f"hard_{name}"] = lambda spark, sf: build(FX.hard_portfolio(spark, sf))


_hard("portfolio_stats", lambda df: P.portfolio_stats(df).select("n", *[r6(c).alias(c) for c in ("mean", "std", "median", "min", "max")]))
_hard("category_performance", lambda df: P.category_performance(df).withColumn("mean", r6("mean")))
_hard("category_distribution", lambda df: P.category_distribution(df).select("category", "count", r6("percent").alias("percent")))
_hard("tier_hierarchy", P.tier_hierarchy)
_hard("batch_summary", lambda df: P.batch_summary(df).withColumn("portfolio_avg", r6("portfolio_avg")))
_hard("score_histogram", lambda df: P.histogram(df).withColumns({"bin_lo": r6("bin_lo"), "bin_hi": r6("bin_hi")}))
