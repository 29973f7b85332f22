"""Language metrics per document (D1-D9).  All narrow column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckscope import lexicons as L
from deckscope.functions import lexicon as LX
from deckscope.operators.scoring import add_sentiments

METRICS = ["confidence_score", "tech_sophistication", "vocabulary_diversity", "avg_sentence_length",
           "readability_score"]


def _words(full: Column) -> Column:
    """Whitespace tokens of cleaned text (its only whitespace is ' ')."""
    return F.array_remove(F.split(full, " "), "")


def _dot_sentences(full: Column) -> Column:
    """Split on '.' only, strip, drop blanks (the metric's own sentence rule)."""
    return F.array_remove(F.transform(F.split(full, r"\."), lambda s: F.trim(s)), "")


def language_metrics(df: DataFrame, sentiment_sections: list[str] | None = None) -> DataFrame:
    """Add ``<section>_sentiment`` (D1), ``confidence_score`` (D2),
    ``tech_sophistication`` (D3), ``vocabulary_diversity`` (D4),
    ``avg_sentence_length`` (D5), ``readability_score`` and
    ``readability_raw`` (D6), with the short-text defaults of D7.

    Input needs ``full_text`` and ``sections``."""
    secs = sentiment_sections or L.SENTIMENT_SECTIONS
    out = add_sentiments(df, secs)
    full = F.col("full_text")
    out = out.withColumns({
        "_lw_words": _words(full),
        "_lw_sents": _dot_sentences(full),
        "_lw_lc": F.col("_lc_full_text") if "_lc_full_text" in out.columns else F.lower(full),
    })
    n_words = F.size("_lw_words")
    n_sents = F.size("_lw_sents")
    short = F.length(full) < 50
    # Cleaned text has only ' ' as whitespace, so: the words of all '.'-pieces
    # are the non-space runs once '.' is a space, and the characters of all
    # words are the text's characters minus its spaces (no per-word pass).
    sent_words = F.regexp_count(F.replace(full, F.lit("."), F.lit(" ")), F.lit(r"[^ ]+"))
    char_total = F.length(F.replace(full, F.lit(" "), F.lit("")))
    asl = n_words / n_sents
    awl = char_total / n_words
    raw = asl * F.lit(1.015) + awl * F.lit(84.6) - F.lit(206.835)
    has = (n_sents > 0) & (n_words > 0)
    cols = {
        f"{s}_sentiment": F.when(~short & (F.length(F.col(f"sections.{s}")) > 50),
                                 F.col(f"_sent_{s}")["compound"]) for s in secs
    }
    cols.update({
        "confidence_score": F.when(short, F.lit(0.0)).otherwise(
            LX.total_occurrences("_lw_lc", L.CONFIDENCE_DENSITY_TERMS) / n_words * F.lit(1000.0)),
        "tech_sophistication": F.when(short, F.lit(0.0)).otherwise(
            LX.total_occurrences("_lw_lc", L.TECH_DENSITY_TERMS) / n_words * F.lit(1000.0)),
        "vocabulary_diversity": F.when(short | (n_words == 0), F.lit(0.0)).otherwise(
            F.size(F.array_distinct("_lw_words")) / n_words),
        "avg_sentence_length": F.when(short | (n_sents == 0), F.lit(0.0)).otherwise(sent_words / n_sents),
        "readability_score": F.when(short, F.lit(5.0)).when(~has, F.lit(0.0)).otherwise(
            F.greatest(F.lit(0.0), F.least(F.lit(10.0), (F.lit(100.0) - raw) / F.lit(10.0)))),
        "readability_raw": F.when(short | ~has, F.lit(None).cast("double")).otherwise(raw),
    })
    return out.withColumns(cols).drop("_lw_words", "_lw_sents", "_lw_lc")


def sentiment_labels(df: DataFrame, id_col: str = "deck_name", sections: list[str] | None = None) -> DataFrame:
    """Long form (id, section, sentiment, label) for the sections that
    have a sentiment; > 0.1 Positive, < -0.1 Negative, else Neutral."""
    secs = sections or L.SENTIMENT_SECTIONS
    long = df.unpivot([id_col], [f"{s}_sentiment" for s in secs], "section", "sentiment")
    long = long.filter(F.col("sentiment").isNotNull())
    return long.select(
        id_col,
        F.initcap(F.regexp_replace("section", "_sentiment$", "")).alias("section"),
        "sentiment",
        F.when(F.col("sentiment") > 0.1, "Positive").when(F.col("sentiment") < -0.1, "Negative")
        .otherwise("Neutral").alias("sentiment_label"),
    )


def language_profile_long(df: DataFrame, id_col: str = "deck_name") -> DataFrame:
    """Four metrics as rows; diversity shown x 100."""
    return df.select(id_col, F.stack(
        F.lit(4),
        F.lit("Confidence Indicators"), F.col("confidence_score"),
        F.lit("Technical Sophistication"), F.col("tech_sophistication"),
        F.lit("Vocabulary Diversity"), F.col("vocabulary_diversity") * F.lit(100.0),
        F.lit("Readability Score"), F.col("readability_score"),
    ).alias("metric", "value"))
