"""Cleaning and section routing as DataFrame -> DataFrame steps.

``sectionize`` is narrow (one projection, no shuffle): every document is
handled inside its own row, whatever the text length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckscope import lexicons as L
from deckscope.functions import text as T


def sectionize(df: DataFrame, text_col: str = "text", section_terms: dict | None = None,
               keep_sentences: bool = False) -> DataFrame:
    """Add ``full_text`` (cleaned), ``word_count`` and ``sections`` (a struct
    with one string per section, keys in ``section_terms`` order).

    ``section_terms`` defaults to the seven routing lists; a user lexicon is a
    plain ``{section: [terms]}`` mapping (see ``lexicon_from_table``).
    """
    terms = section_terms or L.SECTION_TERMS
    out = df.withColumn("full_text", T.clean_text(F.col(text_col)))
    out = out.withColumns({"_sentences": T.split_sentences(F.col("full_text")),
                           "_lc_full_text": F.lower("full_text")})
    out = out.withColumn("_sentences_lc", F.transform("_sentences", lambda s: F.lower(s)))
    secs = T.section_texts(F.col("_sentences"), terms, F.col("_sentences_lc"), F.col("_lc_full_text"))
    out = out.withColumns({
        "word_count": T.word_count(F.col("full_text")).cast("int"),
        "sections": F.struct(*[c.alias(k) for k, c in secs.items()]),
    })
    # ``_lc_full_text`` (lower-cased full text) stays as an internal column:
    # scoring, category and language metrics reuse it instead of lower-casing
    # the whole text again; ``drop_internal`` removes it at the end.
    out = out.drop("_sentences_lc")
    if keep_sentences:
        return out.withColumnRenamed("_sentences", "sentences")
    return out.drop("_sentences")


def explode_sentences(df: DataFrame, text_col: str = "full_text", id_col: str = "doc_id") -> DataFrame:
    """Q5 / B6 table-function form: one row per kept sentence with its 0-based
    position (``posexplode``; narrow, no Python)."""
    return df.select(id_col, F.posexplode(T.split_sentences(F.col(text_col))).alias("pos", "sentence"))


def sentence_sections(df: DataFrame, section_terms: dict | None = None, id_col: str = "doc_id") -> DataFrame:
    """H6 relational form: one row (document, sentence position, section)
    for every sentence that contains a term of the section.

    Each exploded sentence carries the list of sections it matches (one
    regex alternation per section over the lower-cased sentence), which is
    exploded again: no join, and no row is made for a non-matching
    (sentence, term) pair.  ``sectionize`` gives the same membership as
    concatenated section texts."""
    terms = section_terms or L.SECTION_TERMS
    sents = explode_sentences(df, id_col=id_col).withColumn("_lc", F.lower("sentence"))
    matched = F.filter(F.array(*[F.when(F.col("_lc").rlike(T.terms_regex(ts)), F.lit(name))
                                 for name, ts in terms.items()]), lambda x: x.isNotNull())
    return sents.select(id_col, "pos", F.explode(matched).alias("section"))


def lexicon_from_table(df: DataFrame, group_col: str = "section", term_col: str = "term") -> dict[str, list[str]]:
    """Q1: turn a small user term table into the ``{group: [terms]}`` mapping.

    Term tables are dimension tables of a few hundred rows at most; they are
    compiled into the plan as literals, not joined per row.
    """
    rows = df.select(group_col, term_col).collect()
    out: dict[str, list[str]] = {}
    for g, t in rows:
        out.setdefault(g, [])
        if t not in out[g]:
            out[g].append(t.lower())
    return out
