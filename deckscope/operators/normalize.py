"""Tolerant casts of result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deckscope import lexicons as L

SCORE_FIELDS = ["composite_score", *L.DIMENSIONS]
STRING_FIELDS = ["deck_name", "category", "summary", "investability_insight", "competitive_analysis",
                 "extraction_method"]


def safe_float(c: Column, dtype: T.DataType, default: float = 0.0) -> Column:
    """NULL -> default; numbers and booleans -> double; strings keep only
    digits, '.' and '-' and are parsed; unparsable or empty -> default."""
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return F.coalesce(c.cast("double"), F.lit(float(default)))
    cleaned = F.regexp_replace(c.cast("string"), r"[^0-9.\-]", "")
    return F.coalesce(cleaned.try_cast("double"), F.lit(float(default)))


def safe_int(c: Column, dtype: T.DataType, default: int = 0) -> Column:
    """:func:`safe_float` truncated toward zero (out of range -> default)."""
    v = safe_float(c, dtype, float(default))
    return F.coalesce(v.try_cast("int"), F.lit(int(default)))


def normalize_results(df: DataFrame) -> DataFrame:
    """scores through F1, ``word_count`` through F2, text fields
    NULL -> ''; only the columns that exist are touched."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = {c: safe_float(F.col(c), types[c]) for c in SCORE_FIELDS if c in types}
    if "word_count" in types:
        cols["word_count"] = safe_int(F.col("word_count"), types["word_count"])
    cols.update({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in STRING_FIELDS if c in types})
    return df.withColumns(cols)
