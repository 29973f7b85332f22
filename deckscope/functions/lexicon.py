"""Lexicon primitives compiled to column expressions.

* hit     = number of distinct terms present (substring test) x weight, capped
* count   = number of non-overlapping regex matches x weight, capped
* density = occurrences of terms per 1000 words

Term lists are literals, so a component is one compact expression.  The ones
with array lambdas are evaluated outside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def _sql_str(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def distinct_hits(text_lc, terms) -> Column:
    """Number of terms that occur at least once in ``text_lc``.

    Written as a sum of ``contains`` tests (not a lambda over an array) so it
    compiles into the generated code of the projection.  When ``text_lc`` is
    a column name the sum is handed to Spark as one SQL text."""
    if isinstance(text_lc, str):
        c = f"`{text_lc}`"
        return F.expr("(" + " + ".join(f"(CASE WHEN contains({c}, {_sql_str(t)}) THEN 1 ELSE 0 END)"
                                       for t in terms) + ")")
    total = None
    for t in terms:
        x = F.when(text_lc.contains(F.lit(t)), F.lit(1)).otherwise(F.lit(0))
        total = x if total is None else total + x
    return total


def lexicon_hits(text_lc, terms, weight: float, cap: float) -> Column:
    """``min(#terms present * weight, cap)`` as double."""
    return F.least(distinct_hits(text_lc, terms) * F.lit(float(weight)), F.lit(float(cap)))


def regex_matches(text: Column, patterns) -> Column:
    """Total non-overlapping matches of all patterns (sum, in list order)."""
    total = None
    for p in patterns:
        n = F.regexp_count(text, F.lit(p))
        total = n if total is None else total + n
    return total


def regex_hits(text: Column, patterns, weight: float, cap: float) -> Column:
    """``min(#matches * weight, cap)`` as double."""
    return F.least(regex_matches(text, patterns) * F.lit(float(weight)), F.lit(float(cap)))


def regex_values_above(text: Column, pattern: str, threshold: float, weight: float, cap: float) -> Column:
    """Count captured numbers (group 1) greater than ``threshold``, x weight, capped."""
    vals = F.regexp_extract_all(text, F.lit(pattern), 1)
    n = F.size(F.filter(vals, lambda v: v.cast("double") > F.lit(float(threshold))))
    return F.least(n * F.lit(float(weight)), F.lit(float(cap)))


def occurrences(text_lc: Column, term: str) -> Column:
    """Python ``str.count``: non-overlapping occurrences of a literal term."""
    removed = F.length(F.replace(text_lc, F.lit(term), F.lit("")))
    return F.floor((F.length(text_lc) - removed) / F.lit(len(term))).cast("long")


def total_occurrences(text_lc, terms) -> Column:
    """Sum of :func:`occurrences` over the terms (one SQL text for a column name)."""
    if isinstance(text_lc, str):
        c = f"`{text_lc}`"
        parts = [f"CAST(floor((length({c}) - length(replace({c}, {_sql_str(t)}, ''))) / {len(t)}) AS BIGINT)"
                 for t in terms]
        return F.expr("(" + " + ".join(parts) + ")")
    total = None
    for t in terms:
        n = occurrences(text_lc, t)
        total = n if total is None else total + n
    return total
