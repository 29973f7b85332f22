"""Lexicon sentiment as column expressions.

Shape follows the published valence-aware rule set (Hutto & Gilbert, ICWSM
2014): tokens are whitespace pieces, lower-cased, with surrounding punctuation
stripped when at least 3 characters remain.  A lexicon token gets its
valence; booster words up to 3 tokens before it move the valence away from 0
(step 0.293, decay 1 / 0.95 / 0.9); each negator up to 3 tokens before it
multiplies by -0.74.  With S = sum of valences:

    pos_sum = sum(v + 1 | v > 0), neg_sum = sum(v - 1 | v < 0),
    neu = tokens with valence 0, total = pos_sum + |neg_sum| + neu
    pos = pos_sum / total, neg = |neg_sum| / total, neu = neu / total,
    compound = S / sqrt(S^2 + 15)

Differences from the full rule set (documented, by design): no capitals
emphasis, no "but" rule, no punctuation emphasis, no rounding.  The lexicon is
our own small table; pass a bigger one through :class:`SentimentLexicon`.

Lookup cost: membership is an ``IN`` over literals, which Catalyst turns into
a hash-set probe (``InSet``), so each token costs O(1); the map lookup for the
valence runs only for the few tokens that hit.
"""

from __future__ import annotations

import string
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from deckscope import lexicons as L
from deckscope.functions.text import WS_CLASS

PUNCTUATION = string.punctuation


@dataclass(frozen=True)
class SentimentLexicon:
    entries: tuple = tuple(L.SENTIMENT_LEXICON)
    negators: tuple = tuple(L.NEGATORS)
    boosters_up: tuple = tuple(L.BOOSTERS_UP)
    boosters_down: tuple = tuple(L.BOOSTERS_DOWN)
    negation_scalar: float = L.NEGATION_SCALAR
    booster_step: float = L.BOOSTER_STEP
    booster_decay: tuple = field(default=tuple(L.BOOSTER_DECAY))
    alpha: float = L.COMPOUND_ALPHA

    @classmethod
    def from_rows(cls, rows, **kw) -> "SentimentLexicon":
        """Build from ``(token, valence)`` rows, e.g. a small lexicon table's
        ``collect()`` (the table is a fixed-size dimension, not data)."""
        return cls(entries=tuple((str(t).lower(), float(v)) for t, v in rows), **kw)


DEFAULT_LEXICON = SentimentLexicon()


def tokens(text: Column, cleaned: bool = False) -> Column:
    """Lower-cased whitespace tokens of ``text`` (punctuation not yet stripped).

    ``cleaned=True`` for output of ``clean_text`` (and sections built from
    it), whose only whitespace is the plain space: a split on ' ' then gives
    the same tokens without a regex."""
    sep = " " if cleaned else f"{WS_CLASS}+"
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), sep), "")


def token_key(t: Column) -> Column:
    """Lookup key: surrounding punctuation stripped when >= 3 characters remain."""
    p = F.lit(PUNCTUATION)
    stripped = F.btrim(t, p)
    return F.when(F.length(stripped) <= 2, t).otherwise(stripped)


def sql_str(x: str) -> str:
    """Spark SQL string literal (backslash and quote escaped)."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_num(x: float) -> str:
    return f"{float(x)!r}D"


def _key_sql(t: str) -> str:
    p = sql_str(PUNCTUATION)
    return f"(CASE WHEN length(btrim({t}, {p})) <= 2 THEN {t} ELSE btrim({t}, {p}) END)"


def valences_sql(toks: str, lex: SentimentLexicon = DEFAULT_LEXICON) -> str:
    """Spark SQL text of :func:`valences` over the token-array column ``toks``."""
    words = ", ".join(sql_str(w) for w, _ in lex.entries)
    lexmap = "map(" + ", ".join(f"{sql_str(w)}, {sql_num(v)}" for w, v in lex.entries) + ")"
    up = ", ".join(sql_str(w) for w in lex.boosters_up)
    down = ", ".join(sql_str(w) for w in lex.boosters_down)
    neg = ", ".join(sql_str(w) for w in lex.negators)

    def prev(d):
        return f"(CASE WHEN i >= {d} THEN {_key_sql(f'element_at({toks}, i - {d} + 1)')} END)"

    def boost(d):
        w = prev(d)
        return (f"(CASE WHEN {w} IN ({up}) THEN {sql_num(lex.booster_step)} WHEN {w} IN ({down}) "
                f"THEN {sql_num(-lex.booster_step)} ELSE 0.0D END)")

    def negate(d):
        return f"(CASE WHEN {prev(d)} IN ({neg}) THEN {sql_num(lex.negation_scalar)} ELSE 1.0D END)"

    k = _key_sql("t")
    v0 = f"try_element_at({lexmap}, {k})"
    sign = f"(CASE WHEN {v0} < 0 THEN -1.0D ELSE 1.0D END)"
    v = v0
    for d in (1, 2, 3):
        v = f"({v} + (({boost(d)} * {sign}) * {sql_num(lex.booster_decay[d - 1])}))"
    for d in (1, 2, 3):
        v = f"({v} * {negate(d)})"
    return f"array_remove(transform({toks}, (t, i) -> CASE WHEN {k} IN ({words}) THEN {v} ELSE 0.0D END), 0.0D)"


def valences(toks, lex: SentimentLexicon = DEFAULT_LEXICON) -> Column:
    """Array of the non-zero final valences of the tokens, in token order.

    ``toks`` is the name of a token-array column (see :func:`tokens`).  One
    pass over the tokens: a hash-set probe per token (``IN`` over literals
    becomes ``InSet``); the look-back to the 3 previous tokens and the
    valence lookup only run for lexicon hits.  The expression is handed to
    Spark as one SQL text (one parse on the JVM instead of hundreds of
    literal objects built one by one)."""
    if not isinstance(toks, str):
        raise TypeError("valences() takes the name of a token-array column")
    return F.expr(valences_sql(f"`{toks}`", lex))


def scores(vals: Column, n_tokens: Column, lex: SentimentLexicon = DEFAULT_LEXICON) -> Column:
    """Struct ``(pos, neg, neu, compound)`` from the non-zero valences and the token count."""
    zero = F.lit(0.0)
    pos_sum = F.aggregate(vals, zero, lambda a, v: a + F.when(v > 0, v + 1.0).otherwise(zero))
    neg_sum = F.aggregate(vals, zero, lambda a, v: a + F.when(v < 0, v - 1.0).otherwise(zero))
    s = F.aggregate(vals, zero, lambda a, v: a + v)
    neu = n_tokens - F.size(vals)
    total = pos_sum + F.abs(neg_sum) + neu
    ratio = lambda x: F.when(total > 0, F.abs(x / total)).otherwise(zero)
    compound = F.when(s != 0, s / F.sqrt(s * s + F.lit(lex.alpha))).otherwise(zero)
    return F.struct(ratio(pos_sum).alias("pos"), ratio(neg_sum).alias("neg"),
                    ratio(neu.cast("double")).alias("neu"), compound.alias("compound"))
