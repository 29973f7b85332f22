"""Seven capped 0-10 scores and the weighted composite.

The dimension specs are data (``deckscope.lexicons.DIMENSION_SPECS``) and are
compiled here into one narrow projection: no join, no shuffle, no Python.
Lower-cased inputs and sentiment structs are materialised once in their own
projection so each is computed a single time per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckscope import lexicons as L
from deckscope.functions import lexicon as LX
from deckscope.functions import sentiment as S


def _source(spec: dict) -> Column:
    src = spec["source"]
    return F.col("full_text") if src == "full_text" else F.col(f"sections.{src}")


def _lc_name(src: str) -> str:
    return f"_lc_{src}"


def _sent_name(src: str) -> str:
    return f"_sent_{src}"


def add_sentiments(df: DataFrame, sources: list[str], lex: S.SentimentLexicon = S.DEFAULT_LEXICON) -> DataFrame:
    """Add ``_sent_<source>`` structs (pos, neg, neu, compound) for each source
    text that does not have one yet."""
    todo = [s for s in sources if _sent_name(s) not in df.columns]
    if not todo:
        return df
    col = lambda s: F.col("full_text") if s == "full_text" else F.col(f"sections.{s}")
    out = df.withColumns({f"_tok_{s}": S.tokens(col(s), cleaned=True) for s in todo})
    out = out.withColumns({f"_val_{s}": S.valences(f"_tok_{s}", lex) for s in todo})
    out = out.withColumns({_sent_name(s): S.scores(F.col(f"_val_{s}"), F.size(F.col(f"_tok_{s}")), lex)
                           for s in todo})
    return out.drop(*[f"_tok_{s}" for s in todo], *[f"_val_{s}" for s in todo])


def _component(spec: dict, comp: dict) -> Column:
    src = spec["source"]
    lc = F.col(_lc_name(src))
    kind = comp["kind"]
    if kind == "terms":
        return LX.lexicon_hits(_lc_name(src), comp["terms"], comp["weight"], comp["cap"])
    text = lc if comp.get("case") == "lower" else _source(spec)
    if kind == "regex":
        return LX.regex_hits(text, comp["patterns"], comp["weight"], comp["cap"])
    if kind == "regex_gt":
        return LX.regex_values_above(text, comp["pattern"], comp["threshold"], comp["weight"], comp["cap"])
    if kind in ("neg", "pos"):
        share = F.col(_sent_name(src))[kind]
        return F.least(F.abs(share) * F.lit(float(comp["factor"])), F.lit(float(comp["cap"])))
    if kind == "length":
        words = F.regexp_count(_source(spec), F.lit(r"[^ ]+"))
        return F.least(words / F.lit(comp["per"]) * F.lit(float(comp["scale"])), F.lit(float(comp["cap"])))
    raise ValueError(f"unknown component kind {kind!r}")


def dimension_score(spec: dict) -> Column:
    total = None
    for comp in spec["components"]:
        term = _component(spec, comp) * F.lit(float(comp["coef"]))
        total = term if total is None else total + term
    guard = F.length(F.trim(F.coalesce(_source(spec), F.lit("")))) < spec["guard"]
    return F.when(guard, F.lit(0.0)).otherwise(F.least(total, F.lit(10.0)))


def composite(weights: dict[str, float] | None = None) -> Column:
    """C11: sum of score x weight in dimension order (left to right)."""
    w = validate_weights(weights or L.SCORING_WEIGHTS)
    total = None
    for dim, wt in w.items():
        term = F.col(dim) * F.lit(float(wt))
        total = term if total is None else total + term
    return total


def validate_weights(weights: dict[str, float]) -> dict[str, float]:
    """Q2: composite weights must name every dimension, in any order; they are
    applied in dimension order."""
    missing = [d for d in L.DIMENSIONS if d not in weights]
    extra = [d for d in weights if d not in L.DIMENSIONS]
    if missing or extra:
        raise ValueError(f"weights must cover exactly the dimensions; missing={missing} extra={extra}")
    if any(float(weights[d]) < 0 for d in L.DIMENSIONS):
        raise ValueError("weights must be non-negative")
    return {d: float(weights[d]) for d in L.DIMENSIONS}


def score_documents(df: DataFrame, specs: list[dict] | None = None, weights: dict | None = None,
                    lex: S.SentimentLexicon = S.DEFAULT_LEXICON, keep_internal: bool = False) -> DataFrame:
    """Add the seven dimension scores and ``composite_score``.

    Input needs ``full_text`` and ``sections`` (see ``sectionize``).
    """
    specs = specs or L.DIMENSION_SPECS
    lc = {}
    for s in specs:
        needs = any(c["kind"] in ("terms",) or c.get("case") == "lower" for c in s["components"])
        if needs and _lc_name(s["source"]) not in df.columns:
            lc[_lc_name(s["source"])] = F.lower(F.coalesce(_source(s), F.lit("")))
    out = df.withColumns(lc)
    sent_srcs = [s["source"] for s in specs if any(c["kind"] in ("neg", "pos") for c in s["components"])]
    out = add_sentiments(out, list(dict.fromkeys(sent_srcs)), lex)
    out = out.withColumns({s["name"]: dimension_score(s) for s in specs})
    out = out.withColumn("composite_score", composite(weights))
    if keep_internal:
        return out
    return out.drop(*[c for c in out.columns if c.startswith("_lc_")])


def drop_internal(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])
