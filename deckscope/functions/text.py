"""Text column expressions: cleaning, sentence splitting, section routing.

All builders return native Spark ``Column`` expressions (regex, higher-order
array functions), with no Python in the hot path.  Array lambdas are evaluated
outside whole-stage codegen.  Regex patterns are written in the subset shared by Java regex
and RE2 (no look-arounds) so the DuckDB oracle can use the same strings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's ``str.isspace`` set as a character class, so that Spark (Java regex,
# ASCII ``\s``) collapses exactly the characters Python would.  Valid in RE2 too.
WS_CLASS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# Characters removed by cleaning: everything except word characters (Unicode
# letters, digits, underscore), the space, and . , ! ? $ % - ( ) / :
# (whitespace is already a single space at that point).
DROP_CLASS = r"[^\p{L}\p{N}_ .,!?$%\-()/:]"
SENTENCE_SPLIT = r"[.!?]+"
MIN_CLEAN_LENGTH = 10
MIN_SENTENCE_LENGTH = 20


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The same set as plain characters, for character-set trims (no regex).
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace
    (a character-set trim, no regex)."""
    return F.btrim(_col(c), F.lit(WS_CHARS))


def clean_text(c) -> Column:
    """Collapse whitespace, blank out symbols, strip; ``<= 10`` chars -> ''.

    Symbol removal inserts spaces that are not collapsed again (double spaces
    survive), and NULL/'' become ''.
    """
    t = F.regexp_replace(F.coalesce(_col(c), F.lit("")), f"{WS_CLASS}+", " ")
    t = F.trim(F.regexp_replace(t, DROP_CLASS, " "))
    # one use of ``t``: a length test beside it would clean every text twice
    return F.regexp_replace(t, rf"(?s)\A.{{0,{MIN_CLEAN_LENGTH}}}\z", "")


def split_sentences(c) -> Column:
    """Split on runs of ``.!?``, strip, keep pieces of >= 20 chars."""
    pieces = F.transform(F.split(_col(c), SENTENCE_SPLIT), lambda s: F.trim(s))
    return F.filter(pieces, lambda s: F.length(s) >= MIN_SENTENCE_LENGTH)


def word_count(c) -> Column:
    """Number of whitespace-separated tokens (cleaned text has only spaces)."""
    return F.regexp_count(F.coalesce(_col(c), F.lit("")), F.lit(r"[^ ]+"))


def terms_regex(terms) -> str:
    """One alternation of the literal terms: matches iff any term is a substring."""
    return "|".join(_re_escape(t) for t in terms)


def _re_escape(t: str) -> str:
    # Escape regex metacharacters; the result is valid for Java regex and RE2.
    return "".join("\\" + ch if ch in ".^$*+?()[]{}|\\-/" else ch for ch in t)


def section_texts(sentences: Column, section_terms: dict[str, list[str]],
                  sentences_lc: Column | None = None, text_lc: Column | None = None) -> dict[str, Column]:
    """Per section, concatenation of ``sentence + '. '`` for every kept
    sentence whose lower-cased form contains one of the section's terms.

    Multi-label (a sentence can go to several sections), sentence order kept.
    ``sentences`` must be the output of :func:`split_sentences`; pass the
    same split of the lower-cased text as ``sentences_lc`` so each sentence is
    lower-cased once, not once per section.  Membership is a literal substring
    test of the section's terms up to the first that is there.

    With ``text_lc`` (the lower-cased whole text) a section whose terms occur
    nowhere in the text is '' without visiting its sentences: a term inside a
    sentence is also inside the text, so the pre-check only skips work.
    """
    def matcher(terms):
        def any_in(x):
            hit = F.lit(not terms)
            for t in terms:
                hit = hit | x.contains(F.lit(t))
            return hit

        if sentences_lc is None:
            return lambda s: any_in(F.lower(s))
        return lambda s, i: any_in(F.get(sentences_lc, i))

    out = {}
    for name, terms in section_terms.items():
        hit = F.filter(sentences, matcher(terms))
        joined = F.array_join(F.transform(hit, lambda s: F.concat(s, F.lit(". "))), "")
        if text_lc is not None:
            present = None
            for t in terms:
                c = text_lc.contains(F.lit(t))
                present = c if present is None else present | c
            joined = F.when(present, joined).otherwise(F.lit(""))
        out[name] = joined
    return out


def truncate_label(c, limit: int, keep: int | None = None) -> Column:
    """``len > limit`` -> first ``keep`` (default ``limit``) chars + '...'."""
    c = _col(c)
    keep = limit if keep is None else keep
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, keep), F.lit("..."))).otherwise(c)


def deck_name_from_path(path) -> Column:
    """A2: basename with every lower-case '.pdf' removed."""
    base = F.element_at(F.split(_col(path), "/"), -1)
    return F.replace(base, F.lit(".pdf"), F.lit(""))


def title_case_dim(c) -> Column:
    """``a_b`` -> ``A B``."""
    return F.initcap(F.replace(_col(c), F.lit("_"), F.lit(" ")))
