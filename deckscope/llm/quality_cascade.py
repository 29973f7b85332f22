"""Quality rules as a short-circuit cascade, DataFrame functions only.

Every rule is a measure of a text and its words, and a condition that rejects.  On
a bounded, stored sample each rule is timed, and one aggregate counts which
rules reject together; the next rule is always the one that rejects most per
second of the rows that the rules before it leave.  A rule's measure is taken
only of rows that no earlier rule has rejected (``CASE`` ends at the first hit).
The sample decides nothing but the order: which rows are kept is the same for
every order.

Defined cases: null text has no words; empty text is one line without a word;
a row is judged by its own text alone, so repeated rows and null ids are kept
or dropped alike; other columns pass through under any name.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE_CLASS, SPACES, col, free_name, stored

MIN_WORDS, WINDOW, MAX_REPEAT_PCT = 20, 8, 30
#: A word has 3 to 10 letters on average; at most a symbol in ten words; at most 30 % of the characters in repeated
#: lines; a letter in half of the words.
MIN_MEAN, MAX_MEAN, MAX_SYMBOLS_PCT, MAX_DUP_LINES_PCT, MIN_LETTERS_PCT = 3, 10, 10, 30, 50
#: Rows of the sample that the order of the rules is estimated on, at most; rows that are enough to time a rule.
SAMPLE_ROWS, TIMED_ROWS = 1000, 100


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``x``, which is made once however often ``body`` names it.

    One expression, where a chain of columns would be made anew by each filter pushed down on it.
    """
    return F.get(F.transform(F.array(x), body), F.lit(0))


@dataclass(frozen=True)
class Rule:
    """``measure`` of (text, words), ``fails`` of (measure, text, words): rejects.

    ``unit`` (chars or words) and ``weight`` (nanoseconds a unit, roughly) give its cost where the sample is too small to time it.
    """

    name: str
    measured: str
    measure: Callable[[Column, Column], Column]
    fails: Callable[[Column, Column, Column], Column]
    unit: str
    weight: float


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more; windows are compared by hash, sorted, so neighbours tell."""

    def starts(s):
        same = lambda x, i: F.coalesce(x["h"] == F.get(s, i)["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

    def covered(p):
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x)

    def repeated(w):
        pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(pairs, lambda s: let(starts(s), covered)))

    def windows(h):
        return F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(window))))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < window, F.lit(0)).otherwise(let(hashes, lambda h: let(windows(h), repeated))).cast("long")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != ""), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def dup_line_chars(text: Column) -> Column:
    """Characters of the lines that :func:`dup_lines` counts."""
    chars = lambda x: F.char_length(F.array_join(x, ""))
    return let(F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != ""), lambda x: (chars(x) - chars(F.array_distinct(x))).cast("long"))


#: Measures that are told of every row beside those of the rules.
TOLD = (("n_dup_lines", lambda t, w: dup_lines(t)),)
#: Rules whose measures are told of every row, then rules whose measures only the cascade takes.
RULES = (
    Rule("few_words", "n_words", lambda t, w: F.size(w).cast("long"), lambda m, t, w: m < MIN_WORDS, "words", 1),
    Rule("mean_word", "word_chars", lambda t, w: F.char_length(F.array_join(w, "")).cast("long"), lambda m, t, w: (m < MIN_MEAN * F.size(w)) | (m > MAX_MEAN * F.size(w)), "chars", 1),
    Rule("symbols", "n_symbols", lambda t, w: (F.char_length(t) - F.char_length(F.regexp_replace(t, "[#*$%&|<>]", ""))).cast("long"), lambda m, t, w: 100 * m > MAX_SYMBOLS_PCT * F.size(w), "chars", 10),
    Rule("dup_lines", "", lambda t, w: dup_line_chars(t), lambda m, t, w: 100 * m > MAX_DUP_LINES_PCT * F.char_length(t), "chars", 3),
    Rule("repeats", "n_repeat_words", lambda t, w: repeat_words(w), lambda m, t, w: 100 * m > MAX_REPEAT_PCT * F.size(w), "words", 400),
    Rule("letters", "", lambda t, w: F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).cast("long"), lambda m, t, w: 100 * m < MIN_LETTERS_PCT * F.size(w), "words", 100),
)


def _of_words(text: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the text (null: empty) and its words."""
    return let(F.coalesce(text, F.lit("")), lambda t: let(F.filter(F.split(t, SPACE_CLASS + "+"), lambda x: x != ""), lambda w: body(t, w)))


def _seconds(part: DataFrame, what: Column) -> float:
    """The shorter of two runs of ``what`` over the sample."""
    found = []
    for _ in range(2):
        start = time.monotonic()
        part.agg(F.count_if(what)).first()
        found.append(time.monotonic() - start)
    return min(found)


def rule_order(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """The rules in the cascade's order: ``name, rejects`` (sampled rows that the rules before it leave), ``cost`` (seconds over the sample).

    Costs are measured; below ``TIMED_ROWS`` sampled rows they are the expected ones, and an empty table keeps the given order.
    """
    part = docs.select(col(text_col).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(8)) == 0).limit(sample_rows)
    part = stored(part, "quality-sample")
    fails = lambda r: _of_words(F.col("text"), lambda t, w: r.fails(r.measure(t, w), t, w))
    units = {"chars": lambda t, w: F.char_length(t), "words": lambda t, w: F.size(w)}
    names = [f"r{i}" for i in range(len(rules))]
    sizes = {u: _of_words(F.col("text"), f).cast("long").alias(u) for u, f in units.items()}
    seen = part.select(*(fails(r).alias(n) for r, n in zip(rules, names, strict=True)), *sizes.values())
    # a row for each set of rules that reject together: 2 ** rules at most, whatever the table's size
    sets = [r.asDict() for r in seen.groupBy(*names).agg(F.count("*").alias("rows"), *(F.sum(u).alias(u) for u in units)).collect()]
    if sum(s["rows"] for s in sets) < TIMED_ROWS:
        cost = [sum(s[r.unit] for s in sets) * r.weight * 1e-9 for r in rules]
    else:
        nothing = _seconds(part, _of_words(F.col("text"), lambda t, w: F.size(w) < 0))  # the job, reading and splitting into words
        cost = [max(_seconds(part, fails(r)) - nothing, 0.0) for r in rules]
    out, left = [], list(range(len(rules)))
    while left:
        rejects = {i: sum(s["rows"] for s in sets if s[names[i]]) for i in left}
        best = max(left, key=lambda i: (rejects[i] + 0.5) / (cost[i] + 1e-3))
        out.append({"name": rules[best].name, "rejects": rejects[best], "cost": cost[best]})
        sets = [s for s in sets if not s[names[best]]]
        left.remove(best)
    return out


def verdict(text: Column, order: list[str], rules: tuple[Rule, ...] = RULES) -> Column:
    """The first rule, in this order, that rejects the text, else empty."""
    by_name = {r.name: r for r in rules}

    def cascade(t, w):
        out = F.lit("")
        for r in (by_name[x] for x in reversed(order)):
            out = F.when(r.fails(r.measure(t, w), t, w), F.lit(r.name)).otherwise(out)
        return out

    return _of_words(text, cascade)


def judge(docs: DataFrame, text_col: str = "text", *, order: list[str] | None = None, rules: tuple[Rule, ...] = RULES, rejected: str = "rejected_by") -> DataFrame:
    """``docs`` with all told measures (``n_words`` ...) and ``rejected``: the first rule in the cascade's order that rejects the row, else empty.

    They take the place of columns of their names.  A rule whose measure is not
    told takes it only of rows that the rules before it leave.
    """
    order = order or [x["name"] for x in rule_order(docs, text_col, rules)]
    by_name = {r.name: r for r in rules}
    shown = [(r.measured, r.measure) for r in rules if r.measured] + list(TOLD)

    def told(t, w):
        def fails(m, r):
            return r.fails(m[r.measured] if r.measured else r.measure(t, w), t, w)

        return let(F.struct(*(f(t, w).alias(n) for n, f in shown)), lambda m: F.struct(
            *(m[n].alias(n) for n, _ in shown), F.coalesce(*(F.when(fails(m, by_name[x]), F.lit(x)) for x in order), F.lit("")).alias(rejected)))

    all_of, new = free_name(docs.columns, "measures"), {rejected.lower(), *(n for n, _ in shown)}
    return docs.withColumn(all_of, _of_words(col(text_col), told)).select(*(col(x) for x in docs.columns if x.lower() not in new), f"{all_of}.*")


def keep_good(docs: DataFrame, text_col: str = "text", *, order: list[str] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects."""
    order = order or [x["name"] for x in rule_order(docs, text_col, rules)]
    return docs.where(verdict(col(text_col), order, rules) == "")
