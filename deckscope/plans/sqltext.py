"""DuckDB SQL text for the oracle side of the correctness checks.

The oracle restates every rule in SQL, compiled from the same data tables
(term lists, specs, weights) as the Spark operators, so a lexicon change is
checked on both sides.  Nothing here runs on Spark.
"""

from __future__ import annotations

from deckscope import lexicons as L
from deckscope.functions.sentiment import DEFAULT_LEXICON, PUNCTUATION, SentimentLexicon
from deckscope.functions.text import DROP_CLASS, SENTENCE_SPLIT, WS_CHARS, WS_CLASS, terms_regex
from deckscope.sources.fixtures import DECK_PHRASES, PORTFOLIO_CATEGORIES, PORTFOLIO_RULES


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def num(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def strip_ws(t: str) -> str:
    return f"trim({t}, {q(WS_CHARS)})"


def clean(t: str) -> str:
    inner = (f"trim(regexp_replace(regexp_replace(coalesce({t}, ''), {q(WS_CLASS + '+')}, ' ', 'g'), "
             f"{q(DROP_CLASS)}, ' ', 'g'))")
    return f"(CASE WHEN length({inner}) > 10 THEN {inner} ELSE '' END)"


def sentences(t: str) -> str:
    return (f"list_filter(list_transform(string_split_regex({t}, {q(SENTENCE_SPLIT)}), lambda s: trim(s)), "
            f"lambda s: length(s) >= 20)")


def section(sents: str, terms) -> str:
    pat = q(terms_regex(terms))
    return (f"array_to_string(list_transform(list_filter({sents}, lambda s: regexp_matches(lower(s), {pat})), "
            f"lambda s: s || '. '), '')")


def word_count(t: str) -> str:
    return f"CAST(len(regexp_extract_all(coalesce({t}, ''), '[^ ]+')) AS INTEGER)"


def distinct_hits(lc: str, terms) -> str:
    return "(" + " + ".join(f"(CASE WHEN contains({lc}, {q(t)}) THEN 1 ELSE 0 END)" for t in terms) + ")"


def regex_count(t: str, patterns) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({t}, {q(p)}))" for p in patterns) + ")"


def occurrences(lc: str, term: str) -> str:
    return f"CAST(floor((length({lc}) - length(replace({lc}, {q(term)}, ''))) / {len(term)}) AS BIGINT)"


def total_occurrences(lc: str, terms) -> str:
    return "(" + " + ".join(occurrences(lc, t) for t in terms) + ")"


# -- sentiment -----------------------------------------------------------------

def sent_keys(t: str) -> str:
    p = q(PUNCTUATION)
    toks = f"list_filter(string_split_regex(lower(coalesce({t}, '')), {q(WS_CLASS + '+')}), lambda x: x <> '')"
    return (f"list_transform({toks}, lambda x: CASE WHEN length(trim(x, {p})) <= 2 THEN x "
            f"ELSE trim(x, {p}) END)")


def sent_values(keys: str, lex: SentimentLexicon = DEFAULT_LEXICON) -> str:
    words = ", ".join(q(w) for w, _ in lex.entries)
    lookup = "CASE k " + " ".join(f"WHEN {q(w)} THEN {num(v)}" for w, v in lex.entries) + " END"
    up = ", ".join(q(w) for w in lex.boosters_up)
    down = ", ".join(q(w) for w in lex.boosters_down)
    neg = ", ".join(q(w) for w in lex.negators)

    def prev(d):
        return f"(CASE WHEN i - {d} >= 1 THEN {keys}[i - {d}] END)"

    def boost(d):
        w = prev(d)
        return (f"(CASE WHEN {w} IN ({up}) THEN {num(lex.booster_step)} WHEN {w} IN ({down}) "
                f"THEN {num(-lex.booster_step)} ELSE {num(0)} END)")

    def negate(d):
        return f"(CASE WHEN {prev(d)} IN ({neg}) THEN {num(lex.negation_scalar)} ELSE {num(1)} END)"

    v0 = f"({lookup})"
    sign = f"(CASE WHEN {v0} < 0 THEN {num(-1)} ELSE {num(1)} END)"
    v = v0
    for d in (1, 2, 3):
        v = f"({v} + (({boost(d)} * {sign}) * {num(lex.booster_decay[d - 1])}))"
    for d in (1, 2, 3):
        v = f"({v} * {negate(d)})"
    return (f"list_filter(list_transform({keys}, lambda k, i: CASE WHEN k IN ({words}) THEN {v} "
            f"ELSE {num(0)} END), lambda v: v <> 0)")


def sent_struct_fields(vals: str, n: str, lex: SentimentLexicon = DEFAULT_LEXICON) -> dict[str, str]:
    z = num(0)
    pos_sum = f"list_reduce({vals}, lambda a, v: a + CASE WHEN v > 0 THEN v + {num(1)} ELSE {z} END, {z})"
    neg_sum = f"list_reduce({vals}, lambda a, v: a + CASE WHEN v < 0 THEN v - {num(1)} ELSE {z} END, {z})"
    s = f"list_reduce({vals}, lambda a, v: a + v, {z})"
    neu = f"({n} - len({vals}))"
    total = f"({pos_sum} + abs({neg_sum}) + {neu})"

    def ratio(x):
        return f"(CASE WHEN {total} > 0 THEN abs({x} / {total}) ELSE {z} END)"

    return {
        "pos": ratio(pos_sum),
        "neg": ratio(neg_sum),
        "neu": ratio(f"CAST({neu} AS DOUBLE)"),
        "compound": f"(CASE WHEN {s} <> 0 THEN {s} / sqrt({s} * {s} + {num(lex.alpha)}) ELSE {z} END)",
    }


# -- fixtures --------------------------------------------------------------------

def decks_cte(source: str = "documents") -> str:
    phr = " || ".join(f"(CASE WHEN doc_id % {m} = {r} THEN {q(p)} ELSE '' END)" for _, p, m, r in DECK_PHRASES)
    return (f"SELECT doc_id, 'deck_' || CAST(doc_id AS VARCHAR) AS deck_name, "
            f"coalesce(text, '') || '. ' || {phr} AS text FROM {source}")


def documents_cte() -> str:
    return "SELECT doc_id, 'deck_' || CAST(doc_id AS VARCHAR) AS deck_name, text FROM documents"


def portfolio_cte() -> str:
    k = "c_custkey"
    cols = []
    for name, a, b, c, m in PORTFOLIO_RULES:
        km = f"({k} % {m})"
        val = f"CAST((({km} * {km} * {a} + {km} * {b} + {c}) % {m}) % 101 AS DOUBLE) / {num(10)}"
        cols.append(f"CASE WHEN {k} % 97 = 0 THEN {num(0)} ELSE {val} END AS {name}")
    cats = "[" + ", ".join(q(c) for c in PORTFOLIO_CATEGORIES) + "]"
    base = (f"SELECT {k} AS deck_key, c_name AS deck_name, " + ", ".join(cols)
            + f", {cats}[CAST({k} % 8 + 1 AS INTEGER)] AS category FROM customer")
    total = " + ".join(f"{d} * {num(L.SCORING_WEIGHTS[d])}" for d in L.DIMENSIONS)
    return (f"SELECT *, CASE WHEN deck_key % 89 = 3 THEN least({num(10)}, ({total}) + {num(3)}) "
            f"ELSE ({total}) END AS composite_score FROM ({base})")


def hard_portfolio_cte() -> str:
    no_score = f"deck_key % 7 = 0 OR category = {q(PORTFOLIO_CATEGORIES[-1])}"
    return (f"SELECT * REPLACE (CASE WHEN NOT ({no_score}) THEN composite_score END AS composite_score, "
            f"CASE WHEN deck_key % 6 <> 0 THEN market_potential END AS market_potential, "
            f"CASE WHEN deck_key % 5 <> 0 THEN category END AS category, "
            f"'Deck ' || CAST(deck_key // 3 AS VARCHAR) AS deck_name) FROM ({portfolio_cte()})")


def history_cte() -> str:
    return (f"SELECT o.o_orderkey AS analysis_id, p.*, CAST(o.o_orderdate AS TIMESTAMP) AS timestamp, "
            f"CAST(o.o_orderdate AS DATE) AS analysis_date FROM orders o JOIN ({portfolio_cte()}) p "
            f"ON o.o_custkey = p.deck_key")


# -- the document plan ------------------------------------------------------------

def sectionized_cte(src: str) -> str:
    """doc_id, deck_name, text, full_text, word_count, one ``sec_<name>`` column per section."""
    secs = ", ".join(f"{section('_s', t)} AS sec_{name}" for name, t in L.SECTION_TERMS.items())
    inner = (f"SELECT *, {sentences('full_text')} AS _s, {word_count('full_text')} AS word_count "
             f"FROM (SELECT *, {clean('text')} AS full_text FROM ({src}))")
    return f"SELECT * EXCLUDE (_s) FROM (SELECT *, {secs} FROM ({inner}))"


def _src_col(src: str) -> str:
    return "full_text" if src == "full_text" else f"sec_{src}"


def with_sentiments(base: str, srcs, lex: SentimentLexicon = DEFAULT_LEXICON) -> str:
    """Wrap ``base`` adding ``_<field>_<src>`` columns for each source text."""
    q_ = base
    for s in srcs:
        keys = sent_keys(_src_col(s))
        vals = sent_values("_keys", lex)
        f = sent_struct_fields("_vals", "len(_keys)", lex)
        q_ = (f"SELECT * EXCLUDE (_keys, _vals), " + ", ".join(f"{expr} AS _{k}_{s}" for k, expr in f.items())
              + f" FROM (SELECT *, {vals} AS _vals FROM (SELECT *, {keys} AS _keys FROM ({q_})))")
    return q_


def dimension_sql(spec: dict) -> str:
    src = _src_col(spec["source"])
    lc = f"lower(coalesce({src}, ''))"
    total = None
    for comp in spec["components"]:
        kind = comp["kind"]
        text = lc if comp.get("case") == "lower" else src
        if kind == "terms":
            v = f"least({distinct_hits(lc, comp['terms'])} * {num(comp['weight'])}, {num(comp['cap'])})"
        elif kind == "regex":
            v = f"least({regex_count(text, comp['patterns'])} * {num(comp['weight'])}, {num(comp['cap'])})"
        elif kind == "regex_gt":
            n = (f"len(list_filter(regexp_extract_all({text}, {q(comp['pattern'])}, 1), "
                 f"lambda v: CAST(v AS DOUBLE) > {num(comp['threshold'])}))")
            v = f"least({n} * {num(comp['weight'])}, {num(comp['cap'])})"
        elif kind in ("neg", "pos"):
            v = f"least(abs(_{kind}_{spec['source']}) * {num(comp['factor'])}, {num(comp['cap'])})"
        elif kind == "length":
            words = f"len(regexp_extract_all({src}, '[^ ]+'))"
            v = f"least({words} / {comp['per']} * {num(comp['scale'])}, {num(comp['cap'])})"
        else:
            raise ValueError(kind)
        term = f"({v} * {num(comp['coef'])})"
        total = term if total is None else f"({total} + {term})"
    return (f"(CASE WHEN length(trim(coalesce({src}, ''))) < {spec['guard']} THEN {num(0)} "
            f"ELSE least({total}, {num(10)}) END)")


def composite_sql() -> str:
    total = None
    for d in L.DIMENSIONS:
        t = f"({d} * {num(L.SCORING_WEIGHTS[d])})"
        total = t if total is None else f"({total} + {t})"
    return total


def scored_cte(src: str, extra_sentiments=()) -> str:
    base = sectionized_cte(src)
    need = ["problem", "full_text"] + [s for s in extra_sentiments if s not in ("problem", "full_text")]
    base = with_sentiments(base, need)
    dims = ", ".join(f"{dimension_sql(s)} AS {s['name']}" for s in L.DIMENSION_SPECS)
    return f"SELECT *, {composite_sql()} AS composite_score FROM (SELECT *, {dims} FROM ({base}))"


# -- language metrics ----------------------------------------------------------------

def language_cte(src: str) -> str:
    base = with_sentiments(sectionized_cte(src), L.SENTIMENT_SECTIONS)
    words = "list_filter(string_split(full_text, ' '), lambda w: w <> '')"
    sents = "list_filter(list_transform(string_split(full_text, '.'), lambda s: trim(s)), lambda s: s <> '')"
    inner = f"SELECT *, {words} AS _w, {sents} AS _d, lower(full_text) AS _lc FROM ({base})"
    short = "length(full_text) < 50"
    nw, ns = "len(_w)", "len(_d)"
    sent_words = ("list_reduce(list_transform(_d, lambda s: len(list_filter(string_split(s, ' '), "
                  "lambda w: w <> ''))), lambda a, x: a + x, 0)")
    chars = "list_reduce(list_transform(_w, lambda w: CAST(length(w) AS BIGINT)), lambda a, x: a + x, CAST(0 AS BIGINT))"
    raw = f"(({nw} / {ns}) * {num(1.015)} + ({chars} / {nw}) * {num(84.6)} - {num(206.835)})"
    has = f"({ns} > 0 AND {nw} > 0)"
    cols = [f"CASE WHEN NOT ({short}) AND length(sec_{s}) > 50 THEN _compound_{s} END AS {s}_sentiment"
            for s in L.SENTIMENT_SECTIONS]
    cols += [
        f"CASE WHEN {short} THEN {num(0)} ELSE {total_occurrences('_lc', L.CONFIDENCE_DENSITY_TERMS)} / {nw} * {num(1000)} END AS confidence_score",
        f"CASE WHEN {short} THEN {num(0)} ELSE {total_occurrences('_lc', L.TECH_DENSITY_TERMS)} / {nw} * {num(1000)} END AS tech_sophistication",
        f"CASE WHEN {short} OR {nw} = 0 THEN {num(0)} ELSE len(list_distinct(_w)) / {nw} END AS vocabulary_diversity",
        f"CASE WHEN {short} OR {ns} = 0 THEN {num(0)} ELSE {sent_words} / {ns} END AS avg_sentence_length",
        f"CASE WHEN {short} THEN {num(5)} WHEN NOT {has} THEN {num(0)} ELSE greatest({num(0)}, least({num(10)}, ({num(100)} - {raw}) / {num(10)})) END AS readability_score",
        f"CASE WHEN {short} OR NOT {has} THEN NULL ELSE {raw} END AS readability_raw",
    ]
    return f"SELECT * EXCLUDE (_w, _d, _lc), {', '.join(cols)} FROM ({inner})"


# -- enrichment fallbacks -------------------------------------------------------------

def classify_sql(full: str) -> str:
    lc = f"lower(coalesce({full}, ''))"
    scores = {c: distinct_hits(lc, ts) for c, ts in L.CATEGORY_TERMS.items()}
    best = "greatest(" + ", ".join(scores.values()) + ")"
    whens = " ".join(f"WHEN {s} = {best} THEN {q(c)}" for c, s in scores.items())
    return f"(CASE WHEN {best} = 0 THEN 'Other' {whens} END)"


def fallback_summary_sql() -> str:
    items = "[" + ", ".join(f"struct_pack(name := {q(n)}, text := sec_{k})" for k, n in L.SUMMARY_SECTIONS) + "]"
    kept = f"list_filter({items}, lambda x: length({strip_ws('coalesce(x.text, ' + chr(39) * 2 + ')')}) > 20)"
    lines = (f"list_transform({kept}, lambda x: '• ' || x.name || ': ' || CASE WHEN length(x.text) > 70 "
             f"THEN substr(x.text, 1, 70) || '...' ELSE x.text END)")
    pad = (f"CASE WHEN len(_lines) < 4 THEN list_transform(range(len(_lines) + 1, 5), "
           f"lambda k: printf({q(L.SUMMARY_PAD)}, k)) ELSE CAST([] AS VARCHAR[]) END")
    return lines, pad


def fallback_insight_sql(score: str, category: str) -> str:
    parts = []
    for lo, text in L.INSIGHT_TIERS:
        if lo == float("-inf"):
            parts.append(f"ELSE printf({q(text)}, {category})")
        else:
            parts.append(f"WHEN {score} >= {num(lo)} THEN printf({q(text)}, {category})")
    return "(CASE " + " ".join(parts) + " END)"


def enriched_cte(src: str) -> str:
    scored = scored_cte(src)
    lines, pad = fallback_summary_sql()
    n = "length(coalesce(full_text, ''))"
    step1 = f"SELECT *, {lines} AS _lines FROM ({scored})"
    step2 = (f"SELECT * EXCLUDE (_lines), CASE WHEN {n} < 50 THEN 'Other' ELSE {classify_sql('full_text')} END AS category, "
             f"CASE WHEN {n} < 100 THEN {q(L.SUMMARY_SHORT)} ELSE array_to_string(list_concat(_lines, {pad}), chr(10)) END AS summary, "
             f"CASE WHEN {n} < 100 THEN {q(L.COMPETITIVE_SHORT)} ELSE {q(L.COMPETITIVE_MISSING)} END AS competitive_analysis "
             f"FROM ({step1})")
    return f"SELECT *, {fallback_insight_sql('composite_score', 'category')} AS investability_insight FROM ({step2})"


# -- portfolio helpers ----------------------------------------------------------------

def np_round(x: str, d: int) -> str:
    return f"(round_even(({x}) * {num(10 ** d)}, 0) / {num(10 ** d)})"


def erf(x: str) -> str:
    from deckscope.functions.mathx import ERF_A, ERF_P
    ax = f"abs({x})"
    t = f"({num(1)} / ({num(1)} + {num(ERF_P)} * {ax}))"
    poly = num(ERF_A[4])
    for a in reversed(ERF_A[:4]):
        poly = f"({poly} * {t} + {num(a)})"
    y = f"({num(1)} - {poly} * {t} * exp(-({ax} * {ax})))"
    return f"(CASE WHEN {x} < 0 THEN -{y} ELSE {y} END)"


def normal_cdf(x: str, mean: str, sd: str) -> str:
    import math
    return f"({num(0.5)} * ({num(1)} + {erf(f'(({x}) - ({mean})) / (({sd}) * {num(math.sqrt(2.0))})')}))"


def initcap_words(x: str) -> str:
    return (f"array_to_string(list_transform(string_split({x}, ' '), "
            f"lambda w: upper(w[1]) || lower(w[2:])), ' ')")


def benchmark_values() -> str:
    rows = ", ".join("(" + ", ".join([q(r[0])] + [num(v) for v in r[1:]]) + ")" for r in L.INDUSTRY_BENCHMARKS)
    cols = ", ".join(["category"] + [f"b_{c}" for c in L.BENCHMARK_COLUMNS])
    return f"(SELECT * FROM (VALUES {rows}) AS t({cols}))"
