"""DuckDB oracle statements, one per registered query key."""

from __future__ import annotations

from deckscope import lexicons as L
from deckscope.plans import sqltext as S

ORACLE: dict[str, str] = {}


def oracle(name):
    def deco(fn):
        ORACLE[name] = fn()
        return fn
    return deco


def _secs_flat() -> str:
    return ", ".join(f"sec_{s}" for s in L.SECTIONS)


@oracle("clean_documents")
def _clean_documents():
    return (f"SELECT doc_id, full_text, {S.word_count('full_text')} AS word_count, "
            f"CAST(len({S.sentences('full_text')}) AS INTEGER) AS n_sentences "
            f"FROM (SELECT doc_id, {S.clean('text')} AS full_text FROM documents)")


@oracle("section_routing")
def _section_routing():
    return f"SELECT doc_id, word_count, {_secs_flat()} FROM ({S.sectionized_cte(S.decks_cte())})"


@oracle("error_routing")
def _error_routing():
    ext = S.strip_ws("coalesce(text, '')")
    return (f"SELECT doc_id, deck_name, printf('Could not extract sufficient text (got %d chars, need %d+)', "
            f"length({ext}), {L.MIN_TEXT_LENGTH}) AS error FROM ({S.documents_cte()}) "
            f"WHERE length({ext}) < {L.MIN_TEXT_LENGTH}")


def _scores_select(src: str) -> str:
    dims = ", ".join(L.DIMENSIONS)
    return f"SELECT doc_id, deck_name, {dims}, composite_score FROM ({S.scored_cte(src)})"


@oracle("score_decks")
def _score_decks():
    return _scores_select(S.decks_cte())


@oracle("score_documents")
def _score_documents():
    return _scores_select(S.documents_cte())


@oracle("sentiment_sections")
def _sentiment_sections():
    cols = ", ".join(f"_{k}_{src} AS {k}_{src}" for src in ("problem", "full_text")
                     for k in ("pos", "neg", "neu", "compound"))
    return f"SELECT doc_id, {cols} FROM ({S.with_sentiments(S.sectionized_cte(S.decks_cte()), ['problem', 'full_text'])})"


@oracle("language_metrics")
def _language_metrics():
    sents = ", ".join(f"{s}_sentiment" for s in L.SENTIMENT_SECTIONS)
    return (f"SELECT doc_id, {sents}, confidence_score, tech_sophistication, vocabulary_diversity, "
            f"avg_sentence_length, readability_score, readability_raw FROM ({S.language_cte(S.decks_cte())})")


@oracle("enrich_decks")
def _enrich_decks():
    return (f"SELECT doc_id, category, summary, investability_insight, competitive_analysis "
            f"FROM ({S.enriched_cte(S.decks_cte())})")


# == portfolio family ==================================================================

DIMS = L.DIMENSIONS


def _p() -> str:
    return f"WITH p AS ({S.portfolio_cte()}) "


def r6(x: str) -> str:
    return f"round({x}, 6)"


@oracle("portfolio_stats")
def _portfolio_stats():
    c = "composite_score"
    return (_p() + f"SELECT count({c}) AS n, {r6(f'avg({c})')} AS mean, {r6(f'stddev_samp({c})')} AS std, "
            f"{r6(f'median({c})')} AS median, {r6(f'min({c})')} AS min, {r6(f'max({c})')} AS max FROM p")


@oracle("dimension_averages")
def _dimension_averages():
    avgs = ", ".join(f"avg({d}) AS {d}" for d in DIMS)
    return (_p() + f"SELECT dimension, {r6('average')} AS average FROM (UNPIVOT (SELECT {avgs} FROM p) "
            f"ON {', '.join(DIMS)} INTO NAME dimension VALUE average)")


@oracle("category_distribution")
def _category_distribution():
    return (_p() + "SELECT category, count, " + r6("count / total * CAST(100.0 AS DOUBLE)") + " AS percent FROM "
            "(SELECT category, count(*) AS count FROM p GROUP BY category ORDER BY count DESC, category LIMIT 5), "
            "(SELECT count(*) AS total FROM p)")


@oracle("category_stats")
def _category_stats():
    n = S.np_round
    return (_p() + f"SELECT category, {n('avg(composite_score)', 2)} AS avg_score, "
            f"{n('median(composite_score)', 2)} AS median_score, count(*) AS count, "
            f"{n('stddev_samp(composite_score)', 2)} AS std_score, {n('avg(problem_clarity)', 2)} AS avg_problem, "
            f"{n('avg(market_potential)', 2)} AS avg_market, {n('avg(traction_strength)', 2)} AS avg_traction "
            f"FROM p GROUP BY category")


@oracle("portfolio_composition")
def _portfolio_composition():
    avgs = [f"avg({d})" for d in DIMS]
    g = f"greatest({', '.join(avgs)})"
    lo = f"least({', '.join(avgs)})"
    strongest = "CASE " + " ".join(f"WHEN {a} = {g} THEN {S.q(d)}" for a, d in zip(avgs, DIMS)) + " END"
    weakest = "CASE " + " ".join(f"WHEN {a} = {lo} THEN {S.q(d)}" for a, d in zip(avgs, DIMS)) + " END"
    c = "composite_score"
    return (_p() + f"SELECT count(*) AS total_analyzed, {r6(f'avg({c})')} AS average_quality, "
            f"count(*) FILTER (WHERE {c} >= 7) AS investment_ready, "
            f"count(*) FILTER (WHERE {c} >= 5 AND {c} < 7) AS needs_development, "
            f"count(*) FILTER (WHERE {c} < 5) AS significant_work_needed, "
            f"count(DISTINCT category) AS category_diversity, {strongest} AS strongest_dimension, "
            f"{weakest} AS weakest_dimension, {r6(f'stddev_samp({c})')} AS score_variance FROM p")


@oracle("portfolio_risk")
def _portfolio_risk():
    return (_p() + "SELECT CASE WHEN conc > 60 THEN 'High' WHEN conc > 40 THEN 'Medium' ELSE 'Low' END AS concentration_risk, "
            "CASE WHEN low > 40 THEN 'High' WHEN low > 20 THEN 'Medium' ELSE 'Low' END AS quality_risk, "
            "CASE WHEN trac < 4 THEN 'High' WHEN trac < 6 THEN 'Medium' ELSE 'Low' END AS execution_risk FROM ("
            "SELECT top / total * CAST(100.0 AS DOUBLE) AS conc, low / total * CAST(100.0 AS DOUBLE) AS low, trac FROM "
            "(SELECT count(*) AS total, count(*) FILTER (WHERE composite_score < 5) AS low, "
            "avg(traction_strength) AS trac FROM p), "
            "(SELECT max(n) AS top FROM (SELECT count(*) AS n FROM p GROUP BY category)))")


@oracle("market_trends")
def _market_trends():
    five = ["problem_clarity", "market_potential", "traction_strength", "team_experience", "business_model"]
    avgs = ", ".join(f"avg({d}) AS {d}" for d in five)
    return (_p() + ", bc AS (SELECT category, avg(composite_score) AS c, avg(market_potential) AS m FROM p GROUP BY category), "
            "n AS (SELECT count(*) AS n FROM p) "
            "SELECT trend, name, " + r6("value") + " AS value FROM ("
            "(SELECT 'top_performing_categories' AS trend, category AS name, c AS value FROM bc ORDER BY c DESC, category LIMIT 3) "
            "UNION ALL (SELECT 'highest_market_potential_categories', category, m FROM bc ORDER BY m DESC, category LIMIT 3)) "
            "WHERE (SELECT n FROM n) > 1 "
            "UNION ALL SELECT 'dimension_strengths' AS trend, name, " + r6("value") + f" FROM (UNPIVOT (SELECT {avgs} FROM p) "
            f"ON {', '.join(five)} INTO NAME name VALUE value)")


def _bench_cmp() -> str:
    pct = f"least({S.num(99)}, greatest({S.num(1)}, {S.normal_cdf('composite_score', 'b_composite_score', S.num(L.BENCHMARK_SD))} * {S.num(100)}))"
    return (f"SELECT deck_name, category, composite_score - b_composite_score AS composite_vs_benchmark, "
            f"market_potential - b_market_potential AS market_vs_benchmark, "
            f"traction_strength - b_traction_strength AS traction_vs_benchmark, "
            f"team_experience - b_team_experience AS team_vs_benchmark, {pct} AS percentile_rank, "
            f"category AS benchmark_category, CASE WHEN composite_score > b_composite_score THEN 'Above' "
            f"ELSE 'Below' END AS overall_vs_industry FROM p JOIN {S.benchmark_values()} b USING (category)")


@oracle("benchmark_comparison")
def _benchmark_comparison():
    return (_p() + f"SELECT * EXCLUDE (percentile_rank), {r6('percentile_rank')} AS percentile_rank, "
            f"abs(composite_vs_benchmark) AS marker_size FROM ({_bench_cmp()})")


@oracle("benchmark_summary")
def _benchmark_summary():
    g = "composite_vs_benchmark"
    return (_p() + f", cmp AS ({_bench_cmp()}) SELECT count(*) AS total_with_benchmarks, "
            f"count(*) FILTER (WHERE {g} > 1) AS outperformers, count(*) FILTER (WHERE {g} < -1) AS underperformers, "
            f"count(*) FILTER (WHERE {g} > 0) AS above_benchmark, {r6(f'avg({g})')} AS avg_vs_benchmark, "
            f"(SELECT deck_name FROM cmp ORDER BY {g} DESC, deck_name LIMIT 1) AS best_deck, "
            f"(SELECT {g} FROM cmp ORDER BY {g} DESC, deck_name LIMIT 1) AS best_vs_benchmark, "
            f"coalesce(string_agg(DISTINCT category, ',' ORDER BY category), '') AS categories_analyzed, "
            f"CASE WHEN count(*) = 0 THEN 'No benchmark data available' END AS message FROM cmp")


@oracle("executive_summary")
def _executive_summary():
    n = S.np_round
    c = "composite_score"
    f2 = lambda x, d: f"printf('%.{d}f', {n(x, d)})"
    text = ("'EXECUTIVE SUMMARY' || chr(10) || 'Analysis of ' || CAST(n_decks AS VARCHAR) || "
            "' pitch decks completed with an average composite score of ' || " + f2("avg_score", 2) + " || '/10.' || chr(10) || "
            "'TOP PERFORMER: ' || top_deck || ' (' || " + f2("top_score", 2) + " || '/10)' || chr(10) || "
            "'NEEDS IMPROVEMENT: ' || bottom_deck || ' (' || " + f2("bottom_score", 2) + " || '/10)' || chr(10) || "
            "'High performers (7+ score): ' || CAST(high_performers AS VARCHAR) || ' decks (' || " + f2("high_pct", 1)
            + " || '%)' || chr(10) || 'Needs improvement (<5 score): ' || CAST(low_performers AS VARCHAR) || ' decks (' || "
            + f2("low_pct", 1) + " || '%)' || chr(10) || 'Most common category: ' || coalesce(top_category, 'Unknown') || "
            "'.' || chr(10) || 'Average problem clarity: ' || " + f2("ap", 1) + " || '/10' || chr(10) || "
            "'Average market potential: ' || " + f2("am", 1) + " || '/10' || chr(10) || "
            "'Average traction strength: ' || " + f2("atr", 1) + " || '/10'")
    inner = (f"SELECT count(*) AS n_decks, avg({c}) AS avg_score, "
             f"(SELECT deck_name FROM p ORDER BY {c} DESC, deck_name LIMIT 1) AS top_deck, max({c}) AS top_score, "
             f"(SELECT deck_name FROM p ORDER BY {c} ASC, deck_name LIMIT 1) AS bottom_deck, min({c}) AS bottom_score, "
             f"(SELECT category FROM p GROUP BY category ORDER BY count(*) DESC, category LIMIT 1) AS top_category, "
             f"count(*) FILTER (WHERE {c} >= 7) AS high_performers, count(*) FILTER (WHERE {c} < 5) AS low_performers, "
             f"avg(problem_clarity) AS ap, avg(market_potential) AS am, avg(traction_strength) AS atr FROM p")
    mid = (f"SELECT *, high_performers / n_decks * {S.num(100)} AS high_pct, "
           f"low_performers / n_decks * {S.num(100)} AS low_pct FROM ({inner})")
    return (_p() + f"SELECT n_decks, {r6('avg_score')} AS avg_score, top_deck, top_score, bottom_deck, bottom_score, "
            f"top_category, high_performers, {r6('high_pct')} AS high_pct, low_performers, {r6('low_pct')} AS low_pct, "
            f"{text} AS summary_text FROM ({mid})")


@oracle("batch_summary")
def _batch_summary():
    c = "composite_score"
    return (_p() + f"SELECT count(*) AS total_decks, {r6(f'avg({c})')} AS portfolio_avg, "
            f"count(*) FILTER (WHERE {c} >= 7) AS investment_ready, count(DISTINCT category) AS categories, "
            f"max({c}) AS top_score FROM p")


@oracle("category_performance")
def _category_performance():
    return _p() + f"SELECT category, {r6('avg(composite_score)')} AS mean, count(composite_score) AS count FROM p GROUP BY category"


@oracle("correlation_matrix")
def _correlation_matrix():
    dims = [*DIMS, "composite_score"]
    parts = []
    for i, a in enumerate(dims):
        for b in dims[i + 1:]:
            parts.append(f"SELECT {S.q(a)} AS dim_a, {S.q(b)} AS dim_b, {r6(f'corr({a}, {b})')} AS corr FROM p")
            parts.append(f"SELECT {S.q(b)} AS dim_a, {S.q(a)} AS dim_b, {r6(f'corr({a}, {b})')} AS corr FROM p")
    for d in dims:
        parts.append(f"SELECT {S.q(d)} AS dim_a, {S.q(d)} AS dim_b, CAST(1.0 AS DOUBLE) AS corr")
    return _p() + " UNION ALL ".join(parts)


@oracle("score_histogram")
def _score_histogram():
    dims = [*DIMS, "composite_score"]
    long = " UNION ALL ".join(f"SELECT {S.q(d)} AS \"column\", {d} AS value FROM p WHERE {d} IS NOT NULL" for d in dims)
    w = "((hi - lo) / bins)"
    b = f"CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((value - lo) / {w}), bins - 1) END AS INTEGER)"
    return (_p() + f", l AS ({long}), r AS (SELECT \"column\", min(value) AS lo, max(value) AS hi, "
            f"CAST(least(10, count(*)) AS INTEGER) AS bins FROM l GROUP BY \"column\") "
            f"SELECT \"column\", bin, {r6(f'lo + bin * {w}')} AS bin_lo, {r6(f'lo + (bin + 1) * {w}')} AS bin_hi, count "
            f"FROM (SELECT \"column\", {b} AS bin, lo, hi, bins, count(*) AS count FROM l JOIN r USING (\"column\") "
            f"GROUP BY ALL)")


def _tier(c: str) -> str:
    return (f"CASE WHEN {c} > 0 AND {c} <= 4 THEN 'Needs Work' WHEN {c} > 4 AND {c} <= 7 THEN 'Promising' "
            f"WHEN {c} > 7 AND {c} <= 10 THEN 'Investment Ready' END")


@oracle("tier_hierarchy")
def _tier_hierarchy():
    return (_p() + "SELECT CASE WHEN g = 3 THEN 'Total' WHEN g = 1 THEN category ELSE category || '-' || tier END AS id, "
            "CASE WHEN g = 3 THEN 'Portfolio' WHEN g = 1 THEN category ELSE tier END AS label, "
            "CASE WHEN g = 3 THEN '' WHEN g = 1 THEN 'Total' ELSE category END AS parent, value FROM ("
            f"SELECT category, tier, count(*) AS value, GROUPING(category, tier) AS g FROM "
            f"(SELECT category, {_tier('composite_score')} AS tier FROM p) GROUP BY ROLLUP (category, tier)) "
            "WHERE NOT (g = 0 AND tier IS NULL)")


@oracle("distinct_categories")
def _distinct_categories():
    return _p() + "SELECT DISTINCT category FROM p"


@oracle("derived_features")
def _derived_features():
    total = " + ".join(DIMS)
    mean = f"(({total}) / {S.num(7)})"
    ss = " + ".join(f"(({d} - m) * ({d} - m))" for d in DIMS)
    return (_p() + f"SELECT deck_name, market_potential / (traction_strength + {S.num(0.1)}) AS market_traction_ratio, "
            f"(team_experience + traction_strength) / {S.num(2)} AS team_execution_score, "
            f"(business_model + problem_clarity) / {S.num(2)} AS business_clarity_score, m AS overall_strength, "
            f"({ss}) / {S.num(6)} AS score_variance FROM (SELECT *, {mean} AS m FROM p)")


@oracle("risk_factors")
def _risk_factors():
    from deckscope.operators.portfolio import RISK_FACTORS
    return _p() + " UNION ALL ".join(
        f"SELECT deck_name, {S.q(n)} AS factor, {S.num(10)} - {c} AS risk FROM p" for n, c in RISK_FACTORS)


@oracle("due_diligence_flags")
def _due_diligence_flags():
    mean5 = f"((problem_clarity + market_potential + traction_strength + team_experience + business_model) / {S.num(5)})"
    rules = [
        f"CASE WHEN team_experience < 4 AND market_potential > 8 THEN {S.q(L.FLAG_TEAM_MARKET)} END",
        f"CASE WHEN traction_strength > 7 AND business_model < 5 THEN {S.q(L.FLAG_TRACTION_MODEL)} END",
        f"CASE WHEN problem_clarity < 4 AND overall_confidence > 7 THEN {S.q(L.FLAG_CONFIDENCE_PROBLEM)} END",
        f"CASE WHEN abs(composite_score - {mean5}) > 2 THEN {S.q(L.FLAG_INCONSISTENT)} END",
    ]
    fl = f"list_filter([{', '.join(rules)}], lambda x: x IS NOT NULL)"
    return (_p() + f"SELECT deck_name, composite_score, CAST(len(f) AS INTEGER) AS n_flags, array_to_string(f, ' | ') AS flags "
            f"FROM (SELECT deck_name, composite_score, {fl} AS f FROM p) WHERE len(f) > 0")


@oracle("recommendations")
def _recommendations():
    cat = "coalesce(category, 'Unknown')"
    cat_s = "coalesce(category, 'startup')"
    c = "composite_score"
    area = "CASE WHEN market_potential >= 8 THEN 'market potential' ELSE 'traction' END"
    return (_p() + f", s AS (SELECT 'STRONG_BUY' AS type, deck_name AS deck, {c} AS score, {cat} AS category, "
            f"printf({S.q(L.REASON_STRONG_BUY)}, {cat_s}) AS reasoning, 'HIGH' AS confidence, 1 AS priority "
            f"FROM p ORDER BY {c} DESC, deck_name LIMIT 3), "
            f"g AS (SELECT 'CONSIDER' AS type, deck_name AS deck, {c} AS score, {cat} AS category, "
            f"printf({S.q(L.REASON_CONSIDER)}, {area}, {cat_s}) AS reasoning, 'MEDIUM' AS confidence, 2 AS priority "
            f"FROM p WHERE {c} >= 6 AND {c} < 7 AND (market_potential >= 8 OR traction_strength >= 8) "
            f"AND deck_name NOT IN (SELECT deck FROM s)), "
            f"w AS (SELECT 'WATCH' AS type, deck_name AS deck, {c} AS score, {cat} AS category, "
            f"{S.q(L.REASON_WATCH)} AS reasoning, 'LOW' AS confidence, 3 AS priority FROM p "
            f"WHERE {c} >= 4 AND {c} < 6 AND team_experience >= 7 AND deck_name NOT IN (SELECT deck FROM s) "
            f"AND deck_name NOT IN (SELECT deck FROM g)) "
            f"SELECT * FROM s UNION ALL SELECT * FROM g UNION ALL SELECT * FROM w")


@oracle("score_bands")
def _score_bands():
    c = "composite_score"
    return (_p() + f"SELECT deck_name, {c}, {_tier(c)} AS performance_tier, "
            f"concat_ws(' / ', CASE WHEN market_potential >= 5 THEN 'High Market' ELSE 'Low Market' END, "
            f"CASE WHEN traction_strength >= 5 THEN 'High Execution' ELSE 'Low Execution' END) AS quadrant, "
            f"CASE WHEN {c} >= 7 THEN 'score-good' WHEN {c} >= 5 THEN 'score-medium' ELSE 'score-poor' END AS score_class, "
            f"CASE WHEN {c} < 4 THEN '0-4' WHEN {c} < 7 THEN '4-7' ELSE '7-10' END AS gauge_band, "
            f"{c} - {S.num(7)} AS delta_to_7, least({c} * {S.num(10)}, {S.num(100)}) AS bar_width, "
            f"CASE WHEN {c} >= 7 THEN 'high' WHEN {c} >= 5 THEN 'medium' ELSE 'low' END AS band FROM p")


def _summary_table() -> str:
    n = S.np_round
    rounded = ", ".join(f"{n(d, 2)} AS {d}" for d in DIMS)
    return (f"SELECT CAST(rank() OVER (ORDER BY composite_score DESC) AS BIGINT) AS rank, deck_name, composite_score, "
            f"{', '.join(DIMS)}, category FROM (SELECT deck_name, {n('composite_score', 2)} AS composite_score, "
            f"{rounded}, category FROM p)")


@oracle("summary_table")
def _summary_table_q():
    return _p() + _summary_table()


@oracle("top_performers")
def _top_performers():
    return _p() + f"SELECT * FROM ({_summary_table()}) ORDER BY composite_score DESC, deck_name LIMIT 3"


@oracle("bottom_performers")
def _bottom_performers():
    return (_p() + f"SELECT * EXCLUDE (_rn, _n) FROM (SELECT *, row_number() OVER (ORDER BY composite_score ASC, "
            f"deck_name DESC) AS _rn, count(*) OVER () AS _n FROM ({_summary_table()})) "
            f"WHERE _n > 3 AND _rn <= least(3, _n - 3)")


@oracle("ranking_chart")
def _ranking_chart():
    label = "CASE WHEN length(deck_name) > 30 THEN substr(deck_name, 1, 30) || '...' ELSE deck_name END"
    return (_p() + f"SELECT {label} AS label, composite_score, CAST({S.np_round('composite_score', 1)} AS VARCHAR) AS text "
            f"FROM (SELECT * FROM p ORDER BY composite_score DESC, deck_name LIMIT 15)")


@oracle("argmax_argmin")
def _argmax_argmin():
    return (_p() + "SELECT t.deck_name AS top_deck, t.composite_score AS top_score, b.deck_name AS bottom_deck, "
            "b.composite_score AS bottom_score FROM (SELECT * FROM p ORDER BY composite_score DESC, deck_name LIMIT 1) t, "
            "(SELECT * FROM p ORDER BY composite_score ASC, deck_name LIMIT 1) b")


@oracle("vs_reference_vector")
def _vs_reference_vector():
    ref = ", ".join(f"({S.q(d)}, {S.num(v)})" for d, v in zip(DIMS, L.INDUSTRY_AVERAGE))
    label = S.initcap_words("replace(dimension, '_', ' ')")
    return (_p() + f"SELECT deck_name, dimension, {label} AS label, score, "
            f"industry_avg, score - industry_avg AS gap FROM (UNPIVOT (SELECT deck_name, {', '.join(DIMS)} FROM p) "
            f"ON {', '.join(DIMS)} INTO NAME dimension VALUE score) JOIN (VALUES {ref}) AS r(dimension, industry_avg) "
            f"USING (dimension)")


# == history, charts, casts, parsing, diagnosis ===========================================

def _h() -> str:
    return f"WITH h AS ({S.history_cte()}) "


@oracle("analysis_number")
def _analysis_number():
    return (_h() + "SELECT analysis_id, deck_name, composite_score, row_number() OVER "
            "(ORDER BY timestamp, deck_name, analysis_id) AS analysis_number FROM h")


@oracle("timeline_frames")
def _timeline_frames():
    return (_h() + "SELECT CAST(dense_rank() OVER (ORDER BY analysis_date) AS INTEGER) AS frame, "
            "strftime(analysis_date, '%Y-%m-%d') AS analysis_date, deck_name, "
            "market_potential AS x, traction_strength AS y, composite_score AS size, category FROM ("
            "SELECT *, row_number() OVER (PARTITION BY analysis_date, deck_name ORDER BY timestamp DESC, analysis_id DESC) AS rn "
            "FROM h) WHERE rn = 1")


ORACLE["history_numbers"] = ORACLE["analysis_number"]
ORACLE["history_timeline"] = ORACLE["timeline_frames"]


@oracle("history_view")
def _history_view():
    return (_h() + "SELECT deck_name, composite_score, category, timestamp FROM h "
            "WHERE category = 'SaaS' AND composite_score >= 5.0")


def _cut(x: str, n: int, keep: int | None = None) -> str:
    keep = n if keep is None else keep
    return f"(CASE WHEN length({x}) > {n} THEN substr({x}, 1, {keep}) || '...' ELSE {x} END)"


@oracle("radar_rows")
def _radar_rows():
    pts = [(i, d) for i, d in enumerate(DIMS)] + [(len(DIMS), DIMS[0])]
    parts = " UNION ALL ".join(f"SELECT {_cut('deck_name', 25, 22)} AS deck_label, deck_name, {i} AS point, "
                               f"{S.q(d)} AS dimension, {d} AS value FROM t" for i, d in pts)
    return _p() + f", t AS (SELECT * FROM p ORDER BY composite_score DESC, deck_name LIMIT 5) {parts}"


def _at_least(n: int) -> str:
    return f"(SELECT count(*) FROM p) >= {n}"


@oracle("scatter3d_rows")
def _scatter3d_rows():
    return (_p() + f"SELECT deck_name, market_potential AS x, traction_strength AS y, team_experience AS z, "
            f"composite_score * {S.num(2)} AS size, composite_score AS color FROM p WHERE {_at_least(2)}")


@oracle("parallel_rows")
def _parallel_rows():
    return _p() + f"SELECT deck_name, {', '.join(DIMS)}, composite_score AS color FROM p"


@oracle("matrix_rows")
def _matrix_rows():
    label = S.initcap_words("replace(dimension, '_', ' ')")
    return (_p() + f"SELECT {_cut('deck_name', 20)} AS deck_label, deck_name, {label} AS dimension, value FROM "
            f"(UNPIVOT (SELECT deck_name, {', '.join(DIMS)} FROM p WHERE {_at_least(2)}) ON {', '.join(DIMS)} "
            f"INTO NAME dimension VALUE value)")


def _quadrant(m: str, t: str) -> str:
    return (f"concat_ws(' / ', CASE WHEN {m} >= 5 THEN 'High Market' ELSE 'Low Market' END, "
            f"CASE WHEN {t} >= 5 THEN 'High Execution' ELSE 'Low Execution' END)")


@oracle("landscape_rows")
def _landscape_rows():
    return (_p() + f"SELECT category, deck_name, market_potential AS x, traction_strength AS y, "
            f"composite_score * {S.num(3)} AS size, {_quadrant('market_potential', 'traction_strength')} AS quadrant "
            f"FROM p WHERE {_at_least(2)}")


@oracle("normalize_results")
def _normalize_results():
    m = ("SELECT c_name AS deck_name, '$' || CAST(c_acctbal AS VARCHAR) AS composite_score, c_name AS problem_clarity, "
         "c_mktsegment AS market_potential, CAST(c_acctbal AS VARCHAR) AS traction_strength, "
         "concat_ws('.', CAST(c_nationkey AS VARCHAR), CAST(c_custkey % 10 AS VARCHAR), '5') AS team_experience, "
         "'-' || CAST(c_nationkey AS VARCHAR) || '-' AS business_model, CAST(NULL AS VARCHAR) AS vision_moat, "
         "c_acctbal AS overall_confidence, printf('%d words', c_nationkey) AS word_count, "
         "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS category FROM customer")

    def sf(x):
        return f"coalesce(TRY_CAST(regexp_replace({x}, '[^0-9.\\-]', '', 'g') AS DOUBLE), {S.num(0)})"

    strs = [d for d in DIMS if d != "overall_confidence"] + ["composite_score"]
    cols = [f"{sf(c)} AS {c}" for c in strs]
    cols.append(f"coalesce(CAST(overall_confidence AS DOUBLE), {S.num(0)}) AS overall_confidence")
    cols.append(f"coalesce(TRY_CAST(trunc({sf('word_count')}) AS INTEGER), 0) AS word_count")
    cols.append("coalesce(deck_name, '') AS deck_name")
    cols.append("coalesce(category, '') AS category")
    return f"SELECT {', '.join(cols)} FROM ({m})"


@oracle("weak_strong_areas")
def _weak_strong_areas():
    weak = ", ".join(f"CASE WHEN {d} < 5 THEN {S.q(d)} END" for d in DIMS)
    strong = ", ".join(f"CASE WHEN {d} >= 8 THEN {S.q(d)} END" for d in DIMS)
    return _p() + f"SELECT deck_name, concat_ws(',', {weak}) AS weak_areas, concat_ws(',', {strong}) AS strong_areas FROM p"


@oracle("improvement_advice")
def _improvement_advice():
    parts = []
    for k, (d, (area, advice)) in enumerate(zip(DIMS, L.ADVICE)):
        before = " + ".join(f"(CASE WHEN {x} < 5 THEN 1 ELSE 0 END)" for x in DIMS[:k]) or "0"
        parts.append(f"SELECT deck_name, CAST({before} AS INTEGER) AS pos, {S.q(area)} AS area, {S.q(advice)} AS advice "
                     f"FROM p WHERE {d} < 5")
    none = " AND ".join(f"{d} >= 5" for d in DIMS)
    parts.append(f"SELECT deck_name, 0 AS pos, CAST(NULL AS VARCHAR) AS area, {S.q(L.NO_WEAK_AREAS)} AS advice "
                 f"FROM p WHERE {none}")
    return _p() + " UNION ALL ".join(parts)


def _responses_cte() -> str:
    from deckscope.sources.fixtures import RESPONSE_CATEGORIES
    nl = "chr(10)"
    marked = (f"array_to_string(list_transform(string_split(text, {nl}), lambda l, i: CASE WHEN (i - 1) % 3 = 0 "
              f"THEN '• ' || l WHEN (i - 1) % 3 = 1 THEN '- ' || l ELSE l END), {nl})")
    cats = "[" + ", ".join(S.q(c) for c in RESPONSE_CATEGORIES) + "]"
    d = "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"
    return (f"SELECT doc_id, 'summary' AS kind, CASE WHEN doc_id % 4 = 0 THEN text ELSE {marked} END AS response FROM {d} "
            f"UNION ALL SELECT doc_id, 'category', {cats}[CAST(doc_id % {len(RESPONSE_CATEGORIES)} + 1 AS INTEGER)] FROM {d} "
            f"UNION ALL SELECT doc_id, 'insight', text FROM {d} "
            f"UNION ALL SELECT doc_id, 'competitive', CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END FROM {d}")


def _parse_bullets(r: str) -> str:
    nl = "chr(10)"
    lines = f"list_transform(string_split({r}, {nl}), lambda s: {S.strip_ws('s')})"
    marked = f"list_filter({lines}, lambda s: starts_with(s, '•') OR starts_with(s, '-') OR starts_with(s, '*'))"
    cleaned = f"list_transform({marked}, lambda s: {S.strip_ws(chr(114) + 'egexp_replace(s, ' + S.q('^[•*\\- ]+') + ', ' + chr(39) * 2 + ')')})"
    bullets = f"list_transform(list_filter({cleaned}, lambda s: s <> ''), lambda s: '• ' || s)"
    return f"(CASE WHEN len({bullets}) > 0 THEN array_to_string(({bullets})[1:4], {nl}) END)"


def _match_category(r: str) -> str:
    cleaned = f"lower(replace(replace({S.strip_ws(r)}, '\"', ''), '''', ''))"
    return "(CASE " + " ".join(f"WHEN contains({cleaned}, {S.q(c.lower())}) THEN {S.q(c)}" for c in L.MODEL_CATEGORIES) + " END)"


def _trim_insight(r: str) -> str:
    first = S.strip_ws(f"split_part({r}, '.', 1)")
    return f"(CASE WHEN length({first}) > 120 THEN substr({first}, 1, 117) || '...' ELSE {first} END)"


@oracle("enrich_with_responses")
def _enrich_with_responses():
    def nonempty(x):
        return f"(CASE WHEN length({S.strip_ws(x)}) > 0 THEN {S.strip_ws(x)} END)"

    wide = ("SELECT doc_id, " + ", ".join(
        f"max(CASE WHEN kind = {S.q(k)} THEN {nonempty('response')} END) AS r_{k}"
        for k in ("summary", "category", "insight", "competitive")) + " FROM r GROUP BY doc_id")
    base = S.enriched_cte(S.decks_cte())
    n = "length(coalesce(full_text, ''))"
    cat = f"CASE WHEN {n} < 50 THEN 'Other' ELSE coalesce({_match_category('r_category')}, category) END"
    step = f"SELECT doc_id, full_text, composite_score, summary AS fb_summary, r_summary, r_insight, r_competitive, {cat} AS category FROM ({base}) b LEFT JOIN w USING (doc_id)"
    return (f"WITH r AS ({_responses_cte()}), w AS ({wide}) SELECT doc_id, category, "
            f"CASE WHEN {n} < 100 THEN {S.q(L.SUMMARY_SHORT)} ELSE coalesce({_parse_bullets('r_summary')}, fb_summary) END AS summary, "
            f"coalesce({_trim_insight('r_insight')}, {S.fallback_insight_sql('composite_score', 'category')}) AS investability_insight, "
            f"CASE WHEN {n} < 100 THEN {S.q(L.COMPETITIVE_SHORT)} ELSE coalesce(r_competitive, {S.q(L.COMPETITIVE_MISSING)}) END "
            f"AS competitive_analysis FROM ({step})")


@oracle("enrich_after_errors")
def _enrich_after_errors():
    lines, pad = S.fallback_summary_sql()
    base = f"SELECT *, {lines} AS _lines FROM ({S.enriched_cte(S.decks_cte())})"
    failed = (f"SELECT doc_id, category, array_to_string(list_concat(_lines, {pad}), chr(10)) AS summary, investability_insight, "
              f"{S.q(L.ANALYSIS_FAILED)} AS competitive_analysis FROM ({base}) WHERE doc_id % 3 = 0")
    return f"SELECT * FROM ({ORACLE['enrich_with_responses']}) WHERE doc_id % 3 <> 0 UNION ALL {failed}"


@oracle("prompts")
def _prompts():
    n = "length(coalesce(full_text, ''))"
    full = "coalesce(full_text, '')"
    cats = ", ".join(L.MODEL_CATEGORIES[:-1])
    weak = f"concat_ws(', ', {', '.join(f'CASE WHEN {d} < 5 THEN {S.q(d)} END' for d in DIMS)})"
    strong = f"concat_ws(', ', {', '.join(f'CASE WHEN {d} >= 8 THEN {S.q(d)} END' for d in DIMS)})"
    none = lambda x: f"(CASE WHEN {x} = '' THEN 'None' ELSE {x} END)"
    rule = f"(CASE WHEN {n} < 50 THEN 'Other' ELSE {S.classify_sql('full_text')} END)"
    score = f"CAST({S.np_round('composite_score', 1)} AS VARCHAR)"
    base = f"({S.scored_cte(S.decks_cte())})"
    return (f"SELECT doc_id, 'summary' AS kind, printf({S.q(L.PROMPT_SUMMARY)}, {full}) AS prompt "
            f"FROM {base} WHERE {n} >= 100 UNION ALL "
            f"SELECT doc_id, 'category', printf({S.q(L.PROMPT_CATEGORY)}, {S.q(cats)}, {full}) "
            f"FROM {base} WHERE {n} >= 50 UNION ALL "
            f"SELECT doc_id, 'insight', printf({S.q(L.PROMPT_INSIGHT)}, {rule}, {score}, {none(strong)}, {none(weak)}, "
            f"{full}) FROM {base} UNION ALL "
            f"SELECT doc_id, 'competitive', printf({S.q(L.PROMPT_COMPETITIVE)}, {full}) "
            f"FROM {base} WHERE {n} >= 100")


def _pages() -> str:
    return ("SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page_no, text, "
            "CAST((conv_id + turn) % 3 AS INTEGER) AS n_images FROM conversations")


def _diagnosis() -> str:
    t = "t"
    f = f"SELECT doc_id, page_no, n_images, {S.strip_ws('coalesce(text, ' + chr(39) * 2 + ')')} AS t FROM pg"
    g = (f"SELECT doc_id, min(CASE WHEN length({t}) > 50 THEN page_no END) AS stop, "
         f"arg_min(CASE WHEN length({t}) > 50 THEN {t} END, CASE WHEN length({t}) > 50 THEN page_no END) AS sample, "
         f"list(page_no) FILTER (WHERE n_images > 0) AS imgs FROM f GROUP BY doc_id")
    has_text = "(stop IS NOT NULL)"
    has_img = "(len(list_filter(coalesce(imgs, []), lambda x: x < coalesce(stop, 2147483647))) > 0)"
    out = (f"SELECT c.doc_id, c.pages, false AS encrypted, coalesce({has_text}, false) AS has_text, "
           f"coalesce({has_img}, false) AS has_images, CASE WHEN {has_text} THEN substr(sample, 1, 200) || '...' ELSE '' END "
           f"AS text_sample FROM (SELECT doc_id, count(*) AS pages FROM pg GROUP BY doc_id) c LEFT JOIN g USING (doc_id)")
    return (f"WITH pg AS ({_pages()}), f AS ({f}), g AS ({g}) SELECT *, CASE WHEN has_text OR has_images THEN 'ok' "
            f"ELSE 'warning' END AS status, CASE WHEN NOT (has_text OR has_images) THEN 'No readable content detected' END "
            f"AS message, true AS can_process FROM ({out})")


@oracle("page_diagnosis")
def _page_diagnosis():
    return _diagnosis()


@oracle("diagnosis_summary")
def _diagnosis_summary():
    return (f"SELECT count(*) FILTER (WHERE can_process) AS processable, count(*) AS total, "
            f"count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'warning') AS warning, "
            f"count(*) FILTER (WHERE status = 'error') AS error, count(*) FILTER (WHERE can_process) > 0 AS any_processable "
            f"FROM ({_diagnosis()})")


@oracle("choose_extraction")
def _choose_extraction():
    c = ("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE '' END AS c1, "
         "CASE WHEN doc_id % 3 = 1 THEN text END AS c2, text AS c3, doc_id % 2 = 0 AS has_images FROM documents")
    ln = lambda x: f"length(coalesce({x}, ''))"
    method = (f"CASE WHEN {ln('c1')} >= 50 THEN 'PyMuPDF' WHEN {ln('c2')} >= 50 THEN 'pdfplumber' "
              f"WHEN coalesce(has_images, false) AND {ln('c3')} >= 50 THEN 'OCR' ELSE 'none' END")
    text = (f"CASE WHEN {ln('c1')} >= 50 THEN c1 WHEN {ln('c2')} >= 50 THEN c2 WHEN coalesce(has_images, false) "
            f"THEN coalesce(c3, '') ELSE coalesce(c2, '') END")
    return (f"SELECT doc_id, {method} AS extraction_method, CAST(length(t) AS INTEGER) AS text_length, "
            f"length(t) >= 50 AS sufficient FROM (SELECT *, {text} AS t FROM ({c}))")


@oracle("section_preview")
def _section_preview():
    from deckscope.operators.extract import SECTION_LABELS
    parts = []
    for key, title in SECTION_LABELS:
        c = f"coalesce(sec_{key}, '')"
        shown = f"(length({S.strip_ws(c)}) > 20)"
        wc = f"CAST(len(list_filter(string_split_regex({c}, {S.q(S.WS_CLASS + '+')}), lambda w: w <> '')) AS INTEGER)"
        parts.append(
            f"SELECT deck_name, {S.q(key)} AS section, {S.q(title)} AS title, {shown} AS shown, "
            f"CASE WHEN {shown} THEN (CASE WHEN length({c}) > 500 THEN substr({c}, 1, 500) || '...' ELSE {c} END) "
            f"ELSE {S.q(title + ': No significant content detected')} END AS preview, "
            f"CASE WHEN {shown} THEN {wc} END AS word_count FROM s")
    return f"WITH s AS ({S.sectionized_cte(S.decks_cte())}) " + " UNION ALL ".join(parts)


@oracle("assemble_pages")
def _assemble_pages():
    agg = "string_agg(coalesce(text, '') || chr(10), '' ORDER BY turn)"
    return f"SELECT conv_id AS doc_id, {S.strip_ws(agg)} AS text FROM conversations GROUP BY conv_id"


@oracle("deck_names")
def _deck_names():
    return "SELECT page_id, replace(string_split(url, '/')[-1], '.pdf', '') AS deck_name FROM pages"


@oracle("sentence_sections")
def _sentence_sections():
    terms = ", ".join(f"({S.q(s)}, {S.q(t)})" for s, ts in L.SECTION_TERMS.items() for t in ts)
    s = (f"SELECT doc_id, unnest(_s) AS sentence, unnest(generate_series(0, len(_s) - 1)) AS pos FROM "
         f"(SELECT doc_id, {S.sentences('full_text')} AS _s FROM (SELECT doc_id, {S.clean('text')} AS full_text "
         f"FROM ({S.decks_cte()})))")
    return (f"SELECT DISTINCT doc_id, CAST(pos AS INTEGER) AS pos, section FROM ({s}) x "
            f"JOIN (VALUES {terms}) AS t(section, term) ON contains(lower(x.sentence), t.term)")


def _user_terms() -> str:
    return ("SELECT 's' || (item_id % 5) AS section, 'd' || (item_id % 3) AS dimension, 'c' || (item_id % 7) AS component, "
            "(item_id % 7 + 1) / 2 AS weight, 8.0::DOUBLE AS cap, (item_id % 7 + 1) / 10 AS coef, lower(term) AS term FROM ("
            "SELECT item_id, unnest(list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), [substr(text, 1, 3)])) AS term "
            "FROM (SELECT item_id, text, string_split(text, ' ') AS w FROM benchmark)) WHERE term <> ''")


@oracle("term_table_sections")
def _term_table_sections():
    s = (f"SELECT doc_id, unnest(_s) AS sentence, unnest(generate_series(0, len(_s) - 1)) AS pos FROM "
         f"(SELECT doc_id, {S.sentences('full_text')} AS _s FROM (SELECT doc_id, {S.clean('text')} AS full_text FROM documents))")
    return (f"SELECT DISTINCT doc_id, CAST(pos AS INTEGER) AS pos, section FROM ({s}) x "
            f"JOIN (SELECT DISTINCT section, term FROM ({_user_terms()})) t ON contains(lower(x.sentence), t.term)")


@oracle("term_table_scores")
def _term_table_scores():
    return (f"WITH t AS (SELECT DISTINCT dimension, component, term, weight, cap, coef FROM ({_user_terms()})), "
            "p AS (SELECT doc_id, dimension, component, count(DISTINCT term) AS n, max(weight) AS w, max(cap) AS c, max(coef) AS k "
            "FROM documents JOIN t ON contains(lower(text), t.term) GROUP BY ALL) "
            "SELECT doc_id, dimension, CAST(sum(n) AS BIGINT) AS hits, least(list_reduce(list(least(n * w, c) * k ORDER BY component), "
            "lambda a, v: a + v, CAST(0 AS DOUBLE)), 10.0::DOUBLE) AS score FROM p GROUP BY doc_id, dimension")


@oracle("table_sentiment")
def _table_sentiment():
    cols = ", ".join(f"_{k}_full_text AS {k}" for k in ("pos", "neg", "neu", "compound"))
    return f"SELECT doc_id, {cols} FROM ({S.with_sentiments(S.sectionized_cte(S.decks_cte()), ['full_text'])})"


@oracle("sentiment_labels")
def _sentiment_labels():
    lab = "CASE WHEN v > 0.1 THEN 'Positive' WHEN v < -0.1 THEN 'Negative' ELSE 'Neutral' END"
    parts = " UNION ALL ".join(
        f"SELECT doc_id, {S.q(s.capitalize())} AS section, {s}_sentiment AS v FROM lm WHERE {s}_sentiment IS NOT NULL"
        for s in L.SENTIMENT_SECTIONS)
    return (f"WITH lm AS ({S.language_cte(S.decks_cte())}) SELECT doc_id, section, v AS sentiment, {lab} AS sentiment_label "
            f"FROM ({parts})")


@oracle("language_profile")
def _language_profile():
    rows = [("Confidence Indicators", "confidence_score"), ("Technical Sophistication", "tech_sophistication"),
            ("Vocabulary Diversity", f"vocabulary_diversity * {S.num(100)}"), ("Readability Score", "readability_score")]
    parts = " UNION ALL ".join(f"SELECT doc_id, {S.q(m)} AS metric, {e} AS value FROM lm" for m, e in rows)
    return f"WITH lm AS ({S.language_cte(S.decks_cte())}) {parts}"


@oracle("export_scores_long")
def _export_scores_long():
    return _p() + " UNION ALL ".join(
        f"SELECT deck_name, {S.q(label)} AS Metric, coalesce(CAST({c} AS DOUBLE), {S.num(0)}) AS Score FROM p"
        for c, label in L.EXPORT_LABELS)


@oracle("ranked_results")
def _ranked_results():
    n = S.np_round
    ext = S.strip_ws("coalesce(text, '')")
    src = f"SELECT * FROM ({S.documents_cte()}) WHERE length({ext}) >= {L.MIN_TEXT_LENGTH}"
    e = S.enriched_cte(src)
    rounded = ", ".join(f"{n(d, 2)} AS {d}" for d in DIMS)
    return (f"SELECT CAST(rank() OVER (ORDER BY composite_score DESC) AS BIGINT) AS rank, deck_name, composite_score, "
            f"{', '.join(DIMS)}, category, investability_insight, word_count, extraction_method FROM ("
            f"SELECT deck_name, {n('composite_score', 2)} AS composite_score, {rounded}, category, investability_insight, "
            f"word_count, 'text' AS extraction_method FROM ({e}))")


@oracle("batch_run_metrics")
def _batch_run_metrics():
    ext = f"length({S.strip_ws('coalesce(text, ' + chr(39) * 2 + ')')})"
    return (f"SELECT count(*) FILTER (WHERE {ext} >= {L.MIN_TEXT_LENGTH}) AS succeeded, "
            f"count(*) FILTER (WHERE {ext} < {L.MIN_TEXT_LENGTH}) AS failed, count(*) AS total FROM documents")


@oracle("result_rows")
def _result_rows():
    ext = S.strip_ws("coalesce(text, '')")
    src = f"SELECT * FROM ({S.decks_cte()}) WHERE length({ext}) >= {L.MIN_TEXT_LENGTH}"
    return (f"SELECT deck_name, word_count, 'text' AS extraction_method, category, summary, investability_insight, "
            f"competitive_analysis, {', '.join(DIMS)}, composite_score FROM ({S.enriched_cte(src)})")


@oracle("collect_results")
def _collect_results():
    def ok(src):
        ext = S.strip_ws("coalesce(text, '')")
        return f"SELECT * FROM ({src}) WHERE length({ext}) >= {L.MIN_TEXT_LENGTH}"
    a = f"SELECT doc_id, deck_name, composite_score, category, NULL::DOUBLE AS readability_score, 'decks' AS batch FROM ({S.enriched_cte(ok(S.decks_cte()))})"
    lang = S.language_cte(ok(S.documents_cte()))
    scored = S.scored_cte(ok(S.documents_cte()))
    b = (f"SELECT s.doc_id, s.deck_name, s.composite_score, NULL::VARCHAR AS category, l.readability_score, "
         f"'documents' AS batch FROM ({scored}) s JOIN ({lang}) l USING (doc_id)")
    return f"{a} UNION ALL {b}"


def _on_hard(name: str, rows: str = "true") -> str:
    """The statement of ``name`` on the hard rows that ``rows`` names."""
    return ORACLE[name].replace(S.portfolio_cte(), f"SELECT * FROM ({S.hard_portfolio_cte()}) WHERE {rows}")


for _name in ("portfolio_stats", "batch_summary", "score_histogram"):
    ORACLE[f"hard_{_name}"] = _on_hard(_name)
for _name in ("category_performance", "category_distribution"):
    ORACLE[f"hard_{_name}"] = _on_hard(_name, "category IS NOT NULL")
# rows without a category count in the root alone
ORACLE["hard_tier_hierarchy"] = f"SELECT * FROM ({_on_hard('tier_hierarchy')}) WHERE id IS NOT NULL"


@oracle("diagnose")
def _diagnose():
    n = "sum(coalesce(length(text), 0))"
    f = (f"SELECT conv_id AS doc_id, {n} * (conv_id % 3) * 100000 AS length, conv_id % 11 = 0 AS locked, "
         f"CASE WHEN conv_id % 13 = 0 THEN 'bad table ' || CAST(conv_id AS VARCHAR) END AS error FROM conversations GROUP BY conv_id "
         f"UNION ALL SELECT conv_id + 1000000000, {n}, false, NULL FROM conversations WHERE conv_id % 5 = 0 GROUP BY conv_id")
    mb = f"length / {S.num(1024 * 1024)}"
    kind = (f"CASE WHEN {mb} > {L.MAX_FILE_SIZE_MB} THEN 'large' WHEN error IS NOT NULL THEN 'error' WHEN locked THEN 'locked' "
            f"WHEN coalesce(d.has_text, false) OR coalesce(d.has_images, false) THEN 'read' ELSE 'blank' END")
    j = (f"SELECT f.doc_id, {mb} AS mb, error, {kind} AS kind, d.pages, d.has_text, d.has_images, d.text_sample "
         f"FROM ({f}) f LEFT JOIN ({_diagnosis()}) d USING (doc_id)")
    seen = lambda x: f"CASE WHEN kind IN ('read', 'blank') THEN {x} END"
    return (f"SELECT doc_id, 'deck_' || CAST(doc_id AS VARCHAR) AS deck_name, 'deck_' || CAST(doc_id AS VARCHAR) || '.pdf' AS filename, "
            f"mb AS file_size_mb, {seen('coalesce(pages, 0)')} AS pages, "
            f"CASE WHEN kind NOT IN ('large', 'error') THEN kind = 'locked' END AS encrypted, {seen('coalesce(has_text, false)')} AS has_text, "
            f"{seen('coalesce(has_images, false)')} AS has_images, {seen('coalesce(text_sample, ' + chr(39) * 2 + ')')} AS text_sample, "
            f"CASE kind WHEN 'large' THEN 'warning' WHEN 'blank' THEN 'warning' WHEN 'read' THEN 'ok' ELSE 'error' END AS status, "
            f"CASE kind WHEN 'large' THEN printf('Large file (%.1fMB) - may be slow', {S.np_round('mb', 1)}) "
            f"WHEN 'error' THEN 'Cannot open PDF: ' || error WHEN 'locked' THEN 'PDF is password protected' "
            f"WHEN 'blank' THEN 'No readable content detected' END AS message, kind IN ('large', 'read', 'blank') AS can_process FROM ({j})")


@oracle("distinct_decks_by_year")
def _distinct_decks_by_year():
    return (f"SELECT strftime(analysis_date, '%Y') AS year, count(deck_name) AS n_values, count(DISTINCT deck_name) AS n_exact, "
            f"true AS within_bound FROM ({S.history_cte()}) GROUP BY 1")


@oracle("vocabulary_by_language")
def _vocabulary_by_language():
    w = (r"SELECT coalesce(lang, 'none') AS lang, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS word FROM documents")
    count = "count(*) AS n_values, count(DISTINCT word) AS n_exact, true AS within_bound"
    return f"WITH w AS ({w}) SELECT lang, {count} FROM w GROUP BY lang UNION ALL SELECT 'all', {count} FROM w HAVING count(*) > 0"
