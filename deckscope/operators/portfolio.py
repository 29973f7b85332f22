"""Portfolio operators over the result table (I, M, G, H, L families).

The result table is one row per document.  Aggregates use partial (map-side)
aggregation; the only shuffles are by ``category`` (few keys, pre-aggregated)
or by a rounded score.  Dimension tables (benchmarks, advice, reference
vector) are fixed-size literals and are the only broadcast sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckscope import lexicons as L
from deckscope.functions.mathx import normal_cdf
from deckscope.operators.ranking import np_round, small_side, top_k
from deckscope.operators.selection import medians

FIVE = ["problem_clarity", "market_potential", "traction_strength", "team_experience", "business_model"]


def existing(df: DataFrame, cols) -> list[str]:
    """G1: requested columns that exist, in the requested order."""
    return [c for c in cols if c in df.columns]


def select_existing(df: DataFrame, cols) -> DataFrame:
    return df.select(*existing(df, cols))


def at_least_rows(df: DataFrame, n: int) -> DataFrame:
    """The frame itself when it has at least ``n`` rows, else an empty frame
    (the count is one small job; no join, no single-partition window)."""
    return df if df.limit(n).count() >= n else df.limit(0)


def with_missing_as_zero(df: DataFrame, cols) -> DataFrame:
    """A missing score column counts as the literal 0 (never ``fillna``)."""
    return df.withColumns({c: F.lit(0.0) for c in cols if c not in df.columns})


# -- I: aggregations --------------------------------------------------------------------

def portfolio_stats(df: DataFrame, col: str = "composite_score") -> DataFrame:
    """N, mean, sample std, exact median, min, max of the composite; the
    median by counting selection (no sort, see ``selection``)."""
    vals = df.select(col).filter(F.col(col).isNotNull())
    mid = medians(vals, col).first()
    out = vals.agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max"))
    return out.select("n", "mean", "std", F.lit(mid[0] if mid else None).cast("double").alias("median"), "min", "max")


def dimension_averages(df: DataFrame) -> DataFrame:
    """Mean per dimension (existing dimensions), long form."""
    dims = existing(df, L.DIMENSIONS)
    wide = df.agg(*[F.avg(d).alias(d) for d in dims])
    return wide.unpivot([], dims, "dimension", "average")


def _with_category(df: DataFrame) -> DataFrame:
    """Rows that have a category; a frame without the column has none."""
    if "category" not in df.columns:
        df = df.withColumn("category", F.lit(None).cast("string"))
    return df.filter(F.col("category").isNotNull())


def category_distribution(df: DataFrame, k: int = 5) -> DataFrame:
    """Count and share of the top-k categories (ties: name); rows without
    a category are no group and not in the total.  The total is a window sum over the grouped frame (one row per category)."""
    counts = _with_category(df).groupBy("category").agg(F.count(F.lit(1)).alias("count"))
    counts = counts.withColumn("_total", F.sum("count").over(Window.partitionBy()))
    top = counts.orderBy(F.col("count").desc(), F.col("category")).limit(k)
    return top.select("category", "count", (F.col("count") / F.col("_total") * F.lit(100.0)).alias("percent"))


def category_stats(df: DataFrame) -> DataFrame:
    """I4: per category mean / exact median / count / sample std of the
    composite and means of problem, market, traction; all rounded to 2."""
    df = _with_category(df)
    agg = df.groupBy("category").agg(
        F.avg("composite_score").alias("avg_score"), F.count(F.lit(1)).alias("count"),
        F.stddev_samp("composite_score").alias("std_score"), F.avg("problem_clarity").alias("avg_problem"),
        F.avg("market_potential").alias("avg_market"), F.avg("traction_strength").alias("avg_traction"))
    med = medians(df, "composite_score", ["category"], "median_score")
    out = agg.join(med, "category", "left")
    return out.select("category", np_round("avg_score", 2).alias("avg_score"),
                      np_round("median_score", 2).alias("median_score"), "count",
                      np_round("std_score", 2).alias("std_score"), np_round("avg_problem", 2).alias("avg_problem"),
                      np_round("avg_market", 2).alias("avg_market"), np_round("avg_traction", 2).alias("avg_traction"))


def _argmax_name(avgs: dict[str, Column], largest: bool) -> Column:
    """Name of the largest (or smallest) average; the first listed wins ties."""
    items = [F.struct((c if largest else -c).alias("v"), F.lit(-i).alias("o"), F.lit(n).alias("n"))
             for i, (n, c) in enumerate(avgs.items())]
    return F.array_max(F.array(*items))["n"]


def portfolio_composition(df: DataFrame) -> DataFrame:
    """Totals, band counts, category diversity, strongest and weakest
    dimension, composite std -- one row from one aggregation pass."""
    dims = existing(df, L.DIMENSIONS)
    c = F.col("composite_score")
    agg = df.agg(
        F.count(F.lit(1)).alias("total_analyzed"), F.avg(c).alias("average_quality"),
        F.count_if(c >= 7).alias("investment_ready"), F.count_if((c >= 5) & (c < 7)).alias("needs_development"),
        F.count_if(c < 5).alias("significant_work_needed"),
        (F.count_distinct("category") if "category" in df.columns else F.lit(0)).alias("category_diversity"),
        F.stddev_samp(c).alias("score_variance"), *[F.avg(d).alias(f"_avg_{d}") for d in dims])
    avgs = {d: F.col(f"_avg_{d}") for d in dims}
    return agg.select(
        "total_analyzed", "average_quality", "investment_ready", "needs_development", "significant_work_needed",
        "category_diversity",
        (_argmax_name(avgs, True) if dims else F.lit("N/A")).alias("strongest_dimension"),
        (_argmax_name(avgs, False) if dims else F.lit("N/A")).alias("weakest_dimension"),
        "score_variance")


def portfolio_risk(df: DataFrame) -> DataFrame:
    """Concentration (top category share > 60 High, > 40 Medium),
    quality (share below 5: > 40 High, > 20 Medium), execution (mean traction
    < 4 High, < 6 Medium)."""
    if "category" not in df.columns:
        df = df.withColumn("category", F.lit(None).cast("string"))
    if "traction_strength" not in df.columns:
        df = df.withColumn("traction_strength", F.lit(None).cast("double"))
    per = df.groupBy("category").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("composite_score") < 5).alias("_l"),
        F.sum("traction_strength").alias("_ts"), F.count("traction_strength").alias("_tc"))
    both = per.agg(F.sum("_n").alias("_total"), F.max(F.when(F.col("category").isNotNull(), F.col("_n"))).alias("_top"), F.sum("_l").alias("_low"),
                   (F.sum("_ts") / F.sum("_tc")).alias("_trac"))
    conc = F.col("_top") / F.col("_total") * F.lit(100.0)
    low = F.col("_low") / F.col("_total") * F.lit(100.0)
    level = lambda x, hi, mid: F.when(x > hi, "High").when(x > mid, "Medium").otherwise("Low")
    return both.select(
        level(conc, 60, 40).alias("concentration_risk"), level(low, 40, 20).alias("quality_risk"),
        F.when(F.col("_trac") < 4, "High").when(F.col("_trac") < 6, "Medium").otherwise("Low").alias("execution_risk"))


def market_trends(df: DataFrame, k: int = 3) -> DataFrame:
    """Top-3 categories by mean composite and by mean market potential
    (when more than one row), and the five dimension means; long form
    ``(trend, name, value)``; an empty frame gives no rows.  One pass: grouping sets give the categories' and
    the total row, and positions are numbered over these (a row a category)."""
    five = existing(df, FIVE)
    if "category" not in df.columns:
        df = df.withColumn("category", F.lit(None).cast("string"))
    means = [F.avg(d).alias(f"_avg_{d}") for d in five]
    g = df.groupingSets([["category"], []], "category").agg(
        F.grouping_id().alias("_all"), F.avg("composite_score").alias("_c"), F.avg("market_potential").alias("_m"),
        F.count("category").alias("_n"), *means)
    g = g.filter((F.col("_all") == 1) | F.col("category").isNotNull())
    place = lambda c: F.row_number().over(Window.partitionBy("_all").orderBy(F.col(c).desc(), F.col("category")))
    g = g.withColumns({"_pc": place("_c"), "_pm": place("_m"), "_n": F.max("_n").over(Window.partitionBy())})
    row = lambda trend, name, value: F.struct(F.lit(trend).alias("trend"), name.alias("name"), value.alias("value"))
    cat = (F.col("_all") == 0) & (F.col("_n") > 1)
    items = [F.when(cat & (F.col(p) <= k), row(t, F.col("category"), F.col(c)))
             for t, c, p in (("top_performing_categories", "_c", "_pc"), ("highest_market_potential_categories", "_m", "_pm"))]
    items += [F.when(F.col("_all") == 1, row("dimension_strengths", F.lit(d), F.col(f"_avg_{d}"))) for d in five]
    return g.select(F.inline(F.filter(F.array(*items), lambda x: x.isNotNull())))


def benchmark_table(spark) -> DataFrame:
    """Q3 default: the six-category benchmark dimension table."""
    return spark.createDataFrame(L.INDUSTRY_BENCHMARKS, "category string, " + ", ".join(
        f"b_{c} double" for c in L.BENCHMARK_COLUMNS))


def benchmark_comparison(df: DataFrame, benchmarks: DataFrame | None = None) -> DataFrame:
    """H1 + M3: compare with the category benchmark (inner: rows without a
    benchmark are dropped).  A caller's table is stored and counted: broadcast
    up to ``ranking.BROADCAST_ROWS`` rows, else joined by a shuffle; a category
    that it names twice is an error, not a doubled row."""
    if benchmarks is None:
        bench = F.broadcast(benchmark_table(df.sparkSession))
    else:
        bench = small_side(benchmarks)
        twice = bench.groupBy("category").count().filter((F.col("count") > 1) & F.col("category").isNotNull()).first()
        if twice:
            raise ValueError(f"several benchmarks for category {twice['category']!r}")
    d = with_missing_as_zero(df, ["market_potential", "traction_strength", "team_experience"])
    j = d.join(bench, "category", "inner")
    pct = F.least(F.lit(99.0), F.greatest(F.lit(1.0), normal_cdf(F.col("composite_score"), F.col("b_composite_score"),
                                                                   F.lit(L.BENCHMARK_SD)) * F.lit(100.0)))
    return j.select(
        "deck_name", "category",
        (F.col("composite_score") - F.col("b_composite_score")).alias("composite_vs_benchmark"),
        (F.col("market_potential") - F.col("b_market_potential")).alias("market_vs_benchmark"),
        (F.col("traction_strength") - F.col("b_traction_strength")).alias("traction_vs_benchmark"),
        (F.col("team_experience") - F.col("b_team_experience")).alias("team_vs_benchmark"),
        pct.alias("percentile_rank"),
        F.col("category").alias("benchmark_category"),
        F.when(F.col("composite_score") > F.col("b_composite_score"), "Above").otherwise("Below").alias("overall_vs_industry"),
    )


def benchmark_summary(comparison: DataFrame) -> DataFrame:
    """I8 + K5 + G6: count, out/under-performers (gap > 1 / < -1), above
    benchmark (> 0), mean gap, best row (ties: name), categories analysed.
    An empty comparison gives one row with the message."""
    gap = F.col("composite_vs_benchmark")
    agg = comparison.agg(
        F.count(F.lit(1)).alias("total_with_benchmarks"), F.count_if(gap > 1).alias("outperformers"),
        F.count_if(gap < -1).alias("underperformers"), F.count_if(gap > 0).alias("above_benchmark"),
        F.avg(gap).alias("avg_vs_benchmark"),
        F.min_by(F.struct("deck_name", gap.alias("gap")), F.struct(-gap, F.col("deck_name"))).alias("_best"),
        F.array_sort(F.collect_set("category")).alias("categories_analyzed"))
    return agg.select(
        "total_with_benchmarks", "outperformers", "underperformers", "above_benchmark", "avg_vs_benchmark",
        F.col("_best.deck_name").alias("best_deck"), F.col("_best.gap").alias("best_vs_benchmark"),
        "categories_analyzed",
        F.when(F.col("total_with_benchmarks") == 0, F.lit("No benchmark data available")).alias("message"))


def vs_reference_vector(df: DataFrame) -> DataFrame:
    """H2: each dimension beside the industry average (broadcast 7-row table)."""
    spark = df.sparkSession
    ref = spark.createDataFrame(list(zip(L.DIMENSIONS, L.INDUSTRY_AVERAGE)), "dimension string, industry_avg double")
    dims = existing(df, L.DIMENSIONS)
    long = df.unpivot(["deck_name"], dims, "dimension", "score")
    j = long.join(F.broadcast(ref), "dimension", "inner")
    from deckscope.functions.text import title_case_dim
    return j.select("deck_name", "dimension", title_case_dim(F.col("dimension")).alias("label"), "score",
                    "industry_avg", (F.col("score") - F.col("industry_avg")).alias("gap"))


def executive_summary(df: DataFrame) -> DataFrame:
    """One row of summary facts and the text report built from them."""
    c = F.col("composite_score")
    agg = df.agg(
        F.count(F.lit(1)).alias("n_decks"), F.avg(c).alias("avg_score"),
        F.min_by(F.struct("deck_name", c.alias("s")), F.struct(-c, F.col("deck_name"))).alias("_top"),
        F.min_by(F.struct("deck_name", c.alias("s")), F.struct(c, F.col("deck_name"))).alias("_bottom"),
        F.mode("category", True).alias("top_category"),
        F.count_if(c >= 7).alias("high_performers"), F.count_if(c < 5).alias("low_performers"),
        *[F.avg(d).alias(f"avg_{d}") for d in ("problem_clarity", "market_potential", "traction_strength")])
    out = agg.select(
        "n_decks", "avg_score", F.col("_top.deck_name").alias("top_deck"), F.col("_top.s").alias("top_score"),
        F.col("_bottom.deck_name").alias("bottom_deck"), F.col("_bottom.s").alias("bottom_score"), "top_category",
        "high_performers", (F.try_divide("high_performers", "n_decks") * F.lit(100.0)).alias("high_pct"),
        "low_performers", (F.try_divide("low_performers", "n_decks") * F.lit(100.0)).alias("low_pct"),
        "avg_problem_clarity", "avg_market_potential", "avg_traction_strength")
    r = lambda x, d: F.format_string(f"%.{d}f", np_round(x, d))
    text = F.concat(
        F.lit("EXECUTIVE SUMMARY\nAnalysis of "), F.col("n_decks").cast("string"),
        F.lit(" pitch decks completed with an average composite score of "), r("avg_score", 2), F.lit("/10.\n"),
        F.lit("TOP PERFORMER: "), F.col("top_deck"), F.lit(" ("), r("top_score", 2), F.lit("/10)\n"),
        F.lit("NEEDS IMPROVEMENT: "), F.col("bottom_deck"), F.lit(" ("), r("bottom_score", 2), F.lit("/10)\n"),
        F.lit("High performers (7+ score): "), F.col("high_performers").cast("string"), F.lit(" decks ("),
        r("high_pct", 1), F.lit("%)\nNeeds improvement (<5 score): "), F.col("low_performers").cast("string"),
        F.lit(" decks ("), r("low_pct", 1), F.lit("%)\nMost common category: "), F.coalesce("top_category", F.lit("Unknown")),
        F.lit(".\nAverage problem clarity: "), r("avg_problem_clarity", 1),
        F.lit("/10\nAverage market potential: "), r("avg_market_potential", 1),
        F.lit("/10\nAverage traction strength: "), r("avg_traction_strength", 1), F.lit("/10"))
    return out.withColumn("summary_text", F.when(F.col("n_decks") == 0, F.lit("No data available for analysis.")).otherwise(text))


def batch_summary(df: DataFrame) -> DataFrame:
    """Total, mean, count >= 7, distinct categories, max."""
    c = F.col("composite_score")
    return df.agg(F.count(F.lit(1)).alias("total_decks"), F.avg(c).alias("portfolio_avg"),
                  F.count_if(c >= 7).alias("investment_ready"), F.count_distinct("category").alias("categories"),
                  F.max(c).alias("top_score"))


def category_performance(df: DataFrame) -> DataFrame:
    """Mean and number of the composites per category, when there is more
    than one; rows without a category are no group, a category without a
    composite has a NULL mean and the count 0, and a frame without the column
    gives no rows.  The number of groups is a window sum over the grouped frame
    (one row per category)."""
    per = _with_category(df).groupBy("category").agg(F.avg("composite_score").alias("mean"), F.count("composite_score").alias("count"))
    per = per.withColumn("_groups", F.count(F.lit(1)).over(Window.partitionBy()))
    return per.filter("_groups > 1").drop("_groups")


def correlation_matrix(df: DataFrame) -> DataFrame:
    """Pearson correlation of every pair of the 7 dimensions and the
    composite, long form, from one aggregation pass (28 ``corr`` + diagonal)."""
    dims = existing(df, [*L.DIMENSIONS, "composite_score"])
    pairs = [(a, b) for i, a in enumerate(dims) for b in dims[i + 1:]]
    wide = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = wide.unpivot([], [f"`{a}|{b}`" for a, b in pairs], "pair", "corr") if pairs else None
    long = long.select(F.split("pair", r"\|")[0].alias("dim_a"), F.split("pair", r"\|")[1].alias("dim_b"), "corr")
    mirror = long.select(F.col("dim_b").alias("dim_a"), F.col("dim_a").alias("dim_b"), "corr")
    spark = df.sparkSession
    diag = spark.createDataFrame([(d, d, 1.0) for d in dims], "dim_a string, dim_b string, corr double")
    return long.unionByName(mirror).unionByName(diag)


def histogram(df: DataFrame, cols=None, bins: int | None = None) -> DataFrame:
    """Equal-width histogram per column between the column's min and
    max; ``min(10, n)`` bins by default.  Output (column, bin, lo, hi, count)
    for non-empty bins.  Two light passes: one aggregate for the ranges, one
    grouped count per (column, bin)."""
    cols = cols or existing(df, [*L.DIMENSIONS, "composite_score"])
    long = df.unpivot([], cols, "column", "value").filter(F.col("value").isNotNull())
    rng = long.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"),
                                     F.count(F.lit(1)).alias("_n"))
    nb = F.lit(bins) if bins else F.least(F.lit(10), F.col("_n"))
    rng = rng.withColumn("bins", nb.cast("int"))
    j = long.join(F.broadcast(rng), "column", "inner")
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - F.col("lo")) / width), F.col("bins") - 1)).cast("int")
    counts = j.withColumn("bin", b).groupBy("column", "bin", "lo", "hi", "bins").agg(F.count(F.lit(1)).alias("count"))
    w = (F.col("hi") - F.col("lo")) / F.col("bins")
    return counts.select("column", "bin", (F.col("lo") + F.col("bin") * w).alias("bin_lo"),
                         (F.col("lo") + (F.col("bin") + 1) * w).alias("bin_hi"), "count")


def performance_tier(score: Column) -> Column:
    """M4: (0,4] Needs Work, (4,7] Promising, (7,10] Investment Ready; else NULL."""
    return (F.when((score > 0) & (score <= 4), "Needs Work").when((score > 4) & (score <= 7), "Promising")
            .when((score > 7) & (score <= 10), "Investment Ready"))


def tier_hierarchy(df: DataFrame) -> DataFrame:
    """Root count, per-category counts, per (category, tier) counts;
    a NULL tier is counted above the leaf level only, a missing or NULL
    category in the root only."""
    if "category" not in df.columns:
        df = df.withColumn("category", F.lit(None).cast("string"))
    t = df.withColumn("tier", performance_tier(F.col("composite_score")))
    r = t.rollup("category", "tier").agg(F.count(F.lit(1)).alias("value"), F.grouping_id().alias("_g"))
    r = r.filter(~((F.col("_g") == 0) & F.col("tier").isNull()) & ((F.col("_g") == 3) | F.col("category").isNotNull()))
    return r.select(
        F.when(F.col("_g") == 3, "Total").when(F.col("_g") == 1, F.col("category"))
        .otherwise(F.concat_ws("-", "category", "tier")).alias("id"),
        F.when(F.col("_g") == 3, "Portfolio").when(F.col("_g") == 1, F.col("category")).otherwise(F.col("tier")).alias("label"),
        F.when(F.col("_g") == 3, "").when(F.col("_g") == 1, "Total").otherwise(F.col("category")).alias("parent"),
        "value")


# -- M: row rules ------------------------------------------------------------------------

def derived_features(df: DataFrame) -> DataFrame:
    """M1: ratio, two pair means, row mean and row sample variance (ddof 1)
    of the 7 dimensions."""
    d = [F.col(c) for c in L.DIMENSIONS]
    total = d[0]
    for x in d[1:]:
        total = total + x
    mean = total / F.lit(7.0)
    ss = None
    for x in d:
        t = (x - mean) * (x - mean)
        ss = t if ss is None else ss + t
    return df.withColumns({
        "market_traction_ratio": F.col("market_potential") / (F.col("traction_strength") + F.lit(0.1)),
        "team_execution_score": (F.col("team_experience") + F.col("traction_strength")) / F.lit(2.0),
        "business_clarity_score": (F.col("business_model") + F.col("problem_clarity")) / F.lit(2.0),
        "overall_strength": mean,
        "score_variance": ss / F.lit(6.0),
    })


RISK_FACTORS = [("Market Risk", "market_potential"), ("Execution Risk", "traction_strength"),
                ("Team Risk", "team_experience"), ("Business Model Risk", "business_model"),
                ("Competition Risk", "vision_moat")]


def risk_factors(df: DataFrame, factors: int = 5) -> DataFrame:
    """M2: 10 - score per risk factor, long form (first 4 for one document)."""
    fs = RISK_FACTORS[:factors]
    d = with_missing_as_zero(df, [c for _, c in fs])
    args = [x for name, c in fs for x in (F.lit(name), F.lit(10.0) - F.col(c))]
    return d.select("deck_name", F.stack(F.lit(len(fs)), *args).alias("factor", "risk"))


def due_diligence_flags(df: DataFrame) -> DataFrame:
    """M5: four consistency rules; only flagged rows, flags in rule order."""
    d = with_missing_as_zero(df, ["team_experience", "market_potential", "traction_strength", "business_model",
                                  "problem_clarity", "overall_confidence"])
    five = existing(df, FIVE)
    mean5 = None
    if five:
        s = F.col(five[0])
        for c in five[1:]:
            s = s + F.col(c)
        mean5 = s / F.lit(float(len(five)))
    rules = [
        F.when((F.col("team_experience") < 4) & (F.col("market_potential") > 8), F.lit(L.FLAG_TEAM_MARKET)),
        F.when((F.col("traction_strength") > 7) & (F.col("business_model") < 5), F.lit(L.FLAG_TRACTION_MODEL)),
        F.when((F.col("problem_clarity") < 4) & (F.col("overall_confidence") > 7), F.lit(L.FLAG_CONFIDENCE_PROBLEM)),
    ]
    if mean5 is not None:
        rules.append(F.when(F.abs(F.col("composite_score") - mean5) > 2, F.lit(L.FLAG_INCONSISTENT)))
    flags = F.filter(F.array(*rules), lambda x: x.isNotNull())
    out = d.select("deck_name", "composite_score", flags.alias("flags"))
    return out.filter(F.size("flags") > 0)


def recommendations(df: DataFrame) -> DataFrame:
    """M6 + H3 + L1 + K6: STRONG_BUY top 3; CONSIDER 6 <= c < 7 with market
    or traction >= 8; WATCH 4 <= c < 6 with team >= 7; each tier without the
    names of earlier tiers, and in CONSIDER and WATCH one row per name (rows
    without a name are one); sorted by priority, score desc.  One grouping by
    name serves both lower tiers."""
    d = with_missing_as_zero(df, ["market_potential", "traction_strength", "team_experience"])
    c = F.col("composite_score")
    cat = F.coalesce(F.col("category"), F.lit("Unknown")) if "category" in df.columns else F.lit("Unknown")
    cat_s = F.coalesce(F.col("category"), F.lit("startup")) if "category" in df.columns else F.lit("startup")
    d = d.withColumns({"_cat": cat, "_cat_s": cat_s})
    rest = [x for x in ("market_potential", "traction_strength", "team_experience", "_cat", "_cat_s") if x in d.columns]

    strong = top_k(d, 3).select(
        F.lit("STRONG_BUY").alias("type"), F.col("deck_name").alias("deck"), c.alias("score"), F.col("_cat").alias("category"),
        F.format_string(L.REASON_STRONG_BUY, F.col("_cat_s")).alias("reasoning"), F.lit("HIGH").alias("confidence"),
        F.lit(1).alias("priority"))
    gem = (c >= 6) & (c < 7) & ((F.col("market_potential") >= 8) | (F.col("traction_strength") >= 8))
    hope = (c >= 4) & (c < 6) & (F.col("team_experience") >= 7)
    row = F.struct("composite_score", *rest)     # of a name's rows the best score, then the greatest other values
    per = d.filter(gem | hope).groupBy("deck_name").agg(F.max(F.when(gem, row)).alias("_gem"), F.max(F.when(hope, row)).alias("_hope"))
    per = per.join(F.broadcast(strong.select(F.col("deck").alias("deck_name"))), "deck_name", "left_anti")   # three rows at most
    per = per.select("deck_name", F.col("_gem").isNotNull().alias("_is_gem"), F.coalesce("_gem", "_hope").alias("_row")).select("deck_name", "_is_gem", "_row.*")
    area = F.when(F.col("market_potential") >= 8, F.lit("market potential")).otherwise(F.lit("traction"))
    pick = lambda a, b: F.when(F.col("_is_gem"), a).otherwise(b)
    others = per.select(
        pick(F.lit("CONSIDER"), F.lit("WATCH")).alias("type"), F.col("deck_name").alias("deck"), c.alias("score"), F.col("_cat").alias("category"),
        pick(F.format_string(L.REASON_CONSIDER, area, F.col("_cat_s")), F.lit(L.REASON_WATCH)).alias("reasoning"),
        pick(F.lit("MEDIUM"), F.lit("LOW")).alias("confidence"), pick(F.lit(2), F.lit(3)).alias("priority"))
    return strong.unionByName(others).orderBy("priority", F.col("score").desc(), "deck")


def landscape_quadrant(market: Column, traction: Column) -> Column:
    """M7: quadrant from the true axes (x = market, y = traction), split at 5."""
    m = F.when(market >= 5, "High Market").otherwise("Low Market")
    e = F.when(traction >= 5, "High Execution").otherwise("Low Execution")
    return F.concat_ws(" / ", m, e)


def score_class(score: Column) -> Column:
    """M8: >= 7 good, >= 5 medium, else poor."""
    return F.when(score >= 7, "score-good").when(score >= 5, "score-medium").otherwise("score-poor")


def score_bands(df: DataFrame) -> DataFrame:
    """M4, M7-M10 and G3 per row: tier, quadrant, score class, gauge band and
    delta to 7, bar width, band filter label."""
    c = F.col("composite_score")
    return df.select(
        "deck_name", "composite_score",
        performance_tier(c).alias("performance_tier"),
        landscape_quadrant(F.col("market_potential"), F.col("traction_strength")).alias("quadrant"),
        score_class(c).alias("score_class"),
        F.when(c < 4, "0-4").when(c < 7, "4-7").when(c >= 7, "7-10").alias("gauge_band"),
        (c - F.lit(7.0)).alias("delta_to_7"),
        F.when(c.isNotNull(), F.least(c * F.lit(10.0), F.lit(100.0))).alias("bar_width"),
        F.when(c >= 7, "high").when(c >= 5, "medium").when(c < 5, "low").alias("band"),
    )


def probability_band(p: Column) -> Column:
    """M9 (probability gauge): < 30 red, < 70 yellow, else green (p in %)."""
    return F.when(p < 30, "red").when(p < 70, "yellow").when(p >= 70, "green")


def filter_history(df: DataFrame, category: str = "All", min_score: float = 0.0) -> DataFrame:
    """Category equality (skipped for 'All') and composite >= min."""
    out = df
    if category != "All" and "category" in df.columns:
        out = out.filter(F.col("category") == category)
    if "composite_score" in df.columns:
        out = out.filter(F.col("composite_score") >= min_score)
    return out
