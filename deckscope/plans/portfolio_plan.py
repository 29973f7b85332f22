"""Portfolio plans over a result table (one row per document).

* ``portfolio_insights`` -- the six insight frames (composition, risk,
  recommendations, market trends, due-diligence flags, benchmark summary).
* ``report_datasets`` -- the named datasets of the full report (ranked
  table, chart datasets, category analysis, correlation, executive summary),
  built lazily from one input; ``write_report`` writes them with
  ``sources.sinks.report_bundle`` (input persisted once, failures isolated).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from deckscope.operators import charts as CH
from deckscope.operators import ml as ML
from deckscope.operators import portfolio as P
from deckscope.operators import ranking as R
from deckscope.sources.sinks import report_bundle


def portfolio_insights(results: DataFrame) -> dict[str, DataFrame]:
    """The six insight frames of the web batch path (lazy DataFrames)."""
    return {
        "portfolio_summary": P.portfolio_composition(results),
        "risk_assessment": P.portfolio_risk(results),
        "investment_recommendations": P.recommendations(results),
        "market_trends": P.market_trends(results),
        "due_diligence_flags": P.due_diligence_flags(results),
        "benchmark_analysis": P.benchmark_summary(P.benchmark_comparison(results)),
    }


def report_datasets() -> dict[str, Callable[[DataFrame], DataFrame | None]]:
    """Builders of the report datasets, by name (each takes the result table)."""
    def clusters(df):
        c = ML.cluster_performance(df)
        return None if c is None else ML.project_2d(c)

    return {
        "ranked_table": lambda df: R.summary_table(df, materialize_input=False),
        "radar_chart": CH.radar_rows,
        "ranking_chart": R.ranking_chart_rows,
        "score_distributions": P.histogram,
        "performance_matrix": CH.matrix_rows,
        "category_analysis": P.category_stats,
        "scatter_3d": CH.scatter3d_rows,
        "parallel_coordinates": CH.parallel_rows,
        "competitive_landscape": CH.landscape_rows,
        "risk_heatmap": P.risk_factors,
        "performance_clusters": clusters,
        "hierarchy": P.tier_hierarchy,
        "correlation_matrix": P.correlation_matrix,
        "executive_summary": P.executive_summary,
    }


def write_report(results: DataFrame, path: str, names: list[str] | None = None) -> dict[str, str]:
    """A10: write the report datasets as JSON under ``path/<name>``; returns
    name -> 'ok' / 'skipped' / error text (one failure does not stop the rest)."""
    builders = report_datasets()
    if names is not None:
        builders = {k: v for k, v in builders.items() if k in names}
    return report_bundle(results, path, builders)
