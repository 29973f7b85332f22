"""Plan assertions: the shapes we rely on for scale."""
from deckscope.operators import portfolio as P
from deckscope.operators.scoring import score_documents
from deckscope.operators.sections import sectionize
from deckscope.plans.document_plan import analyze
from deckscope.sources import fixtures as FX
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_is_narrow_and_python_free(spark):
    docs = FX.documents(spark, SF_SMALL)
    plan = _plan(score_documents(sectionize(docs)))
    assert "Exchange" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "InSet" in plan or "INSET" in plan.upper()


def test_scan_reads_only_needed_columns(spark):
    docs = FX.documents(spark, SF_SMALL)
    plan = _plan(analyze(docs).select("deck_name", "composite_score"))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_benchmark_join_broadcasts_dimension_table(spark):
    plan = _plan(P.benchmark_comparison(FX.portfolio(spark, SF_SMALL)))
    assert "BroadcastHashJoin" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_portfolio_aggregates_have_no_cross_join(spark):
    pf = FX.portfolio(spark, SF_SMALL)
    for df in (P.portfolio_risk(pf), P.category_distribution(pf), P.market_trends(pf)):
        plan = _plan(df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_registered_query_plans_a_cross_or_nested_loop_join(spark):
    import __spark_entry__ as E

    bad = {}
    for name, fn in E.queries().items():
        if name.startswith("ml_"):
            continue
        plan = _plan(fn(spark, SF_SMALL))
        if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan or "BatchEvalPython" in plan:
            bad[name] = plan[:300]
    assert not bad, bad


def test_responses_join_shuffles_no_text(spark):
    """With answers joined by document, no text column reaches the join."""
    from deckscope.operators.enrich import enrich
    from deckscope.operators.scoring import score_documents
    from deckscope.operators.sections import sectionize

    scored = score_documents(sectionize(FX.decks(spark, SF_SMALL)), keep_internal=True)
    out = enrich(scored, FX.responses(spark, SF_SMALL), keep_text=False)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    join_part = plan[plan.find("Join"):]
    assert "full_text" not in join_part.split("Project")[0]
    assert not any(c in out.columns for c in ("text", "full_text", "sections", "_lc_full_text"))
