"""Command-line entry points (non-interactive).

    python -m deckscope.plans.cli batch --input DOCS.parquet --output OUT [--responses R.parquet]
    python -m deckscope.plans.cli watch --input IN_DIR --output OUT --checkpoint CKPT --schema-from SAMPLE.parquet

``batch``: scores a document table (columns doc_id, deck_name, text) and
writes ``ranked/`` (CSV with header), ``errors/`` (too-short documents),
``report/`` (report datasets as JSON) and appends ``history/``.
``watch``: runs the folder-watch stream until the files present are done
(``--continuous`` keeps it running).
"""

from __future__ import annotations

import argparse
import json
import sys

from deckscope import lexicons as L
from deckscope.operators.ranking import materialize, summary_table
from deckscope.plans.document_plan import analyze, route_errors, timed_run, with_extraction
from deckscope.plans.portfolio_plan import write_report
from deckscope.session import get_spark
from deckscope.sources import sinks as SK
from deckscope.sources.tables import spread


def run_batch(spark, input_path: str, output: str, responses: str | None = None) -> dict:
    docs = spread(spark.read.parquet(input_path))
    resp = spark.read.parquet(responses) if responses else None
    results, metrics = timed_run(docs, lambda d: materialize(analyze(d, responses=resp, keep_text=False)
                                                             .drop("text", "extracted", "full_text", "sections")))
    SK.write_ranked_csv(summary_table(results, materialize_input=False), f"{output}/ranked")
    _, errors = route_errors(with_extraction(docs))
    errors.write.mode("overwrite").parquet(f"{output}/errors")
    report = write_report(results, f"{output}/report")
    SK.append_history(results.select("deck_name", "category", *L.DIMENSIONS, "composite_score"), f"{output}/history")
    return {"metrics": metrics, "report": report}


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="deckscope")
    sub = ap.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("batch")
    b.add_argument("--input", required=True)
    b.add_argument("--output", required=True)
    b.add_argument("--responses")
    w = sub.add_parser("watch")
    w.add_argument("--input", required=True)
    w.add_argument("--output", required=True)
    w.add_argument("--checkpoint", required=True)
    w.add_argument("--schema-from", required=True, help="a parquet file with the input schema")
    w.add_argument("--continuous", action="store_true")
    args = ap.parse_args(argv)
    spark = get_spark()
    if args.cmd == "batch":
        print(json.dumps(run_batch(spark, args.input, args.output, args.responses), default=str))
        return 0
    from deckscope.streaming.watch import start_scoring
    schema = spark.read.parquet(args.schema_from).schema
    q = start_scoring(spark, args.input, args.output, args.checkpoint, schema, available_now=not args.continuous)
    q.awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
