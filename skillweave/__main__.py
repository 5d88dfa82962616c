"""python -m skillweave run | show-prompts | purpose-index"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from skillweave.functions.vocab import STAGES
from skillweave.operators import purpose_index
from skillweave.plans import prompts
from skillweave.plans.config import Settings, read_settings
from skillweave.plans.materialize import materialize, release
from skillweave.plans.pipeline import Pipeline, absolute
from skillweave.sources import jsonl

#: one invented unit with everything a stage may see
DEMO = {
    "data_id": "demo", "repo_name": "example", "relative_path": "retry.py", "language": "python", "symbol": "fetch_with_retry",
    "unit_type": "function", "line_start": 1, "line_end": 8, "interface": "fetch_with_retry(fetch, attempts)",
    "code": "def fetch_with_retry(fetch, attempts):\n    ...", "generated": "def fetch_with_retry(fetch, attempts):\n    pass",
    "first_reason": "the terminal failure is missing", "accepted_stage": "equivalence", "rationale": "equivalent",
    "parser_metadata": {"chunk_index": None, "chunk_count": None, "parent_symbol": None},
    "source_tag": {"keep_for_extraction": True, "selection_rationale": "bounded retries"},
    "skill": {
        "level": "composite", "name": "Bounded retry", "summary": "Try an operation a bounded number of times.", "worth_extracting": True,
        "skill_value_score": 0.9, "generality_score": 0.9, "abstraction_score": 0.8, "confidence": 0.9,
        **{c: [c.replace("_", " ")] for c in prompts.SKILL_LISTS},
    },
}
DEMO_SCHEMA = (
    "data_id string, repo_name string, relative_path string, language string, symbol string, unit_type string, line_start int, line_end int, "
    "interface string, code string, generated string, first_reason string, accepted_stage string, rationale string, "
    "parser_metadata struct<chunk_index: int, chunk_count: int, parent_symbol: string>, "
    "source_tag struct<keep_for_extraction: boolean, selection_rationale: string>, "
    "skill struct<level: string, name: string, summary: string, worth_extracting: boolean, skill_value_score: double, generality_score: double, "
    "abstraction_score: double, confidence: double, " + ", ".join(f"{c}: array<string>" for c in prompts.SKILL_LISTS) + ">"
)

def show_prompts(spark: SparkSession, stage: str) -> list[dict]:
    one = spark.createDataFrame([DEMO], DEMO_SCHEMA)
    return jsonl.plain(one.select(prompts.BUILDERS[stage]().alias("m")).first()["m"])



def index_purposes(spark: SparkSession, source: str, target: str) -> dict:
    """Cards at target, edges and dropped records beside it. A line that is no object ends it with its file:line."""
    lines = purpose_index.records_of(jsonl.read_lines(spark, source), "payload")
    try:
        inferred = materialize(purpose_index.infer(lines))
    except Exception as e:
        if at := jsonl.first_bad_line(spark, source):
            raise ValueError(f"{at}: not a JSON object") from e
        raise
    out = absolute(target)
    stem = out.removesuffix(".jsonl").removesuffix(".json")
    cards, edges, dropped = purpose_index.cards(inferred), purpose_index.edges(inferred), purpose_index.dropped(inferred)
    jsonl.write_lines(cards, out, ("purpose_id",))
    jsonl.write_lines(edges, f"{stem}_edges.jsonl")
    jsonl.write_lines(dropped, f"{stem}_dropped.jsonl")
    said = {"purpose_cards": cards.count(), "edges": edges.count(), "dropped": dropped.count(), "output": out}
    release(inferred)
    return said


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="skillweave", description="Grounded procedural skills from source code, on Spark")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="scan repositories and build verified skill records")
    run.add_argument("input")
    for option in ("--config", "--base-url", "--model", "--output-dir"):
        run.add_argument(option)
    run.add_argument("--api-key-env", default="OPENAI_API_KEY")
    run.add_argument("--allow-public-model-url", action="store_true")
    run.add_argument("--tables-only", action="store_true", help="leave out the single files beside the tables")
    show = commands.add_parser("show-prompts", help="print what one stage's model sees")
    show.add_argument("--stage", required=True, choices=STAGES)
    index = commands.add_parser("purpose-index", help="build the purpose view of accepted records")
    index.add_argument("input")
    index.add_argument("output")
    args = parser.parse_args(argv)
    settings = None
    if args.command == "run":
        if args.config:
            settings = read_settings(args.config)
            settings.output_dir = args.output_dir or settings.output_dir
        elif args.base_url and args.model:
            model = {"base_url": args.base_url, "model": args.model, "api_key_env": args.api_key_env}
            model["allow_public_url"] = args.allow_public_model_url
            settings = Settings(model=model, output_dir=args.output_dir or "runs/latest")
        else:
            raise SystemExit("run needs --config, or --base-url and --model")
    spark = SparkSession.builder.appName("skillweave").getOrCreate()
    if args.command == "show-prompts":
        said = show_prompts(spark, args.stage)
    elif args.command == "purpose-index":
        said = index_purposes(spark, args.input, args.output)
    else:
        said = Pipeline(spark, settings).run(args.input, export=not args.tables_only)["summary"]
    print(json.dumps(said, ensure_ascii=False, indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
