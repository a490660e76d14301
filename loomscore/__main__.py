"""Command line: python -m loomscore VERB ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from .operators import agreement, generation, metrics
from .plans import flows, review, runner
from .sources import tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomscore")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *names: str, **flags: object) -> None:
        v = verbs.add_parser(name)
        for n in names:
            v.add_argument(n)
        for flag, default in flags.items():
            v.add_argument(f"--{flag.replace('_', '-')}", **({"action": "store_true"} if default is False else {"type": type(default) if default is not None else str, "default": default}))

    verb("status", "root")
    verb("check-prompt", "prompt")
    verb("scenarios", "path")
    verb("generate", "scenarios", "out", "prompt", "models", "label", adapter="mock", created="", ids=None, variants="all")
    verb("validate", "folder", out=None, scenarios=None, prompt=None, strict=False)
    verb("pairs", "folder")
    verb("pair-sheet", "folder", "out")
    verb("payload", "folder", "out", seed=0, include_unreviewed=False, prompt=None, qa_prompt=None, models=None, label=None)
    verb("run", "folder", "out", "prompt", "models", "label", qa_prompt=None, conditions="full_mcq,target_only_mcq", adapter="mock", cache=None, seed=0)
    verb("benchmark", "folder", "out", "prompt", "models", "label", qa_prompt=None, conditions="full_mcq,target_only_mcq", adapter="mock", cache=None, seed=0)
    verb("metrics", "normalized", "gold", "out", n_boot=0, cluster="conversation_id", seed=0)
    verb("baselines", "folder")
    verb("model-fill", "sheet", "out", "models", "label", "condition", adapter="mock", only_empty=False)
    verb("agreement", "sheets", "ids")
    verb("adjudicate", "folder", "sheets", "ids", "out", decisions=None)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("loomscore").getOrCreate()

    def show(rows: DataFrame) -> None:
        """Every row, a line each, in the driver's hands one partition at a time."""
        for r in rows.toLocalIterator():
            print(json.dumps(r.asDict(True), ensure_ascii=False, default=str))

    def asked(path: str | None) -> dict | None:
        return tables.load_prompt(spark, path, runner.PROMPT_SLOTS) if path else None

    if a.verb == "check-prompt":
        problems = tables.prompt_problems(tables.read_document(spark, a.prompt))
        print(*problems, sep="\n")
        return int(bool(problems))
    if a.verb == "status":
        for name, state in flows.status(spark, a.root):
            print(f"{name}: {state}")
    elif a.verb == "scenarios":
        show(generation.summary(tables.load_scenarios(spark, a.path)[0]))
    elif a.verb == "generate":
        prompt = tables.load_prompt(spark, a.prompt, runner.GENERATE_SLOTS)
        print(json.dumps(flows.generate(spark, a.scenarios, a.out, runner.get_adapter(a.adapter), tables.load_model(spark, a.models, a.label), prompt, a.created, a.ids and a.ids.split(","), a.variants)))
    elif a.verb == "validate":
        counts = flows.validate(spark, a.folder, a.out, a.scenarios, asked(a.prompt))
        print(json.dumps(counts))
        return int(a.strict and counts.get("error", 0) > 0)
    elif a.verb == "pairs":
        for rows in flows.pair_report(spark, a.folder):
            show(rows)
    elif a.verb == "pair-sheet":
        flows.pair_sheet(spark, a.folder, a.out)
    elif a.verb == "payload":
        config = tables.load_model(spark, a.models, a.label) if a.models else None
        print(json.dumps(flows.payload(spark, a.folder, a.out, a.seed, a.include_unreviewed, asked(a.prompt), config, asked(a.qa_prompt))))
    elif a.verb in ("run", "benchmark"):
        parts = (spark, a.folder, a.out, runner.get_adapter(a.adapter), tables.load_model(spark, a.models, a.label), asked(a.prompt), asked(a.qa_prompt), a.conditions.split(","), a.cache)
        if a.verb == "run":
            print(json.dumps(flows.send(*parts, seed=a.seed)))
        else:
            show(metrics.benchmark_summary(flows.benchmark(*parts, seed=a.seed)))
    elif a.verb == "metrics":
        show(flows.metrics_report(spark, a.normalized, a.gold, a.out, a.n_boot, a.cluster, a.seed))
    elif a.verb == "baselines":
        show(flows.run_baselines(spark, a.folder))
    elif a.verb == "model-fill":
        print(json.dumps(review.fill(spark, a.sheet, a.out, runner.get_adapter(a.adapter), tables.load_model(spark, a.models, a.label), a.condition, a.only_empty)))
    elif a.verb == "agreement":
        show(agreement.agreement(tables.load_sheets(spark, a.sheets, spark.read.schema("sample_id string, review_id string").json(a.ids))))
    elif a.verb == "adjudicate":
        tables.write_jsonl(flows.adjudicate(spark, a.folder, a.sheets, a.ids, a.decisions), a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
