"""The engine's verbs: each composes operators, writes what it makes and returns a small summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agreement, baselines, dialogue, generation, joins, metrics, pairs, resample, rules
from ..sources import schemas, tables
from . import runner, runs

MODEL_COLUMNS = {"generation_model": "$.model", "generation_created": "$.created"}


def derived(spark: SparkSession, folder: str) -> DataFrame:
    """A dataset's samples with all derived columns."""
    rows = tables.checked_dataset(spark, folder)
    return dialogue.derive(rows.withColumns({c: F.try_variant_get("generation_metadata", p, "string") for c, p in MODEL_COLUMNS.items()}))


def validate(spark: SparkSession, folder: str, out: str | None = None, scenarios: str | None = None, prompt: dict | None = None) -> dict:
    """All rules over a dataset, with a prompt also over its requests; schema problems alone where there are any."""
    rows, problems = tables.load_dataset(spark, folder)
    if not problems.isEmpty():
        place = F.when(F.col("file").isNotNull(), F.concat(F.lit(" ("), "file", F.lit(":"), F.col("line").cast("string"), F.lit(")"))).otherwise("")
        found = problems.unionByName(tables.broken_constraints(spark, folder)).select(F.lit("error").alias("level"), "sample_id", F.lit("SCHEMA").alias("code"), F.concat("problem", place).alias("message"))
    else:
        rows = derived(spark, folder)
        body = F.array_join(F.transform("dialogue", lambda t: F.concat(t["speaker_id"], F.lit("\t"), t["text"])), "\n")
        found = rules.issues(rows, [*rules.record_rules(), *rules.label_rules(), *rules.structure_rules()])
        found = found.unionByName(rules.duplicates(rows, "sample_id", "sample_id", body, F.concat_ws(":", "target_turn", "target_predicate")))
        own = rows.withColumn("candidates", rules.ids())
        if scenarios:
            sc, _ = tables.load_scenarios(spark, scenarios)
            if again := [f"{r['problem']} {r['scenario_id']} ({r['file']}:{r['line']})" for r in tables.scenario_problems(spark, scenarios).limit(100).collect()]:
                raise ValueError("scenario errors:\n- " + "\n- ".join(again))
            sc = sc.select("scenario_id", F.transform("participants", lambda p: p["entity_id"]).alias("candidates"), F.transform("variants", lambda v: v["variant"]).alias("variants"))
            found = found.unionByName(rules.links(own, sc))
        found = found.unionByName(sample_leaks(dialogue.neutral_ids(rows), prompt))
        found = found.unionByName(rules.balance_issues(rules.balance(rows)))
    if out:
        tables.write_jsonl(found, out)
        found = tables.read_jsonl(spark, out, "level string, sample_id string, code string, message string")
    return {r["level"]: r["n"] for r in rules.level_counts(found).collect()}


def asked(items: DataFrame, prompt: dict, config: dict, qa_prompt: dict | None = None) -> dict[str, Column]:
    """What the requests for each condition say, as columns of ``items``: no row is made or joined."""
    conditions = ("full_mcq", "target_only_mcq", *(("full_qa",) if qa_prompt else ()))
    return {c: F.concat(F.lit(config.get("system", "") + "\n"), runner.says(c, prompt, config, qa_prompt)["user"]) for c in conditions}


def payload_leaks(items: DataFrame, gold: DataFrame, prompt: dict | None = None, config: dict | None = None, qa_prompt: dict | None = None, body: DataFrame | None = None) -> DataFrame:
    """Issues of written items and, with a prompt, of the requests built from them; an item without gold is searched all the same.

    ``body``: (item_id, json) of the items as they were written, columns that ``items`` doesn't know included.
    """
    keys = gold.select("item_id", "gold_entity_id", F.map_values("id_map").alias("original_ids"))
    own = rules.with_key_paths(items, "item_id", dialogue.FORBIDDEN_ITEM_KEYS, body)
    own = own.join(keys, "item_id", "left").withColumn("original_ids", F.coalesce("original_ids", F.array().cast("array<string>")))
    says = asked(own, prompt, config or {}, qa_prompt) if prompt else {}
    return rules.issues(own, rules.payload_rules(says, items.columns), "item_id")


def sample_leaks(samples: DataFrame, prompt: dict | None = None) -> DataFrame:
    """Issues of the items that derived samples with id_map would give and, with a prompt, of their requests."""
    items = dialogue.items(samples)
    rationale = F.col("author_rationale") if "author_rationale" in samples.columns else F.lit(None).cast("string")
    own = rules.with_key_paths(items, "item_id", dialogue.FORBIDDEN_ITEM_KEYS).join(samples.select(F.col("sample_id").alias("item_id"), rationale.alias("author_rationale"), "gold_referent_id"), "item_id")
    says = asked(own, prompt, {}) if prompt and prompt["template"].strip() else {}
    return rules.issues(own, rules.leak_rules(says, items.columns), "item_id")


def payload(
    spark: SparkSession, folder: str, out: str, seed: int = 0, include_unreviewed: bool = False, prompt: dict | None = None, config: dict | None = None, qa_prompt: dict | None = None
) -> dict:
    """Items and gold keys of a dataset, written, read again and searched for leaks as they were written."""
    kept, skipped = dialogue.evaluation_split(dialogue.neutral_ids(derived(spark, folder), seed), include_unreviewed)
    tables.write_jsonl(dialogue.items(kept), f"{out}/items")
    tables.write_jsonl(dialogue.gold(kept), f"{out}/gold")
    items, gold = tables.read_jsonl(spark, f"{out}/items", schemas.ITEMS), tables.read_jsonl(spark, f"{out}/gold", schemas.GOLD)
    lines = spark.read.text(f"{out}/items").select(F.parse_json("value").alias("v"))
    body = lines.select(F.try_variant_get("v", "$.item_id", "string").alias("item_id"), F.to_json("v").alias("json"))
    leaks = payload_leaks(items, gold, prompt, config, qa_prompt, body)
    return {"items": items.count(), "skipped": skipped.count(), "leaks": leaks.count()}


def checked_conditions(conditions: Sequence[str]) -> tuple[str, ...]:
    if odd := set(conditions) - {"full_mcq", "target_only_mcq", "full_qa"}:
        raise ValueError(f"unknown conditions {sorted(odd)}")
    return tuple(conditions)


def send(spark: SparkSession, folder: str, out: str, adapter: runner.Adapter, config: dict, prompt: dict, qa_prompt: dict | None = None, conditions: Sequence[str] = ("full_mcq", "target_only_mcq"), cache: str | None = None, seed: int = 0, **options: object) -> dict:
    """The requests of a folder's items, sent in a run folder that can be taken up again; the run's counts."""
    items = tables.read_jsonl(spark, f"{folder}/items", schemas.ITEMS)
    known = spark.read.schema(schemas.RESPONSES).json(cache) if cache else None
    digests = {"items_sha256": tables.folder_digest(spark, f"{folder}/items")}
    return runs.run_folder(spark, items, checked_conditions(conditions), adapter, prompt, config, out, qa_prompt, seed, digests, cache=known, **options)


def benchmark(spark: SparkSession, folder: str, out: str, adapter: runner.Adapter, config: dict, prompt: dict, qa_prompt: dict | None = None, conditions: Sequence[str] = ("full_mcq", "target_only_mcq"), cache: str | None = None, **options: object) -> DataFrame:
    """Alignment check, run, normalisation, gold join, sheet and all summaries."""
    checked_conditions(conditions)
    items, gold = tables.read_jsonl(spark, f"{folder}/items", schemas.ITEMS), tables.read_jsonl(spark, f"{folder}/gold", schemas.GOLD)
    aligned = joins.alignment_problems(items.select("item_id", F.transform("candidates", lambda c: c["entity_id"]).alias("candidate_ids")), gold)
    if wrong := aligned.limit(20).collect():
        raise ValueError("items and gold differ:\n- " + "\n- ".join(f"{r['item_id']}: {r['problem']}" for r in wrong))
    send(spark, folder, out, adapter, config, prompt, qa_prompt, conditions, cache, **options)
    others = F.filter("dialogue_participants", lambda p: ~p.eqNullSafe(F.col("target_speaker_id")))
    label = F.try_element_at(F.filter("candidates", lambda c: c["entity_id"] == F.try_element_at(others, F.lit(1))), F.lit(1))["label"]
    seen = items.withColumn("addressee_label", F.when(F.size(others) == 1, label))
    rows = runner.normalise(spark.read.schema(schemas.RESPONSES).json(f"{out}/responses"), seen)
    tables.write_jsonl(rows, f"{out}/normalized")
    scored = joins.strict_join(rows, gold, "item_id").withColumn("predicted_role", joins.predicted_role())
    tables.write_csv(tables.per_sample(scored), f"{out}/per_sample")
    report(scored, out)
    return scored


def summaries(scored: DataFrame) -> dict[str, DataFrame]:
    """All parts of a benchmark's summary, by model and condition."""
    keys = ["model_label", "condition"]
    paired = pairs.pair_consistency(scored, tuple(keys))
    return {
        "metrics": metrics.benchmark_summary(scored),
        "tables": metrics.benchmark_tables(scored),
        "role_confusion": metrics.confusion(scored, F.col("gold_role"), F.col("predicted_role"), keys),
        "slot_confusion": metrics.confusion(scored, F.col("gold_entity_id"), F.col("predicted_entity_id"), keys),
        "pair_consistency": pairs.pair_summary(paired, *keys, names=pairs.CONSISTENCY).drop("n_families"),
        "dropped_pairs": paired.filter("c1 IS NULL OR c2 IS NULL").select(*keys, "pair_id").distinct(),
        "context_benefit": pairs.condition_benefit(scored, "full_mcq", "target_only_mcq", "item_id"),
    }


def report(scored: DataFrame, out: str) -> None:
    """``summaries`` as folders of JSON lines."""
    for name, rows in summaries(scored).items():
        tables.write_jsonl(rows, f"{out}/{name}")


def metrics_report(spark: SparkSession, normalized: str, gold: str, out: str, n_boot: int = 0, cluster: str = "conversation_id", seed: int = 0) -> DataFrame:
    """Summaries of normalised answers, with intervals by model and condition where ``n_boot`` isn't 0."""
    keyed = tables.read_jsonl(spark, gold, schemas.GOLD)
    rows = tables.read_jsonl(spark, normalized, schemas.NORMALIZED)
    scored = joins.strict_join(rows, keyed, "item_id").withColumn("predicted_role", joins.predicted_role())
    report(scored, out)
    if n_boot:
        found = intervals(scored, n_boot, cluster, seed)
        body = [{"model_label": m, "condition": c, **v} for (m, c), v in found.items()]
        tables.write_document(spark, body, f"{out}/bootstrap")
    return spark.read.json(f"{out}/metrics")


def generate(spark: SparkSession, scenarios: str, out: str, adapter: runner.Adapter, config: dict, prompt: dict, created: str, ids: Sequence[str] | None = None, variants: str = "all", **options: object) -> dict:
    """Drafts of scenarios: requests in a run folder, answers read into a dataset, and what couldn't be read."""
    rows, _ = tables.load_scenarios(spark, scenarios)
    jobs = generation.jobs(rows, ids, variants)
    asked = generation.requests(jobs, prompt, config, config.get("output_schema", ""))
    counts = runs.settle(spark, asked, adapter, f"{out}/run", {**config, "prompt_version": prompt["version"]}, **options)
    answers = spark.read.schema(schemas.RESPONSES).json(f"{out}/run/responses").select("item_id", "raw_text")
    read = generation.parsed(jobs.join(answers, "item_id"))
    records, labels = generation.drafts(read, config, prompt["version"], created)
    tables.write_jsonl(records, f"{out}/{tables.DIALOGUES}")
    tables.write_jsonl(labels, f"{out}/{tables.LABELS}")
    tables.write_jsonl(read.filter("problem IS NOT NULL").select("item_id", "problem"), f"{out}/unread")
    return counts


def status(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """The parts of a dataset or run folder and what state each is in."""
    parts = (tables.DIALOGUES, tables.LABELS, "items", "gold", "config", "requests", "responses", "summary", "normalized", "metrics")
    there = {p: tables.exists(spark, f"{root}/{p}") for p in parts}
    found = [(p, "there" if there[p] else "missing") for p in parts]
    n = runs.written_passes(spark, root)
    return found + [("run", "none" if not n else f"ended after {n} passes" if there["summary"] else f"stopped in pass {n}")]


def run_baselines(spark: SparkSession, folder: str) -> DataFrame:
    items, gold = tables.read_jsonl(spark, f"{folder}/items", schemas.ITEMS), tables.read_jsonl(spark, f"{folder}/gold", schemas.GOLD)
    return metrics.benchmark_summary(joins.strict_join(baselines.run(items), gold, "item_id"))


def intervals(scored: DataFrame, n_boot: int, cluster: str = "conversation_id", seed: int = 0) -> dict[tuple[str, str], dict]:
    """Accuracy with a cluster bootstrap for each model and condition (a few, chosen by the run)."""
    keys = [tuple(r) for r in scored.select("model_label", "condition").distinct().collect()]
    return {k: resample.bootstrap(scored.filter((F.col("model_label") == k[0]) & (F.col("condition") == k[1])), cluster, resample.accuracy(), n_boot, seed).first().asDict() for k in keys}


def pair_report(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Differences of a dataset's pairs, and their problems."""
    turns = F.map_from_entries(F.transform("dialogue", lambda t: F.struct(t["turn_index"], F.concat_ws("\t", t["speaker_id"], t["text"]))))
    rows = derived(spark, folder).withColumns({"candidates": rules.ids(), "target_text": F.try_element_at("dialogue", F.col("target_turn"))["text"], "turns": turns})
    fields = ("sample_id", "scenario_id", "variant", "pair_ids", "pair_claims", "pair_expected_gold_change", "manipulated_variables", "expected_gold_change", "candidates", "target_text", "turns", *pairs.CONTROLLED_VARIABLES)
    two = pairs.members(rows.select(*dict.fromkeys(fields)))
    found = pairs.pair_diff(two)
    return pairs.manifest(found), pairs.pair_problems(two, found)


def pair_sheet(spark: SparkSession, folder: str, out: str) -> None:
    """Both dialogues of each pair side by side, with empty judgements."""
    found, _ = pair_report(spark, folder)
    shown = derived(spark, folder).select("sample_id", dialogue.render(F.size("dialogue"), mark=True).alias("d"))
    a, b = (shown.select(F.col("sample_id").alias(f"{s}_id"), F.col("d").alias(f"dialogue_{s}")) for s in "ab")
    blank = [F.lit("").alias(c) for c in ("pair_valid", "only_claimed_changed", "gold_change_as_intended", "notes")]
    rows = found.join(a, "a_id").join(b, "b_id").select("pair_id", F.col("a_id").alias("sample_a"), F.col("b_id").alias("sample_b"), F.array_join("claimed_manipulations", ",").alias("claimed_manipulations"), "dialogue_a", "dialogue_b", *blank)
    tables.write_csv(rows, out)


def adjudicate(spark: SparkSession, folder: str, sheets: str, ids: str, decisions: str | None = None) -> DataFrame:
    """Final labels of a dataset from its sheets; problems in the sheets stop it."""
    rows = tables.checked_dataset(spark, folder)
    votes = tables.load_sheets(spark, sheets, spark.read.schema("sample_id string, review_id string").json(ids))
    wrong = agreement.vote_problems(votes, rows.select("sample_id", rules.ids().alias("ids"))).limit(20).collect()
    if wrong:
        raise ValueError("sheets have problems:\n- " + "\n- ".join(f"{r['annotator']}/{r['sample_id']}: {r['problem']}" for r in wrong))
    return agreement.adjudicate(rows.select("sample_id", "gold_referent_id", "addressee_id", "ambiguity_status"), votes, tables.load_decisions(spark, decisions))
