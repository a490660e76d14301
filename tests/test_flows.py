"""The verbs on a small dataset of our own, from files to files."""

import json

import pytest
from pyspark.sql import functions as F

from loomscore.operators import dialogue, generation, metrics, rules
from loomscore.plans import flows, runner
from loomscore.sources import schemas, tables

PROMPT = {"version": "q", "slots": ["dialogue", "candidates"], "template": "{dialogue}\n{candidates}"}


def sample(i, gold, text="Dana went home", variant="base", pairs=("S1:base~v1",), **label):
    people = [{"entity_id": f"P{k}", "name": n, "aliases": [], "in_dialogue": k < 3} for k, n in ((1, "Alma"), (2, "Bela"), (3, "Dana"))]
    turns = [{"turn_index": 1, "speaker_id": "P1", "text": "where is Dana"}, {"turn_index": 2, "speaker_id": "P2", "text": text}]
    record = {"sample_id": i, "dataset": "controlled", "scenario_id": "S1", "pair_ids": list(pairs), "variant": variant, "participants": people, "dialogue": turns, "speaker_id": "P2", "target_turn": 2, "target_predicate": "went", "creation_method": "human", "generation_metadata": {"created": "2024", "x": 1}, "version": "1"}
    base = {"sample_id": i, "gold_referent_id": gold, "anchor_turn": 1, "anchor_referent_id": "P3", "ambiguity_status": "unambiguous", "annotation_status": "accepted", "linguistic_cues": [], "manipulated_variables": ["referent_shift"] if variant != "base" else [], "pair_claims": {}, "pair_expected_gold_change": {}, "validation_metadata": {}}
    return record, base | label


@pytest.fixture
def folder(tmp_path):
    def write(*samples):
        for name, k in (("dialogues.jsonl", 0), ("labels.jsonl", 1)):
            (tmp_path / name).write_text("".join(json.dumps(s[k], ensure_ascii=False) + "\n" for s in samples))
        return str(tmp_path)

    return write


def test_a_clean_dataset_has_no_errors(spark, folder):
    path = folder(sample("a", "P3"), sample("b", "P1", text="so went she", variant="v1"))
    assert "error" not in flows.validate(spark, path, f"{path}/issues")


def test_problems_are_told(spark, folder):
    path = folder(sample("a", "P9"), sample("b", "P3", text="P1 went and went", variant="v1", pairs=("S1:base~v1", "S1:x~y")))
    flows.validate(spark, path, f"{path}/issues")
    codes = {r["code"] for r in spark.read.json(f"{path}/issues").collect()}
    assert {"GOLD_NOT_CANDIDATE", "ID_IN_TEXT", "PREDICATE_SPAN"} - codes == {"PREDICATE_SPAN"}  # it is where the first one is
    missing = folder(sample("a", "P3"), (sample("b", "P3")[0], sample("c", "P3")[1]))
    assert flows.validate(spark, missing) == {"error": 2}


def test_payload_benchmark_and_baselines(spark, folder):
    path = folder(sample("a", "P3"), sample("b", "P1", text="so went she", variant="v1"), sample("c", None, ambiguity_status="ambiguous", annotation_status="rejected", pairs=()))
    assert flows.payload(spark, path, f"{path}/out") == {"items": 2, "skipped": 1, "leaks": 0}
    scored = flows.benchmark(spark, f"{path}/out", f"{path}/run", runner.Mock("first"), {"model_id": "m"}, PROMPT)
    summary = {r["condition"]: r for r in metrics.benchmark_summary(scored).collect()}
    assert summary["full_mcq"]["ok"] == 2 and summary["full_mcq"]["n_rows"] == 2
    sheet = tables.read_csv(spark, f"{path}/run/per_sample")
    assert tuple(sheet.columns) == schemas.PER_SAMPLE and sheet.count() == 4
    ci = flows.intervals(scored, 20)
    assert ci["m", "full_mcq"]["n_rows"] == 2 and ci["m", "full_mcq"]["n_clusters"] == 1
    found = {r["model_label"]: r for r in flows.run_baselines(spark, f"{path}/out").collect()}
    assert found["most_recent_entity"]["accuracy_numerator"] == 1 and found["current_addressee"]["accuracy_numerator"] == 1
    with pytest.raises(ValueError, match="unknown conditions"):
        flows.benchmark(spark, f"{path}/out", f"{path}/run", runner.Mock(), {"model_id": "m"}, PROMPT, conditions=("other",))


def test_pairs_are_compared(spark, folder):
    path = folder(sample("a", "P3"), sample("b", "P1", text="so went she", variant="v1", expected_gold_change=True))
    diff, problems = flows.pair_report(spark, path)
    row = diff.first()
    assert {"gold_referent_id", "gold_referent_role"} <= set(row["differing_variables"]) and row["observed_gold_change"] and row["differing_turns"] == [2]
    assert row["unclaimed_differences"] == [] and not row["is_single_variable_pair"] and problems.count() == 0


def test_pairs_with_conflicting_claims_are_problems_only(spark, folder):
    claims = [{"pair_claims": {"S1:base~v1": [c]}} for c in ("referent_shift", "distractor")]
    path = folder(sample("a", "P3", **claims[0]), sample("b", "P1", text="so went she", variant="v1", **claims[1]))
    diff, problems = flows.pair_report(spark, path)
    assert diff.count() == 0 and "conflicting" in problems.first()["problem"]


SHOWN = {"version": "plain", "slots": ["dialogue", "target_marker", "target_speaker_label", "candidates"], "template": "{dialogue}\n{target_speaker_label}: {target_marker}\n" + rules.CANDIDATE_HEAD + "\n{candidates}"}


def test_leaks_are_found_in_items_and_requests(spark, folder):
    """In the items' keys, texts and line counts, and in what is sent, with or without gold."""
    path = folder(sample("a", "P3"), sample("b", "P1", text="the speaker spoke\nof Alma"))
    d = dialogue.neutral_ids(flows.derived(spark, path)).withColumn("author_rationale", F.when(F.col("sample_id") == "a", "Dana went"))
    plain = sorted((r["sample_id"], r["code"]) for r in flows.sample_leaks(d).collect())
    assert plain == [("a", "ITEM_HAS_RATIONALE"), ("b", "FUTURE_CONTEXT")]  # prompts are checked where one is given
    found = sorted((r["sample_id"], r["code"]) for r in flows.sample_leaks(d, SHOWN).collect())
    assert found == [("a", "ITEM_HAS_RATIONALE"), ("b", "FUTURE_CONTEXT"), ("b", "PROMPT_ROLE_WORD"), ("b", "PROMPT_ROLE_WORD")]
    telling = {**SHOWN, "template": "Your role: " + SHOWN["template"]}
    assert [r["sample_id"] for r in flows.sample_leaks(d, telling).collect() if r["code"] == "PROMPT_ROLE_FIELD"].count("a") == 2
    items, gold = dialogue.items(d), dialogue.gold(d)
    system = {"system": 'the role is "e1"'}
    for key in (gold, gold.limit(0)):  # an item without gold is searched too
        leaks = [(r["sample_id"], r["code"]) for r in flows.payload_leaks(items, key, SHOWN, system).collect()]
        assert ("b", "FUTURE_CONTEXT") in leaks and leaks.count(("a", "PROMPT_ROLE_WORD")) == 2
    told = {r["sample_id"] for r in flows.payload_leaks(items, gold.withColumn("gold_entity_id", F.lit("E1")), SHOWN, system).collect() if r["code"] == "PROMPT_GOLD_ID"}
    assert told == {"a", "b"}


def test_an_item_with_a_forbidden_key_is_named_alone(spark, folder):
    path = folder(sample("a", "P3"), sample("b", "P1"))
    d = dialogue.neutral_ids(flows.derived(spark, path))
    items, gold = dialogue.items(d), dialogue.gold(d)
    extra = F.when(F.col("item_id") == "b", F.create_map(F.lit("x"), F.array(F.create_map(F.lit("id_map"), F.lit("1")))))
    leaks = flows.payload_leaks(items.withColumn("extra", extra), gold).collect()
    assert [(r["sample_id"], r["code"], r["message"]) for r in leaks] == [("b", "ITEM_FORBIDDEN_KEY", "item carries extra.x.[0].id_map")]
    body = items.select("item_id", F.when(F.col("item_id") == "a", '{"item_id": "a", "notes": {"gold_role": null}}').otherwise("{}").alias("json"))
    assert [(r["sample_id"], r["message"]) for r in flows.payload_leaks(items, gold, body=body).collect()] == [("a", "item carries notes.gold_role")]


def test_each_gold_key_is_refused(spark):
    for k in dialogue.GOLD_KEYS:
        bad = spark.createDataFrame([("i", "x")], f"item_id string, {k} string")
        with pytest.raises(ValueError, match="gold"):
            runner.requests(bad, ("full_mcq",), PROMPT, {"model_id": "m"})
        assert runner.strip_gold(bad).columns == ["item_id"]
    rows = spark.createDataFrame([(k, json.dumps({"a": [{k: 1}]})) for k in dialogue.FORBIDDEN_ITEM_KEYS], "id string, j string")
    found = {r["id"]: r["paths"] for r in rules.key_paths(rows, "id", F.col("j"), dialogue.FORBIDDEN_ITEM_KEYS).collect()}
    assert found == {k: [f"a.[0].{k}"] for k in dialogue.FORBIDDEN_ITEM_KEYS}


def test_scenario_constraints(spark):
    kind = "sample_id string, participants array<struct<entity_id:string>>, intended_gold_id string, previous_referent_id string, distractor_id string, variants array<struct<variant:string,expected_gold_id:string,pair_with:string>>"
    rows = [("good", [("P1",), ("P2",)], "P1", None, "P2", [("v1", "P2", "base"), ("v2", None, "v1")]), ("bad", [("P1",)], "P9", "P1", None, [("v1", "P9", None), ("v1", None, "v7")])]
    found = rules.issues(spark.createDataFrame(rows, kind), rules.scenario_rules())
    assert sorted((r["sample_id"], r["code"]) for r in found.collect()) == [("bad", c) for c in ("SCENARIO_LINK", "VARIANTS_REPEATED", "VARIANT_GOLD", "VARIANT_PAIR")]


def test_scenarios_to_drafts(spark, tmp_path):
    scenario = {"scenario_id": "S1", "dataset": "controlled", "title": "t", "setting": "s", "participants": [{"entity_id": "P1", "name": "Alma", "in_dialogue": True}, {"entity_id": "P2", "name": "Bela", "in_dialogue": True}], "intended_gold_id": "P1", "distractor_id": "P2", "conditions": {"target_role": "speaker", "n_turns": 2}, "required_context": [], "naturalness_constraints": ["short"], "cue_constraints": [], "variants": [{"variant": "v1", "description": "d", "manipulated_variables": ["distractor"], "expected_gold_id": "P2", "pair_with": "base"}]}
    (tmp_path / "sc.jsonl").write_text(json.dumps(scenario) + "\n")
    rows, twice = tables.load_scenarios(spark, str(tmp_path / "sc.jsonl"))
    assert twice.count() == 0 and {(r["axis"], r["n"]) for r in generation.summary(rows).collect()} >= {("n_scenarios", 1), ("n_variants", 1)}
    jobs = generation.jobs(rows)
    assert {r["sample_id"]: r["pair_ids"] for r in jobs.collect()} == {"S1-base": ["S1:base~v1"], "S1-v1": ["S1:base~v1"]}
    asked = generation.requests(jobs, {"version": "g", "slots": ["scenario", "constraints"], "template": "{scenario}\n{constraints}"}, {"model_id": "m"}, "{}")
    assert all("- short" in r["user"] and "Alma" in r["user"] for r in asked.collect())
    answer = '{"turns": [{"speaker": "Alma", "text": " hi "}, {"speaker": "Bela", "text": "went"}], "target_turn": 2, "target_predicate": "went"}'
    read = generation.parsed(jobs.withColumn("raw_text", F.when(F.col("variant") == "base", answer).otherwise('{"turns": [{"speaker": "Zoe", "text": "x"}]}')))
    problems = {r["variant"]: r["problem"] for r in read.collect()}
    assert problems == {"base": None, "v1": "unknown speaker"}
    records, labels = generation.drafts(read, {"model_id": "m"}, "g", "2024")
    assert records.first()["speaker_id"] == "P2" and labels.first()["distractor_id"] == "P2"
