"""Line numbers over splits, and loads that tell all problems."""

import json

import pytest
from pyspark.sql import functions as F

from loomscore.plans import flows
from loomscore.sources import lines, schemas, tables


@pytest.fixture
def small_splits(spark):
    for k, v in (("spark.sql.files.maxPartitionBytes", "1000"), ("spark.sql.files.openCostInBytes", "10")):
        spark.conf.set(k, v)
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)


def test_lines_are_numbered_over_splits(spark, tmp_path, small_splits):
    texts = {f"f{k}.txt": [f"{k}-{i} " + "x" * (i * 7 % 90) if i % 13 else "" for i in range(n)] for k, n in ((0, 1), (1, 400), (2, 37), (3, 1000))}
    for name, rows in texts.items():
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    found = lines.numbered(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    got = {(r["file"].rsplit("/", 1)[1], r["line"]): r["value"] for r in found.collect()}
    assert got == {(name, i + 1): x for name, rows in texts.items() for i, x in enumerate(rows)}


def test_every_bad_line_is_told(spark, tmp_path, small_splits):
    rows = [json.dumps({"s": f"r{i}", "n": i, "l": [i]}) for i in range(200)]
    rows[3], rows[50], rows[51], rows[120], rows[199] = '{"s": "cut', "", "[1]", '{"s": "x", "n": "many"}', '{"s": "y"} {"s": "z"}'
    (tmp_path / "a.jsonl").write_text("\n".join(rows))
    read = lines.read_lines(spark, str(tmp_path / "a.jsonl"), "s string, n int, l array<int>")
    assert {r["line"]: r["problem"] for r in read.filter("problem is not null").collect()} == {4: "not a JSON object", 52: "not a JSON object", 121: "a field of another type", 200: "not a JSON object"}
    good = {r["line"]: tuple(r["row"]) for r in read.filter("problem is null").collect()}
    assert good == {i + 1: (f"r{i}", i, [i]) for i in range(200) if i not in (3, 50, 51, 120, 199)}


def record(i, **more):
    people = [{"entity_id": f"P{k}", "name": n, "aliases": [], "in_dialogue": True} for k, n in ((1, "Alma"), (2, "Bela"))]
    turns = [{"turn_index": 1, "speaker_id": "P1", "text": "well"}, {"turn_index": 2, "speaker_id": "P2", "text": "went home"}]
    return json.dumps({"sample_id": i, "dataset": "controlled", "scenario_id": "S1", "pair_ids": [], "variant": "base", "participants": people, "dialogue": turns, "speaker_id": "P2", "target_turn": 2, "target_predicate": "went"} | more)


def label(i, **more):
    return json.dumps({"sample_id": i, "gold_referent_id": "P1", "ambiguity_status": "unambiguous", "annotation_status": "accepted"} | more)


def test_a_dataset_tells_all_its_errors(spark, tmp_path):
    (tmp_path / tables.DIALOGUES).write_text("\n".join([record("a"), "{oops", record("b", target_turn=9), record("c"), record("c"), record("d")]))
    (tmp_path / tables.LABELS).write_text("\n".join([label("a"), label("b"), label("c"), label("e"), label("d", anchor_turn=0), '{"sample_id": "f", "anchor_turn": "one"}']))
    rows, problems = tables.load_dataset(spark, str(tmp_path))
    assert {r["sample_id"] for r in rows.collect()} == {"a", "b", "c", "d"}
    told = {(r["sample_id"], r["problem"], r["line"]) for r in problems.collect()}
    assert told == {(None, "not a JSON object", 2), ("f", "a field of another type", 6), ("c", "duplicate record", None), ("e", "label without record", None)}
    broken = {(r["sample_id"], r["problem"].split(":")[0], r["line"]) for r in tables.broken_constraints(spark, str(tmp_path)).collect()}
    assert broken >= {("b", "TARGET_OUT_OF_RANGE", 3), ("d", "ANCHOR_HALF", 5), ("d", "ANCHOR_TURN", 5)} and not {s for s, _, _ in broken} - {"b", "d"}
    assert flows.validate(spark, str(tmp_path), f"{tmp_path}/issues")["error"] == len(told) + len(broken)
    said = [r["message"] for r in spark.read.json(f"{tmp_path}/issues").collect()]
    assert any(m.startswith("not a JSON object (") and m.endswith("dialogues.jsonl:2)") for m in said)
    with pytest.raises(ValueError, match="dialogues.jsonl:2"):
        tables.checked_dataset(spark, str(tmp_path))


def test_scenarios_tell_all_their_errors(spark, tmp_path):
    good = {"scenario_id": "S1", "participants": [{"entity_id": "P1"}], "intended_gold_id": "P1", "variants": []}
    rows = [json.dumps(good), json.dumps(good), json.dumps(good | {"scenario_id": "S2", "intended_gold_id": "P9"}), "nothing"]
    (tmp_path / "s.jsonl").write_text("\n".join(rows))
    found = {(r["scenario_id"], r["problem"].split(":")[0], r["line"]) for r in tables.scenario_problems(spark, str(tmp_path / "s.jsonl")).collect()}
    assert found == {("S1", "duplicate scenario", 2), ("S2", "SCENARIO_LINK", 3), (None, "not a JSON object", 4)}


def test_the_last_decision_wins_by_file_and_place(spark, tmp_path):
    head = ",".join(schemas.DECISIONS)
    for name, rows in (("b.csv", ["s1,x,revise,E2,,,late", 's2,x,accept,,,,"over\nlines"', "s2,x,reject,,,,last"]), ("a.csv", ["s1,x,accept,,,,early", "s3,x,accept,,,,only"])):
        (tmp_path / name).write_text(head + "\n" + "\n".join(rows) + "\n")
    got = {r["sample_id"]: r["reason"] for r in tables.load_decisions(spark, str(tmp_path)).collect()}
    assert got == {"s1": "late", "s2": "last", "s3": "only"}


def test_review_ids_are_numbered_without_gaps(spark):
    ids = {r["sample_id"]: r["review_id"] for r in tables.review_ids(spark.range(1200).select(F.concat(F.lit("s"), "id").alias("sample_id")), 3).collect()}
    assert sorted(ids.values(), key=lambda x: int(x[1:])) == [f"R{i:03d}" for i in range(1, 1201)]
    assert ids == {r["sample_id"]: r["review_id"] for r in tables.review_ids(spark.range(1200).repartition(7).select(F.concat(F.lit("s"), "id").alias("sample_id")), 3).collect()}
