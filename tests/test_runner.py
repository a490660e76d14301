"""Requests, retries, cache, sources and streams."""

import pytest
from pyspark.sql import functions as F

from loomscore.plans import runner
from loomscore.sources import tables
from loomscore.streaming import log


ITEM = "item_id string, full_text string, local_text string, target_marker struct<form:string,begin:int,end:int>, target_speaker_label string, candidates array<struct<entity_id:string,label:string,aliases:array<string>>>"
PROMPT = {"version": "1", "slots": ["dialogue", "candidates"], "template": "{dialogue}|{candidates}"}


def items(spark):
    return spark.createDataFrame([("i1", "A: x\nB: y", "B: y", ("y", 3, 4), "B", [("E1", "A", ["x"]), ("E2", "B", ["y"])])], ITEM)


def test_gold_is_refused_and_stripped(spark):
    bad = items(spark).withColumn("gold_entity_id", F.lit("E1"))
    with pytest.raises(ValueError, match="gold"):
        runner.requests(bad, ("full_mcq",), PROMPT, {"model_id": "m"})
    assert "gold_entity_id" not in runner.strip_gold(bad).columns


def test_requests_follow_their_condition(spark):
    rows = {r["condition"]: r for r in runner.requests(items(spark), ("full_mcq", "target_only_mcq", "full_qa"), PROMPT, {"model_id": "m"}).collect()}
    assert rows["full_mcq"]["user"] == "A: x\nB: y|E1: A\nE2: B"
    assert rows["target_only_mcq"]["user"] == "B: y|E1: A\nE2: B"
    assert rows["full_qa"]["user"] == "A: x\nB: y|" and rows["full_qa"]["candidate_ids"] == []
    assert len({r["payload_hash"] for r in rows.values()}) == 3


def test_cached_answers_are_not_asked_again(spark):
    asked = runner.requests(items(spark), ("full_mcq", "target_only_mcq"), PROMPT, {"model_id": "m"})
    first = runner.run(asked, runner.Mock()).filter("condition = 'full_mcq'")
    again = {r["condition"]: r for r in runner.run(asked, runner.Dry(), first).collect()}
    assert again["full_mcq"]["from_cache"] and again["full_mcq"]["status"] == "ok"
    assert not again["target_only_mcq"]["from_cache"] and again["target_only_mcq"]["status"] == "missing"
    assert runner.run_summary(runner.run(asked, runner.Dry(), first)).first().asDict() == {"ok": 1, "missing": 1, "cached": 1, "permanent_error": 0}


def test_failures_are_not_answers(spark):
    """A cached row without a text is asked again, and a hash that the cache has twice gives one row."""
    asked = runner.requests(items(spark), ("full_mcq", "target_only_mcq"), PROMPT, {"model_id": "m"})
    hashes = {r["condition"]: r["payload_hash"] for r in asked.collect()}
    cache = spark.createDataFrame([(hashes["full_mcq"], None), (hashes["full_mcq"], None), (hashes["target_only_mcq"], "E1"), (hashes["target_only_mcq"], "E1")], "payload_hash string, raw_text string")
    got = sorted((r["condition"], r["from_cache"], r["status"]) for r in runner.run(asked, runner.Mock(), cache).collect())
    assert got == [("full_mcq", False, "ok"), ("target_only_mcq", True, "ok")]


def test_last_answer_counts_and_missing_overrides(spark):
    rows = [("i1", "full_mcq", "m", 1, '{"entity_id": "E1"}', "ok"), ("i1", "full_mcq", "m", 2, '{"entity_id": "E2"}', "ok"), ("i1", "full_qa", "m", 1, "A", "missing"), ("zz", "full_mcq", "m", 1, "x", "ok")]
    answers = spark.createDataFrame(rows, "item_id string, condition string, model_label string, ordinal long, raw_text string, status string")
    got = {r["condition"]: r for r in runner.normalise(answers, items(spark).withColumn("addressee_label", F.lit("A"))).collect()}
    assert len(got) == 2 and got["full_mcq"]["predicted_entity_id"] == "E2" and got["full_qa"]["parse_status"] == "missing"


def test_another_configuration_is_refused():
    runner.same_run({"model_id": "a"}, {"model_id": "a"})
    with pytest.raises(ValueError, match="model_id"):
        runner.same_run({"model_id": "a"}, {"model_id": "b"})


def test_sheets_come_back(spark, tmp_path):
    path = tmp_path / "sheet_full_ann.csv"
    path.write_text("﻿order,review_id,dialogue,naturalness_1to5,referent_id,addressee_id,context_sufficient,ambiguity,notes\n1,R001,\"a\nb\",4, E1 ,,yes,unambiguous,\"say \"\"hi\"\"\"\n2,R002,c,,,,,,\n", encoding="utf-8")
    ids = spark.createDataFrame([("s1", "R001")], "sample_id string, review_id string")
    rows = {r["sample_id"]: r for r in tables.load_sheets(spark, str(path), ids).collect()}
    assert rows["s1"]["referent_id"] == "E1" and rows["s1"]["annotator"] == "ann" and rows["s1"]["condition"] == "full" and rows["s1"]["notes"] == 'say "hi"'
    assert rows["R002"]["referent_id"] == "" and rows["R002"]["ambiguity"] == ""


def test_jsonl_round_trip_and_bad_lines(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("ä\nb", 2)], "s string, n int")
    tables.write_jsonl(df, str(tmp_path / "x"))
    assert sorted(map(tuple, tables.read_jsonl(spark, str(tmp_path / "x"), "s string, n int").collect())) == [("a", None), ("ä\nb", 2)]
    (tmp_path / "bad.jsonl").write_text('{"s": "a"}\n{"s": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "s string").collect()


def test_prompts_and_paths(spark, tmp_path):
    assert tables.prompt_problems({"template": "{a} {b}", "slots": ["a", "c"]}) == ["slot {b} is not declared", "declared slot {c} is not used"]
    assert tables.inside("/w", "a/../b") and not tables.inside("/w", "../b") and not tables.inside("/w", "/etc")


def test_running_accuracy_over_a_log(spark, tmp_path):
    source = tmp_path / "log"
    source.mkdir()
    (source / "a.json").write_text('{"item_id":"1","condition":"c","model_label":"m","raw_text":"E1"}\n{"item_id":"1","condition":"c","model_label":"m","raw_text":"E1"}\n{"item_id":"2","condition":"c","model_label":"m","raw_text":"E2"}\n')
    once = log.first_answers(log.read_log(spark, str(source)))
    scored = once.select("condition", F.lit("E1").alias("gold_entity_id"), F.col("raw_text").alias("predicted_entity_id"), F.lit("ok").alias("parse_status"))
    q = log.running_accuracy(scored).writeStream.outputMode("update").format("memory").queryName("acc").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("acc").collect()} == {("c", 0.5, 1, 2)}
