"""Runs in a folder: passes, waits, crashes and second runs."""

import json
import os
import pathlib
import sys
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomscore.plans import runner, runs
from loomscore.sources import tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import a test module
PROMPT = {"version": "1", "slots": ["dialogue", "candidates"], "template": "{dialogue}|{candidates}"}
CONFIG = {"model_id": "m"}


class Scripted:
    """Notes each call in a folder, and fails as ``script`` says: item to a list of failures by attempt."""

    def __init__(self, folder, script=None, stop_at=None):
        self.folder, self.script, self.stop_at = str(folder), script or {}, stop_at

    def complete(self, request):
        calls = pathlib.Path(self.folder)
        if self.stop_at and len(list(calls.iterdir())) >= self.stop_at:
            os._exit(9)  # as a killed worker
        (calls / uuid.uuid4().hex).write_text(f"{request['item_id']} {request['attempt']}")
        failures = self.script.get(request["item_id"], [])
        if request["attempt"] < len(failures):
            raise failures[request["attempt"]]
        return {"raw_text": f'{{"entity_id": "{request["item_id"]}"}}', "input_tokens": 3}


@pytest.fixture
def place(tmp_path):
    (tmp_path / "calls").mkdir()
    return tmp_path


def calls(place):
    return sorted(p.read_text() for p in (place / "calls").iterdir())


def items(spark, n=3):
    kind = "item_id string, full_text string, local_text string, target_marker struct<form:string,begin:int,end:int>, target_speaker_label string, candidates array<struct<entity_id:string,label:string,aliases:array<string>>>"
    return spark.createDataFrame([(f"i{k}", f"A: x{k}\nB: y", "B: y", ("y", 3, 4), "B", [("E1", "A", ["x"]), ("E2", "B", ["y"])]) for k in range(n)], kind)


def lines(spark, out):
    return {(r["item_id"], r["condition"]): r for r in spark.read.json(f"{out}/responses").collect()}


def test_failures_are_tried_again_in_later_passes(spark, place):
    T, P = runner.TransientError, runner.PermanentError
    script = {"i0": [T("busy"), T("busy", 30)], "i1": [T("a"), T("b"), T("c")], "i2": [P("no")]}
    now, waits = [0.0], []

    def wait(seconds):
        waits.append(seconds)
        now[0] += seconds

    def clock():
        return spark.sql("select unix_micros(current_timestamp()) / 1e6").first()[0] + now[0]

    out = str(place / "run")
    counts = runs.run_folder(spark, items(spark, 4), ("full_mcq",), Scripted(place / "calls", script), PROMPT, CONFIG, out, wait=wait, clock=clock)
    assert counts == {"ok": 2, "missing": 2, "cached": 0, "permanent_error": 1}
    assert calls(place) == ["i0 0", "i0 1", "i0 2", "i1 0", "i1 1", "i1 2", "i2 0", "i3 0"]
    got = {k[0]: (r["status"], r["retries"], r["error"]) for k, r in lines(spark, out).items()}
    assert got == {"i0": ("ok", 2, None), "i1": ("missing", 2, "transient: c"), "i2": ("missing", 0, "permanent: no"), "i3": ("ok", 0, None)}
    assert sum(waits) > 25 and max(waits) <= 31  # the service's own wait counts where it is longer; others don't wait for it


def test_a_run_that_was_killed_sends_what_is_left(spark, place):
    out = str(place / "run")
    with pytest.raises(Exception):  # noqa: B017
        runs.run_folder(spark, items(spark, 12), ("full_mcq",), Scripted(place / "calls", stop_at=5), PROMPT, CONFIG, out, batch=1)
    done = {r["item_id"] for r in runs.attempts(spark, out).collect()}
    assert not tables.exists(spark, f"{out}/summary")
    before = len(calls(place))
    counts = runs.run_folder(spark, items(spark, 12), ("full_mcq",), Scripted(place / "calls"), PROMPT, CONFIG, out, batch=1)
    assert counts["ok"] == 12 and counts["cached"] == 0
    after = [x.split()[0] for x in calls(place)]
    log = [r["payload_hash"] for r in runs.attempts(spark, out).collect()]
    assert len(log) == len(set(log)) == 12  # each answer once
    assert len(after) - before == 12 - len(done) and all(after.count(i) == 1 for i in done)


def test_a_second_run_asks_for_failures_only(spark, place):
    out = str(place / "run")
    runs.run_folder(spark, items(spark), ("full_mcq",), Scripted(place / "calls", {"i1": [runner.PermanentError("no")]}), PROMPT, CONFIG, out)
    counts = runs.run_folder(spark, items(spark), ("full_mcq",), Scripted(place / "calls"), PROMPT, CONFIG, out)
    assert counts == {"ok": 3, "missing": 0, "cached": 2, "permanent_error": 0}
    assert calls(place) == ["i0 0", "i1 0", "i1 0", "i2 0"]
    assert {k[0]: r["from_cache"] for k, r in lines(spark, out).items()} == {"i0": True, "i1": False, "i2": True}
    runs.run_folder(spark, items(spark), ("full_mcq",), Scripted(place / "calls"), PROMPT, CONFIG, out)
    assert len(calls(place)) == 4


def test_another_configuration_is_refused(spark, place):
    out = str(place / "run")
    runs.run_folder(spark, items(spark, 1), ("full_mcq",), runner.Mock(), PROMPT, CONFIG, out)
    with pytest.raises(ValueError, match="model_id"):
        runs.run_folder(spark, items(spark, 1), ("full_mcq",), runner.Mock(), PROMPT, {"model_id": "other"}, out)
    with pytest.raises(ValueError, match="prompt_version"):
        runs.run_folder(spark, items(spark, 1), ("full_mcq",), runner.Mock(), {**PROMPT, "version": "2"}, CONFIG, out)


def test_equal_payloads_are_sent_once(spark, place):
    same = items(spark, 1).withColumn("item_id", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))))
    out = str(place / "run")
    counts = runs.run_folder(spark, same, ("full_mcq",), Scripted(place / "calls"), PROMPT, CONFIG, out)
    assert len(calls(place)) == 1 and counts == {"ok": 3, "missing": 0, "cached": 2, "permanent_error": 0}


def test_answers_of_other_logs_are_taken(spark, place):
    asked = runner.requests(items(spark), ("full_mcq",), PROMPT, CONFIG)
    cache = asked.filter("item_id <> 'i2'").select("payload_hash", F.when(F.col("item_id") == "i0", "E1").alias("raw_text"))
    counts = runs.run_folder(spark, items(spark), ("full_mcq",), Scripted(place / "calls"), PROMPT, CONFIG, str(place / "run"), cache=cache)
    assert calls(place) == ["i1 0", "i2 0"] and counts["cached"] == 1


def test_nothing_to_send(spark, place):
    out = str(place / "run")
    assert runs.run_folder(spark, items(spark, 0), ("full_mcq",), runner.Mock(), PROMPT, CONFIG, out) == {"ok": 0, "missing": 0, "cached": 0, "permanent_error": 0}
    assert json.loads(pathlib.Path(out, "summary").glob("part-*").__next__().read_text())["ok"] == 0
