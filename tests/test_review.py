"""Sheets filled by a model, and the verbs from the command line."""

import json
import pathlib
import sys
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomscore import __main__ as cli
from loomscore.plans import review, runner
from loomscore.sources import schemas, tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])
CONFIG = {"model_id": "m"}
BLANK = dict.fromkeys(schemas.JUDGEMENTS, "")


def row(i, **more):
    return {"order": str(i), "review_id": f"R{i:03d}", "dialogue": "Alma: hi\nBela: [[went]]", "target_turn": "2", "target_predicate": "went", "target_speaker": "Bela", "candidates": "E1=Alma; E2=Bela"} | BLANK | more


class Judge:
    """Answers by what stands in the prompt; ``bad`` ids get an answer that can't be read, ``down`` ones none."""

    def __init__(self, folder, bad=(), down=()):
        self.folder, self.bad, self.down = str(folder), bad, down

    def complete(self, request):
        (pathlib.Path(self.folder) / uuid.uuid4().hex).write_text(request["item_id"])
        if request["item_id"] in self.down:
            raise runner.PermanentError("off")
        if request["item_id"] in self.bad:
            return {"raw_text": "I can't say"}
        return {"raw_text": json.dumps({"ambiguity": "Unambiguous", "referent_id": "E1", "context_sufficient": "yes", "naturalness_1to5": "4", "addressee_id": "E9", "notes": "n"})}


@pytest.fixture
def place(tmp_path):
    (tmp_path / "calls").mkdir()
    return tmp_path


def sheet(spark, place, rows):
    tables.write_csv(spark.createDataFrame([tuple(r[c] for c in schemas.SHEET) for r in rows], ", ".join(f"`{c}` string" for c in schemas.SHEET)).coalesce(1), f"{place}/in")
    return f"{place}/in"


def filled(spark, place):
    return {r["review_id"]: r.asDict() for r in tables.read_csv(spark, f"{place}/out/sheet").collect()}


def calls(place):
    return sorted(p.read_text() for p in (place / "calls").iterdir())


def test_filling_twice_changes_nothing(spark, place):
    path = sheet(spark, place, [row(i, dialogue=f"Alma: hi {i}\nBela: [[went]]") for i in range(4)])
    for k in range(2):
        n = review.fill(spark, path, f"{place}/out", Judge(place / "calls"), CONFIG, "full")
        assert n == {"n": 4, "ok": 4, "failed": 0, "unparsable": 0, "resumed": 4 * k, "permanent_error": 0}
        got = filled(spark, place)
        assert {tuple(got[f"R00{i}"][c] for c in schemas.JUDGEMENTS) for i in range(4)} == {("4", "E1", "", "yes", "unambiguous", "n")}
        assert got["R002"]["dialogue"] == "Alma: hi 2\nBela: [[went]]" and len(calls(place)) == 4


def test_people_come_before_models_and_failures_are_asked_again(spark, place):
    rows = [row(0, dialogue="A: 0", ambiguity="uncertain", notes="mine"), row(1, dialogue="A: 1"), row(2, dialogue="A: 2"), row(3, dialogue="A: 3")]
    path = sheet(spark, place, rows)
    n = review.fill(spark, path, f"{place}/out", Judge(place / "calls", bad=("R002",), down=("R003",)), CONFIG, "local", only_empty=True)
    assert (n["n"], n["ok"], n["failed"], n["unparsable"], n["permanent_error"]) == (4, 2, 1, 1, 1)
    got = filled(spark, place)
    assert (got["R000"]["ambiguity"], got["R000"]["notes"]) == ("uncertain", "mine") and got["R001"]["referent_id"] == "E1" and got["R001"]["naturalness_1to5"] == ""
    assert got["R002"]["notes"] == "(unparsable) I can't say" and got["R003"]["notes"] == "(no response)"
    n = review.fill(spark, path, f"{place}/out", Judge(place / "calls"), CONFIG, "local", only_empty=True)
    assert (n["ok"], n["failed"], n["resumed"]) == (4, 0, 1)
    assert calls(place) == ["R001", "R002", "R002", "R003", "R003"] and filled(spark, place)["R002"]["ambiguity"] == "unambiguous"


def test_prompts_hold_what_a_condition_may_show(spark):
    df = spark.createDataFrame([("Alma: {candidates}\nBela: x\nDana: y", "E1=Alma; E2=Bela;E3 = Dana ;"), ("Alma: a\nBela: b", "E1=Alma; E2=Bela; E3=Dana"), ("X: a\nY: b\nZ: c", "E1=Alma; E2=Bela; E3=Dana")], "dialogue string, candidates string")
    full, two, unknown = (r[0] for r in df.select(review.asked("full")).collect())
    assert "Alma: {candidates}\nBela: x" in full and "E1=Alma\nE2=Bela\nE3 = Dana\n" in full and "addressee_id" in full
    assert "addressee_id" not in two and "addressee_id" in unknown and "{key}" not in two and "{three}" not in two
    local = df.select(review.asked("local")).first()[0]
    assert "naturalness" not in local and "addressee" not in local and '{"ambiguity"' in local


def test_verbs_from_dataset_to_report(spark, tmp_path, capsys):
    people = [{"entity_id": f"P{k}", "name": n, "aliases": [], "in_dialogue": True} for k, n in ((1, "Alma"), (2, "Bela"))]
    record = {"sample_id": "a", "dataset": "controlled", "scenario_id": "S1", "pair_ids": ["S1:base~v1"], "variant": "base", "participants": people, "dialogue": [{"turn_index": 1, "speaker_id": "P1", "text": "hi Bela"}, {"turn_index": 2, "speaker_id": "P2", "text": "went"}], "speaker_id": "P2", "target_turn": 2, "target_predicate": "went", "creation_method": "human", "generation_metadata": {"created": "2024"}}
    label = {"sample_id": "a", "gold_referent_id": "P1", "ambiguity_status": "unambiguous", "annotation_status": "accepted", "linguistic_cues": [], "manipulated_variables": []}
    other = [{"turn_index": 1, "speaker_id": "P1", "text": "well"}, {"turn_index": 2, "speaker_id": "P2", "text": "she went"}]
    more = [({**record, "sample_id": "b", "variant": "v1", "dialogue": other}, {**label, "sample_id": "b", "gold_referent_id": "P2"})]
    data, run = tmp_path / "data", tmp_path / "run"
    data.mkdir()
    (data / "dialogues.jsonl").write_text("".join(json.dumps(r) + "\n" for r in (record, more[0][0])))
    (data / "labels.jsonl").write_text("".join(json.dumps(r) + "\n" for r in (label, more[0][1])))
    prompt = tmp_path / "prompt.json"
    prompt.write_text(json.dumps({"version": "1", "slots": ["dialogue", "candidates"], "template": "the speaker:\n{dialogue}\n{candidates}"}, indent=1))
    models = tmp_path / "models.json"
    models.write_text(json.dumps({"decoding": {}, "models": [{"model_label": "x", "model_id": "mock"}]}, indent=1))

    def say(*argv):
        code = cli.main([str(a) for a in argv])
        return code, capsys.readouterr().out.strip().splitlines()

    assert say("check-prompt", prompt)[0] == 0
    assert json.loads(say("payload", data, data)[1][-1]) == {"items": 2, "skipped": 0, "leaks": 0}
    assert json.loads(say("payload", data, data, "--prompt", prompt, "--models", models, "--label", "x")[1][-1])["leaks"] == 4  # a role word in both conditions of both
    code, out = say("validate", data, "--prompt", prompt, "--strict")
    assert code == 1 and json.loads(out[-1])["error"] >= 4
    assert json.loads(say("run", data, run, prompt, models, "x")[1][-1]) == {"ok": 4, "missing": 0, "cached": 0, "permanent_error": 0}
    assert json.loads(say("run", data, run, prompt, models, "x")[1][-1])["cached"] == 4
    assert len(say("benchmark", data, run, prompt, models, "x")[1]) == 2
    assert {"run: ended after 1 passes", "metrics: there", "items: missing"} <= set(say("status", run)[1])
    for name in ("tables", "role_confusion", "slot_confusion", "pair_consistency", "context_benefit"):
        assert spark.read.json(f"{run}/{name}").count() > 0, name
    assert spark.read.json(f"{run}/pair_consistency").filter("both_correct + base_correct_only + variant_correct_only + both_wrong = 1").count() == 2
    assert len(say("metrics", f"{run}/normalized", f"{data}/gold", tmp_path / "report", "--n-boot", 50)[1]) == 2
    boot = tables.read_document(spark, f"{tmp_path}/report/bootstrap")
    assert {(b["condition"], b["n_boot"], b["n_clusters"]) for b in boot} == {("full_mcq", 50, 1), ("target_only_mcq", 50, 1)}
    with pytest.raises(ValueError, match="slots"):
        bad = tmp_path / "bad.json"
        bad.write_text(json.dumps({"version": "1", "slots": ["gold"], "template": "{gold}"}))
        cli.main(["run", str(data), str(tmp_path / "r2"), str(bad), str(models), "x"])


def test_show_prints_every_row(spark, tmp_path, capsys):
    rows = [json.dumps({"scenario_id": f"S{i}", "dataset": f"d{i}", "participants": [], "variants": []}) for i in range(1500)]
    (tmp_path / "s.jsonl").write_text("\n".join(rows))
    cli.main(["scenarios", str(tmp_path / "s.jsonl")])
    assert len(capsys.readouterr().out.strip().splitlines()) > 1500
