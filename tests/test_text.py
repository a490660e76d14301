"""Text functions, parsers and derived columns."""

import random

import pytest
from pyspark.sql import functions as F

from loomscore.functions import parsing, text
from loomscore.operators import agreement, baselines, dialogue, joins, rules


def people(*entries):
    return F.array(*(F.struct(F.lit(e).alias("entity_id"), F.lit(n).alias("name"), F.array(*map(F.lit, a)).cast("array<string>").alias("aliases")) for e, n, a in entries))


def plain_mentions(body, forms):
    taken, found = [False] * len(body), []
    for form, eid in forms:
        start = 0
        while (at := body.find(form, start)) >= 0:
            if not any(taken[at : at + len(form)]):
                found.append((at, eid))
                taken[at : at + len(form)] = [True] * len(form)
            start = at + len(form)
    return sorted(found)


def test_nested_forms_go_to_the_longest(spark):
    roster = people(("T1", "kim", []), ("T2", "kim's sister", []))
    found = spark.range(1).select(text.find_mentions(F.lit("kim's sister kim"), text.surface_forms(roster))).first()[0]
    assert [tuple(m) for m in found] == [(0, "T2"), (13, "T1")]


def test_mentions_equal_a_plain_search(spark):
    r = random.Random(5)
    bodies = ["".join(r.choice("aab b") for _ in range(r.randint(0, 30))) for _ in range(300)]
    forms = [("aab", "x"), ("aa", "y"), ("ba", "x"), ("b", "z")]
    column = F.array(*(F.struct(F.lit(f).alias("form"), F.lit(e).alias("eid")) for f, e in forms))
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, t string").withColumn("m", text.find_mentions("t", column)).collect()
    for row in rows:
        assert [tuple(m) for m in row["m"]] == plain_mentions(row["t"], forms)


def parsed(spark, column, *raw):
    return [tuple(r[1])[:2] for r in spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, raw string").select("i", column).orderBy("i").collect()]


def test_free_answers(spark):
    ids = F.array(F.lit("T1"), F.lit("T10"))
    got = parsed(spark, parsing.parse_free("raw", ids), "it is T10", "T1 or T10", " \t　", None, "cannot determine", "T100")
    assert got == [("T10", "ok"), (None, "invalid"), (None, "invalid"), (None, "missing"), (None, "abstain"), (None, "invalid")]


def test_structured_answers(spark):
    ids = F.array(F.lit("T1"), F.lit("T10"))
    raw = ['{"entity_id": "T1"}', '```json\n{"entity_id": "T10"}\n```', '{"entity_id": null}', '{"entity_id": ["T1"]}', '{"entity_id": "T9"}', "T1", '{"other": 1}', '{"entity_id": "None"}']
    assert [s for _, s in parsed(spark, parsing.parse_structured("raw", ids), *raw)] == ["ok", "ok", "abstain", "invalid", "invalid", "invalid", "abstain", "abstain"]


def test_aliases_and_pronouns(spark):
    roster = F.array(*(F.struct(F.lit(e).alias("entity_id"), F.lit(n).alias("label"), F.array(F.lit(a)).alias("aliases")) for e, n, a in (("E1", "Mina", "sis"), ("E2", "Joon", "bro"))))
    column = parsing.parse_by_alias("raw", parsing.alias_entries(roster, F.lit("Mina"), F.lit("Joon")))
    assert parsed(spark, column, "bro did", "화자", "상대방", "sis and bro", "nobody", "모르겠 sis") == [("E2", "ok"), ("E1", "ok"), ("E2", "ok"), (None, "unmapped"), (None, "unmapped"), (None, "abstain")]


def test_templates_replace_in_order():
    with pytest.raises(KeyError):
        text.render_template("{a}", ["a"], {})
    with pytest.raises(ValueError):
        text.render_template(" ", [], {})


def test_a_value_may_bring_in_a_later_slot(spark):
    out = text.render_template("{a}-{b}", ["a", "b"], {"a": F.lit("{b}"), "b": F.lit("x")})
    assert spark.range(1).select(out).first()[0] == "x-x"


RECORD = "sample_id string, participants array<struct<entity_id:string,name:string,aliases:array<string>,in_dialogue:boolean>>, dialogue array<struct<turn_index:int,speaker_id:string,text:string>>, speaker_id string, target_turn int, target_predicate string, span struct<begin:int,end:int>, addressee_id string, gold_referent_id string, anchor_turn int, anchor_referent_id string, anchor_addressee_id string, distractor_id string"


def record(spark, turns, gold, third=False, **label):
    who = [("P1", "Ann", [], True), ("P2", "Ben", [], True), ("P3", "Cid", [], third)]
    d = [(i + 1, s, t) for i, (s, t) in enumerate(turns)]
    body = d[-1][2]
    at = body.find("went")
    row = ("s", who, d, d[-1][1], len(d), "went", (at, at + 4), label.get("addressee"), gold, label.get("anchor_turn"), label.get("anchor"), None, label.get("distractor"))
    return dialogue.derive(spark.createDataFrame([row], RECORD)).first()


def test_shift_variables(spark):
    r = record(spark, [("P1", "Ben called"), ("P2", "yes"), ("P2", "went home")], "P2", anchor_turn=1, anchor="P2")
    assert (r["referent_changed"], r["referent_role_changed"], r["speaker_changed"], r["gold_referent_role"], r["anchor_referent_role"]) == (False, True, True, "speaker", "addressee")


def test_without_anchor_shifts_are_unknown(spark):
    r = record(spark, [("P1", "x"), ("P2", "went")], "P1")
    assert r["speaker_changed"] is None and r["referent_changed"] is None and r["referent_role_changed"] is None


def test_distance_and_distractor(spark):
    turns = [("P1", "Cid is here"), ("P2", "Ann too"), ("P1", "went home")]
    r = record(spark, turns, "P3")
    assert (r["turn_distance"], r["distractor_present"], r["most_recent_mentioned_id"]) == (2, True, "P1")
    assert record(spark, turns, "P3", distractor="P2")["distractor_present"] is False


def test_mentions_after_the_predicate_do_not_count(spark):
    r = record(spark, [("P1", "hm"), ("P2", "went with Cid")], "P3")
    assert r["turn_distance"] is None and r["mentions"] == []


@pytest.mark.parametrize(("addressee", "gold", "role"), [(None, "P1", None), ("P1", "P1", "addressee"), ("P1", "P3", "third_party")])
def test_three_party_roles(spark, addressee, gold, role):
    assert record(spark, [("P1", "x"), ("P2", "went")], gold, third=True, addressee=addressee)["gold_referent_role"] == role


VOTE = "annotator string, condition string, sample_id string, referent_id string, addressee_id string, context_sufficient string, ambiguity string, naturalness_1to5 string, notes string"


def votes(spark, *rows):
    return spark.createDataFrame([(a, c, s, r, "", "", m, n, "") for a, c, s, r, m, n in rows], VOTE)


def test_kappa_of_a_single_category_is_undefined(spark):
    v = votes(spark, *((a, "full", s, "E1", "unambiguous", "") for a in "xy" for s in "12"))
    r = {x["field"]: x for x in agreement.agreement(v).collect()}
    assert r["referent_id"]["cohen_kappa"] is None and r["referent_id"]["percent_agreement"] == 1.0 and r["addressee_id"]["n"] == 0


def test_kappa(spark):
    given = zip("123456", "AABBBB", "AABBBA", strict=True)
    v = votes(spark, *(row for s, x, y in given for row in (("x", "full", s, x, "unambiguous", "4"), ("y", "full", s, y, "unambiguous", "bad"))))
    r = next(x for x in agreement.agreement(v).collect() if x["field"] == "referent_id")
    assert r["cohen_kappa"] == pytest.approx((5 / 6 - 0.5) / 0.5)
    assert agreement.naturalness(v).first()["error"] == "non-integer naturalness"


def test_context_need(spark):
    v = votes(spark, *(("x" + str(i), "local", s, r, m, "") for s, both in {"a": [("E1", "unambiguous")] * 2, "b": [("", "ambiguous")] * 2, "c": [("E1", "unambiguous"), ("E2", "unambiguous")], "d": [("E1", "unambiguous")]}.items() for i, (r, m) in enumerate(both)))
    gold = spark.createDataFrame([("a", "E1"), ("b", "E1"), ("c", "E1"), ("d", None)], "sample_id string, final_gold string")
    assert dict(agreement.context_need(v, gold).collect()) == {"a": "locally_recoverable", "b": "discourse_dependent", "c": "conflict"}


def test_first_rule_of_a_chain_counts(spark):
    chain = rules.first_of(rules.Rule("error", "A", F.col("n") > 1, "a"), rules.Rule("error", "B", F.col("n") > 0, "b"))
    got = rules.issues(spark.createDataFrame([("x", 1), ("y", 2), ("z", None)], "sample_id string, n int"), chain).collect()
    assert {(r["sample_id"], r["code"]) for r in got} == {("x", "B"), ("y", "A")}


def plain_paths(value, names, path=""):
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in ([path + k] if k in names else []) + plain_paths(v, names, f"{path}{k}.")]
    return [p for i, v in enumerate(value) for p in plain_paths(v, names, f"{path}[{i}].")] if isinstance(value, list) else []


def test_keys_at_any_depth(spark):
    """Keys in objects, lists and lists of lists; not names that stand in texts."""
    import json

    bodies = [{"gold": 1}, {"a": {"b": [{"gold": 1}, {"x": [[{"gold": {"gold": None}}]]}]}}, {"t": 'say "gold": now', "u": "gold", "v": ["gold"]}, {"goldish": 1, "go": {"ld": 2}}, {}, {"id.x": {"id": 3}, "é": [1, [2, {"id": []}]]}, {'q"gold': 1}, {"a\\": {"gold": "x"}}]
    rows = [(i, json.dumps(b, ensure_ascii=False, separators=(",", ":"))) for i, b in enumerate(bodies)] + [(99, None)]
    found = {r["k"]: r["paths"] for r in rules.key_paths(spark.createDataFrame(rows, "k int, j string"), "k", F.col("j"), ("gold", "id")).collect()}
    assert found == {i: sorted(p) for i, b in enumerate(bodies) if (p := plain_paths(b, ("gold", "id")))}
    assert rules.key_paths(spark.createDataFrame(rows[2:5], "k int, j string"), "k", F.col("j"), ("gold",)).count() == 0


def test_passages_of_all_lengths_equal_a_plain_search(spark):
    texts = ["a b c d e f g h", "x y", "b c d e z", "one  b c d e f\tq", "xx yy zz", "sand and", "", "q q q q q q q"]
    passages = ["b c d e f", "x y", "c d e", "", "q q q q q q", "and", "x", "b c d e", " c d", "y z", "nowhere at all in any of them"]
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    p = spark.createDataFrame(list(enumerate(passages)), "pid int, passage string")
    expected = {(i, j) for i, x in enumerate(texts) for j, y in enumerate(passages) if y and y in x}
    for most in (1 << 20, 40):  # one block of short passages, and several
        assert sorted(map(tuple, joins.containing(t, "text", p, "passage", most=most).select("id", "pid").collect())) == sorted(expected)
    assert joins.containing(t, "text", p.limit(0), "passage").count() == 0


def test_sides_are_measured_in_bytes(spark):
    assert joins.held(spark.range(10)) == 160
    assert joins.held(spark.createDataFrame([("a" * 84, ["x"])], "a string, b array<string>")) > 116
    assert joins.held(spark.range(0)) == 0


def test_a_null_addressee_falls_back_to_the_labels_a_and_b(spark):
    roster = F.array(*(F.struct(F.lit(e).alias("entity_id"), F.lit(n).cast("string").alias("label"), F.array().cast("array<string>").alias("aliases")) for e, n in (("E1", "A"), ("E2", "B"), ("E3", None))))
    for label in (F.lit(None).cast("string"), None):
        column = parsing.parse_by_alias("raw", parsing.alias_entries(roster, F.lit("A"), label))
        assert parsed(spark, column, "상대방") == [("E2", "ok")]
    nobody = parsing.parse_by_alias("raw", parsing.alias_entries(roster, F.lit(None).cast("string"), F.lit("Z")))
    assert parsed(spark, nobody, "화자", "상대방") == [(None, "unmapped")] * 2


def test_ids_with_other_characters_keep_their_pattern(spark):
    column = parsing.parse_free("raw", F.array(F.lit("P-1"), F.lit("P-10")))
    assert parsed(spark, column, "it is P-10.", "P-1 or P-10", "P-100") == [("P-10", "ok"), (None, "invalid"), (None, "invalid")]


def test_strict_join_stops_at_missing_gold(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "k string"), spark.createDataFrame([("x", 1)], "k string, v int")
    with pytest.raises(Exception, match="no gold for y"):
        joins.strict_join(a, b, "k").collect()


def test_speaker_and_addressee_baselines(spark):
    schema = "item_id string, target_speaker_id string, target_speaker_label string, dialogue_participants array<string>, speaker_sequence array<string>, candidates array<struct<entity_id:string,label:string,aliases:array<string>>>"
    df = spark.createDataFrame([("two", "E1", "A", ["E1", "E2"], ["E2", "E1"], []), ("three", "E1", "A", ["E1", "E2", "E3"], ["E2", "E3", "E1", "E1"], []), ("label", None, "B", [], [], [("E7", "B", []), ("E8", "B", [])])], schema)
    got = {(r["item_id"], r["model_label"]): r["predicted_entity_id"] for r in baselines.run(df, ("current_speaker", "current_addressee")).collect()}
    assert got["two", "current_addressee"] == "E2" and got["three", "current_addressee"] == "E3" and got["label", "current_speaker"] == "E8"


def by_alias(raw, roster, speaker, addressee):
    """What parse_by_alias gives, plainly."""
    table = {}
    for label, words in ((addressee or ("B" if speaker == "A" else "A"), parsing.ADDRESSEE_PRONOUNS), (speaker, parsing.SPEAKER_PRONOUNS)):
        for who in [e for e, n, _ in roster if n == label][-1:]:
            for w in words:
                table.pop(w, None)
                table[w] = who
    for e, n, others in roster:
        for a in (e, n, *others):
            if a:
                table.pop(a, None)
                table[a] = e
    if raw is None:
        return None, "missing"
    rest, found = raw.strip(), set()
    if not rest:
        return None, "invalid"
    if any(p in rest for p in parsing.ABSTAIN_PATTERNS):
        return None, "abstain"
    for a in sorted(table, key=lambda a: -len(a)):
        if a in rest:
            rest = rest.replace(a, " ")
            found.add(table[a])
    return (found.pop(), "ok") if len(found) == 1 else (None, "unmapped")


def test_aliases_equal_a_plain_version(spark):
    # repeated aliases, a pronoun as an alias, aliases that only come about when others are taken out
    roster = [("E1", "A", ["ab", "나"]), ("E2", "B", ["ab", "x y", ""]), ("E3", "C", ["qq", "x", "ab"]), ("E4", "A", ["zqqz", "상대방"])]
    people = F.array(*(F.struct(F.lit(e).alias("entity_id"), F.lit(n).alias("label"), F.array(*map(F.lit, a)).alias("aliases")) for e, n, a in roster))
    raw = ["ab", "나", "xqqqy", "x y", "xqqy", "상대", "상대방", "qq ", "E1 E4", "E1", "zqqz", " \t", None, "not enough ab", "none", "화자", "zqqzqq"]
    for speaker, addressee in (("A", "B"), ("B", None), ("Z", "C")):
        column = parsing.parse_by_alias("raw", parsing.alias_entries(people, F.lit(speaker), F.lit(addressee).cast("string")))
        assert parsed(spark, column, *raw) == [by_alias(r, roster, speaker, addressee) for r in raw]


def test_aliases_and_the_text_are_worked_out_once(spark):
    said = str(parsing.parse_by_alias("raw", parsing.alias_entries(F.col("roster"), F.col("speaker"))))
    assert said.count("regexp_replace") == 1 and said.count("flatten") == 1
