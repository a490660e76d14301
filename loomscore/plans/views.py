"""The driver's tables seen as the engine's: our own choice, to give every operator rows to work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PEOPLE = {"user": ("The", "and"), "assistant": ("of",), "system": ("to",)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nth(n: Column, of: int = 4) -> Column:
    return F.concat(F.lit("E"), (n % of + 1).cast("string"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored rows; everything follows from the ids and the property k."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.get_json_object("props", "$.k").cast("int").alias("k"))
    k, eid, uid = F.col("k"), F.col("event_id"), F.col("user_id")
    status = F.when(k % 10 == 0, "invalid").when(k % 10 == 1, "abstain").when(k % 10 == 2, "missing").when(k % 10 == 3, "unmapped").otherwise("ok")
    cues = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 5 == 1, F.array(F.lit("honorific"))).when(k % 5 == 2, F.array(F.lit("honorific"), F.lit("zero"))).otherwise(F.array(F.lit("zero")))
    roles = F.create_map(F.lit("E1"), F.lit("speaker"), F.lit("E2"), F.lit("addressee"), F.lit("E3"), F.lit("third_party"))
    return e.select(
        eid.alias("item_id"), uid.alias("conversation_id"), F.col("event_type").alias("condition"), F.concat(F.lit("m"), (eid % 2).cast("string")).alias("model_label"), "ts", "k",
        F.when(eid % 97 != 0, nth(uid)).alias("gold_entity_id"), F.when((status == "ok") & (k % 23 != 0), nth(k)).alias("predicted_entity_id"), status.alias("parse_status"), roles.alias("entity_roles"),
        F.transform(F.sequence(F.lit(1), (2 + eid % 3).cast("int")), lambda i: F.concat(F.lit("E"), i.cast("string"))).alias("candidates"),
        F.when(eid % 2 == 0, nth(k + 1)).alias("designated_distractor_id"), nth(k + 2).alias("most_recent_mentioned_id"), (k % 2 == 0).alias("distractor_present"),
        F.when(k % 7 != 6, k % 7).alias("turn_distance"), F.when(k % 3 != 2, k % 3 == 1).alias("referent_changed"), cues.alias("linguistic_cues"),
        F.when(k % 5 != 4, k % 5 == 1).alias("speaker_changed"), F.when(k % 11 != 3, k % 11 == 1).alias("referent_role_changed"), F.when(eid % 3 == 0, "controlled").otherwise("naturalistic").alias("dataset"), F.when(eid % 5 == 0, "llm").otherwise("human").alias("creation_method"),
        F.when(k % 6 == 0, "locally_recoverable").when(k % 6 == 1, "discourse_dependent").when(k % 6 == 2, "conflict").alias("context_need"),
        F.when(k % 13 != 0, (k * 10).cast("long")).alias("input_tokens"), (k % 4).cast("long").alias("output_tokens"),
    )


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows with a pair for each user and day, whose versions are the event types."""
    s = scored(spark, sf_dir)
    day = F.date_format("ts", "yyyy-MM-dd")
    scenario = F.concat(F.col("conversation_id").cast("string"), F.lit("-"), day)
    return s.withColumns({
        "version": F.col("condition"), "family_id": F.when(F.col("conversation_id") % 5 != 0, (F.col("conversation_id") % 7).cast("string")), "pair_id": F.concat(scenario, F.lit(":view~click")),
        "pair_ids": F.array(F.concat(scenario, F.lit(":view~click")), F.concat(scenario, F.lit(":click~view"))),
    })


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of answers to items (one for each user), later ones written over earlier ones."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.get_json_object("props", "$.k").cast("int").alias("k"))
    k = F.col("k")
    text = (
        F.when(k % 8 == 0, nth(k)).when(k % 8 == 1, F.concat(F.lit("```json\n{\"entity_id\": \""), nth(k), F.lit("\"}\n```"))).when(k % 8 == 2, F.concat(F.lit("I think E1 or "), nth(k), F.lit("."))).when(k % 8 == 3, F.lit("  \t"))
        .when(k % 8 == 4, F.lit(None).cast("string")).when(k % 8 == 5, F.lit("cannot determine this")).when(k % 8 == 6, F.concat(F.lit("so {\"entity_id\": \""), F.when(k % 3 == 0, "none").otherwise("E9"), F.lit("\"} it is"))).otherwise(F.lit("{\"entity_id\": [\"E1\"]}"))
    )
    return e.select(F.col("user_id").alias("item_id"), F.col("event_type").alias("condition"), F.lit("m").alias("model_label"), F.col("ts").alias("at"), F.col("event_id").alias("ordinal"), text.alias("raw_text"), F.when(text.isNull(), "missing").otherwise("ok").alias("status"), F.md5(F.col("event_id").cast("string")).alias("payload_hash"))


def roster() -> Column:
    return F.array(*(F.struct(F.lit(f"E{i}").alias("entity_id"), F.lit(n).alias("label"), F.array(F.lit(a)).alias("aliases")) for i, n, a in ((1, "A", "view"), (2, "B", "click"), (3, "C", "this"), (4, "D", "one"))))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as the votes of three annotators on documents, under both conditions."""
    lab = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    d = F.col("doc_id")

    def vote(name: str, condition: str, v: Column, salt: int) -> Column:
        referent = F.when((d + salt) % 11 == 0, "").otherwise(F.concat(F.lit("E"), (v + 1).cast("string")))
        ambiguity = F.when((d + salt) % 7 == 0, "ambiguous").when((d + salt) % 13 == 0, "").when((d + salt) % 29 == 0, "odd").otherwise("unambiguous")
        return F.struct(
            F.lit(name).alias("annotator"), F.lit(condition).alias("condition"), referent.alias("referent_id"), F.when(v == 1, "E2").otherwise("").alias("addressee_id"), F.when(v == 1, "yes").otherwise("no").alias("context_sufficient"), ambiguity.alias("ambiguity"),
            F.when((d + salt) % 31 == 0, "x" if condition == "local" else "").otherwise((1 + (d + salt * v) % 5).cast("string")).alias("naturalness_1to5"), F.lit("").alias("notes"),
        )

    each = F.array(vote("quality", "full", F.col("q"), 0), vote("toxic", "full", F.col("t"), 0), vote("third", "full", F.col("q"), 3), vote("quality", "local", F.col("q"), 1), vote("toxic", "local", F.col("t"), 2))
    return lab.select(d.cast("string").alias("sample_id"), F.explode(each).alias("v")).select("sample_id", "v.*")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).cast("int").alias("turn_index"), F.col("role").alias("speaker_id"), "text")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as labelled dialogue records; the target is the last turn, its predicate the last word.

    All are gathered, whatever their number of turns: a row's size is that of
    its own dialogue.  Where there is one turn it is the target, no anchor
    stands before it, and the shift columns are null.  Turns without a conv_id
    belong to no conversation.
    """
    t = turns(spark, sf_dir).filter("conv_id IS NOT NULL")
    body = F.array_sort(F.collect_list(F.struct("turn_index", "speaker_id", "text"))).alias("dialogue")
    r = t.groupBy("conv_id").agg(body)
    people = F.array(*(F.struct(F.lit(p).alias("entity_id"), F.lit(p.capitalize()).alias("name"), F.array(*map(F.lit, a)).alias("aliases"), F.lit(p != "system").alias("in_dialogue")) for p, a in PEOPLE.items()))
    c, n = F.col("conv_id"), F.size("dialogue")
    target = F.try_element_at("dialogue", F.lit(-1))
    word = F.regexp_extract(target["text"], r"(\S+)\s*$", 1)
    at = F.length(F.rtrim(target["text"])) - F.length(word)
    who = F.array(F.lit("user"), F.lit("assistant"), F.lit("system"))

    def person(n: Column) -> Column:
        return F.element_at(who, (n % 3 + 1).cast("int"))

    base = r.select(c, "dialogue", people.alias("participants"), n.alias("target_turn"), target["speaker_id"].alias("speaker_id"), word.alias("target_predicate"), F.struct(at.alias("begin"), (at + F.length(word)).alias("end")).alias("span"))
    return base.select(
        c.cast("string").alias("sample_id"), F.when(c % 2 == 0, "controlled").otherwise("naturalistic").alias("dataset"), F.concat(F.lit("S"), (c % 10).cast("string")).alias("scenario_id"), F.when(c % 3 == 0, F.concat(F.lit("F"), (c % 4).cast("string"))).alias("family_id"),
        F.array(F.concat(F.lit("S"), F.floor(c / 2).cast("string"), F.lit(":base~v1"))).alias("pair_ids"), F.when(c % 2 == 0, "base").otherwise("v1").alias("variant"), "participants", "dialogue", "speaker_id", "target_turn", "target_predicate", "span",
        F.when(c % 3 == 0, "llm").otherwise("human").alias("creation_method"), F.when(c % 6 == 0, "").otherwise("g").alias("generation_model"), F.when(c % 8 == 0, "").otherwise("2024-01-01").alias("generation_created"),
        F.when(c % 7 != 0, person(c)).alias("gold_referent_id"), F.when(c % 4 == 0, person(c + 1)).alias("addressee_id"), F.when(c % 5 != 0, F.lit(1)).alias("anchor_turn"), F.when(c % 5 != 0, person(c + 2)).alias("anchor_referent_id"),
        F.lit(None).cast("string").alias("anchor_addressee_id"), F.when(c % 6 == 1, person(c + 1)).alias("distractor_id"), F.when(c % 7 == 0, "unreviewed").otherwise("unambiguous").alias("ambiguity_status"), F.when(c % 3 == 1, "in_review").otherwise("accepted").alias("annotation_status"),
        F.when(c % 4 == 1, F.array(F.lit("zero"))).otherwise(F.array().cast("array<string>")).alias("linguistic_cues"), F.when(c % 2 == 1, F.array(F.lit("referent_shift"))).otherwise(F.array().cast("array<string>")).alias("manipulated_variables"),
        F.lit(None).cast("map<string,array<string>>").alias("pair_claims"), F.lit(None).cast("map<string,boolean>").alias("pair_expected_gold_change"), F.when(c % 2 == 1, c % 4 == 1).alias("expected_gold_change"),
    )


PROMPT = {"version": "q1", "slots": ["dialogue", "target_speaker_label", "target_marker", "candidates"], "template": "{dialogue}\nWho does \"{target_marker}\" of {target_speaker_label} speak of?\n{candidates}"}
CONFIG = {"model_id": "mock", "model_label": "mock", "output_schema": "{}", "decoding": {"temperature": 0}}
