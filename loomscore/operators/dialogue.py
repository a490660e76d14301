"""Derived columns of dialogue records.

A record has sample_id, participants (array of entity_id, name, aliases,
in_dialogue), dialogue (array of turn_index, speaker_id, text, in order),
speaker_id, target_turn, target_predicate and span (begin, end; 0-based) and the
label's columns.  Unknown values stay null, they never become false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import find_mentions, surface_forms

MENTIONS = "array<struct<turn:int,pos:int,eid:string>>"


def in_dialogue_ids(people: str = "participants") -> Column:
    return F.transform(F.filter(people, lambda p: F.coalesce(p["in_dialogue"], F.lit(True))), lambda p: p["entity_id"])


def infer_addressee(speaker: Column, declared: Column, ids: Column) -> Column:
    """The declared one, else the only other person in the dialogue."""
    others = F.filter(ids, lambda i: i != speaker)
    return F.coalesce(declared, F.when(F.size(others) == 1, F.try_element_at(others, F.lit(1))))


def role(entity: Column, speaker: Column, addressee: Column, ids: Column) -> Column:
    """speaker, addressee, third_party; null for no entity, and for one in the dialogue while the addressee is unknown."""
    alone = F.size(F.filter(ids, lambda i: i != speaker)) == 1
    unknown = F.when(F.array_contains(ids, entity), F.when(alone, "addressee")).otherwise("third_party")
    return F.when(entity.isNull(), None).when(entity == speaker, "speaker").when(addressee.isNotNull(), F.when(entity == addressee, "addressee").otherwise("third_party")).otherwise(unknown)


def mentions() -> Column:
    """All mentions up to the target turn, of which only what stands before the predicate counts."""
    forms = surface_forms("participants")
    said = F.filter("dialogue", lambda t: t["turn_index"] <= F.col("target_turn"))

    def of(t: Column) -> Column:
        text = F.when((t["turn_index"] == F.col("target_turn")) & F.col("span").isNotNull(), F.left(t["text"], F.col("span.begin"))).otherwise(t["text"])
        return F.transform(find_mentions(text, forms), lambda m: F.struct(t["turn_index"].alias("turn"), m["pos"].alias("pos"), m["eid"].alias("eid")))

    return F.array_sort(F.flatten(F.transform(said, of)))


def last_of(found: Column, entity: Column) -> Column:
    """The place of an entity's last mention: struct(turn, pos)."""
    m = F.array_max(F.filter(found, lambda x: x["eid"] == entity))
    return F.when(m.isNotNull(), F.struct(m["turn"].alias("turn"), m["pos"].alias("pos")))


def derive(records: DataFrame) -> DataFrame:
    """``records`` with mentions and the twelve derived columns; an anchor outside [1, target_turn) gives null shift columns."""
    ids, gold, speaker = in_dialogue_ids(), F.col("gold_referent_id"), F.col("speaker_id")
    addressee = infer_addressee(speaker, F.col("addressee_id"), ids)
    anchored = F.col("anchor_turn").isNotNull() & F.col("anchor_referent_id").isNotNull() & F.col("anchor_turn").between(1, F.col("target_turn") - 1)
    anchor_speaker = F.try_element_at("dialogue", F.col("anchor_turn"))["speaker_id"]
    anchor_addressee = infer_addressee(anchor_speaker, F.col("anchor_addressee_id"), ids)
    rows = records.withColumns({
        "mentions": mentions(),
        "gold_referent_role": role(gold, speaker, addressee, ids),
        "anchor_referent_role": F.when(anchored, role(F.col("anchor_referent_id"), anchor_speaker, anchor_addressee, ids)),
        "speaker_changed": F.when(anchored, anchor_speaker != speaker),
        "referent_changed": F.when(anchored & gold.isNotNull(), F.col("anchor_referent_id") != gold),
        "n_turns": F.size("dialogue"),
        "n_participants": F.size(ids),
    })
    found = F.col("mentions")
    last_gold, last_distractor = last_of(found, gold), last_of(found, F.col("distractor_id"))
    recent = F.try_element_at(found, F.lit(-1))["eid"]
    declared = last_distractor.isNotNull() & (last_gold.isNull() | F.coalesce(last_distractor > last_gold, F.lit(False)))
    present = F.when(gold.isNull(), None).when(F.col("distractor_id").isNotNull(), declared).otherwise(recent.isNotNull() & (recent != gold))
    return rows.withColumns({
        "referent_role_changed": F.when(F.col("referent_changed").isNotNull(), F.col("anchor_referent_role") != F.col("gold_referent_role")),
        "gold_last_mention_turn": last_gold["turn"],
        "turn_distance": F.col("target_turn") - last_gold["turn"],
        "most_recent_mentioned_id": recent,
        "distractor_present": present,
        "distractor_last_mention_turn": last_distractor["turn"],
    })


def name_of(entity: Column) -> Column:
    return F.try_element_at(F.filter("participants", lambda p: p["entity_id"] == entity), F.lit(1))["name"]


def render(up_to: Column | None = None, mark: bool = False) -> Column:
    """"name: text" lines up to a turn (the target's by default), with [[ ]] around the predicate if ``mark``."""
    limit = F.col("target_turn") if up_to is None else up_to

    def line(t: Column) -> Column:
        b, e, text = F.col("span.begin"), F.col("span.end"), t["text"]
        marked = F.concat(F.left(text, b), F.lit("[["), F.substring(text, b + 1, e - b), F.lit("]]"), F.substring(text, e + 1, F.length(text)))
        return F.concat(name_of(t["speaker_id"]), F.lit(": "), F.when(F.lit(mark) & (t["turn_index"] == F.col("target_turn")) & F.col("span").isNotNull(), marked).otherwise(text))

    return F.array_join(F.transform(F.filter("dialogue", lambda t: t["turn_index"] <= limit), line), "\n")


def neutral_ids(records: DataFrame, seed: int = 0) -> DataFrame:
    """``records`` with id_map: each person's id to E1, E2, ... in a seeded order that is fixed within a family."""
    family = F.coalesce("family_id", "scenario_id", "sample_id")
    keyed = F.transform("participants", lambda p: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), family, p["entity_id"])).alias("h"), p["entity_id"].alias("eid")))
    order = F.transform(F.array_sort(keyed), lambda s: s["eid"])
    return records.withColumn("id_map", F.map_from_arrays(order, F.transform(order, lambda e, i: F.concat(F.lit("E"), (i + 1).cast("string")))))


def mapped(entity: Column) -> Column:
    return F.when(F.coalesce(entity, F.lit("")) != "", F.try_element_at("id_map", entity))


def items(records: DataFrame) -> DataFrame:
    """What an evaluated model may see of records with ``id_map``."""
    label = name_of(F.col("speaker_id"))
    target = F.try_element_at(F.filter("dialogue", lambda t: t["turn_index"] == F.col("target_turn")), F.lit(1))["text"]
    offset = F.length(label) + 2
    people = F.transform("participants", lambda p: F.struct(F.try_element_at("id_map", p["entity_id"]).alias("entity_id"), p["name"].alias("label"), F.array_distinct(F.concat(F.array(p["name"]), p["aliases"])).alias("aliases")))
    ordered = F.array_sort(people, lambda a, b: F.when(F.length(a["entity_id"]) != F.length(b["entity_id"]), F.length(a["entity_id"]) - F.length(b["entity_id"])).when(a["entity_id"] < b["entity_id"], -1).when(a["entity_id"] > b["entity_id"], 1).otherwise(0))
    return records.select(
        F.col("sample_id").alias("item_id"), "dataset", F.col("scenario_id").alias("conversation_id"), F.coalesce("family_id", "scenario_id").alias("family_id"), F.try_element_at("pair_ids", F.lit(1)).alias("pair_id"), "pair_ids", F.col("variant").alias("version"),
        render().alias("full_text"), F.concat(label, F.lit(": "), target).alias("local_text"), "target_turn",
        F.struct(F.col("target_predicate").alias("form"), (F.col("span.begin") + offset).alias("begin"), (F.col("span.end") + offset).alias("end")).alias("target_marker"),
        label.alias("target_speaker_label"), mapped(F.col("speaker_id")).alias("target_speaker_id"),
        F.transform(F.filter("dialogue", lambda t: t["turn_index"] <= F.col("target_turn")), lambda t: F.try_element_at("id_map", t["speaker_id"])).alias("speaker_sequence"),
        F.transform(in_dialogue_ids(), lambda i: F.try_element_at("id_map", i)).alias("dialogue_participants"), ordered.alias("candidates"),
    )


# Names that no item may carry, and those that a search of written items looks for beside them.
GOLD_KEYS = (
    "gold_entity_id", "gold_role", "gold_referent_id", "gold_referent_role", "designated_distractor_id",
    "distractor_id", "anchor_referent_id", "author_rationale", "restored_form", "gold",
)
FORBIDDEN_ITEM_KEYS = (
    *GOLD_KEYS, "addressee_id", "anchor_turn", "anchor_addressee_id", "entity_roles", "context_need",
    "manipulated_variables", "pair_claims", "expected_gold_change", "linguistic_cues",
    "ambiguity_status", "annotation_status", "validation_metadata", "id_map",
)


def gold(records: DataFrame) -> DataFrame:
    """The key to ``items``, of derived records with ``id_map``."""
    ids = in_dialogue_ids()
    addressee = infer_addressee(F.col("speaker_id"), F.col("addressee_id"), ids)
    roles = F.map_from_entries(F.transform("participants", lambda p: F.struct(F.try_element_at("id_map", p["entity_id"]), role(p["entity_id"], F.col("speaker_id"), addressee, ids))))
    return records.select(
        F.col("sample_id").alias("item_id"), mapped(F.col("gold_referent_id")).alias("gold_entity_id"), F.col("gold_referent_role").alias("gold_role"), roles.alias("entity_roles"), mapped(addressee).alias("addressee_id"),
        mapped(F.col("distractor_id")).alias("designated_distractor_id"), "speaker_changed", "referent_changed", "referent_role_changed", "turn_distance", "distractor_present", mapped(F.col("most_recent_mentioned_id")).alias("most_recent_mentioned_id"),
        "dataset", "creation_method", "annotation_status", "ambiguity_status", "linguistic_cues", "manipulated_variables", F.map_from_entries(F.transform(F.map_entries("id_map"), lambda e: F.struct(e["value"], e["key"]))).alias("id_map"),
    )


def evaluation_split(records: DataFrame, include_unreviewed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records for evaluation, and (sample_id, reason) of those left out."""
    reason = F.when(F.col("gold_referent_id").isNull(), F.concat(F.lit("no gold (ambiguity="), F.coalesce("ambiguity_status", F.lit("None")), F.lit(")")))
    if not include_unreviewed:
        reason = reason.when(~F.col("annotation_status").eqNullSafe(F.lit("accepted")), F.concat(F.lit("annotation_status="), F.coalesce("annotation_status", F.lit("None"))))
    return records.filter(reason.isNull()), records.select("sample_id", reason.alias("reason")).filter("reason is not null")


# -- turns as rows -----------------------------------------------------------


def turn_gaps(turns: DataFrame, dialogue: str, turn: str, first: int = 1) -> DataFrame:
    """Dialogues whose turns aren't first, first + 1, ... without repeats."""
    n = F.count("*")
    seen = turns.groupBy(dialogue).agg(n.alias("n"), F.min(turn).alias("lo"), F.max(turn).alias("hi"), F.count_distinct(turn).alias("d"))
    return seen.filter((F.col("lo") != first) | (F.col("hi") != F.col("n") + first - 1) | (F.col("d") != F.col("n")))


def previous_speaker(turns: DataFrame, dialogue: str, turn: str, speaker: str) -> DataFrame:
    """``turns`` with ``previous_other``: the last earlier speaker who isn't the turn's own.

    With the speaker before this run of turns carried along, no frame looks back further than one row.
    """
    w = W.partitionBy(dialogue).orderBy(turn)
    before = F.lag(speaker).over(w)
    run = turns.withColumn("__new", F.when(~before.eqNullSafe(F.col(speaker)), before))
    return run.withColumn("previous_other", F.last("__new", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")
