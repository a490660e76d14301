"""Heuristic predictors over items: columns of (predicted_entity_id, parse_status, rule)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import find_mentions, last_mention, strip_speaker_labels, surface_forms

THIRD_PARTY_RULE = "most_recent_third_party_mention"


def result(entity: Column, rule: Column | str, otherwise: str) -> Column:
    return F.struct(entity.alias("predicted_entity_id"), F.when(entity.isNotNull(), "ok").otherwise("unmapped").alias("parse_status"), F.when(entity.isNotNull(), rule if isinstance(rule, Column) else F.lit(rule)).otherwise(otherwise).alias("rule"))


def said(text: Column, people: Column) -> Column:
    return last_mention(find_mentions(text, surface_forms(people, "label")))


def most_recent_entity() -> Column:
    """The last candidate named before the target predicate, speakers' labels aside."""
    lines = strip_speaker_labels(F.col("full_text"), F.transform("candidates", lambda c: c["label"]))
    cut = F.greatest(F.col("target_marker.begin") - (F.length(F.coalesce("target_speaker_label", F.lit(""))) + 2), F.lit(0))
    last = F.try_element_at(lines, F.lit(-1))
    text = F.array_join(F.concat(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), F.array(F.when(cut.isNotNull(), F.left(last, cut)).otherwise(last))), "\n")
    return result(said(text, F.col("candidates")), "most_recent_entity", "no explicit mention")


def most_recent_explicit_np() -> Column:
    """The last candidate with aliases named in the whole text."""
    return result(said(F.col("full_text"), F.filter("candidates", lambda c: F.size(c["aliases"]) > 0)), "most_recent_explicit_np", "no explicit mention")


def most_recent_entity_oracle(mentions: str = "mentions", limit: str = "target_position") -> Column:
    """The last of annotated mentions (position, entity_id) before the target."""
    own = F.filter(mentions, lambda m: F.col(limit).isNull() | (m["position"] < F.col(limit)))
    return result(F.array_max(F.transform(own, lambda m: F.struct(m["position"], m["entity_id"].alias("e"))))["e"], "most_recent_entity_oracle", "no prior mention")


def current_speaker() -> Column:
    labelled = F.try_element_at(F.filter("candidates", lambda c: c["label"].eqNullSafe(F.col("target_speaker_label"))), F.lit(-1))["entity_id"]
    return result(F.coalesce("target_speaker_id", labelled), "current_speaker", "current_speaker")


def current_addressee() -> Column:
    """The other of two participants, else the last earlier speaker who isn't the current one."""
    others = F.filter("dialogue_participants", lambda p: ~p.eqNullSafe(F.col("target_speaker_id")))
    before = F.filter(F.slice("speaker_sequence", 1, F.greatest(F.size("speaker_sequence") - 1, F.lit(0))), lambda s: ~s.eqNullSafe(F.col("target_speaker_id")))
    two = F.size(others) == 1
    entity = F.when(two, F.try_element_at(others, F.lit(1))).otherwise(F.try_element_at(before, F.lit(-1)))
    return result(entity, F.when(two, "other_participant").otherwise("previous_speaker"), "current_addressee")


def majority_role_prior(role: Column) -> Column:
    """The candidate (with ``role``) of the majority role; of several third parties the last named, else the first."""
    own = F.filter("candidates", lambda c: c["role"] == role)
    first = F.try_element_at(own, F.lit(1))["entity_id"]
    named = said(F.coalesce("full_text", F.lit("")), own)
    third = role == "third_party"
    entity = F.when(third, F.coalesce(named, first)).otherwise(first)
    rule = F.when(~third, role).when(named.isNotNull(), THIRD_PARTY_RULE).otherwise("first_third_party")
    return F.struct(entity.alias("predicted_entity_id"), F.when(entity.isNotNull(), "ok").otherwise("unmapped").alias("parse_status"), F.when(third & first.isNull(), THIRD_PARTY_RULE).otherwise(rule).alias("rule"))


BASELINES = {"most_recent_entity": most_recent_entity, "current_speaker": current_speaker, "current_addressee": current_addressee}


def run(items: DataFrame, names: tuple[str, ...] = tuple(BASELINES)) -> DataFrame:
    """Rows like those of normalised responses, one for each item and baseline, in one pass."""
    each = F.array(*(F.struct(F.lit(n).alias("model_label"), BASELINES[n]().alias("r")) for n in names))
    return items.withColumn("__b", F.explode(each)).select("*", F.lit("baseline").alias("condition"), "__b.model_label", "__b.r.predicted_entity_id", "__b.r.parse_status", "__b.r.rule").drop("__b")
