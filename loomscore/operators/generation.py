"""Drafts from scenarios: jobs, views for a generating model, and answers read into records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import json_object
from ..functions.text import label_of, render_template, strip

VARIANT = "struct<variant:string,description:string,manipulated_variables:array<string>,expected_gold_id:string,expected_gold_change:boolean,pair_with:string>"
ANSWER = "turns array<struct<speaker:string,text:string>>, target_turn string, target_predicate string, _bad string"


def jobs(scenarios: DataFrame, ids: Sequence[str] | None = None, variants: str = "all") -> DataFrame:
    """A row for each scenario and variant, the base (null ``spec``) among them; ``variants="base"`` for bases alone."""
    some = scenarios if ids is None else scenarios.filter(F.col("scenario_id").isin(*ids))
    base = F.array(F.lit(None).cast(VARIANT))
    each = F.concat(base, F.coalesce("variants", F.array().cast(f"array<{VARIANT}>"))) if variants == "all" else base
    rows = some.withColumn("spec", F.explode(each)).withColumn("variant", F.coalesce("spec.variant", F.lit("base")))
    return rows.withColumns({"sample_id": F.concat_ws("-", "scenario_id", "variant"), "item_id": F.concat_ws(":", "scenario_id", "variant"), "pair_ids": pair_ids(), "gold": F.coalesce(F.nullif("spec.expected_gold_id", F.lit("")), F.col("intended_gold_id"))})


def pair_ids() -> Column:
    """ "scenario:a~b" for each variant that names this one as its other side, and for the side that this one names."""
    here = F.col("variant")

    def of(v: Column) -> Column:
        return F.array_compact(F.array(
            F.when(v["pair_with"] == here, F.concat("scenario_id", F.lit(":"), here, F.lit("~"), v["variant"])),
            F.when((v["variant"] == here) & (F.coalesce(v["pair_with"], F.lit("")) != ""), F.concat("scenario_id", F.lit(":"), v["pair_with"], F.lit("~"), here)),
        ))

    return F.flatten(F.transform(F.coalesce("variants", F.array().cast(f"array<{VARIANT}>")), of))


def name_of(entity: Column) -> Column:
    return F.try_element_at(F.filter("participants", lambda p: p["entity_id"] == entity), F.lit(1))["name"]


def view() -> Column:
    """What the generating model may know of a job, as JSON."""
    people = F.transform("participants", lambda p: F.struct(p["name"].alias("name"), p["in_dialogue"].alias("in_dialogue"), p["note"].alias("note")))
    fields = F.struct(
        "scenario_id", "title", "setting", people.alias("participants"), F.col("conditions.n_turns").alias("n_turns"), F.col("conditions.target_role").alias("target_role"), name_of(F.col("gold")).alias("intended_referent"),
        name_of(F.col("previous_referent_id")).alias("previous_referent"), name_of(F.col("distractor_id")).alias("distractor"), "required_context", F.col("spec.variant").alias("variant"), F.col("spec.description").alias("variant_description"),
    )
    return F.to_json(fields, {"ignoreNullFields": "false"})


def requests(rows: DataFrame, prompt: Mapping, config: Mapping, output_schema: str) -> DataFrame:
    """Requests for ``runner.run``: one for each job."""
    rules = F.concat(F.coalesce("naturalness_constraints", F.array().cast("array<string>")), F.coalesce("cue_constraints", F.array().cast("array<string>")))
    lines = F.when(F.size(rules) > 0, F.array_join(F.transform(rules, lambda c: F.concat(F.lit("- "), c)), "\n")).otherwise("-")
    asked = render_template(prompt["template"], prompt["slots"], {"scenario": view(), "variant": F.col("variant"), "constraints": lines, "output_schema": F.lit(output_schema)})
    from ..plans.runner import payload_hash

    out = rows.select("item_id", F.lit("generate").alias("condition"), F.array().cast("array<string>").alias("candidate_ids"), F.lit(config.get("model_id", "unset")).alias("model_id"), F.lit(config.get("model_label", "")).alias("model_label"), F.lit(config.get("system", "")).alias("system"), asked.alias("user"), F.lit("{}").alias("decoding"), F.lit(output_schema).alias("output_schema"), F.lit(config.get("seed")).cast("long").alias("seed"), F.lit(prompt["version"]).alias("prompt_version"))
    return out.withColumn("payload_hash", payload_hash())


def parsed(answered: DataFrame) -> DataFrame:
    """Jobs with ``raw_text`` read: dialogue, target_turn, target_predicate, speaker_id, or ``problem``."""
    body = json_object(strip("raw_text"))
    read = answered.withColumn("__a", F.from_json(body, ANSWER, {"columnNameOfCorruptRecord": "_bad"}))
    inside = F.filter("participants", lambda p: F.coalesce(p["in_dialogue"], F.lit(True)))
    id_of = F.map_from_arrays(F.transform(inside, lambda p: p["name"]), F.transform(inside, lambda p: p["entity_id"]))
    turns = F.transform("__a.turns", lambda t, i: F.struct((i + 1).alias("turn_index"), F.try_element_at(id_of, t["speaker"]).alias("speaker_id"), strip(F.coalesce(t["text"], F.lit(""))).alias("text")))
    read = read.withColumns({"dialogue": turns, "target_turn": F.coalesce(F.expr("try_cast(__a.target_turn AS INT)"), F.size("__a.turns")), "target_predicate": strip(F.coalesce("__a.target_predicate", F.lit("")))})
    speaker = F.try_element_at("dialogue", F.col("target_turn"))["speaker_id"]
    problem = (
        F.when(F.col("raw_text").isNull(), "no answer").when(body.isNull() | F.col("__a._bad").isNotNull(), "no json object").when(~(F.size("__a.turns") > 0) | F.col("__a.turns").isNull(), "no turns")
        .when(F.exists("dialogue", lambda t: t["speaker_id"].isNull()), "unknown speaker").when(F.col("target_predicate") == "", "no target_predicate").when(speaker.isNull(), "target_turn out of range")
    )
    return read.withColumns({"speaker_id": speaker, "problem": problem}).drop("__a")


def drafts(good: DataFrame, config: Mapping, prompt_version: str, created: str) -> tuple[DataFrame, DataFrame]:
    """Records and candidate labels of jobs without a problem."""
    rows = good.filter("problem IS NULL")
    meta = F.to_json(F.struct(F.lit(config.get("model_id")).alias("model"), F.lit(config.get("provider")).alias("provider"), F.lit(prompt_version).alias("prompt_version"), F.lit(created).alias("created")))
    records = rows.select("sample_id", "dataset", "scenario_id", F.lit(None).cast("string").alias("template_id"), F.col("scenario_id").alias("family_id"), "pair_ids", "variant", "participants", "dialogue", "speaker_id", "target_turn", "target_predicate", F.lit(None).cast("array<int>").alias("target_predicate_span"), F.lit("subject").alias("omitted_argument"), F.lit("llm_generated_api").alias("creation_method"), F.parse_json(meta).alias("generation_metadata"), F.lit("1").alias("version"))
    distractor = F.when(~F.col("distractor_id").eqNullSafe(F.col("gold")), F.col("distractor_id"))
    labels = rows.select("sample_id", F.col("gold").alias("gold_referent_id"), distractor.alias("distractor_id"), F.lit("unreviewed").alias("ambiguity_status"), F.lit("candidate").alias("annotation_status"), F.coalesce("spec.manipulated_variables", F.array().cast("array<string>")).alias("manipulated_variables"), F.col("spec.expected_gold_change").alias("expected_gold_change"))
    return records, labels


def summary(scenarios: DataFrame) -> DataFrame:
    """(axis, level, n): scenarios, variants, and histograms over datasets, target roles and participants."""
    inside = F.size(F.filter("participants", lambda p: F.coalesce(p["in_dialogue"], F.lit(True))))
    pairs = F.array(
        F.struct(F.lit("n_scenarios").alias("axis"), F.lit("").alias("level"), F.lit(1).alias("n")), F.struct(F.lit("n_variants").alias("axis"), F.lit("").alias("level"), F.greatest(F.size("variants"), F.lit(0)).alias("n")),
        F.struct(F.lit("by_dataset").alias("axis"), label_of(F.col("dataset")).alias("level"), F.lit(1).alias("n")), F.struct(F.lit("by_target_role").alias("axis"), label_of(F.col("conditions.target_role")).alias("level"), F.lit(1).alias("n")),
        F.struct(F.lit("by_n_participants").alias("axis"), inside.cast("string").alias("level"), F.lit(1).alias("n")),
    )
    return scenarios.select(F.explode(pairs).alias("h")).groupBy("h.axis", "h.level").agg(F.sum("h.n").alias("n"))


def unfinished(sheet: DataFrame, log: DataFrame, condition: str) -> tuple[DataFrame, DataFrame]:
    """Sheet rows to ask again, and the judgements that an earlier run left for blank ones.

    ``log``: review_id, condition, ambiguity, notes and further judgements.
    """
    valid = log.filter((F.col("condition") == condition) & (F.coalesce("ambiguity", F.lit("")) != "") & ~F.coalesce("notes", F.lit("")).startswith("(unparsable)"))
    blank = sheet.filter(F.trim(F.coalesce("ambiguity", F.lit(""))) == "")
    return blank.join(valid.select("review_id"), "review_id", "left_anti"), valid.join(blank.select("review_id"), "review_id", "left_semi")
