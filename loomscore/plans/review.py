"""Review sheets filled by a model, in the columns that people fill.

A sheet's rows become requests of a run folder, so a fill that is stopped goes
on where it was, and one that is repeated asks for nothing that was answered
in a readable way.  A row that has a judgement keeps it with ``only_empty``:
people come before models.  The filled sheet replaces the one before it when
all of it is written.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import parse_judgement
from ..functions.text import keyed_order, strip
from ..sources import schemas, tables
from . import runner, runs

VERSION = "review-1"
# What is asked, and the keys and values of an answer (fixed values: those of the sheets).
LOCAL = """Below are one utterance and the people it may speak of; what was said before isn't shown.
Decide whether this line alone settles who the omitted subject of the predicate in [[ ]] is. Mostly it doesn't; don't guess. Only choose "unambiguous" if words in the line prove it.

[Utterance]
{dialogue}

[Candidates] (id=name)
{candidates}

Answer with one line of JSON:
{"ambiguity": "unambiguous|ambiguous|uncertain", "referent_id": "<a candidate's id if settled, else empty>", "context_sufficient": "yes|no", "notes": "<why, in a sentence>"}"""
FULL = """Below is a dialogue, a line "name: text" for each turn; the last line is the one to judge, and nothing follows it.
Decide who the omitted subject of the predicate in [[ ]] in the last line is. Choose "unambiguous" only if words of the dialogue prove it; "ambiguous" if more than one fits, "uncertain" if you can't tell, both with an empty referent_id.
Say whether the dialogue holds enough to decide, and how natural it is (1 not at all to 5 quite).
{three}
[Dialogue]
{dialogue}

[Candidates] (id=name)
{candidates}

Answer with one line of JSON:
{"referent_id": "<a candidate's id or empty>", "ambiguity": "unambiguous|ambiguous|uncertain", "context_sufficient": "yes|no", "naturalness_1to5": "1|2|3|4|5"{key}, "notes": "<why, in a sentence>"}"""
THREE = "Three people take part: give in addressee_id whom the last line is said to, if a name in it or the turn before settles it, else leave it empty.\n"
THREE_KEY = ', "addressee_id": "<a participant\'s id or empty>"'


def candidates() -> Column:
    """(id, name) of a cell "E1=Alma; E2=Bela"."""
    cells = F.filter(F.transform(F.split("candidates", ";"), strip), lambda c: c.contains("="))
    return F.transform(cells, lambda c: F.struct(strip(F.substring_index(c, "=", 1)).alias("id"), strip(F.substring(c, F.instr(c, "=") + 1, F.length(c))).alias("name")))


def three_take_part() -> Column:
    """Of at least three candidates three speak; where no speaker is a candidate by name, three names speak."""
    spoken = F.filter(F.split("dialogue", "\n"), lambda x: x.contains(":"))
    names = F.array_distinct(F.transform(spoken, lambda x: strip(F.substring_index(x, ":", 1))))
    known = F.array_intersect(names, F.transform(candidates(), lambda c: c["name"]))
    return (F.size(candidates()) >= 3) & (F.when(F.size(known) > 0, F.size(known)).otherwise(F.size(names)) == 3)


def asked(condition: str) -> Column:
    lines = F.array_join(F.filter(F.transform(F.split("candidates", ";"), strip), lambda c: c != ""), "\n")
    text: Column = F.lit(LOCAL if condition == "local" else FULL)
    if condition != "local":
        text = F.replace(F.replace(text, F.lit("{three}"), F.when(three_take_part(), THREE).otherwise("")), F.lit("{key}"), F.when(three_take_part(), THREE_KEY).otherwise(""))
    # what a cell holds is put in last, so that no slot in it is filled
    before, after = F.substring_index(text, "{dialogue}", 1), F.substring_index(text, "{dialogue}", -1)
    return F.concat(before, "dialogue", F.substring_index(after, "{candidates}", 1), lines, F.substring_index(after, "{candidates}", -1))


def requests(sheet: DataFrame, condition: str, config: dict) -> DataFrame:
    decoding = json.dumps(config.get("decoding", {}), sort_keys=True)
    text = {"condition": condition, "model_id": config.get("model_id", "unset"), "model_label": config.get("model_label", config.get("model_id", "unset")), "system": config.get("system", ""), "decoding": decoding, "output_schema": "", "prompt_version": VERSION}
    ids = F.array_sort(F.transform(candidates(), lambda c: c["id"]))
    rows = sheet.select(F.col("review_id").alias("item_id"), ids.alias("candidate_ids"), asked(condition).alias("user"), F.lit(None).cast("long").alias("seed"), *(F.lit(v).alias(n) for n, v in text.items()))
    return rows.withColumns({"payload_hash": runner.payload_hash(), "position_key": keyed_order(0, "item_id")})


def fill(spark: SparkSession, sheet: str, out: str, adapter: runner.Adapter, config: dict, condition: str, only_empty: bool = False, **options: object) -> dict:
    """Fill a sheet (CSV) into ``out``/sheet; counts of rows, of those with a readable answer, and of failures."""
    if condition not in ("local", "full"):
        raise ValueError(f"unknown condition {condition}")
    rows = tables.read_csv(spark, sheet)
    blank = F.col("ambiguity") == "" if only_empty else F.lit(True)
    read = parse_judgement(F.col("raw_text"), F.array().cast("array<string>"), F.lit(condition))
    counts = runs.settle(spark, requests(rows.filter(blank), condition, config), adapter, f"{out}/run", {**config, "prompt_version": VERSION, "condition": condition}, good=read["ambiguity"] != "", **options)
    answers = spark.read.schema(schemas.RESPONSES).json(f"{out}/run/responses").select(F.col("item_id").alias("review_id"), "raw_text", "from_cache")
    judged = rows.withColumn("__blank", blank).join(answers, "review_id", "left")
    judged = judged.withColumn("__j", parse_judgement(F.col("raw_text"), F.transform(candidates(), lambda c: c["id"]), F.lit(condition)))
    filled = [F.when(F.col("__blank"), F.col(f"__j.{c}")).otherwise(F.col(c)).alias(c) if c in schemas.JUDGEMENTS else F.col(c) for c in rows.columns]
    tables.write_csv(judged.select(*filled), f"{out}/sheet")
    notes = F.col("__j.notes")
    n = judged.agg(
        F.count("*").alias("n"), F.count_if(F.col("__blank") & F.col("raw_text").isNull()).alias("failed"), F.count_if(F.col("__blank") & notes.startswith("(unparsable)")).alias("unparsable"),
        F.count_if(F.col("__blank") & F.coalesce("from_cache", F.lit(False))).alias("resumed"),
    ).first().asDict()
    return {"n": n["n"], "ok": n["n"] - n["failed"] - n["unparsable"], **{k: n[k] for k in ("failed", "unparsable", "resumed")}, "permanent_error": counts["permanent_error"]}
