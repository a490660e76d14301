"""Readers and writers of the engine's tables.

All go through Spark's sources, so a path may be in any store that Spark
reads.  Text tables are read with their declared schema and fail on a
malformed line.
"""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import keyed_order, strip
from ..operators.joins import match_problems, sized
from . import lines, schemas

DIALOGUES, LABELS = "dialogues.jsonl", "labels.jsonl"


# -- JSON lines --------------------------------------------------------------


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank lines are skipped, a malformed one stops the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """A folder of files with one object a line, UTF-8."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_log(df: DataFrame, path: str, fresh: bool = False) -> None:
    """Rows at the end of a log; ``fresh`` starts it anew."""
    df.write.mode("overwrite" if fresh else "append").option("ignoreNullFields", "false").json(path)


def spanned(records: DataFrame) -> DataFrame:
    """``records`` with ``span`` from target_predicate_span, or where the predicate occurs once."""
    given = F.col("target_predicate_span")
    text = F.try_element_at("dialogue", F.col("target_turn"))["text"]
    at = F.instr(text, F.col("target_predicate")) - 1
    found = F.when(at >= 0, F.struct(at.alias("begin"), (at + F.length("target_predicate")).alias("end")))
    return records.withColumn("span", F.when(F.size(given) == 2, F.struct(F.try_element_at(given, F.lit(1)).alias("begin"), F.try_element_at(given, F.lit(2)).alias("end"))).otherwise(found))


def load_dataset(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Records joined with their labels, and all problems (file, line, sample_id, problem).

    Problems: lines that can't be read, and repeated, missing and orphan
    sample ids.  The rest is loaded all the same.
    """
    parts, told = [], []
    for name, schema in ((DIALOGUES, schemas.RECORDS), (LABELS, schemas.LABELS)):
        read = lines.read_lines(spark, f"{folder}/{name}", schema)
        told.append(read.filter("problem IS NOT NULL").select("file", "line", F.col("row.sample_id").alias("sample_id"), "problem"))
        parts.append(read.filter("problem IS NULL").select("row.*"))
    records, labels = spanned(parts[0]), parts[1]
    whole = match_problems(records, labels, "sample_id").select(F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("line"), "sample_id", "problem")
    return records.join(labels, "sample_id"), whole.unionByName(told[0]).unionByName(told[1])


def broken_constraints(spark: SparkSession, folder: str) -> DataFrame:
    """(file, line, sample_id, problem) of every constraint that a record or a label breaks by itself."""
    from ..operators import rules

    def found(name: str, schema: str, own: list[rules.Rule], shape=lambda x: x) -> DataFrame:
        read = lines.read_lines(spark, f"{folder}/{name}", schema).filter("problem IS NULL")
        return lines.broken(shape(read.select("file", "line", "row.*")), own, "file", "line", "sample_id")

    return found(DIALOGUES, schemas.RECORDS, rules.record_rules(), spanned).unionByName(found(LABELS, schemas.LABELS, rules.label_rules()))


def checked_dataset(spark: SparkSession, folder: str, most: int = 100) -> DataFrame:
    """``load_dataset``, or an error that names up to ``most`` problems."""
    rows, problems = load_dataset(spark, folder)
    if found := problems.limit(most).collect():
        raise ValueError("dataset errors:\n- " + "\n- ".join(" ".join(str(x) for x in (r["problem"], r["sample_id"], r["file"] and f"({r['file']}:{r['line']})") if x) for r in found))
    return rows


def save_dataset(rows: DataFrame, folder: str) -> None:
    for name, schema in ((DIALOGUES, schemas.RECORDS), (LABELS, schemas.LABELS)):
        write_jsonl(rows.select(*(f.name for f in T.StructType.fromDDL(schema))), f"{folder}/{name}")


def load_scenarios(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Scenarios, and the ids that occur more than once."""
    rows = read_jsonl(spark, path, schemas.SCENARIOS)
    return rows, rows.groupBy("scenario_id").agg(F.count("*").alias("n")).filter("n > 1").select("scenario_id")


def scenario_problems(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, scenario_id, problem): lines that can't be read, constraints that scenarios break, ids that come again."""
    from ..operators import rules

    read = lines.read_lines(spark, path, schemas.SCENARIOS)
    key = F.col("row.scenario_id").alias("scenario_id")
    bad = read.filter("problem IS NOT NULL").select("file", "line", key, "problem")
    good = read.filter("problem IS NULL").select("file", "line", "row.*")
    again = good.groupBy("scenario_id").agg(F.sort_array(F.collect_list(F.struct("file", "line"))).alias("places")).filter("size(places) > 1")
    again = again.select("scenario_id", F.explode(F.slice("places", 2, F.size("places"))).alias("p")).select("p.file", "p.line", "scenario_id", F.lit("duplicate scenario").alias("problem"))
    return bad.unionByName(lines.broken(good, rules.scenario_rules(), "file", "line", "scenario_id")).unionByName(again)


# -- CSV ---------------------------------------------------------------------


def read_csv(spark: SparkSession, path: str, file: str | None = None) -> DataFrame:
    """All strings, cells over several lines, a byte order mark or none; blank cells are "", others trimmed; with the file's path in column ``file``."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"').csv(path)
    return rows.select(*(F.coalesce(strip(c), F.lit("")).alias(c.lstrip("﻿")) for c in rows.columns), *([F.col("_metadata.file_path").alias(file)] if file else []))


def write_csv(df: DataFrame, path: str, *by: str) -> None:
    out = df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"')
    (out.partitionBy(*by) if by else out).csv(path)


def review_ids(samples: DataFrame, seed: int = 0) -> DataFrame:
    """sample_id, review_id: R001, R002, ... in a seeded order.

    The order is that of a hash, whose first three digits make 4096 parts:
    each is numbered by itself, and only the parts' sizes meet in one task.
    """
    keyed = samples.select("sample_id", keyed_order(seed, "sample_id").alias("k")).withColumn("p", F.left("k", F.lit(3)))
    sizes = keyed.groupBy("p").agg(F.count("*").alias("n"))
    before = sizes.select("p", (F.sum("n").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    n = F.col("before") + F.row_number().over(W.partitionBy("p").orderBy("k", "sample_id"))
    rows = keyed.join(F.broadcast(before), "p").withColumn("n", n)
    return rows.select("sample_id", F.concat(F.lit("R"), F.when(F.col("n") < 1000, F.lpad(F.col("n").cast("string"), 3, "0")).otherwise(F.col("n").cast("string"))).alias("review_id"))


def sheets(samples: DataFrame, ids: DataFrame, annotators: list[str], condition: str, seed: int = 0) -> DataFrame:
    """A row for each annotator and sample, in an order of the annotator's own, with empty judgements.

    ``samples``: sample_id, full_text, local_text, target_turn, target_predicate, target_speaker, candidate_lines.
    """
    each = samples.join(ids, "sample_id").withColumn("annotator", F.explode(F.array(*map(F.lit, annotators))))
    order = F.row_number().over(W.partitionBy("annotator").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "annotator", F.lit(condition), "sample_id"))))
    body = F.col("local_text") if condition == "local" else F.col("full_text")
    blank = [F.lit("").alias(c) for c in schemas.JUDGEMENTS]
    return each.select("annotator", order.alias("order"), "review_id", body.alias("dialogue"), "target_turn", "target_predicate", "target_speaker", F.col("candidate_lines").alias("candidates"), *blank)


def load_sheets(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """Votes from files named sheet_{condition}_{annotator}.csv; a review id without a sample stands for itself."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    name = F.regexp_extract("_metadata.file_name", r"sheet_([^_.]+)_(.+)\.csv$", 1)
    who = F.regexp_extract("_metadata.file_name", r"sheet_([^_.]+)_(.+)\.csv$", 2)
    clean = rows.select(name.alias("condition"), who.alias("annotator"), *(F.coalesce(strip(c), F.lit("")).alias(c) for c in ("review_id", *schemas.JUDGEMENTS)))
    return clean.join(sized(ids), "review_id", "left").withColumn("sample_id", F.coalesce("sample_id", "review_id"))


def load_decisions(spark: SparkSession, path: str | None) -> DataFrame:
    """One decision a sample, the last by file name and place in the file; no path, no decisions."""
    if path is None:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in schemas.DECISIONS))
    rows = read_csv(spark, path, "__file").withColumn("__at", F.struct("__file", F.monotonically_increasing_id()))  # one task reads a file, as cells may span lines
    return rows.groupBy("sample_id").agg(F.max_by(F.struct(*schemas.DECISIONS[1:]), "__at").alias("d")).select("sample_id", "d.*")


def per_sample(rows: DataFrame) -> DataFrame:
    """The columns of the result sheet; ``rows`` may have more, and lacks none but ``correct``."""
    from ..operators.metrics import is_correct

    out = rows.withColumn("correct", is_correct().cast("int"))
    return out.select(*(F.col(c).cast("string").alias(c) if c in out.columns else F.lit("").alias(c) for c in schemas.PER_SAMPLE))


# -- files and small documents -----------------------------------------------


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def folder_digest(spark: SparkSession, path: str) -> str:
    """One sha256 of a file or of a folder's files, whatever their names."""
    each = file_digest(spark, path).agg(F.array_sort(F.collect_list("sha256")).alias("all"))
    return each.select(F.when(F.size("all") == 1, F.get("all", F.lit(0))).otherwise(F.sha2(F.array_join("all", ""), 256))).first()[0]


def read_document(spark: SparkSession, path: str) -> dict:
    """A small JSON document (a prompt, a configuration), read on the driver through Spark's store."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write_document(spark: SparkSession, value: dict | list, path: str) -> None:
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_prompt(spark: SparkSession, path: str, allowed: tuple[str, ...]) -> dict:
    prompt = read_document(spark, path)
    if gone := {"version", "slots", "template"} - prompt.keys():
        raise ValueError(f"prompt lacks {sorted(gone)}")
    if odd := set(prompt["slots"]) - set(allowed):
        raise ValueError(f"slots that aren't allowed: {sorted(odd)}")
    return prompt


def prompt_problems(prompt: dict) -> list[str]:
    """Slots used but not declared, and declared but not used."""
    import re

    used, declared = set(re.findall(r"\{([^{}]*)\}", prompt["template"])), set(prompt["slots"])
    return [f"slot {{{s}}} is not declared" for s in sorted(used - declared)] + [f"declared slot {{{s}}} is not used" for s in sorted(declared - used)]


def load_model(spark: SparkSession, path: str, label: str) -> dict:
    """A model's settings over the common ones of its file."""
    file = read_document(spark, path)
    own = next((m for m in file["models"] if m.get("model_label") == label), None)
    if own is None:
        raise ValueError(f"no model {label}")
    return {k: v for k, v in file.items() if k != "models"} | own


def inside(root: str, path: str) -> bool:
    """Whether a relative path stays below the workspace."""
    depth = 0
    for part in PurePosixPath(path).parts:
        depth += -1 if part == ".." else 0 if part in (".", "/") else 1
        if depth < 0:
            return False
    return not PurePosixPath(path).is_absolute() or PurePosixPath(path).is_relative_to(root)


def write_report(samples: DataFrame, issues: DataFrame, counts: DataFrame, path: str) -> None:
    """Markdown: a summary of histograms, then each sample's dialogue with the label folded away and its flags.

    ``samples``: scenario_id, sample_id, variant, dialogue_text, label_lines (array of strings).
    """
    flags = issues.filter("sample_id is not null").groupBy("sample_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("level", F.lit(":"), "code"))), "; ").alias("flags"))
    body = F.concat_ws(
        "\n", F.concat(F.lit("### "), "sample_id", F.lit(" (variant="), F.coalesce("variant", F.lit("-")), F.lit(")")), F.lit(""), F.lit("```text"), "dialogue_text", F.lit("```"), F.lit(""), F.lit("<details><summary>label</summary>"), F.lit(""),
        F.array_join(F.transform("label_lines", lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit(""), F.lit("</details>"), F.when(F.col("flags").isNotNull(), F.concat(F.lit("\nflags: "), "flags")), F.lit(""),
    )
    head = counts.groupBy("axis").agg(F.array_join(F.array_sort(F.collect_list(F.concat("level", F.lit("="), F.col("n").cast("string")))), ", ").alias("v")).select(F.lit("").alias("s"), F.concat(F.lit("0"), "axis").alias("o"), F.concat(F.lit("| "), "axis", F.lit(" | "), "v", F.lit(" |")).alias("value"))
    parts = samples.join(flags, "sample_id", "left").select(F.col("scenario_id").alias("s"), F.concat(F.lit("2"), "sample_id").alias("o"), body.alias("value"))
    titles = samples.select("scenario_id").distinct().select(F.col("scenario_id").alias("s"), F.lit("1").alias("o"), F.concat(F.lit("## "), "scenario_id", F.lit("\n")).alias("value"))
    head.unionByName(titles).unionByName(parts).orderBy("s", "o").select("value").write.mode("overwrite").text(path)
