"""Lines of text files with their file and number, and JSON lines read with all their faults.

A file's lines lie in splits that different tasks read.  The splits' counts
(one row a split) give the number of lines before each; within a split lines
are numbered by the order in which its task reads them.  No line is shuffled
or sorted for its number, whatever a file's size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.joins import sized
from ..operators.rules import Rule


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1, blank ones included), value."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value", F.monotonically_increasing_id().alias("n"))
    splits = rows.groupBy("file", "at").agg(F.count("*").alias("lines"), F.min("n").alias("first"))
    before = F.sum("lines").over(W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, 0)) - F.col("lines")
    starts = splits.select("file", "at", (before - F.col("first") + 1).alias("shift"))
    return rows.join(sized(starts), ["file", "at"]).select("file", (F.col("n") + F.col("shift")).alias("line"), "value")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, line, row (a struct of ``schema``) and problem (null if there is none) of each line that isn't blank.

    Nothing stops at a bad line: one that is no JSON object, or a field of
    another type, is told, and its row holds what could be read.
    """
    lines = numbered(spark, path).filter(F.trim("value") != "")
    alone = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), F.col("value"), F.lit("]"))), "$", "array<variant>")
    is_object = F.coalesce((F.size(alone) == 1) & F.trim("value").startswith("{"), F.lit(False))
    read = lines.withColumns({"ok": is_object, "row": F.from_json("value", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"})})
    problem = F.when(~F.col("ok"), "not a JSON object").when(F.col("row")["__bad"].isNotNull(), "a field of another type")
    return read.select("file", "line", F.col("row").dropFields("__bad").alias("row"), problem.alias("problem"))


def broken(rows: DataFrame, rules: Sequence[Rule], *keys: Column | str) -> DataFrame:
    """``keys`` and problem: each rule that a row breaks, all of them in one projection."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(r.when, F.lit(False)), F.concat(F.lit(r.code + ": "), r.message if isinstance(r.message, Column) else F.lit(r.message))) for r in rules)))
    return rows.select(*keys, F.explode(found).alias("problem"))
