"""Joins and deduplication of records, items, gold keys and response logs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a side is broadcast.
MOST = 16 << 20


def row_bytes(schema: T.StructType) -> Column:
    """About what a row takes in memory: 16 bytes a column, and the length of texts, byte strings and nested values."""
    long = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    nested = [f for f in schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    long += [F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)) for f in nested]
    return sum(long, F.lit(16 * len(schema))).cast("long")


def held(df: DataFrame) -> int:
    """About the bytes that all rows take, by one aggregation."""
    return df.agg(F.coalesce(F.sum(row_bytes(df.schema)), F.lit(0))).first()[0]


def sized(df: DataFrame, most: int = MOST) -> DataFrame:
    """To be broadcast if its rows take at most ``most`` bytes; the planner chooses for larger ones."""
    return F.broadcast(df) if held(df) <= most else df


def last_write(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``; partial maxima, so a frequent key costs no more than others."""
    body = F.struct(*(c for c in log.columns if c not in keys))
    return log.groupBy(*keys).agg(F.max_by(body, F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def match_problems(records: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(key, problem) for repeated keys on either side and for keys on one side only."""
    a = records.groupBy(key).agg(F.count("*").alias("a"))
    b = labels.groupBy(key).agg(F.count("*").alias("b"))
    said = F.array_compact(F.array(F.when(F.col("a") > 1, "duplicate record"), F.when(F.col("b") > 1, "duplicate label"), F.when(F.col("b").isNull(), "missing label"), F.when(F.col("a").isNull(), "label without record")))
    return a.join(b, key, "full_outer").select(key, F.explode(said).alias("problem"))


def strict_join(rows: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """Each row with its gold columns, which replace its own; a row without gold or a repeated gold key stops the query."""
    once = gold.groupBy(key).agg(F.count("*").alias("__n"), *(F.any_value(c).alias(c) for c in gold.columns if c != key))
    j = rows.drop(*(c for c in gold.columns if c != key)).join(once, key, "left")
    said = F.when(F.col("__n").isNull(), F.concat(F.lit("no gold for "), F.col(key).cast("string"))).otherwise(F.concat(F.lit("repeated gold for "), F.col(key).cast("string")))
    return j.filter(F.when(F.col("__n") == 1, True).otherwise(F.raise_error(said).isNull())).drop("__n")


def predicted_role() -> Column:
    return F.when(F.col("predicted_entity_id").isNotNull(), F.try_element_at("entity_roles", F.col("predicted_entity_id")))


def alignment_problems(items: DataFrame, gold: DataFrame, key: str = "item_id", require_accepted: bool = True) -> DataFrame:
    """(key, problem): ids repeated or on one side only, gold that is no candidate, labels that aren't accepted.

    ``items``: key and candidate_ids.  ``gold``: key, gold_entity_id, annotation_status.
    """
    i = items.groupBy(key).agg(F.count("*").alias("ni"), F.any_value("candidate_ids").alias("c"))
    g = gold.groupBy(key).agg(F.count("*").alias("ng"), F.any_value("gold_entity_id").alias("e"), F.any_value("annotation_status").alias("s"))
    accepted = F.col("ng").isNotNull() & ~F.col("s").eqNullSafe(F.lit("accepted")) if require_accepted else F.lit(False)
    said = F.array_compact(F.array(
        F.when(F.col("ni") > 1, "duplicate item"), F.when(F.col("ng") > 1, "duplicate gold"), F.when(F.col("ng").isNull(), "item without gold"), F.when(F.col("ni").isNull(), "gold without item"),
        F.when(F.col("ni").isNotNull() & F.col("ng").isNotNull() & ~F.coalesce(F.array_contains("c", F.col("e")), F.lit(False)), "gold not a candidate"), F.when(accepted, "not accepted"),
    ))
    return i.join(g, key, "full_outer").select(key, F.explode(said).alias("problem"))


def with_cache(requests: DataFrame, cache: DataFrame, key: str = "payload_hash", answer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Requests whose answer is in the cache, with it, and those that must be sent.

    A key that the cache has several times counts once; where ``answer`` names
    a column, rows without one are no answers.
    """
    if answer:
        cache = cache.filter(F.col(answer).isNotNull())
    body = [c for c in cache.columns if c != key]
    once = cache.groupBy(key).agg(F.max(F.struct(*body)).alias("__r")).select(key, "__r.*") if body else cache.distinct()
    return requests.join(once, key), requests.join(once.select(key), key, "left_anti")


def containing(texts: DataFrame, text: str, passages: DataFrame, passage: str, most: int = MOST) -> DataFrame:
    """Rows of ``texts`` with each passage that they contain, both sides' columns.

    A passage that stands in a text brings all but its first and last word, so
    up to three of the words between lead to the texts that may have it; of
    those runs the longest in letters is taken, as common words are short.
    Passages of one or two words have no such key and are looked for one by
    one, ``most`` bytes of them at a time.
    """

    def cut(c: Column) -> Column:
        return F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")

    def runs(words: Column, first: int, last: Column, n: int) -> Column:
        return F.when(last >= first, F.transform(F.sequence(F.lit(first), last), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

    real = passages.filter(F.col(passage) != "").withColumn("__w", cut(F.col(passage)))
    size = F.size("__w")
    parts: list[DataFrame] = []
    for n, some in ((3, size >= 5), (2, size == 4), (1, size == 3)):
        keyed = real.filter(some)
        if keyed.isEmpty():
            continue
        best = F.array_max(F.transform(runs(F.col("__w"), 2, size - n, n), lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))["k"]
        own = texts.withColumn("__o", cut(F.col(text)))
        grams = own.withColumn("__k", F.explode(F.array_distinct(runs(F.col("__o"), 1, F.size("__o") - n + 1, n)))).drop("__o")
        parts.append(grams.join(sized(keyed.withColumn("__k", best).drop("__w")), "__k").drop("__k").filter(F.col(text).contains(F.col(passage))))
    short = real.filter(size < 3).drop("__w")
    blocks = -(-held(short) // most)
    for k in range(blocks):
        some = short.filter(F.pmod(F.xxhash64(passage), F.lit(blocks)) == k)
        parts.append(texts.join(F.broadcast(some), F.col(text).contains(F.col(passage))))
    if not parts:
        return texts.crossJoin(passages.limit(0))
    return reduce(DataFrame.unionByName, parts)
