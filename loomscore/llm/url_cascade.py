"""URL filters: host-and-path rules, and a Bloom filter cascade for listed keys.

The cascade's first level encodes the listed keys; the second those other keys
of the corpus that the first takes for listed; the third the listed keys that
the second takes for those; and so on until a level has no false positives.
As it is built over the complete key universe, membership is exact for every
key in it, and a lookup needs no join: a key is listed if the first level
that lacks it is an odd one, counting from zero.

Keys fall into shards by their hash, and each shard has a cascade of its own,
built in one task from different keys, so repeats of a key weigh nothing.
Where all filters take at most ``BLOCK_BYTES`` they are broadcast and rows are
judged where they lie.  Beyond that, rows and filters are shuffled by shard
once, and a task holds one shard's filter at a time; a shard with far more rows
than others, as that of a frequent key, is dealt over several tasks, each with
a copy of the filter.

Null URLs and those without "://" have an empty host and path and the empty
key; repeated URLs are judged alike; an empty table or list gives no listed
keys; whole URLs count, whatever their length; of rules equally long the last
in order wins; columns with the names of results are replaced.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import batches, joins, scratch

SHARD_KEYS, BLOCK_BYTES, MOST_LEVELS = 500_000, 32 << 20, 64
FIRST_RATE, LATER_RATE = 1 / 16, 1 / 2
LEVEL = struct.Struct("<QI")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# -- rules -------------------------------------------------------------------


def with_host_path(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with ``host`` and ``path``."""
    rest = F.coalesce(F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return df.withColumns({"host": host, "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)})


def rule_columns(rules: list[tuple[str, str, str]]) -> tuple[F.Column, F.Column]:
    """Rule and verdict for ``host`` and ``path`` from (verdict, host, path) rules; the longest that fits, null if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


# -- cascade -----------------------------------------------------------------


def positions(h1: np.ndarray, h2: np.ndarray, level: int, k: int, m: np.ndarray | int) -> np.ndarray:
    """Of the k-th bit of each key at a level of m bits."""
    x = h1 + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ x >> np.uint64(27)
    return (x + np.uint64(k) * (h2 * np.uint64(2 * level + 3) | np.uint64(1))) % np.asarray(m, np.uint64)


def build_levels(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> bytes:
    """The levels of one shard, one after another."""
    inside, outside = (h1[listed], h2[listed]), (h1[~listed], h2[~listed])
    out: list[bytes] = []
    while len(inside[0]):
        if len(out) == MOST_LEVELS:
            raise ValueError("two keys have the same hashes")
        level = len(out)
        k = max(1, round(-np.log2(LATER_RATE if level else FIRST_RATE)))
        m = 64 * (1 + int(len(inside[0]) * k / np.log(2)) // 64)
        bits = np.zeros(m, bool)
        for j in range(k):
            bits[positions(*inside, level, j, m).astype(np.int64)] = True
        out.append(LEVEL.pack(m, k) + np.packbits(bits, bitorder="little").tobytes())
        wrong = np.ones(len(outside[0]), bool)
        for j in range(k):
            wrong &= bits[positions(*outside, level, j, m).astype(np.int64)]
        inside, outside = (outside[0][wrong], outside[1][wrong]), inside
    return b"".join(out)


def hashes(key: str) -> tuple[F.Column, F.Column]:
    return F.xxhash64(F.col(key)), F.xxhash64(F.lit("second"), F.col(key))


def build(universe: DataFrame, listed: DataFrame, shards: int | None = None) -> tuple[DataFrame, int]:
    """(shard, levels) and the number of shards; both inputs have one column, the keys, with repeats or without.

    Listed keys belong to the universe even if it lacks them.
    """
    flags = universe.toDF("key").withColumn("listed", F.lit(False)).unionByName(listed.toDF("key").withColumn("listed", F.lit(True)))
    keys = flags.withColumn("key", F.coalesce("key", F.lit(""))).groupBy("key").agg(F.max("listed").alias("listed"))
    if shards is None:
        many = universe.agg(F.approx_count_distinct(universe.columns[0])).first()[0]
        shards = max(int(universe.sparkSession.conf.get("spark.sql.shuffle.partitions")), many // SHARD_KEYS + 1)
    h1, h2 = hashes("key")

    def one(part: pd.DataFrame) -> pd.DataFrame:
        levels = build_levels(*(part[c].to_numpy().view(np.uint64) for c in ("h1", "h2")), part["listed"].to_numpy(bool))
        return pd.DataFrame({"shard": part["shard"].iloc[:1], "levels": [levels]})

    placed = keys.select(F.pmod(h2, F.lit(shards)).cast("int").alias("shard"), h1.alias("h1"), h2.alias("h2"), "listed")
    return placed.groupBy("shard").applyInPandas(one, "shard int, levels binary"), shards


class Filters:
    """Levels of some shards, their bits in a row; arrays have a column for each shard that is there."""

    def __init__(self, found: list[tuple[int, bytes]]):
        found = sorted(found)
        self.shards = np.array([shard for shard, _ in found], np.int64)
        self.bits = np.frombuffer(b"".join(levels for _, levels in found), np.uint8)
        self.start = np.zeros((MOST_LEVELS + 1, len(found)), np.int64)
        self.m = np.zeros((MOST_LEVELS + 1, len(found)), np.uint64)
        self.k = np.zeros((MOST_LEVELS + 1, len(found)), np.int64)
        base = 0
        for column, (_, levels) in enumerate(found):
            at = level = 0
            while at < len(levels):
                m, k = LEVEL.unpack_from(levels, at)
                at += LEVEL.size
                self.start[level, column], self.m[level, column], self.k[level, column] = base + at, m, k
                at, level = at + m // 8, level + 1
            base += len(levels)

    def listed(self, shard: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Of keys of any shards; a shard that isn't there has no listed keys."""
        out = np.zeros(len(shard), bool)
        if not len(self.shards):
            return out
        column = np.minimum(np.searchsorted(self.shards, shard), len(self.shards) - 1)
        rows, level = np.flatnonzero(self.shards[column] == shard), 0
        while len(rows):
            s, a, b = column[rows], h1[rows], h2[rows]
            hit = self.m[level, s] > 0
            for j in range(int(self.k[level, s].max(initial=0))):
                use = np.flatnonzero(hit & (j < self.k[level, s]))
                p = positions(a[use], b[use], level, j, self.m[level, s[use]]).astype(np.int64)
                hit[use] &= self.bits[self.start[level, s[use]] + (p >> 3)] >> (p & 7).astype(np.uint8) & 1 == 1
            out[rows[~hit]] = level % 2 == 1
            rows, level = rows[hit], level + 1
        return out


def judge(df: DataFrame, key: str, cascade: DataFrame, shards: int, out: str = "listed", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``df`` with boolean ``out``: whether the row's key is a listed one."""
    spark = df.sparkSession
    levels = scratch.written(cascade)
    keep = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.BooleanType())])
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = df.withColumn("__key", text).select(*keep, *(h.alias(n) for h, n in zip(hashes("__key"), ("__h1", "__h2"), strict=True))).withColumn("__shard", F.pmod("__h2", F.lit(shards)).cast("int"))
    n = len(keep)

    def answered(b: pa.RecordBatch, f: Filters) -> pa.RecordBatch:
        h1, h2 = (b.column(n + i).to_numpy().view(np.uint64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(f.listed(b.column(n + 2).to_numpy(), h1, h2))], schema.names)

    if levels.agg(F.coalesce(F.sum(F.length("levels")), F.lit(0))).first()[0] <= block_bytes:
        filters = spark.sparkContext.broadcast([(r["shard"], bytes(r["levels"])) for r in levels.collect()])

        def looked_up(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f = Filters(filters.value)
            for b in batches.slices(it, 10_000):
                yield answered(b, f)

        return rows.mapInArrow(looked_up, schema)

    def streamed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Filters([])
        for b in batches.slices(it, 10_000):
            body = b.column(n + 3)
            cuts = [*np.flatnonzero(body.is_valid().to_numpy(zero_copy_only=False)).tolist(), b.num_rows]
            yield answered(b.slice(0, cuts[0]), f)
            for a, z in zip(cuts, cuts[1:], strict=False):
                f = Filters([(b.column(n + 2)[a].as_py(), body[a].as_py())])
                yield answered(b.slice(a + 1, z - a - 1), f)

    # as many parts of a shard as it has average shards' rows
    held = scratch.written(rows.groupBy("__shard").agg(F.count("*").alias("__n")))
    mean = held.agg(F.greatest(F.lit(1), F.ceil(F.avg("__n")))).first()[0]
    parts = held.select("__shard", F.ceil(F.col("__n") / mean).cast("int").alias("__parts"))
    dealt = rows.join(joins.sized(parts), "__shard").select(*keep, "__h1", "__h2", "__shard", F.lit(None).cast("binary").alias("__levels"), F.pmod(F.monotonically_increasing_id(), "__parts").cast("int").alias("__part"))
    of_shard = levels.select(F.col("shard").alias("__shard"), "levels").join(joins.sized(parts), "__shard")
    nothing = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in keep]
    zero = F.lit(0).cast("long")
    filters_first = of_shard.select(*nothing, zero.alias("__h1"), zero.alias("__h2"), "__shard", F.col("levels").alias("__levels"), F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = dealt.unionByName(filters_first).repartition(tasks, "__shard", "__part").sortWithinPartitions("__shard", "__part", F.asc_nulls_last("__levels"))
    return both.drop("__part").mapInArrow(streamed, schema)
