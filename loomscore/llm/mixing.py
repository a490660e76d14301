"""Mixing sources to target weights by a temperature, with DataFrame functions only.

A source's weight is its share of the tokens to the power of an exponent,
normalised.  The exponent, from 0 (all sources alike) to 1 (as they are), is
found by bisection: the largest at which the weights' entropy reaches
``ENTROPY`` of that of equal weights, but none so small that a source would be
repeated more than ``REPEATS`` times.  The budget is the least at which every
source is used up once, or a number of tokens that is given.

A source's share of the budget is realised as whole passes over its blocks,
each pass a keyed permutation of them, and a last pass that ends where the
share is met, inside one block at a document.  Within a block documents have a
keyed order in each pass too, so every copy has its place: pass, rank of the
block, place in the block.  Blocks hold about ``BLOCK_TOKENS`` tokens; documents
fall into them by a hash, so a source with a large part of all rows is spread
evenly.  A permutation orders blocks by their keyed hash; ranks and sums come
from the hash's ``PREFIX`` leading hexadecimal digits first and then within
each prefix, so no window spans a source's blocks.  Exponents are found from
sums over the sources, never from a list of them.

Tokens are words, runs without ASCII white space.  A null text has none; a
null source is a source of its own; sources without tokens have weight 0 and
their documents come once.  Rows of one id and source share their place and
are repeated alike; null ids count as one id.  Columns with the names of
results are replaced; texts are counted whole whatever their length; empty
tables give no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import joins, scratch

ENTROPY, REPEATS, BLOCK_TOKENS, STEPS = 0.95, 2.0, 65_536, 40
#: Hexadecimal digits by which a permutation's ranks are split; bisection steps that one scan of the sources' shares answers.
PREFIX, TOGETHER = 3, 5
WORD = r"[^ \t-\r]+"
NONE = "(none)"


def n_tokens(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def drawn(*parts: str | F.Column) -> F.Column:
    """A keyed hash that orders rows the same way everywhere."""
    return F.md5(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p for p in parts)))


def in_block(doc_id: F.Column, blocks: F.Column, seed: str) -> F.Column:
    return F.pmod(F.conv(F.substring(drawn(seed, F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long"), blocks)


def by_repeats(spread: float, repeats: float) -> float:
    """The smallest exponent, of STEPS halvings, at which the smallest share is repeated ``repeats`` times at most; ``spread``: largest over smallest share."""
    if spread <= repeats:
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (mid, high) if spread ** (1 - mid) > repeats else (low, mid)
    return high


def by_entropy(shares: DataFrame, entropy: float) -> float:
    """The largest exponent, of STEPS halvings, at which the entropy of the weights from ``p`` reaches ``entropy`` of that of equal weights.

    A scan sums for all midpoints that the next TOGETHER halvings can meet.
    """

    def enough(s: float, t: float, x: float, n: int) -> bool:
        return math.log(s) - x * t / s >= entropy * math.log(n)

    def sums(at: list[float]) -> tuple[int, list[tuple[float, float]]]:
        powers = [F.pow("p", F.lit(x)) for x in at]
        row = shares.agg(F.count("*").alias("n"), *(F.sum(w) for w in powers), *(F.sum(w * F.log("p")) for w in powers)).first()
        return row[0], list(zip(row[1 : 1 + len(at)], row[1 + len(at) :], strict=True))

    low, high, done = 0.0, 1.0, 0
    n, ((s, t),) = sums([1.0])
    if enough(s, t, 1.0, n):
        return 1.0
    while done < STEPS:
        steps = min(TOGETHER, STEPS - done)
        at = [low + (high - low) * k / 2**steps for k in range(1, 2**steps)]
        _, found = sums(at)
        a, b = 0, 2**steps
        while b - a > 1:
            k = (a + b) // 2
            a, b = (k, b) if enough(*found[k - 1], at[k - 1], n) else (a, k)
        low, high, done = low + (high - low) * a / 2**steps, low + (high - low) * b / 2**steps, done + steps
    return low


@dataclass
class Mix:
    """What realises the weights: one row a source, one for each pass of a block, and the documents of the block in which a last pass ends."""

    sources: DataFrame  # source, weight, quota, passes, blocks
    blocks: DataFrame  # source, block, pass, block_rank
    ends: DataFrame  # source, doc_id, ends_in (whether the last pass has it)
    seed: str


def ranked(rows: DataFrame, order: F.Column, amount: str, seed_columns: list[str]) -> DataFrame:
    """``rows`` with block_rank and ``before`` (``amount`` of the rows in front) in the order of hash ``order``, for each of ``seed_columns``."""
    rows = scratch.written(rows.withColumns({"__order": order, "__prefix": F.substring(order, 1, PREFIX)}))
    of_prefix = rows.groupBy(*seed_columns, "__prefix").agg(F.count("*").alias("__rows"), F.sum(amount).alias("__amount"))
    front = W.partitionBy(*seed_columns).orderBy("__prefix").rowsBetween(W.unboundedPreceding, -1)  # 16 ** PREFIX rows at most
    of_prefix = of_prefix.select(*seed_columns, "__prefix", F.coalesce(F.sum("__rows").over(front), F.lit(0)).alias("__rows"), F.coalesce(F.sum("__amount").over(front), F.lit(0)).alias("__amount"))
    inside = W.partitionBy(*seed_columns, "__prefix").orderBy("__order", "block").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"__r": F.coalesce(F.count("*").over(inside), F.lit(0)), "__b": F.coalesce(F.sum(amount).over(inside), F.lit(0))})
    rows = rows.join(joins.sized(of_prefix), [*seed_columns, "__prefix"])
    return rows.withColumns({"block_rank": F.col("__r") + F.col("__rows") + 1, "before": F.col("__b") + F.col("__amount")}).drop("__order", "__prefix", "__r", "__b", "__rows", "__amount")


def fit(df: DataFrame, budget: int | None = None, entropy: float = ENTROPY, repeats: float = REPEATS, seed: str = "mix", doc_id: str = "doc_id", source: str = "source", text: str = "text") -> Mix:
    docs = scratch.written(df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source), F.lit(NONE)).alias("source"), n_tokens(text).alias("n")))
    totals = scratch.written(docs.groupBy("source").agg(F.sum("n").alias("t")))
    some = totals.filter("t > 0")
    all_tokens, top, least = some.agg(F.sum("t"), F.max("t"), F.min("t")).first()
    x, z = 1.0, 1.0
    if all_tokens:
        shares = some.select((F.col("t") / F.lit(all_tokens)).alias("p"))
        x = max(by_entropy(shares, entropy), by_repeats((top / all_tokens) / (least / all_tokens), repeats))
        z = shares.agg(F.sum(F.pow("p", F.lit(x)))).first()[0]
    weight = F.when(F.col("t") > 0, F.round(F.pow(F.col("t") / F.lit(all_tokens), F.lit(x)) / F.lit(z), 9)).otherwise(0.0)
    tokens = F.lit(float(budget)) if budget is not None else F.ceil(F.lit(top) / F.round(F.pow(F.lit(top) / F.lit(all_tokens), F.lit(x)) / F.lit(z), 9))
    weighed = totals.withColumns({"weight": weight, "tokens": tokens})
    quota = F.when(F.col("t") > 0, F.floor(F.col("weight") * F.col("tokens"))).otherwise(0).cast("long")
    quota = quota if budget is not None else F.greatest(quota, F.col("t"))
    sources = scratch.written(
        weighed.withColumn("quota", quota)
        .withColumn("passes", F.when(F.col("t") > 0, F.floor(F.col("quota") / F.col("t"))).otherwise(1).cast("long"))
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("t") / BLOCK_TOKENS)).cast("long"))
        .select("source", "t", "weight", "quota", "passes", "blocks")
    )
    placed = docs.join(joins.sized(sources.select("source", "quota", "passes", "t", "blocks")), "source").withColumn("block", in_block(F.col("doc_id"), F.col("blocks"), seed))
    per_block = placed.groupBy("source", "block").agg(F.sum("n").alias("n"), F.first("passes").alias("passes"), (F.first("quota") - F.first("passes") * F.first("t")).alias("rest"))
    per_pass = per_block.withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("passes") + F.when(F.col("rest") > 0, 1).otherwise(0))))
    order = drawn(seed, F.col("pass"), F.col("source"), F.col("block"))
    every = ranked(per_pass, order, "n", ["source", "pass"])
    last = F.col("pass") > F.col("passes")
    blocks = scratch.written(every.filter(~last | (F.col("before") < F.col("rest"))).withColumn("ends", last & (F.col("before") + F.col("n") > F.col("rest"))))
    at_end = placed.select("source", "block", "doc_id", "n").join(joins.sized(blocks.filter("ends").select("source", "block", "passes", "rest", "before")), ["source", "block"])
    at_end = at_end.groupBy("source", "doc_id").agg(F.sum("n").alias("n"), F.first("passes").alias("passes"), F.first(F.col("rest") - F.col("before")).alias("rest"))
    order = W.partitionBy("source").orderBy(in_pass(F.col("passes") + 1, F.col("doc_id"), seed), "doc_id")  # of one block of each source
    ends = at_end.withColumn("ends_in", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("n") < F.col("rest")).filter("ends_in").select("source", "doc_id", "ends_in")
    return Mix(sources, blocks.select("source", "block", "pass", "block_rank", "ends"), scratch.written(ends), seed)


def in_pass(number: F.Column, doc_id: F.Column, seed: str) -> F.Column:
    """The hash that orders a block's documents in a pass."""
    return drawn(seed, number, F.coalesce(doc_id.cast("string"), F.lit("")))


ADDED = ("weight", "block", "passes", "copies")


def apply(df: DataFrame, mix: Mix, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``df`` with weight, block, passes (array of (pass, block_rank), one for each copy) and copies (how often the mix has the row)."""
    keep = [c for c in df.columns if c not in ADDED]
    rows = df.select(*keep).withColumns({"__source": F.coalesce(F.col(source), F.lit(NONE)), "__doc": F.col(doc_id)})
    rows = rows.join(joins.sized(mix.sources.select(F.col("source").alias("__source"), "weight", "blocks")), "__source")
    rows = rows.withColumn("block", in_block(F.col("__doc"), F.col("blocks"), mix.seed))
    a_pass = F.struct(F.col("pass").cast("int").alias("pass"), "block_rank")
    of_block = mix.blocks.groupBy(F.col("source").alias("__source"), "block").agg(  # a pass each
        F.array_sort(F.collect_list(F.when(~F.col("ends"), a_pass))).alias("__all"), F.max(F.when(F.col("ends"), a_pass)).alias("__end")
    )
    rows = rows.join(joins.sized(scratch.written(of_block)), ["__source", "block"], "left")
    ends = joins.sized(mix.ends.select(F.col("source").alias("__s"), F.col("doc_id").alias("__d"), "ends_in"))
    rows = rows.join(ends, (F.col("__source") == F.col("__s")) & F.col("__doc").eqNullSafe(F.col("__d")), "left")
    whole = F.coalesce("__all", F.array().cast("array<struct<pass:int,block_rank:bigint>>"))
    passes = F.when(F.coalesce("ends_in", F.lit(False)) & F.col("__end").isNotNull(), F.array_append(whole, F.col("__end"))).otherwise(whole)
    return rows.select(*keep, "weight", "block", passes.alias("passes"), F.size(passes).cast("long").alias("copies"))


def copies(df: DataFrame) -> DataFrame:
    """A row of ``apply`` for each of its copies, with pass and block_rank in place of passes."""
    keep = [c for c in df.columns if c not in ("passes", "copies", "pass", "block_rank")]
    return df.withColumn("__p", F.explode("passes")).select(*keep, "__p.pass", "__p.block_rank")


def realised(df: DataFrame, mix: Mix, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The copies of a result of ``apply`` with their place (in the block in that pass, from 1).

    Ordered by source, pass, block_rank and place, rows are the mix in the
    order in which to read it.  Rows of one id and source share their place.
    """
    rows = copies(df.drop("place")).withColumns({"__source": F.coalesce(F.col(source), F.lit(NONE)), "__doc": F.col(doc_id)})
    ids = rows.select("__source", "pass", "block", "__doc").distinct()
    order = W.partitionBy("__source", "pass", "block").orderBy(in_pass(F.col("pass"), F.col("__doc"), mix.seed), "__doc")
    places = ids.withColumn("place", F.row_number().over(order).cast("long")).select(F.col("__source").alias("__s"), F.col("pass").alias("__n"), F.col("__doc").alias("__d"), "place")
    same = (F.col("__source") == F.col("__s")) & (F.col("pass") == F.col("__n")) & F.col("__doc").eqNullSafe(F.col("__d"))
    return rows.join(joins.sized(scratch.written(places)), same).drop("__source", "__doc", "__s", "__n", "__d")
