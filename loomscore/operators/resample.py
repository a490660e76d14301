"""Cluster bootstrap by weights: how often each cluster is drawn, counted where its sums lie.

A resample needs a statistic's sums in each cluster, times the number of its
draws.  The copies of a cluster that is drawn more than once are kept apart:
what pairs rows does so within a copy, so sums are taken cluster by cluster
and multiplied, which holds for pairs of items or conditions as for plain
rows.

Clusters are dealt into parts by hash (one part up to ``WHOLE`` clusters, else
4096).  How many of a replicate's draws fall into a part comes from a seeded
tree of binomial draws over the parts' sizes, which each task goes down by
itself to its own part; inside a part draws are hashes of (seed, replicate,
part, draw).  So no draw is ever a row: a task holds one part's sums, its
counts as a matrix of a bounded size, and hands on one row a replicate.  All
sums are whole numbers, so no order of summing changes a result.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import is_correct
from .pairs import complete, condition_pairs, pair_consistency

#: Clusters that are one part.
WHOLE = 4096
#: Draws, or entries of the matrix of counts, that a task holds at a time.
HELD = 1 << 22

Prepare = Callable[[DataFrame, tuple[str, ...]], DataFrame]


def ratio(numerator: str, denominator: str) -> Column:
    return F.try_divide(F.col(numerator).cast("double"), F.col(denominator).cast("double"))


class Statistic:
    """What a resample's value is made of.

    ``prepare`` turns rows into those that the sums are over, without joining
    rows of different values of the columns that it is given (by default all
    rows stay as they are).  ``sums`` are whole numbers, ``value`` a column of
    total sums.  With ``by``, sums are kept for each value of these columns,
    and ``fold`` aggregates the groups' values ``v`` to the statistic's.
    """

    def __init__(self, sums: Mapping[str, Column], value: Column, prepare: Prepare | None = None, by: Sequence[str] = (), fold: Column | None = None):
        if bool(by) != (fold is not None):
            raise ValueError("by and fold go together")
        self.sums, self.value, self.prepare, self.by, self.fold = dict(sums), value, prepare or (lambda rows, keys: rows), tuple(by), fold

    def summed(self, rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
        return self.prepare(rows, keys).groupBy(*keys, *self.by).agg(*(F.coalesce(c.cast("long"), F.lit(0)).alias(n) for n, c in self.sums.items()))

    def of(self, totals: DataFrame, *keys: str) -> DataFrame:
        """``v`` of total sums for each value of ``keys``."""
        each = totals.select(*keys, self.value.alias("v"))
        return each.groupBy(*keys).agg(self.fold.alias("v")) if self.by else each


def accuracy() -> Statistic:
    return Statistic({"hits": F.sum(is_correct().cast("long")), "all_rows": F.count("*")}, ratio("hits", "all_rows"))


def macro_accuracy(by: str) -> Statistic:
    """Mean of the accuracies of the groups of ``by`` that a resample holds."""
    return Statistic({"hits": F.sum(is_correct().cast("long")), "all_rows": F.count("*")}, ratio("hits", "all_rows"), by=(by,), fold=F.avg("v"))


def difference(a: str, b: str, by: str = "condition") -> Statistic:
    """Accuracy under a less that under b; undefined where either has no rows."""
    on = {"a": F.col(by) == a, "b": F.col(by) == b}
    sums = {f"{k}_{n}": F.sum(F.when(c, v)) for k, c in on.items() for n, v in (("hits", is_correct().cast("long")), ("rows", F.lit(1).cast("long")))}
    return Statistic(sums, ratio("a_hits", "a_rows") - ratio("b_hits", "b_rows"))


def model_difference(a: str, b: str) -> Statistic:
    return difference(a, b, by="model_label")


def mean(column: str) -> Statistic:
    return Statistic({"total": F.sum(F.col(column).cast("long")), "n": F.count(column)}, ratio("total", "n"))


def paired_items(a: str, b: str, order: str) -> Statistic:
    """Mean difference between two conditions over the items with both; of a copy's rows of an item the last by ``order`` counts."""
    return Statistic({"total": F.sum("diff"), "n": F.count("diff")}, ratio("total", "n"), lambda rows, keys: condition_pairs(rows, a, b, order, ("item_id", *keys)))


def consistency() -> Statistic:
    """Share of complete pairs of which both sides are right."""
    return Statistic({"both": F.sum(F.col("c1") * F.col("c2")), "n": F.count("*")}, ratio("both", "n"), lambda rows, keys: complete(pair_consistency(rows, keys)))


def percentile(values: Column, q: float) -> Column:
    """With linear interpolation at q (n - 1)."""
    return F.percentile(values, F.lit(q))


# -- draws -------------------------------------------------------------------

LOW = np.uint64(0xFFFFFFFF)


def stirred(x: np.ndarray) -> np.ndarray:
    """32 mixed bits of 32 (shifts and two odd factors)."""
    x = (x ^ (x >> np.uint64(16))) * np.uint64(0x85EBCA6B) & LOW
    x = (x ^ (x >> np.uint64(13))) * np.uint64(0xC2B2AE35) & LOW
    return x ^ (x >> np.uint64(16))


def share(sizes: Sequence[int], part: int, n_boot: int, seed: int) -> np.ndarray:
    """Draws of each replicate that fall into ``part``, of as many as all ``sizes`` together."""
    low, high = 0, len(sizes)
    left = np.full(n_boot, sum(sizes), np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        first, second = sum(sizes[low:middle]), sum(sizes[middle:high])
        # a node's own stream, so that every task that passes it draws the same
        split = np.random.Generator(np.random.Philox(key=[seed, low * (len(sizes) + 1) + high])).binomial(left, first / max(1, first + second))
        low, high, left = (low, middle, split) if part < middle else (middle, high, left - split)
    return left


def counts(m: int, draws: np.ndarray, part: int, seed: int, first: int = 0) -> np.ndarray:
    """How often each of ``m`` clusters is drawn in each replicate from ``first`` on, ``draws`` times in all."""
    boot = np.repeat(np.arange(len(draws)), draws)
    nth = (np.arange(len(boot)) - np.repeat(np.cumsum(draws) - draws, draws)).astype(np.uint64)
    h = stirred((np.uint64(seed & 0xFFFFFFFF) + (boot + first).astype(np.uint64) * np.uint64(0x9E3779B1)) & LOW)
    h = stirred((h + np.uint64(part * 0x85EBCA77 & 0xFFFFFFFF)) & LOW)
    h = stirred((h + nth * np.uint64(0xC2B2AE3D)) & LOW)
    return np.bincount(boot * m + (h * np.uint64(m) >> np.uint64(32)).astype(np.int64), minlength=len(draws) * m).reshape(-1, m)


def replicates(sums: DataFrame, statistic: Statistic, sizes: Sequence[int], n_boot: int, seed: int) -> DataFrame:
    """(boot, by, sums): of each replicate in each part of ``sums`` (__p, __c, by, sums, __base)."""
    by, names = list(statistic.by), list(statistic.sums)
    sizes = list(sizes)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        which = int(part["__p"].iloc[0])
        clusters, at = np.unique(part["__c"].to_numpy(), return_inverse=True)
        m, draws = len(clusters), share(sizes, which, n_boot, seed)
        real = (part["__base"] == 0).to_numpy()
        rows, at = part[real], at[real]
        group = rows.groupby(by, dropna=False, sort=False).ngroup().to_numpy() if by else np.zeros(len(rows), np.int64)
        out = []
        for k in range(int(group.max(initial=0)) + 1):
            mine = group == k
            values = np.zeros((m, len(names)), np.int64)
            np.add.at(values, at[mine], rows[names].to_numpy(np.int64)[mine])
            total, step = [], max(1, HELD // max(m, int(draws.max(initial=1))))
            for a in range(0, n_boot, step):
                total.append(counts(m, draws[a : a + step], which, seed, a) @ values)
            found = pd.DataFrame(np.concatenate(total), columns=names)
            found.insert(0, "boot", np.arange(n_boot))
            for b in by:
                found[b] = pd.Series([rows[b][mine].iloc[0] if mine.any() else None] * n_boot, dtype=object)
            out.append(found)
        return pd.concat(out)[["boot", *by, *names]]

    schema = ", ".join(["boot long", *(f"`{b}` {sums.schema[b].dataType.simpleString()}" for b in by), *(f"`{n}` long" for n in names)])
    each = sums.groupBy("__p").applyInPandas(run, schema)
    return each.groupBy("boot", *by).agg(*(F.sum(n).alias(n) for n in names))


def bootstrap(rows: DataFrame, cluster: str, statistic: Statistic, n_boot: int = 2000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """One row: point, ci_low, ci_high, n_rows, n_clusters, n_boot, n_undefined.

    As many clusters as there are get drawn, with replacement, ``n_boot`` times.
    A null cluster is a cluster.  Without rows all values are null and counts 0.
    """
    own = rows.withColumn("__c", F.coalesce(F.col(cluster).cast("string"), F.lit("None")))
    digits = F.conv(F.substring(F.md5("__c"), 1, 3), 16, 10).cast("int")
    base = own.groupBy("__c").agg(F.count("*").alias("__base"))
    held = {r["p"]: r for r in base.groupBy(digits.alias("p")).agg(F.count("*").alias("n"), F.sum("__base").alias("rows")).collect()}  # at most 4096
    n, n_rows = (sum(r[k] for r in held.values()) for k in ("n", "rows"))
    whole = n <= WHOLE
    sizes = [n] if whole else [held[p]["n"] if p in held else 0 for p in range(4096)]
    zero = [F.lit(0).cast("long").alias(c) for c in statistic.sums]
    sums = statistic.summed(own, ("__c",)).withColumn("__base", F.lit(0).cast("long"))
    both = sums.unionByName(base.select("__c", "__base", *zero), allowMissingColumns=True)
    drawn = replicates(both.withColumn("__p", F.lit(0) if whole else digits), statistic, sizes, n_boot, seed)
    ends = [percentile(F.col("v"), q).alias(c) for c, q in (("ci_low", alpha / 2), ("ci_high", 1 - alpha / 2))]
    found = statistic.of(drawn, *(("boot",) if statistic.by else ())).agg(*ends, F.count("*").alias("n_boot"), F.count_if(F.col("v").isNull()).alias("n_undefined"))
    point = statistic.of(statistic.summed(rows)).select("v").scalar()
    return found.select(point.alias("point"), "ci_low", "ci_high", F.lit(n_rows).cast("long").alias("n_rows"), F.lit(n).cast("long").alias("n_clusters"), "n_boot", "n_undefined")
