"""Votes of annotators: checks, agreement, unanimity, context need, adjudication.

A vote has annotator, condition, sample_id and the judgements referent_id,
addressee_id, context_sufficient, ambiguity, naturalness_1to5 and notes, all
strings, "" where blank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import AMBIGUITY

FIELDS = ("referent_id", "addressee_id", "context_sufficient", "ambiguity", "determinable")


def with_determinable(votes: DataFrame) -> DataFrame:
    return votes.withColumn("determinable", F.when(F.coalesce("ambiguity", F.lit("")) == "", "").otherwise(F.initcap((F.col("ambiguity") == "unambiguous").cast("string"))))


def last_votes(votes: DataFrame, order: str) -> DataFrame:
    """One vote for each annotator, condition and sample: the last by ``order``."""
    body = F.struct(*(c for c in votes.columns))
    return votes.groupBy("condition", "annotator", "sample_id").agg(F.max_by(body, F.col(order)).alias("v")).select("v.*")


def annotator_pairs(votes: DataFrame) -> DataFrame:
    """Samples that two annotators share under a condition, a before b by name: condition, sample_id, a, b (structs)."""
    body = F.struct(*(c for c in votes.columns if c not in ("condition", "sample_id")))
    side = votes.select("condition", "sample_id", body.alias("v"))
    other = side.withColumnRenamed("v", "b")
    return side.withColumnRenamed("v", "a").join(other, ["condition", "sample_id"]).filter(F.col("a.annotator") < F.col("b.annotator"))


def shared_fields(votes: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """condition, pair "a~b", field, x, y for each shared sample; nulls count as blanks."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f"a.{f}"), F.lit("")).alias("x"), F.coalesce(F.col(f"b.{f}"), F.lit("")).alias("y")) for f in fields))
    name = F.concat(F.col("a.annotator"), F.lit("~"), F.col("b.annotator")).alias("pair")
    return annotator_pairs(votes).select("condition", name, F.explode(each).alias("f")).select("condition", "pair", "f.field", "f.x", "f.y")


def agreement(votes: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """For each condition, pair and field: n, n_missing, percent_agreement, cohen_kappa, kappa_note.

    Blanks on either side are missing.  Kappa is null over nothing and where the expected agreement is 1.
    """
    keys = ["condition", "pair", "field"]
    # the table of two answers is small, whatever the number of samples
    cells = shared_fields(with_determinable(votes), fields).groupBy(*keys, "x", "y").agg(F.count("*").alias("n"))
    full = cells.withColumn("ok", (F.col("x") != "") & (F.col("y") != ""))
    base = full.groupBy(*keys).agg(F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(~F.col("ok"), F.col("n")).otherwise(0)).alias("n_missing"), F.sum(F.when(F.col("ok") & (F.col("x") == F.col("y")), F.col("n")).otherwise(0)).alias("same"))
    sides = full.filter("ok").select(*keys, "n", F.explode(F.array(F.struct(F.lit("x").alias("s"), F.col("x").alias("v")), F.struct(F.lit("y").alias("s"), F.col("y").alias("v")))).alias("m"))
    both = sides.groupBy(*keys, F.col("m.v").alias("v")).agg(F.sum(F.when(F.col("m.s") == "x", F.col("n")).otherwise(0)).alias("nx"), F.sum(F.when(F.col("m.s") == "y", F.col("n")).otherwise(0)).alias("ny"))
    chance = both.groupBy(*keys).agg(F.sum(F.col("nx") * F.col("ny")).alias("e"))
    n = F.col("n").cast("double")
    observed, expected = F.col("same") / n, F.col("e") / (n * n)
    kappa = F.when((F.col("n") > 0) & (F.col("e") < F.col("n") * F.col("n")), (observed - expected) / (1 - expected))
    return base.join(chance, keys, "left").select(*keys, "n", "n_missing", F.when(F.col("n") > 0, observed).alias("percent_agreement"), kappa.alias("cohen_kappa"), F.when((F.col("n") > 0) & kappa.isNull(), "undefined: single category").alias("kappa_note"))


def naturalness(votes: DataFrame) -> DataFrame:
    """n, mean_abs_diff, within_1 of the ratings that both gave; one that isn't a whole number spoils its group."""
    x, y = (F.nullif(F.col(f"{s}.naturalness_1to5"), F.lit("")) for s in "ab")
    rated = annotator_pairs(votes).select("condition", F.concat(F.col("a.annotator"), F.lit("~"), F.col("b.annotator")).alias("pair"), x.alias("x"), y.alias("y")).filter("x is not null and y is not null")
    i, j = F.expr("try_cast(trim(x) AS INT)"), F.expr("try_cast(trim(y) AS INT)")
    diff = F.abs(i - j)
    out = rated.groupBy("condition", "pair").agg(F.count("*").alias("n"), F.bool_or(diff.isNull()).alias("bad"), F.avg(diff).alias("m"), F.avg((diff <= 1).cast("int")).alias("w"))
    return out.select("condition", "pair", "n", F.when(~F.col("bad"), F.col("m")).alias("mean_abs_diff"), F.when(~F.col("bad"), F.col("w")).alias("within_1"), F.when(F.col("bad"), "non-integer naturalness").alias("error"))


def disagreements(votes: DataFrame) -> DataFrame:
    """Shared samples whose referent or ambiguity differ."""
    a_b = annotator_pairs(votes)
    differ = ~F.col("a.referent_id").eqNullSafe(F.col("b.referent_id")) | ~F.col("a.ambiguity").eqNullSafe(F.col("b.ambiguity"))
    return a_b.filter(differ).select("condition", F.concat(F.col("a.annotator"), F.lit("~"), F.col("b.annotator")).alias("pair"), "sample_id")


def unanimous(value: Column | str) -> Column:
    """The value if all are the same; a blank is one."""
    v = F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))
    return F.when(F.min(v) == F.max(v), F.max(v))


def vote_problems(votes: DataFrame, candidates: DataFrame) -> DataFrame:
    """(annotator, sample_id, problem).  ``candidates``: sample_id and ids, one row a sample."""
    twice = votes.groupBy("annotator", "sample_id", "condition").agg(F.count("*").alias("n")).filter("n > 1").select("annotator", "sample_id", F.lit("duplicate vote").alias("problem"))
    known = votes.join(candidates.select("sample_id", "ids"), "sample_id", "left")

    def outside(field: str) -> Column:
        return F.when((F.coalesce(field, F.lit("")) != "") & ~F.array_contains("ids", F.col(field)), F.lit(f"{field} not a candidate"))

    bad = F.when((F.coalesce("ambiguity", F.lit("")) != "") & ~F.col("ambiguity").isin(*AMBIGUITY), F.lit("ambiguity invalid"))
    said = F.when(F.col("ids").isNull(), F.array(F.lit("unknown sample"))).otherwise(F.array_compact(F.array(outside("referent_id"), outside("addressee_id"), bad)))
    return twice.unionByName(known.select("annotator", "sample_id", F.explode(said).alias("problem")))


def context_need(votes: DataFrame, gold: DataFrame) -> DataFrame:
    """sample_id, context_need of samples with gold and local votes.  ``gold``: sample_id, final_gold."""
    r, a = F.coalesce("referent_id", F.lit("")), F.coalesce("ambiguity", F.lit(""))
    local = votes.filter("condition = 'local'").join(gold.filter("final_gold is not null"), "sample_id")
    seen = local.groupBy("sample_id").agg(F.bool_and((a == "unambiguous") & (r == F.col("final_gold"))).alias("local"), F.bool_and(a.isin("ambiguous", "uncertain") | (r == "")).alias("discourse"))
    return seen.select("sample_id", F.when(F.col("local"), "locally_recoverable").when(F.col("discourse"), "discourse_dependent").otherwise("conflict").alias("context_need"))


def adjudicate(samples: DataFrame, votes: DataFrame, decisions: DataFrame, min_annotators: int = 2) -> DataFrame:
    """Final labels from full votes and, where they differ, decisions.

    ``samples``: sample_id, gold_referent_id, addressee_id, ambiguity_status.
    ``decisions``: sample_id, decision, final_referent_id, final_ambiguity, final_addressee_id, one row a sample.
    Returns these with annotation_status, outcome, addressee_disputed, gold_overridden, addressee_overridden, context_need.
    """
    full = votes.filter("condition = 'full'").groupBy("sample_id").agg(
        F.count_distinct("annotator").alias("n"), unanimous("referent_id").alias("r"), unanimous("ambiguity").alias("a"), unanimous("addressee_id").alias("d"),
        F.bool_or(F.coalesce("addressee_id", F.lit("")) != "").alias("any_d"))
    blank = [F.coalesce(F.nullif(F.col(c), F.lit(""))).alias(f"d_{c}") for c in ("decision", "final_referent_id", "final_ambiguity", "final_addressee_id")]
    j = samples.join(full, "sample_id", "left").join(decisions.select("sample_id", *blank), "sample_id", "left")
    n = F.coalesce("n", F.lit(0))
    outcome = (
        F.when(n < min_annotators, "in_review")
        .when((F.col("r") != "") & (F.col("a") == "unambiguous"), "accepted_unanimous")
        .when((F.col("r") == "") & F.col("a").isin("ambiguous", "uncertain"), "rejected_unanimous_ambiguous")
        .when((F.col("d_decision") == "accept") & F.col("d_final_referent_id").isNotNull(), "accepted_adjudicated")
        .when(F.col("d_decision") == "reject", "rejected")
        .otherwise("pending")
    )
    j = j.withColumn("outcome", outcome)
    o = F.col("outcome")
    status = F.when(o.startswith("accepted"), "accepted").when(o.startswith("rejected"), "rejected").otherwise("in_review")
    gold = F.when(o == "accepted_unanimous", F.col("r")).when(o == "accepted_adjudicated", F.col("d_final_referent_id")).when(o.startswith("rejected"), F.lit(None)).otherwise(F.col("gold_referent_id"))
    told = F.coalesce("d_final_ambiguity", F.lit("ambiguous"))
    ambiguity = (
        F.when(o.startswith("accepted"), "unambiguous").when(o == "rejected_unanimous_ambiguous", F.col("a"))
        .when(o == "rejected", F.when(told == "unambiguous", "uncertain").otherwise(told)).otherwise(F.col("ambiguity_status"))
    )
    enough = n >= min_annotators
    addressee = F.when(enough & F.col("d_final_addressee_id").isNotNull(), F.col("d_final_addressee_id")).when(enough & (F.col("d") != ""), F.col("d")).otherwise(F.col("addressee_id"))
    disputed = enough & F.col("d_final_addressee_id").isNull() & F.col("d").isNull() & F.coalesce("any_d", F.lit(False))
    final = j.select("sample_id", "outcome", status.alias("annotation_status"), gold.alias("final_gold"), ambiguity.alias("final_ambiguity"), addressee.alias("final_addressee"), disputed.alias("addressee_disputed"), (~gold.eqNullSafe(F.col("gold_referent_id"))).alias("gold_overridden"), (~addressee.eqNullSafe(F.col("addressee_id"))).alias("addressee_overridden"))
    need = context_need(votes, final.filter("annotation_status = 'accepted'").select("sample_id", "final_gold"))
    return final.join(need, "sample_id", "left")
