"""Ratio metrics over scored rows, grouped tables, confusion counts and summaries.

A scored row has item_id, conversation_id, condition, model_label,
gold_entity_id, predicted_entity_id, parse_status, and further columns as each
metric names them.  A ratio is three columns: value (null over nothing),
numerator and denominator.  Everything is one aggregation with partial sums.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import label_of, label_of_boolean

# The states of a parsed answer.
STATUSES = ("ok", "invalid", "abstain", "missing", "unmapped")


def is_ok() -> Column:
    return F.col("parse_status").eqNullSafe(F.lit("ok"))


def is_correct() -> Column:
    return is_ok() & F.col("predicted_entity_id").eqNullSafe(F.col("gold_entity_id"))


def role_of(entity: str) -> Column:
    """Role of the entity in the row's map; null if there is none."""
    return F.when(F.col(entity).isNotNull(), F.try_element_at("entity_roles", F.col(entity)))


def count_if(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


class Ratio:
    """Two aggregates over rows; ``columns`` gives value, numerator and denominator."""

    def __init__(self, numerator: Column, denominator: Column, value: Column | None = None):
        self.numerator, self.denominator = numerator.cast("long"), denominator.cast("long")
        self.value = F.try_divide(self.numerator.cast("double"), self.denominator.cast("double")) if value is None else value

    def columns(self, prefix: str = "") -> list[Column]:
        return [self.value.alias(prefix + "value"), self.numerator.alias(prefix + "numerator"), self.denominator.alias(prefix + "denominator")]


def entity_accuracy() -> Ratio:
    return Ratio(count_if(is_correct()), F.count("*"))


def role_accuracy() -> Ratio:
    return Ratio(count_if(is_ok() & (role_of("gold_entity_id") == role_of("predicted_entity_id"))), F.count("*"))


def same_role_wrong_entity() -> Ratio:
    return Ratio(count_if(is_ok() & ~is_correct() & (role_of("gold_entity_id") == role_of("predicted_entity_id"))), F.count("*"))


def distractor_rate(key: str = "designated_distractor_id") -> Ratio:
    return Ratio(count_if(is_ok() & (F.nullif(F.col(key), F.lit("")) == F.col("predicted_entity_id"))), F.count("*"))


def distractor_error_rate() -> Ratio:
    target = F.coalesce(F.nullif("designated_distractor_id", F.lit("")), F.nullif("most_recent_mentioned_id", F.lit("")))
    present = F.coalesce("distractor_present", F.lit(False))
    hit = present & is_ok() & (F.col("predicted_entity_id") == target) & ~target.eqNullSafe(F.col("gold_entity_id"))
    return Ratio(count_if(hit), count_if(present))


def chance_level() -> Ratio:
    n = F.size("candidates")
    some = F.count(F.when(n > 0, 1))
    return Ratio(some, some, F.avg(F.when(n > 0, 1 / n)))


def mapping_failure_rate() -> Ratio:
    return Ratio(count_if(~is_ok()), F.count("*"))


def status_columns() -> list[Column]:
    """Rows of each known status, none left out."""
    return [count_if(F.col("parse_status") == s).cast("long").alias(s) for s in STATUSES]


def table(rows: DataFrame, keys: Sequence[str], ratio: Ratio, prefix: str = "") -> DataFrame:
    return rows.groupBy(*keys).agg(*ratio.columns(prefix))


def metric_table(rows: DataFrame, group: Column, ratio: Ratio, name: str = "grp") -> DataFrame:
    """One row for each value of ``group``, nulls as "None"."""
    return rows.groupBy(label_of(group).alias(name)).agg(*ratio.columns())


def confusion(rows: DataFrame, gold: Column, predicted: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of gold by prediction; rows that aren't ok stand under their status."""
    seen = F.when(is_ok(), label_of(predicted)).otherwise(label_of(F.col("parse_status")))
    return rows.groupBy(*keys, label_of(gold).alias("gold"), seen.alias("predicted")).agg(F.count("*").alias("n"))


def cues(column: str = "linguistic_cues", name: str = "cue") -> Column:
    """A row for each cue, "none" for rows without."""
    c = F.col(column)
    return F.explode(F.when(F.size(c) > 0, c).otherwise(F.array(F.lit("none")))).alias(name)


def distinct_with_null(column: str) -> Column:
    """Different values, null among them."""
    return (F.count_distinct(F.col(column)) + F.max(F.col(column).isNull().cast("int"))).cast("long")


def by_dimensions(rows: DataFrame, keys: Sequence[str], dimensions: Mapping[str, Column]) -> DataFrame:
    """Accuracy by each value of each dimension, in one pass: a row is counted once in every dimension."""
    each = F.array(*(F.struct(F.lit(d).alias("dimension"), label_of(c).alias("level")) for d, c in dimensions.items()))
    correct = rows.select(*keys, is_correct().cast("int").alias("hit"), F.explode(each).alias("d"))
    return correct.groupBy(*keys, "d.dimension", "d.level").agg(F.try_divide(F.sum("hit").cast("double"), F.count("*")).alias("value"), F.sum("hit").cast("long").alias("numerator"), F.count("*").alias("denominator"))


# A summary's tables and the columns that they group by.
TABLES = {
    "by_referent_changed": "referent_changed", "by_speaker_changed": "speaker_changed", "by_role_changed": "referent_role_changed", "by_distractor_present": "distractor_present", "by_turn_distance": "turn_distance", "by_dataset": "dataset", "by_creation_method": "creation_method", "by_context_need": "context_need",
}


def benchmark_tables(rows: DataFrame) -> DataFrame:
    """All accuracy tables of a benchmark's summary in one pass: model_label, condition, dimension, level, value, numerator, denominator.

    A row counts once in each table, and in by_linguistic_cue once for each of its cues ("none" without).
    """
    of = dict(rows.dtypes)
    level = {d: label_of_boolean(F.col(c)) if of[c] == "boolean" else label_of(F.col(c)) for d, c in TABLES.items() if c in of}
    level["by_referent_type"] = label_of(F.col("gold_role") if "gold_role" in of else role_of("gold_entity_id"))
    single = F.array(*(F.struct(F.lit(d).alias("dimension"), c.alias("level")) for d, c in level.items()))
    own = F.when(F.size("linguistic_cues") > 0, F.col("linguistic_cues")).otherwise(F.array(F.lit("none")))
    each = F.concat(single, F.transform(own, lambda c: F.struct(F.lit("by_linguistic_cue").alias("dimension"), c.alias("level"))))
    keys = ["model_label", "condition"]
    hit = rows.select(*keys, is_correct().cast("int").alias("hit"), F.explode(each).alias("d"))
    return hit.groupBy(*keys, "d.dimension", "d.level").agg(F.try_divide(F.sum("hit").cast("double"), F.count("*")).alias("value"), F.sum("hit").cast("long").alias("numerator"), F.count("*").alias("denominator"))


def benchmark_summary(rows: DataFrame) -> DataFrame:
    """One row for each model and condition: overall ratios, statuses and counts."""
    keys = ["model_label", "condition"]
    out = rows.groupBy(*keys).agg(
        *entity_accuracy().columns("accuracy_"), *role_accuracy().columns("role_"), *chance_level().columns("chance_"), *distractor_error_rate().columns("distractor_error_"),
        *status_columns(), F.count("*").alias("n_rows"), distinct_with_null("conversation_id").alias("n_clusters"),
    )
    open_answer = F.col("condition").contains("qa")
    return out.withColumns({f"chance_{c}": F.when(~open_answer, F.col(f"chance_{c}")) for c in ("value", "numerator", "denominator")})


def cost(rows: DataFrame, keys: Sequence[str], input_price: float | None, output_price: float | None) -> DataFrame:
    """Tokens and their price per million; no price, no cost."""
    i, o = (F.sum(F.coalesce(c, F.lit(0))).cast("long") for c in ("input_tokens", "output_tokens"))
    price = F.lit(None).cast("double") if input_price is None or output_price is None else (i * input_price + o * output_price) / 1_000_000
    return rows.groupBy(*keys).agg(i.alias("input_tokens"), o.alias("output_tokens"), F.count("input_tokens").alias("n_with_usage"), price.alias("cost"))


def majority_role(rows: DataFrame) -> DataFrame:
    """The most frequent gold role; of equal ones the first by name."""
    counts = rows.select(role_of("gold_entity_id").alias("role")).filter("role is not null").groupBy("role").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "role").limit(1)


def natural_tables(rows: DataFrame) -> DataFrame:
    """by_role and by_candidate_count: dimension, level and accuracy."""
    return by_dimensions(rows, [], {"by_role": role_of("gold_entity_id"), "by_candidate_count": F.coalesce(F.size("candidates"), F.lit(0))})


def natural_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy().agg(*entity_accuracy().columns("accuracy_"), *role_accuracy().columns("role_"), *same_role_wrong_entity().columns("same_role_"), *chance_level().columns("chance_"), *status_columns(), distinct_with_null("conversation_id").alias("n_conversations"))


Metric = Callable[[], Ratio]
