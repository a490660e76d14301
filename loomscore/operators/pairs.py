"""Paired rows: two versions of an item, two conditions, and pairs of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import pair_sides
from .metrics import Ratio, distractor_rate, is_correct, status_columns, table

TRANSITIONS = {"both_correct": (1, 1), "correct_to_wrong": (1, 0), "wrong_to_correct": (0, 1), "both_wrong": (0, 0)}
#: The same of a base and its variant.
CONSISTENCY = {"both_correct": (1, 1), "base_correct_only": (1, 0), "variant_correct_only": (0, 1), "both_wrong": (0, 0)}


def build_pairs(rows: DataFrame, first: str, second: str, order: str, keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """One row a pair: c1, c2 (0 or 1; null if that side is missing), family_id.  Of repeated versions the last by ``order`` counts."""
    some = rows.filter(F.col("pair_id").isNotNull() & F.col("version").isin(first, second)).withColumn("hit", is_correct().cast("int"))

    def last(column: str, version: str) -> Column:
        return F.max_by(F.when(F.col("version") == version, F.col(column)), F.when(F.col("version") == version, F.col(order)))

    return some.groupBy(*keys).agg(last("hit", first).alias("c1"), last("hit", second).alias("c2"), last("family_id", first).alias("family_id"))


def complete(pairs: DataFrame) -> DataFrame:
    return pairs.filter("c1 is not null and c2 is not null")


def dropped(pairs: DataFrame) -> DataFrame:
    return pairs.filter("c1 is null or c2 is null").select("pair_id")


def pair_ratios() -> dict[str, Ratio]:
    n = F.count("*")
    return {"pair": Ratio(F.sum(F.col("c1") * F.col("c2")), n), "harm": Ratio(F.count_if((F.col("c1") == 1) & (F.col("c2") == 0)), n), "recovery": Ratio(F.count_if((F.col("c1") == 0) & (F.col("c2") == 1)), n)}


def transitions(names: dict[str, tuple[int, int]] = TRANSITIONS) -> list[Column]:
    return [F.count_if((F.col("c1") == a) & (F.col("c2") == b)).cast("long").alias(n) for n, (a, b) in names.items()]


def pair_summary(pairs: DataFrame, *keys: str, names: dict[str, tuple[int, int]] = TRANSITIONS) -> DataFrame:
    """Ratios and transitions of complete pairs."""
    ratios = [c for n, r in pair_ratios().items() for c in r.columns(n + "_")]
    return complete(pairs).groupBy(*keys).agg(*ratios, *transitions(names), F.count("*").alias("n_pairs"), (F.count_distinct("family_id") + F.coalesce(F.max(F.col("family_id").isNull().cast("int")), F.lit(0))).cast("long").alias("n_families"))


def controlled_summary(rows: DataFrame, first: str, second: str, order: str) -> dict[str, DataFrame]:
    """A controlled experiment: ``summary`` (one row: ratios, transitions, pairs, families, dropped pairs, statuses), ``dropped`` pairs, and ``distractor_by_version`` where distractors are named."""
    found = build_pairs(rows, first, second, order)
    gone = dropped(found)
    counts = gone.agg(F.count("*").alias("n_dropped")).select(F.struct("*").alias("d"))
    said = rows.agg(*status_columns()).select(F.struct("*").alias("s"))
    summary = pair_summary(found).withColumns({"d": counts.scalar(), "s": said.scalar()}).select("*", "d.*", "s.*").drop("d", "s")
    by_version = table(rows.filter("designated_distractor_id IS NOT NULL"), ["version"], distractor_rate())
    return {"summary": summary, "dropped": gone, "distractor_by_version": by_version}


def pair_consistency(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs by the ids "scenario:a~b" that rows list: c1 of the one row of version a, c2 of the one of version b.

    A pair without exactly one row on each side has null c1 and c2.
    """
    ids = F.when(F.size("pair_ids") > 0, F.col("pair_ids")).when(F.coalesce("pair_id", F.lit("")) != "", F.array("pair_id"))
    each = rows.select(*keys, "version", is_correct().cast("int").alias("hit"), F.explode(ids).alias("pair_id"))
    a, b = pair_sides("pair_id", lenient=True)
    on_a, on_b = F.col("version").eqNullSafe(a), F.col("version").eqNullSafe(b)
    sides = each.groupBy(*keys, "pair_id").agg(F.count_if(on_a).alias("na"), F.count_if(on_b).alias("nb"), F.max(F.when(on_a, F.col("hit"))).alias("ha"), F.max(F.when(on_b, F.col("hit"))).alias("hb"))
    one = (F.col("na") == 1) & (F.col("nb") == 1)
    return sides.select(*keys, "pair_id", F.when(one, F.col("ha")).alias("c1"), F.when(one, F.col("hb")).alias("c2"), F.lit(None).cast("string").alias("family_id"))


def condition_pairs(rows: DataFrame, a: str, b: str, order: str, keys: tuple[str, ...] = ("item_id",), by: str = "condition") -> DataFrame:
    """Items with both conditions and the difference of their hits."""
    some = rows.filter(F.col(by).isin(a, b)).withColumn("hit", is_correct().cast("int"))

    def last(which: str) -> Column:
        return F.max_by(F.when(F.col(by) == which, F.col("hit")), F.when(F.col(by) == which, F.col(order)))

    return some.groupBy(*keys).agg((last(a) - last(b)).alias("diff")).filter("diff is not null")


def condition_benefit(rows: DataFrame, a: str, b: str, order: str) -> DataFrame:
    """For each model, the mean difference over items with both conditions; models without such items are left out."""
    diffs = condition_pairs(rows, a, b, order, ("model_label", "item_id"))
    return diffs.groupBy("model_label").agg(F.avg("diff").alias("value"), F.sum("diff").cast("long").alias("numerator"), F.count("*").alias("denominator"))


def condition_difference(rows: DataFrame, a: str, b: str, order: str, keys: tuple[str, ...] = ("item_id",)) -> DataFrame:
    return condition_pairs(rows, a, b, order, keys).agg(F.avg("diff").alias("value"), F.sum("diff").cast("long").alias("numerator"), F.count("*").alias("denominator"))


# -- pairs of records --------------------------------------------------------

# The variables that are compared, what each manipulation may
# change, and those that say nothing while a gold referent is missing.
CONTROLLED_VARIABLES = (
    "gold_referent_id", "gold_referent_role", "speaker_id", "addressee_id", "speaker_changed", "referent_changed", "referent_role_changed",
    "turn_distance", "gold_last_mention_turn", "most_recent_mentioned_id", "distractor_present", "distractor_id", "distractor_last_mention_turn",
    "n_turns", "n_participants", "target_predicate", "anchor_turn", "anchor_referent_id", "linguistic_cues",
)
MANIPULATION_SCOPE = {
    "referent_shift": ("gold_referent_id", "gold_referent_role", "referent_changed", "referent_role_changed", "turn_distance", "gold_last_mention_turn", "most_recent_mentioned_id", "distractor_present", "distractor_id", "distractor_last_mention_turn", "anchor_turn", "anchor_referent_id"),
    "distractor": ("distractor_present", "distractor_id", "distractor_last_mention_turn", "most_recent_mentioned_id"),
    "context_distance": ("turn_distance", "gold_last_mention_turn", "n_turns", "anchor_turn", "most_recent_mentioned_id", "distractor_last_mention_turn"),
    "speaker_role": ("speaker_id", "addressee_id", "gold_referent_role", "speaker_changed", "referent_role_changed", "anchor_turn", "anchor_referent_id", "gold_referent_id", "referent_changed", "turn_distance", "gold_last_mention_turn", "most_recent_mentioned_id", "distractor_present"),
    "linguistic_cue": ("linguistic_cues", "target_predicate", "gold_last_mention_turn", "most_recent_mentioned_id", "turn_distance", "distractor_present"),
    "anchor_speaker": ("speaker_changed", "anchor_turn", "gold_last_mention_turn", "turn_distance", "most_recent_mentioned_id", "distractor_present", "distractor_last_mention_turn"),
    "anchor_entity": ("anchor_referent_id", "anchor_turn", "referent_changed", "referent_role_changed", "most_recent_mentioned_id", "distractor_present", "distractor_last_mention_turn", "turn_distance", "gold_last_mention_turn", "speaker_changed"),
}
GOLD_DEPENDENT = ("gold_referent_id", "gold_referent_role", "referent_changed", "referent_role_changed", "turn_distance", "gold_last_mention_turn", "distractor_present", "most_recent_mentioned_id", "addressee_id")


def strings(words: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def members(records: DataFrame) -> DataFrame:
    """pair_id, n, a, b: the two records of each id in ``pair_ids``, by sample_id; null a and b if there aren't two.

    ``records`` has sample_id, scenario_id, variant, pair_ids, pair_claims, pair_expected_gold_change,
    manipulated_variables, expected_gold_change, candidates (ids), target_text, turns and CONTROLLED_VARIABLES.
    Only counts, the least and the greatest record of a pair are gathered, never a list.
    """
    body = F.struct(*(F.col(c) for c in records.columns if c != "pair_ids"))
    each = records.select(F.explode("pair_ids").alias("pair_id"), F.col("sample_id").alias("sid"), body.alias("r"))
    two = each.groupBy("pair_id").agg(F.count("*").alias("n"), F.min_by("r", "sid").alias("a"), F.max_by("r", "sid").alias("b"))
    return two.select("pair_id", "n", *(F.when(F.col("n") == 2, F.col(c)).alias(c) for c in ("a", "b")))


def pair_diff(pairs: DataFrame) -> DataFrame:
    """What differs between the records of each pair of ``members``, what was claimed to differ, and what wasn't."""
    a, b = F.col("a"), F.col("b")
    pid = F.col("pair_id")
    base, name = pair_sides("pair_id")
    claims_a, claims_b = F.try_element_at(a["pair_claims"], pid), F.try_element_at(b["pair_claims"], pid)
    conflict = claims_a.isNotNull() & claims_b.isNotNull() & (F.array_sort(claims_a) != F.array_sort(claims_b))
    side = F.when(a["variant"] == name, a).when(b["variant"] == name, b)
    own = F.coalesce(claims_a, claims_b)
    claimed = F.array_sort(F.when(own.isNotNull(), own).when(side["sample_id"].isNotNull(), side["manipulated_variables"]).otherwise(F.array_union(a["manipulated_variables"], b["manipulated_variables"])))
    expected_in = F.when(F.map_contains_key(a["pair_expected_gold_change"], pid), F.try_element_at(a["pair_expected_gold_change"], pid)).when(F.map_contains_key(b["pair_expected_gold_change"], pid), F.try_element_at(b["pair_expected_gold_change"], pid))
    has_expected = F.coalesce(F.map_contains_key(a["pair_expected_gold_change"], pid), F.lit(False)) | F.coalesce(F.map_contains_key(b["pair_expected_gold_change"], pid), F.lit(False))
    expected = F.when(has_expected, expected_in).when(base == "base", side["expected_gold_change"])
    differs = F.array_compact(F.array(*(F.when(~a[v].eqNullSafe(b[v]), F.lit(v)) for v in CONTROLLED_VARIABLES)))
    scope = F.create_map(*(x for k, v in MANIPULATION_SCOPE.items() for x in (F.lit(k), strings(v))))
    allowed = F.flatten(F.transform(F.col("claimed"), lambda c: F.coalesce(F.try_element_at(scope, c), F.array().cast("array<string>"))))
    gold_missing = a["gold_referent_id"].isNull() | b["gold_referent_id"].isNull()
    observed = F.when(~gold_missing, a["gold_referent_id"] != b["gold_referent_id"])
    turns = F.array_union(F.map_keys(a["turns"]), F.map_keys(b["turns"]))
    found = pairs.filter("n = 2").select("pair_id", "a", "b", conflict.alias("conflict"), claimed.alias("claimed"), differs.alias("differs"), expected.alias("expected_gold_change"), observed.alias("observed_gold_change"), gold_missing.alias("gold_missing"))
    unclaimed = F.array_sort(F.filter(F.array_except("differs", allowed), lambda v: ~(F.col("gold_missing") & F.array_contains(strings(GOLD_DEPENDENT), v))))
    same_cands = F.array_sort(a["candidates"]) == F.array_sort(b["candidates"])
    same_target = a["target_text"].eqNullSafe(b["target_text"])
    structural = same_cands & (same_target | F.array_contains("claimed", "linguistic_cue"))
    return found.select(
        "pair_id", a["scenario_id"].alias("scenario_id"), a["sample_id"].alias("a_id"), b["sample_id"].alias("b_id"), "conflict", F.col("claimed").alias("claimed_manipulations"),
        F.col("differs").alias("differing_variables"),
        F.array_sort(F.filter(turns, lambda t: ~F.try_element_at(a["turns"], t).eqNullSafe(F.try_element_at(b["turns"], t)))).alias("differing_turns"),
        same_target.alias("same_target_utterance"), same_cands.alias("same_candidate_set"), structural.alias("structural_conditions_met"), "expected_gold_change", "observed_gold_change",
        F.coalesce(F.col("expected_gold_change") == F.col("observed_gold_change"), F.lit(True)).alias("gold_change_matches_expectation"), unclaimed.alias("unclaimed_differences"), (~F.col("gold_missing")).alias("evaluable"),
        ((F.size(unclaimed) == 0) & (F.size("claimed") == 1) & structural).alias("is_single_variable_pair"), (a["scenario_id"] != b["scenario_id"]).alias("spans_scenarios"),
    )


def manifest(diffs: DataFrame) -> DataFrame:
    """The pairs of ``pair_diff`` that a manifest lists: those with conflicting claims are problems only."""
    return diffs.filter(~F.coalesce("conflict", F.lit(False)))


def pair_problems(pairs: DataFrame, diffs: DataFrame) -> DataFrame:
    """(pair_id, problem): sizes other than two, pairs across scenarios, conflicting claims, unexpected gold changes."""
    size = pairs.filter("n <> 2").select("pair_id", F.concat(F.lit("pair "), "pair_id", F.lit(" has "), F.col("n").cast("string"), F.lit(" members")).alias("problem"))
    said = F.array_compact(
        F.array(
            F.when(F.col("spans_scenarios"), F.concat(F.lit("pair "), "pair_id", F.lit(" spans scenarios"))),
            F.when(F.col("conflict"), F.concat(F.lit("pair "), "pair_id", F.lit(": conflicting pair_claims"))),
            F.when(~F.col("conflict") & ~F.col("gold_change_matches_expectation"), F.concat(F.lit("pair "), "pair_id", F.lit(": expected_gold_change="), F.col("expected_gold_change").cast("string"), F.lit(" but observed "), F.col("observed_gold_change").cast("string"))),
        )
    )
    return size.unionByName(diffs.select("pair_id", F.explode(said).alias("problem")))
