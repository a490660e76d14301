"""Ratio metrics, pairs and resampling on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from loomscore.operators import metrics, pairs, resample

SCHEMA = "item_id string, condition string, model_label string, conversation_id string, gold_entity_id string, predicted_entity_id string, parse_status string, entity_roles map<string,string>, candidates array<string>, pair_id string, version string, family_id string, ord long"


def rows(spark, *given):
    base = {"item_id": "i", "condition": "c", "model_label": "m", "conversation_id": "v", "gold_entity_id": "e1", "predicted_entity_id": "e1", "parse_status": "ok", "entity_roles": {}, "candidates": None, "pair_id": None, "version": None, "family_id": None, "ord": 0}
    return spark.createDataFrame([tuple((base | g)[k] for k in base) for g in given], SCHEMA)


def value(df, ratio):
    return tuple(df.agg(*ratio.columns()).first())


def test_rows_that_are_not_ok_stay_in_the_denominator(spark):
    df = rows(spark, {}, {"predicted_entity_id": "e2"}, *({"parse_status": s, "predicted_entity_id": None} for s in ("invalid", "abstain", "missing")))
    assert value(df, metrics.entity_accuracy()) == (0.2, 1, 5)
    assert tuple(df.agg(*metrics.status_columns()).first()) == (2, 1, 1, 1, 0)


def test_no_rows_have_no_value(spark):
    assert value(rows(spark).limit(0), metrics.entity_accuracy()) == (None, 0, 0)


def test_null_gold_and_prediction_agree(spark):
    assert value(rows(spark, {"gold_entity_id": None, "predicted_entity_id": None}), metrics.entity_accuracy())[1] == 1


def test_roles(spark):
    roles = {"e1": "speaker", "e2": "addressee", "e3": "addressee", "e4": "third_party"}
    df = rows(spark, {"entity_roles": roles}, {"entity_roles": roles, "gold_entity_id": "e4", "predicted_entity_id": "e3"}, {"entity_roles": roles, "gold_entity_id": "e2", "predicted_entity_id": "e3"})
    assert value(df, metrics.role_accuracy())[1] == 2
    assert value(df, metrics.same_role_wrong_entity())[1] == 1


def test_chance_is_the_mean_over_rows_with_candidates(spark):
    df = rows(spark, {"candidates": list("abcd")}, {"candidates": list("ab")}, {"candidates": None}, {"candidates": []})
    assert value(df, metrics.chance_level()) == (0.375, 2, 2)


def test_pairs_drop_incomplete_ones(spark):
    def pair(p, first, second):
        out = [{"pair_id": p, "version": "v1", "predicted_entity_id": "e1" if first else "e2"}]
        return out + ([] if second is None else [{"pair_id": p, "version": "v2", "predicted_entity_id": "e1" if second else "e2"}])

    found = pairs.build_pairs(rows(spark, *pair("p1", 1, 0), *pair("p2", 1, 1), *pair("p3", 0, 1), *pair("p4", 1, None)), "v1", "v2", "ord")
    assert [r[0] for r in pairs.dropped(found).collect()] == ["p4"]
    s = pairs.pair_summary(found).first()
    assert (s["pair_numerator"], s["harm_numerator"], s["recovery_numerator"], s["n_pairs"]) == (1, 1, 1, 3)


def test_condition_difference_uses_items_with_both(spark):
    df = rows(spark, {"item_id": "i1", "condition": "a"}, {"item_id": "i1", "condition": "b", "predicted_entity_id": "e2"}, {"item_id": "i2", "condition": "a"}, {"item_id": "i3", "condition": "b"})
    assert tuple(pairs.condition_difference(df, "a", "b", "ord").first()) == (1.0, 1, 1)


def test_one_cluster_gives_its_own_value(spark):
    r = resample.bootstrap(rows(spark, {}, {"predicted_entity_id": "e2"}), "conversation_id", resample.accuracy(), n_boot=20).first()
    assert (r["point"], r["ci_low"], r["ci_high"], r["n_clusters"], r["n_undefined"]) == (0.5, 0.5, 0.5, 1, 0)


def test_undefined_replicates_are_counted(spark):
    df = rows(spark, {"condition": "a", "conversation_id": "x"}, {"condition": "b", "conversation_id": "y"})
    r = resample.bootstrap(df, "conversation_id", resample.difference("a", "b"), n_boot=40).first()
    assert r["point"] == 0.0 and 0 < r["n_undefined"] < 40


@pytest.mark.parametrize(("values", "q", "expected"), [([0.0, 1.0], 0.5, 0.5), ([3.0], 0.975, 3.0), ([0.0, 1.0, 2.0, 10.0], 0.025, 0.075)])
def test_percentile_interpolates(spark, values, q, expected):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.agg(resample.percentile(F.col("v"), q)).first()[0] == pytest.approx(expected)


def test_majority_role_breaks_ties_by_name(spark):
    roles = {"e1": "speaker", "e2": "addressee"}
    df = rows(spark, {"entity_roles": roles}, {"entity_roles": roles, "gold_entity_id": "e2"})
    assert metrics.majority_role(df).first()["role"] == "addressee"
