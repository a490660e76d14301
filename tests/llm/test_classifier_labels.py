"""The classifier where labels of a class are few or missing."""

import math

import numpy as np
import pytest

from loomscore.llm import cotraining, queries, words

SF = "/root/testdata/sf0.001"


def views(y, seed=0):
    r = np.random.default_rng(seed)
    return tuple(3 * (y[:, None] * 2 - 1) + r.normal(size=(len(y), 3)) for _ in range(2))


def test_rare_classes_are_learnt():
    """Few of a class, none of them in the last quarter or none before it."""
    pool_y = np.random.default_rng(1).integers(0, 2, 400)
    pool = views(pool_y, 2)
    for rare in (0, 1):
        for where in ([0, 5, 9], [37, 38, 39], [0], [39]):
            y = np.full(40, 1 - rare)
            y[where] = rare
            model = cotraining.cotrain(*views(y), y, lambda *a: cotraining.pseudo_sums(*a, pool))
            assert model.text is not None
            for p in model.scores(*pool)[:2]:
                assert p[pool_y == 1].mean() > p[pool_y == 0].mean()
            if len(where) > 1:
                kept = model.scores(*pool)[2] >= 0.5
                assert kept[pool_y == 1].mean() > 0.9 and kept[pool_y == 0].mean() < 0.1


def test_each_class_fits_and_calibrates():
    fits, calibrates = cotraining.split(np.array([0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 1]))
    assert fits.tolist() == [0, 1, 2, 3, 4, 5, 6, 9] and calibrates.tolist() == [7, 8, 10]
    assert [x.tolist() for x in cotraining.split(np.array([0, 0, 1]))] == [[0, 2], [1, 2]]


def test_labels_of_one_kind_keep_all_that_is_not_empty(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, " "), (3, None), (4, "d")], "doc_id long, text string")
    for quality in (0, 1):
        labels = spark.createDataFrame([(1, quality), (4, quality)], "doc_id long, quality int")
        rows = cotraining.score(docs, cotraining.fit(docs, labels)).collect()
        assert {r["doc_id"]: (r["kept"], r["quality_score"]) for r in rows} == {1: (True, quality), 2: (False, 0.0), 3: (False, 0.0), 4: (True, quality)}


def plain_model(docs, labels):
    """Co-training written row by row over everything in one place."""
    half = [lambda x: np.clip(x, -6e4, 6e4).astype("<f2").astype(float)] * 2
    xs = half[0](cotraining.text_features([(d["text"] or "").encode() for d in docs], words.Codes()))
    ms = half[1](np.array([cotraining.metadata_features(d["lang"], d["source"], d["n_chars"]) for d in docs]))
    order = sorted((xxhash_of(d["doc_id"]), d["doc_id"], i) for i, d in enumerate(docs) if d["doc_id"] in labels)
    known = [i for _, _, i in order]
    y = np.array([labels[docs[i]["doc_id"]] for i in known])
    fits, held = [], []
    for kind in (0, 1):
        of_kind = [k for k in range(len(y)) if y[k] == kind]
        cut = len(of_kind) - max(1, len(of_kind) // 4)
        fits += of_kind[: max(1, cut)]
        held += of_kind[cut:]
    fits, held = sorted(fits), sorted(held)
    rest = [i for i, d in enumerate(docs) if d["doc_id"] not in labels]
    sides = (xs, ms)
    views = [cotraining.View.fit(side[known][fits], y[fits]) for side in sides]
    for _ in range(cotraining.ROUNDS):
        for v, side in zip(views, sides, strict=True):
            v.calibrate(side[known][held], y[held])
        sure = []
        for v, side in zip(views, sides, strict=True):
            handed, prior = [], math.log(y.mean() / (1 - y.mean()))
            for i in rest:
                odds = float(v.log_odds(side[i][None])[0])
                if all(1 / (1 + math.exp(-q)) >= 0.98 for q in (odds, odds - prior)):
                    handed.append((i, 1))
                if all(1 / (1 + math.exp(q)) >= 0.98 for q in (odds, odds - prior)):
                    handed.append((i, 0))
            sure.append(handed)
        for _ in range(cotraining.STEPS):
            for k, (v, side) in enumerate(zip(views, sides, strict=True)):
                w = v.weights
                gradient, hessian = 1e-3 * w, (1e-3 + 1e-2) * np.eye(len(w))
                for kind in (0, 1):
                    own = [known[f] for f in fits if y[f] == kind]
                    handed = [i for i, label in sure[1 - k] if label == kind]
                    for i in own + handed:
                        z = np.append(np.clip((side[i] - v.mean) / v.scale, -8, 8), 1.0)
                        p = 1 / (1 + math.exp(-float(np.clip(z @ w, -40, 40))))
                        gradient = gradient + z * (p - kind) * 0.5 / (len(own) + len(handed))
                    for i in own:
                        z = np.append(np.clip((side[i] - v.mean) / v.scale, -8, 8), 1.0)
                        hessian = hessian + np.outer(z, z) * 0.25 * 0.5 / len(own)
                v.weights = w - np.linalg.solve(hessian, gradient)
    for v, side in zip(views, sides, strict=True):
        v.calibrate(side[known][held], y[held])
    return cotraining.Model(*views, float(y.mean()))


def xxhash_of(doc_id):
    return HASHES[doc_id]


HASHES = {}


def test_the_query_equals_a_plain_version(spark):
    docs = queries.table(spark, SF, "documents")
    rows = docs.collect()
    labels = {}
    for r in queries.table(spark, SF, "labels").collect():
        labels[r["doc_id"]] = min(labels.get(r["doc_id"], 1), r["quality"])
    HASHES.update((r["doc_id"], r["h"]) for r in docs.select("doc_id", cotraining.order("doc_id").alias("h")).collect())
    model = plain_model(rows, labels)
    text = [(r["text"] or "").encode() for r in rows]
    scores = model.scores(cotraining.text_features(text, words.Codes()), np.array([cotraining.metadata_features(r["lang"], r["source"], r["n_chars"]) for r in rows]))
    found = {r["doc_id"]: r for r in queries.op6_cotraining(spark, SF).collect()}
    for k, r in enumerate(rows):
        expected = [float(s[k]) if text[k].strip() else 0.0 for s in scores]
        assert [found[r["doc_id"]][c] for c in cotraining.SCORES] == pytest.approx(expected, abs=2e-6)
        assert found[r["doc_id"]]["kept"] == (expected[2] >= 0.5)


def test_many_repeated_ids_ties_and_a_long_text(spark):
    """A labelled id of 20,000 rows counts once in the sample; rows that are alike score alike."""
    docs = spark.range(20_000).selectExpr("1L AS doc_id", "'good words in a row' AS text").unionByName(spark.createDataFrame([(2, "# # # # #"), (3, "good words " * 100_000), (None, "good words in a row")], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    scored = cotraining.score(docs, cotraining.fit(docs, labels)).selectExpr("doc_id", "round(quality_score, 9) AS quality_score", "kept").distinct().collect()
    by = {r["doc_id"]: (r["quality_score"], r["kept"]) for r in scored}
    assert len(scored) == len(by) == 4 and by[1] == by[None]
