"""Quality rules and the classifier."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomscore.llm import cotraining, quality_rules, queries, words

SF = "/root/testdata/sf0.01"


def plain_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = {x for x in windows if windows.count(x) > 1} if len(windows) < 400 else {x for x, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {i + k for i, x in enumerate(windows) if x in twice for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def samples():
    r = random.Random(4)
    out = ["", " \n\t", "a", "é # ü|\n\n é # ü|\n x", "a b c d e f g h a b c d e f g h", "a " * 17, "x\x0by\x0cz\u00a0q"]
    for _ in range(60):
        out.append("".join(r.choice(["a ", "b ", "a b a b a b a ", "\n", "é#", " *"]) for _ in range(r.randint(0, 60))))
    return out


def test_base_counts(spark):
    texts = samples()
    df = spark.createDataFrame([*enumerate(texts), (999, None), (0, texts[0])], "doc_id long, text string").withColumn("kept", F.lit("clash"))
    rows = quality_rules.judge(df, df.select("doc_id").limit(0)).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        n, chars, symbols, dup, repeat = plain_base("" if r["doc_id"] == 999 else texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 20 or 100 * repeat > 30 * n)
        assert r["kept"] == (not r["base_failed"])  # no trusted documents: all ratios are one


def test_windows_do_not_cross_texts():
    w = words.Words([b"a b c d e f g h i", b"c d e f g h i a b", b"x"], words.Codes())
    assert w.repeat_words().tolist() == [0, 0, 0]


def test_scores_equal_a_plain_ratio(spark):
    texts = ["the cat sat on the mat " * 5, "buy now cheap pills $$$ " * 5, "the cat sat on the mat again and again today " * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["score"] for r in quality_rules.judge(df, df.filter("doc_id = 0").select("doc_id")).collect()}
    found = [words.Words([t.encode()], words.Codes()).grams(quality_rules.BUCKETS)[0] for t in texts]
    raw = np.bincount(np.concatenate(found), minlength=quality_rules.BUCKETS)
    target = np.bincount(found[0], minlength=quality_rules.BUCKETS)
    ratio = np.log(target + quality_rules.PSEUDO) - np.log(raw * (target.sum() / raw.sum()) + quality_rules.PSEUDO)
    for d, at in enumerate(found):
        assert rows[d] == pytest.approx(ratio[at].mean())
    assert rows[0] > rows[1]


def test_rules_keep_clean_documents(spark):
    labels = queries.table(spark, SF, "labels")
    held = labels.filter("doc_id % 3 = 0")
    judged = quality_rules.judge(queries.table(spark, SF, "documents"), labels.filter("doc_id % 3 <> 0 AND quality = 1 AND toxic = 0").select("doc_id"))
    rows = judged.join(held, "doc_id").filter("n_words >= 20").collect()
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.97 * len(good)
    assert sum(r["kept"] for r in bad) <= 0.4 * len(bad)


def test_classifier_on_held_out_labels(spark):
    docs, labels = queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")
    model = cotraining.fit(docs, labels.filter("doc_id % 3 <> 0"))
    rows = cotraining.score(docs.withColumn("kept", F.lit("clash")), model).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    right = sum(r["kept"] == (r["quality"] == 1) for r in rows)
    assert right >= 0.96 * len(rows)
    assert sum(r["kept"] for r in rows if r["quality"] == 1) >= 0.98 * sum(r["quality"] for r in rows)


def test_classifier_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "x y z", "en", "s", 5), (3, "x y z", "en", "s", 5), (None, "w", "q", "r", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = cotraining.score(docs, cotraining.fit(docs, none)).collect()
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in rows) == [(0, True), (1, False), (2, False), (3, True), (3, True)]
    one_kind = spark.createDataFrame([(3, 1), (None, 0), (2, None)], "doc_id long, quality int")
    assert all(r["kept"] for r in cotraining.score(docs.filter("doc_id = 3"), cotraining.fit(docs, one_kind)).collect())
    assert cotraining.score(docs.limit(0).drop("lang", "n_chars"), cotraining.Model(None, None, 0.5)).count() == 0


def test_views_teach_each_other():
    r = np.random.default_rng(0)
    y = r.integers(0, 2, 800)
    a, b = (y[:, None] * 2 - 1 + r.normal(size=(800, 3)) for _ in range(2))
    model = cotraining.cotrain(a[:60], b[:60], y[:60], lambda *x: cotraining.pseudo_sums(*x, (a[60:400], b[60:400])))
    p = model.scores(a[400:], b[400:])[2]
    assert ((p > 0.5) == (y[400:] > 0)).mean() > 0.93
