"""Near-duplicate rows with repeated and missing ids."""

import corpus_pipeline


def test_one_row_of_each_component_stays(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [
        (1, a), (1, a), (2, a),  # a repeated row and another id
        (2, b),  # an id again, with a text of its own
        (None, c), (None, c), (None, c),  # no ids at all
        (None, d), (7, d), (7, d.upper()),  # an id before none; one text in two spellings
    ]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = [(r["doc_id"], r["text"].lower()) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    assert sorted(kept, key=lambda r: r[1]) == [(1, a), (2, b), (None, c), (7, d)]
    assert corpus_pipeline.near_duplicates(spark, df.limit(0), "").count() == 0
