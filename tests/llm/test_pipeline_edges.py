"""The pipeline's stages, one after another, on nulls, repeats, ties, a very long text, clashing columns and no rows."""

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def clean(seed, n=60):
    return " ".join(f"word{seed}x{i % 37}" for i in range(n)) + "."


def tables(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, KIND).selectExpr("*", "'clash' AS kept", "1 AS __row", "2 AS copies", "3 AS pass", "4 AS fp")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(d, int(d % 4 != 0), 0) for d in sorted({r[0] for r in rows if r[0] is not None})]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_every_stage_and_the_whole_run(spark, tmp_path):
    bad = "# | # | $$$ # " * 30
    rows = [(i, bad + str(i) if i % 4 == 0 else clean(i), ("en", "de", None)[i % 3], ("web", None)[i % 2], 300) for i in range(40)]
    rows += [(1, clean(1), "de", None, 300), (None, clean(77), None, None, None), (50, None, "en", "web", 0), (51, "", "en", "web", 0), (52, clean(5) + " mail a.b@c.org", "en", None, None), (53, clean(99, 200_000), "en", "web", 9)]
    sf = tables(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        alone = stage(spark, docs, sf)
        assert alone.columns == list(corpus_pipeline.COLUMNS)
        left[name] = [tuple(r) for r in alone.collect()]
        assert stage(spark, docs.limit(0), sf).count() == 0
    kept = {r[0] for r in left["quality classifier"]}
    assert not kept & {50, 51} and {1, 53} <= kept
    near = [r[0] for r in left["SimHash near-dedup"]]
    assert near.count(1) == 1 and (50 in near) != (51 in near) and 53 in near
    private = {r[0]: r for r in left["PII surrogates"]}
    assert len(left["PII surrogates"]) == len(rows) and private[50][1] is None and private[51][1] == "" and "a.b@c.org" not in private[52][1]
    mixed = [r[0] for r in left["source mixing"]]
    assert set(mixed) == {r[0] for r in rows} and mixed.count(1) % 2 == 0
    ids = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()}
    assert ids[50] == ids[51] == 0 and ids[53] > 200_000
    whole = [r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()]
    assert set(whole) <= kept and {1, 53} <= set(whole)


def test_a_run_without_documents(spark, tmp_path):
    sf = tables(spark, tmp_path, [(1, clean(1), "en", "web", 3)])
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{sf}/none/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{sf}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{sf}/none").count() == 0
