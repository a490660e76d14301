"""The corpus pipeline against its stages done plainly."""

import collections

import pytest

pytest.importorskip("corpus_pipeline")
P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from loomscore.llm import cotraining, mixing, pii, queries, simhash  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = queries.table(spark, SF, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = cotraining.fit(docs, queries.table(spark, SF, "labels"))
    good = {r["doc_id"] for r in cotraining.score(docs, model).filter("kept").collect()}
    fps = {d: simhash.fingerprint(rows[d]["text"].encode()) for d in good}
    up = {d: d for d in good}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(good)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    kept = [d for d in ids if root(d) == d]
    assert len(kept) < len(good) < len(rows)
    masked = pii.replace(docs.filter(docs["doc_id"].isin(kept)), pii.session_key(spark))
    copies = {r["doc_id"]: r["copies"] for r in mixing.apply(masked, mixing.fit(masked)).collect()}
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    expected = collections.Counter({(r["doc_id"], len(library.encode(r["text"], add_special_tokens=False).ids)): copies[r["doc_id"]] for r in masked.collect()})
    found = collections.Counter((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert found == expected


def test_stages_keep_the_columns(spark):
    docs = queries.table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
