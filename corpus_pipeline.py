"""A corpus from documents to token ids, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``.  All but the last return
the columns of ``documents``.

Null and empty texts are never accepted by the classifier, so later stages see
none of them in a run; on its own each stage takes them: they are one group of
near-duplicates, hold nothing private, come once in the mix and have no ids.
Null ids, languages and sources are values like others.  Repeated rows are
scored alike, are one group, and count as often as they come in the mix.
Columns beyond those of ``documents`` are dropped by each stage, whatever their
names; texts are taken whole whatever their length; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscore.llm import bpe, cotraining, joins, mixing, pii, queries, scratch, simhash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    docs = docs.select(*COLUMNS)
    model = cotraining.fit(docs, queries.table(spark, sf_dir, "labels"))
    return cotraining.score(docs, model).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that with the smallest id, whether ids are repeated or null (``simhash.representatives``)."""
    rows = scratch.written(docs.select(*COLUMNS).withColumn("__row", F.monotonically_increasing_id()))
    kept = scratch.written(simhash.representatives(rows, "__row"))
    return rows.join(joins.sized(kept), "__row", "left_semi").select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates in place of personal data and secrets; n_chars counts the new text."""
    return pii.replace(docs.select(*COLUMNS), pii.session_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources has it, every one at least once."""
    docs = docs.select(*COLUMNS)
    return mixing.copies(mixing.apply(docs, mixing.fit(docs))).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and digests of the ids and of the text decoded from them."""
    path = queries.tokenizer("byte_bpe_50k.json")
    return queries.bpe_digest(bpe.round_trip(docs.select("doc_id", "text"), path, drop_text=True))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("PII surrogates", private),
    ("source mixing", mixture),
    ("BPE encoding and decoding", token_ids),
]
#: The classifier and the tokenizer can't be expressed in SQL; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  Tables that a stage needed for itself, and its predecessor's, go once its own is written."""
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = scratch.folder(spark)
        with scratch.scope(spark):
            found = stage(spark, docs, sf_dir)
            found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
        if before:
            scratch.remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
