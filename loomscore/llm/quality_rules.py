"""Quality rules: repetition counts, and a hashed n-gram likelihood ratio.

The ratio compares two multinomials over hashed word n-grams (one and two
words, lower-cased, without marks at their ends): one of trusted documents,
one of the whole raw corpus.  A document's score is the mean over its n-grams of the
log of the smoothed ratio; it passes if the score reaches the threshold, the
same for every document.  Counts cover all documents; what is gathered and
broadcast is one pair of counts for each of ``BUCKETS`` buckets, whatever the
corpus.

Null and empty texts have no words and fail the base rules; their score is 0.
Repeated rows are judged alike, columns other than id and text are ignored,
texts are counted whole whatever their length, a score at the threshold is
kept, and an empty table gives no rows.  Without trusted documents both models are
the raw one, and every document that passes the base rules is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches, joins
from .words import Codes, Words

BUCKETS = 1 << 16
#: Mean log ratio below which a document is dropped.
THRESHOLD = -0.04
#: N-grams added to both counts of a bucket.
PSEUDO = 50.0
SYMBOLS = b"#*$%&|<>"


def base(text: bytes, words: list[bytes]) -> tuple[int, int, int]:
    """word_chars, n_symbols, n_dup_lines."""
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(b"".join(words).decode("utf-8", "replace")), symbols, len(lines) - len(set(lines))


def counts(df: DataFrame, trusted: str, text: str = "text") -> DataFrame:
    """bucket, raw, target: n-grams of all documents, and of those where ``trusted`` is true."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, raw, target = Codes(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches.slices(it):
            words = Words([x or b"" for x in b.column(0).to_pylist()], codes)
            at, of = words.grams(BUCKETS)
            raw += np.bincount(at, minlength=BUCKETS)
            target += np.bincount(at[b.column(1).to_numpy(zero_copy_only=False)[of]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    parts = df.select(F.col(text).cast("binary").alias("text"), F.coalesce(F.col(trusted), F.lit(False)).alias("good")).mapInArrow(run, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(found: list[tuple[int, int, int]]) -> np.ndarray:
    """For each bucket, the log of target over raw probability.

    Both counts are smoothed by PSEUDO n-grams of the raw model, on the scale
    of the target's counts: a bucket of which the target can't say more than
    that gets a ratio near one, so that a rare word counts for nothing merely
    because no trusted document has it.
    """
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for k, r, t in found:
        raw[k], target[k] = r, t
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log(target + PSEUDO) - np.log(raw * (target.sum() / raw.sum()) + PSEUDO)


def judge(df: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept of each row of ``df``.

    ``trusted`` has one column, the ids of trusted documents.
    """
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    found = counts(joins.flagged(docs, trusted, "doc_id", "good"), "good")
    # at most BUCKETS rows, whatever the input
    ratio = df.sparkSession.sparkContext.broadcast(log_ratios([tuple(r) for r in found.collect()]))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, weight = Codes(), ratio.value
        for b in batches.slices(it):
            texts = [x or b"" for x in b.column(1).to_pylist()]
            words = Words(texts, codes)
            rows = [base(*z) for z in zip(texts, words.split, strict=True)]
            n, repeat = words.lengths, words.repeat_words()
            at, of = words.grams(BUCKETS)
            scores = np.bincount(of, weight[at], len(texts)) / np.maximum(1, np.bincount(of, minlength=len(texts)))
            failed = (n < 20) | (100 * repeat > 30 * n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array(repeat), pa.array(failed), pa.array(scores), pa.array(~failed & (scores >= threshold))], ["doc_id", *names, "base_failed", "score", "kept"])

    schema = "doc_id long, " + "".join(f"{n} long, " for n in names) + "base_failed boolean, score double, kept boolean"
    return docs.mapInArrow(run, schema)
