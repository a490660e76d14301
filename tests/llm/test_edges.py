"""Empty tables, null ids and very long texts in the quality rules and the media columns."""

import hashlib
import re
import zlib

from loomscore.llm import mpeg, quality_rules

LONG = " ".join(f"w{i % 5000} {i}" for i in range(150_000)) + "\nsame line\nsame line\n"


def test_quality_rules_at_the_edges(spark):
    kind = "doc_id long, text string"
    none = spark.createDataFrame([], "doc_id long")
    assert quality_rules.judge(spark.createDataFrame([], kind), none).count() == 0
    rows = [(None, "a b c"), (1, LONG), (1, LONG), (2, None), (3, "")]
    found = {(r["doc_id"], r["n_words"]): r for r in quality_rules.judge(spark.createDataFrame(rows, kind), spark.createDataFrame([(1,), (None,)], "doc_id long")).collect()}
    words = re.findall(r"[^\x20\x09-\x0D]+", LONG)
    own = found[1, len(words)]
    assert (own["word_chars"], own["n_dup_lines"], own["n_repeat_words"], own["base_failed"]) == (sum(map(len, words)), 1, 0, False)
    assert set(found) == {(None, 3), (1, len(words)), (2, 0), (3, 0)} and all(found[k]["base_failed"] and not found[k]["kept"] for k in ((None, 3), (2, 0), (3, 0)))


def test_media_at_the_edges(spark):
    kind = "doc_id long, text string"
    assert mpeg.digest(mpeg.parsed(mpeg.stored(spark.createDataFrame([], kind)))).count() == 0
    rows = [(None, "x"), (1, LONG), (2, None)]
    found = {r["doc_id"]: r for r in mpeg.digest(mpeg.parsed(mpeg.stored(spark.createDataFrame(rows, kind)))).collect()}
    for doc_id, text in rows:
        body = (text or "").encode()
        payload = body + b"\xff" * (-len(body) % 576 or 576 * (not body))
        r = found[doc_id]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
