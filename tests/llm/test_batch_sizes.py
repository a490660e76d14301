"""What Python is handed at a time is bounded in bytes, whatever the number of rows."""

import pyarrow as pa
import pytest
from pyspark.sql import types as T

pytest.importorskip("xxhash")

from loomscore.llm import batches  # noqa: E402


def test_batches_of_long_texts_hold_few_rows(spark):
    def sizes(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    spark.conf.unset(batches.SETTING)
    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('abcdefghij', 1000) AS text")
    try:
        found = batches.mapped(rows, sizes, "n long, bytes long").collect()
        assert sum(r["n"] for r in found) == 3000
        assert max(r["bytes"] for r in found) < 1.1 * batches.BYTES
    finally:
        spark.conf.unset(batches.SETTING)


def test_operators_bound_their_batches_and_keep_a_setting_of_the_session(spark):
    rows = spark.range(3).selectExpr("id", "'x' AS text")
    try:
        for own, then in ((None, str(batches.BYTES)), ("123456", "123456")):
            spark.conf.set(batches.SETTING, own) if own else spark.conf.unset(batches.SETTING)
            found = batches.append(rows, "text", "size", T.LongType(), lambda: lambda v: list(map(len, v))).collect()
            assert sorted(tuple(r) for r in found) == [(k, "x", 1) for k in range(3)]
            assert spark.conf.get(batches.SETTING).rstrip("b") == then
    finally:
        spark.conf.unset(batches.SETTING)
