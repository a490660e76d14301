"""What the join shuffles: sets and sketches no more often than they are needed, signatures no wider."""

import pytest

pytest.importorskip("xxhash")

from loomscore.llm import joins, partenum  # noqa: E402


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_values_too_large_to_broadcast_are_shuffled_by_one_side_only(spark, monkeypatch):
    pairs = spark.createDataFrame([(3, 1), (4, 1), (4, 2), (9, 4)], "a long, b long")
    values = spark.createDataFrame([(k, bytes([k]) * 200) for k in range(10)], "row long, value binary")
    small = sorted(tuple(r) for r in partenum.beside(pairs, values).select("a", "b", "x", "y").collect())
    assert small == sorted((a, b, bytearray([a]) * 200, bytearray([b]) * 200) for a, b in [(3, 1), (4, 1), (4, 2), (9, 4)])
    monkeypatch.setattr(joins, "fits", lambda df, most=0: "value" not in df.columns)
    monkeypatch.setattr(joins, "MOST", 500)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = partenum.beside(pairs, values).select("a", "b", "x", "y")
        assert sorted(tuple(r) for r in large.collect()) == small
        assert plan(large).count("SortMergeJoin") <= 2  # one join by shuffle; the final and the first plan are both told
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_sketch_is_dealt_once_for_all_lists_of_one_smallest_member(spark, monkeypatch):
    """Near copies share many lists; what is written beside the sketches has one row for each smallest member, part and row."""
    seen, written = [], partenum.scratch.written

    def kept(df):
        out = written(df)
        if {"pivot", "part", "row"} <= set(out.columns):
            seen.append((out.count(), out.select("pivot", "part", "row").distinct().count()))
        return out

    monkeypatch.setattr(partenum.scratch, "written", kept)
    base = [f"b{i}" for i in range(120)]
    rows = [(k, " ".join([*base[:at], f"own{k}", *base[at + 1 :], f"end{k}", *(f"e{k}-{i}" for i in range(9 * (k % 2)))])) for k in range(12) for at in [9 * k]]
    found = partenum.components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.count() == len(rows)
    assert seen and all(n == once for n, once in seen)


def test_signatures_keep_their_instance_and_forty_bits():
    for i in partenum.table(partenum.PERCENT):
        assert i.number << partenum.BITS < 1 << 48
