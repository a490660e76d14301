"""URL cascade, licence rules and mixing, with their SQL on the smallest tables."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from loomscore.llm import license_rules, mixing, queries, url_cascade

SF = "/root/testdata/sf0.001"


def canonical(rows):
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert canonical(df.select(*columns).collect()) == canonical([tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()])


# -- urls --------------------------------------------------------------------


@pytest.mark.parametrize(
    ("url", "host", "path"),
    [("http://A.Example.ORG/es/x?q#f", "a.example.org", "/es/x"), ("https://x.com", "x.com", ""), ("x.com/a", "", ""), (None, "", ""), ("a://b#c://d", "b", ""), ("://h?x/y", "h", ""), ("ftp://ÄÖ.de/ä", "ÄÖ.de", "/ä"), ("", "", "")],
)
def test_hosts_and_paths(spark, url, host, path):
    row = url_cascade.with_host_path(spark.createDataFrame([(url,)], "url string")).first()
    assert (row["host"], row["path"]) == (host, path)


@pytest.mark.parametrize(
    ("url", "rule", "verdict"),
    [("http://example.org/es/", "example.org/es/", "block"), ("http://m.example.org/en/12", "example.org/en/1", "block"), ("http://example.org/en/2", "org/", "allow"), ("http://badexample.org/es/", "org/", "allow"), ("http://a.com/fr/", "com/fr/", "allow"), ("http://a.com/de/1", "com/de/", "block"), ("http://a.com/en", None, None), ("http://org", None, None)],
)
def test_the_longest_rule_counts(spark, url, rule, verdict):
    df = url_cascade.with_host_path(spark.createDataFrame([(url,)], "url string"))
    assert tuple(df.select(*url_cascade.rule_columns(queries.RULES)).first()) == (rule, verdict)


@pytest.mark.parametrize("block_bytes", [1 << 20, 1])
def test_cascade_is_exact(spark, block_bytes):
    keys = spark.range(6000).select(F.concat(F.lit("k"), F.col("id") % 5000).alias("key"))
    listed = spark.range(0, 5000, 3).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade, shards = url_cascade.build(keys, listed, shards=3)
    got = url_cascade.judge(keys, "key", cascade, shards, block_bytes=block_bytes)
    assert got.count() == 6000
    assert got.filter(F.col("listed") != (F.substring("key", 2, 9).cast("int") % 3 == 0)).count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 20, 1])
def test_a_frequent_key_a_very_long_one_and_repeated_rows(spark, block_bytes):
    """A key of a third of all rows, equal rows and a key of two million letters are judged alike on both paths."""
    long = "z" * 2_000_000
    keys = spark.range(900).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") == 1, F.lit(long)).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), F.lit("x").alias("__part0"))
    listed = spark.createDataFrame([("hot",), (long,), ("k7",)], "key string")
    cascade, shards = url_cascade.build(keys.select("key"), listed, shards=4)
    got = url_cascade.judge(keys, "key", cascade, shards, block_bytes=block_bytes).groupBy(F.substring("key", 1, 3).alias("k")).agg(F.min("listed").alias("a"), F.max("listed").alias("b"), F.count("*").alias("n")).collect()
    assert all(r["a"] == r["b"] for r in got)
    assert {r["k"] for r in got if r["a"]} == {"hot", "zzz", "k7"}
    assert sum(r["n"] for r in got) == 900


def test_equally_long_rules_the_later_one_counts(spark):
    df = url_cascade.with_host_path(spark.createDataFrame([("http://a.b.com/x",)], "url string"))
    found = df.select(*url_cascade.rule_columns([("allow", "b.com", "/x"), ("block", "b.com", "/x")])).first()
    assert tuple(found) == ("b.com/x", "block")


def test_cascade_edge_cases(spark):
    keys = spark.createDataFrame([(None,), ("",), ("a",), ("a",)], "key string").withColumn("listed", F.lit("clash"))
    nothing = spark.createDataFrame([], "key string")
    assert not any(r["listed"] for r in url_cascade.judge(keys, "key", *url_cascade.build(keys.select("key"), nothing)).collect())
    everything = url_cascade.judge(keys, "key", *url_cascade.build(keys.select("key"), keys.select("key")))
    assert all(r["listed"] for r in everything.collect())
    assert url_cascade.judge(nothing, "key", *url_cascade.build(nothing, nothing)).count() == 0


# -- licences ----------------------------------------------------------------


def test_licences(spark):
    wrapped = license_rules.SENTENCES["mit-grant"].replace(" of ", "\nof ") + ":\n\n" + license_rules.SENTENCES["mit-condition"].replace(" and ", "\nand ") + ".\n\n" + license_rules.SENTENCES["as-is"].replace(" OF ", "\nOF ") + "."
    texts = {
        "x.\nReleased under the MIT License.": "MIT", "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0!!": "Apache-2.0", "see. This work is licensed under the GNU General Public License, version 3. ok": "GPL-3.0-only", wrapped: "MIT",
        "Not Released under the MIT License.": None, "the MIT License": None, "": None, None: None, "Licensed under CC BY-NC 4.0. Released under the MIT License.": "MIT,CC-BY-NC-4.0",
    }
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, license string")
    got = {r["text"]: r for r in license_rules.scan(df).collect()}
    for text, expected in texts.items():
        assert got[text]["licenses"] == (expected or ""), text
        assert got[text]["license"] == (expected.split(",")[0] if expected else None)
    assert license_rules.scan(df.limit(0)).count() == 0


# -- mixing ------------------------------------------------------------------


def corpus(spark, sizes):
    return spark.createDataFrame([(f"{s}{i}", s, "w " * 10) for s, n in sizes.items() for i in range(n)] + [("empty", "none", None), ("nil", None, "a b")], "doc_id string, source string, text string")


def test_sources_meet_their_weights(spark):
    docs = corpus(spark, {"a": 300, "b": 100, "c": 60})
    mix = mixing.fit(docs, repeats=3.0)
    rows = mixing.apply(docs.withColumn("copies", F.lit("clash")), mix).collect()
    assert len(rows) == docs.count() and all(r["copies"] >= 1 for r in rows)
    sources = {r["source"]: r for r in mix.sources.collect()}
    assert sum(s["weight"] for s in sources.values()) == pytest.approx(1, abs=1e-6)
    for s in ("a", "b", "c"):
        used = sum(r["copies"] * 10 for r in rows if r["source"] == s)
        assert sources[s]["quota"] <= used < sources[s]["quota"] + 10
    assert max(r["copies"] for r in rows) <= 4
    placed = mixing.realised(mixing.apply(docs, mix), mix).collect()
    assert len(placed) == sum(r["copies"] for r in rows)
    keys = [(r["source"], r["pass"], r["block_rank"], r["place"]) for r in placed]
    assert len(set(keys)) == len(keys)
    for s in ("a", "b", "c"):
        first = sorted((r["block_rank"], r["place"]) for r in placed if r["source"] == s and r["pass"] == 1)
        assert {b for b, _ in first} == set(range(1, 1 + max(b for b, _ in first)))


def test_many_blocks_repeated_rows_null_ids_and_a_long_text(spark, monkeypatch):
    """Ranks by prefix equal those of one window; rows of one id and source share places and are repeated alike."""
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 20)
    rows = [(i, "a", "w " * (i % 9)) for i in range(400)] + [(i, "b", "w " * 5) for i in range(60)] * 2 + [(None, "b", "w w")] * 5 + [(900, "b", "long " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("place", F.lit("clash"))
    mix = mixing.fit(docs, repeats=1.5)
    found = mixing.apply(docs, mix)
    placed = mixing.realised(found, mix).drop("text").collect()
    assert len(placed) == found.agg(F.sum("copies")).first()[0] >= len(rows)
    blocks = {(r["source"], r["pass"], r["block"]): r["block_rank"] for r in placed}
    for s, n in {(s, n) for s, n, _ in blocks}:
        ranks = sorted(v for k, v in blocks.items() if k[:2] == (s, n))
        assert len(set(ranks)) == len(ranks)
        if n == 1:
            ordered = sorted((k[2] for k in blocks if k[:2] == (s, n)), key=lambda b: hashlib.md5(f"mix|1|{s}|{b}".encode()).hexdigest())
            assert [blocks[s, n, b] for b in ordered] == sorted(ranks)
    for r in placed:
        assert {x["place"] for x in placed if (x["source"], x["doc_id"], x["pass"]) == (r["source"], r["doc_id"], r["pass"])} == {r["place"]}
        break
    assert sum(r["doc_id"] is None for r in placed) % 5 == 0


def test_ties_have_defined_weights(spark):
    docs = corpus(spark, {"a": 50, "b": 50, "c": 50}).filter("source IN ('a', 'b', 'c')")
    mix = mixing.fit(docs)
    assert {r["weight"] for r in mix.sources.collect()} == {0.333333333}
    assert mixing.apply(docs, mix).filter("copies <> 1").count() == 0


def test_the_repetition_limit_wins_over_entropy(spark):
    docs = corpus(spark, {"a": 1000, "b": 10}).filter("source IN ('a', 'b')")
    rows = mixing.apply(docs, mixing.fit(docs, entropy=1.0, repeats=2.0)).collect()
    assert max(r["copies"] for r in rows) == 2 and {r["copies"] for r in rows if r["source"] == "a"} == {1}


def test_a_budget_below_the_corpus_takes_a_part(spark):
    docs = corpus(spark, {"a": 400, "b": 400}).filter("source IN ('a', 'b')")
    rows = mixing.apply(docs, mixing.fit(docs, budget=4000)).collect()
    for s in "ab":
        assert sum(r["copies"] for r in rows if r["source"] == s) == 200


def test_no_rows(spark):
    docs = corpus(spark, {}).limit(0)
    assert mixing.apply(docs, mixing.fit(docs)).count() == 0
