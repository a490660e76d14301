"""SimHash components against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from loomscore.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    up = {d: d for d in fps}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


@pytest.mark.parametrize("text", ["", " \n", "One", "a b c", "A b C d", "É É é é x", "w " * 500, "x\u00a0y z\tq\vr", "日本 語 x y z"])
def test_fingerprints(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_components_equal_all_pairs(spark):
    r = random.Random(2)
    bodies = []
    for _ in range(25):
        words = [f"w{r.randint(0, 10**6)}" for _ in range(r.randint(3, 160))]
        bodies.append(" ".join(words))
        for _ in range(r.randint(0, 6)):
            words = list(words)
            words[r.randrange(len(words))] = "changed"
            bodies.append(" ".join(words))
    bodies += [None, "", " ", bodies[0], bodies[0]]
    rows = list(enumerate(bodies))
    r.shuffle(rows)
    got = {x["doc_id"]: x for x in simhash.components(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS component_id")).collect()}
    fps = {d: plain_fingerprint(t) for d, t in rows}
    expected = plain_components(fps)
    assert len(set(expected.values())) < len(rows) - 5
    assert {d: (x["fingerprint"], x["component_id"]) for d, x in got.items()} == {d: (f"{fps[d]:016x}", expected[d]) for d in fps}


def test_empty_table_and_single_rows(spark):
    assert simhash.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert simhash.components(spark.createDataFrame([(5, "x")], "doc_id long, text string")).first()["component_id"] == 5


@pytest.mark.parametrize("which", [0, 33, 69])
def test_long_lists_find_the_same_links(monkeypatch, which):
    r = random.Random(which)
    free = [p for p in range(8) if p not in simhash.LISTS[which]]
    base, fps = r.getrandbits(64), set()
    for _ in range(30):
        x = base
        for _ in range(r.randint(0, 7)):
            x ^= 1 << (8 * (7 - r.choice(free)) + r.randrange(8))
        fps.add(x)
        for _ in range(r.randint(0, 4)):
            fps.add(x ^ 1 << (8 * (7 - r.choice(free)) + r.randrange(8)))
    array = np.array(sorted(fps), np.uint64)

    def groups():
        forest = simhash.Forest(len(array))
        for i, j in simhash.linked(array, which):
            forest.join(i, j)
        return [forest.root(i) for i in range(len(array))]

    def counts(x):  # in this list: its positions are the first four shared bytes
        return tuple(p for p in range(8) if not x >> 8 * (7 - p) & 0xFF)[:4] == simhash.LISTS[which] and x.bit_count() <= 4

    forest, values = simhash.Forest(len(array)), array.tolist()
    for i, a in enumerate(values):
        for j in range(i + 1, len(values)):
            if counts(a ^ values[j]):
                forest.join(i, j)
    expected = [forest.root(i) for i in range(len(values))]
    assert len(set(expected)) < len(expected)
    for most in (0, 5, len(array) - 1, len(array), 1024):
        monkeypatch.setattr(simhash, "PAIRWISE", most)
        assert groups() == expected


def test_lists_that_span_batches(spark):
    """One hot list of some thousand fingerprints, in batches of a few rows, at the bound of PAIRWISE and beyond."""
    r = random.Random(8)
    base = r.getrandbits(64)
    fps = {base}
    while len(fps) < 1500:
        x = base
        for _ in range(r.randint(1, 6)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    df = spark.createDataFrame([(simhash.signed(x),) for x in sorted(fps)], "fp long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        links = [tuple(x) for x in simhash.index_links(df).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    up = {simhash.signed(x): simhash.signed(x) for x in fps}

    def root(d):
        while up[d] != d:
            up[d] = d = up[up[d]]
        return d

    for a, b in links:
        up[max(root(a), root(b))] = min(root(a), root(b))
    expected = plain_components({simhash.signed(x): x for x in fps})
    assert {d: root(d) for d in up} == expected


def test_nulls_ties_and_very_long_texts(spark):
    """Null ids are a component's id only if it has no other; rows of one id may have several texts; whole texts count."""
    long = " ".join(f"v{i % 977}" for i in range(300_000))
    rows = [(None, "only null ids here"), (None, "only null ids here"), (7, "x y z w v"), (7, "another text of id seven"), (3, "x y z w v"), (9, long), (8, long + " end"), (None, long)]
    got = sorted(simhash.components(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    by = [(r["doc_id"], r["component_id"]) for r in got]
    assert sorted(by, key=str) == sorted([(None, None), (None, None), (7, 3), (7, 7), (3, 3), (9, 8), (8, 8), (None, 8)], key=str)
    assert next(r["fingerprint"] for r in got if r["doc_id"] == 9) == f"{plain_fingerprint(long):016x}"


def test_stars_follow_a_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100)], "a long, b long")
    got = dict(map(tuple, simhash.stars(links).collect()))
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}
