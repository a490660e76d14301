"""Components of the n-gram join against all pairs, and its signatures' guarantee."""

import random
import re

import numpy as np
import pytest

from loomscore.llm import partenum


def plain_set(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def plain_components(rows, percent=85):
    """Of (doc_id, text) rows: by place, the size and the smallest id reachable."""
    found = [plain_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(found):
        for j in range(i):
            both = len(a & found[j])
            if both and 100 * both >= percent * (len(a) + len(found[j]) - both):
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(found[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)]


def texts(seed, groups=30):
    r = random.Random(seed)
    passage = [f"common{i}" for i in range(40)]
    out = []
    for _ in range(groups):
        words = [f"w{r.randint(0, 10**6)}" for _ in range(r.choice((2, 3, 4, 5, 8, 10, 12, 30, 90, 200)))]
        if r.random() < 0.4:
            words += passage
        out.append(" ".join(words))
        for _ in range(r.randint(0, 8)):  # a chain, whose ends needn't be linked
            words = list(words)
            for _ in range(r.randint(1, 1 + len(words) // 40)):
                k = r.randrange(len(words))
                words[k : k + r.randint(0, 1)] = [f"n{r.randint(0, 10**6)}"] * r.randint(0, 2)
            out.append("  ".join(words).upper() if r.random() < 0.2 else "\n".join(words))
    return out


def components(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "'x' AS digest", "2 AS n", "3 AS h").repartition(3)
    return sorted(map(tuple, partenum.components(df, **kw).collect()), key=str)


@pytest.mark.parametrize("common", [1, 3, 64])
def test_components_equal_all_pairs(spark, monkeypatch, common):
    """Also where nearly all signatures are void, so that the finer enumeration has to find the links."""
    monkeypatch.setattr(partenum, "COMMON", common)
    bodies = texts(common)
    rows = list(enumerate(bodies)) + [(1000, bodies[5]), (1001, bodies[5]), (2000, None), (2001, ""), (2002, " \n"), (None, bodies[7]), (None, "no id here at all"), (3, bodies[9]), (3, bodies[9])]
    random.Random(1).shuffle(rows)
    expected = sorted(plain_components(rows), key=str)
    assert len({c for _, _, c in expected}) < len(rows) - 40
    assert components(spark, rows) == expected


def test_other_similarities_and_batches(spark):
    rows = list(enumerate(texts(9, 15)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for percent in (70, 95):
            assert components(spark, rows, percent=percent) == sorted(plain_components(rows, percent), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_lists_span_batches(spark, monkeypatch):
    """One group of near copies far beyond COMMON, in batches of a few rows."""
    monkeypatch.setattr(partenum, "COMMON", 4)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(base[:k] + [f"own{i}"] + base[k + 1 :])) for i in range(150) for k in [i % 60]] + [(900, " ".join(base[:30]))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        assert components(spark, rows) == sorted(plain_components(rows), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("near", [1, 128])
def test_the_last_pass_reads_only_lists_that_may_have_more_links(spark, monkeypatch, near):
    """Lists that are compared in full and gave no pair aren't dealt out a second time; longer ones are."""
    read, unlike = [], partenum.unlike

    def counted(members, percent, forest):
        read.append(members.count())
        return unlike(members, percent, forest)

    monkeypatch.setattr(partenum, "NEAR", near)
    monkeypatch.setattr(partenum, "unlike", counted)
    r = random.Random(4)
    bodies = texts(64, 20) + [" ".join(["one passage of all"] + [f"u{r.randint(0, 10**6)}" for _ in range(r.randint(8, 14))]) for _ in range(40)]
    rows = list(enumerate(bodies))
    assert components(spark, rows) == sorted(plain_components(rows), key=str)
    assert len(read) == 2 and read[0] > 100 and (near == 1 or read[1] < read[0] / 2)


def test_pairs_of_many_lists_are_told_once(spark, monkeypatch):
    """Sets just too far apart share many lists, of which many have the same members: each pair is told about once, not for each list."""
    told, read, unlike = [], [], partenum.unlike

    def counted(members, percent, forest):
        read.append((members.count(), members.select("row").distinct().count()))
        found = unlike(members, percent, forest)
        told.append((found.count(), found.filter("a IS NOT NULL").select("a", "b").distinct().count()))
        return found

    monkeypatch.setattr(partenum, "unlike", counted)
    r = random.Random(8)
    base = [f"b{i}" for i in range(300)]
    bodies = []
    for k in range(30):
        words = list(base)
        for i in r.sample(range(0, 300, 10), 3):  # of 297 shingles each differs in about 12, two in about 24
            words[i] = f"own{k}-{i}"
        bodies.append(" ".join(words + [f"end{k}-{i}" for i in range(15)]))
    rows = list(enumerate(bodies))
    assert components(spark, rows) == sorted(plain_components(rows), key=str)
    assert read[0][1] >= 20 and told[-1][1] >= 20
    assert told[-1][0] <= 8 * told[-1][1]


def test_lists_with_the_same_members_are_kept_once(spark, monkeypatch):
    monkeypatch.setattr(partenum, "COMMON", 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    lists = [[1, 2], [1, 2], [1, 2, 3], [2, 3], [1, 2, 3], [7], list(range(20, 32)), list(range(20, 32))]
    df = spark.createDataFrame([(s, row, row + 100) for s, rows in enumerate(lists) for row in rows], "sig long, row long, n long")
    try:
        for common in (4, None):
            found = partenum.lists(df, common).filter("pivot <> row")
            kept = {}
            for sig, pivot, n_pivot, row, n in partenum.single(found).collect():
                assert (n_pivot, n) == (pivot + 100, row + 100)
                kept.setdefault((sig, pivot), []).append(row)
            short = [(p, *sorted(x)) for (_, p), x in kept.items() if p < 20]
            assert sorted(short) == [(1, 2), (1, 2, 3), (2, 3)]
            long = [(p, *sorted(x)) for (_, p), x in kept.items() if p >= 20]
            assert set(long) == (set() if common else {tuple(range(20, 32))})
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table_and_very_long_texts(spark):
    assert components(spark, []) == []
    long = [f"v{i}" for i in range(30_000)]
    rows = [(7, " ".join(long)), (5, " ".join(long[:-2000])), (6, " ".join(long[: len(long) // 2])), (8, "x")]
    assert components(spark, rows) == [(5, 27997, 5), (6, 14997, 6), (7, 29997, 5), (8, 1, 8)]


@pytest.mark.parametrize("percent", [60, 85, 95])
def test_linked_sets_share_signatures(percent):
    r = np.random.default_rng(percent)
    for _ in range(300):
        n = int(r.integers(2, 400))
        both = r.integers(0, 2**64, n, np.uint64)
        drop, add = int(r.integers(0, 1 + n // 8)), int(r.integers(0, 1 + n // 8))
        a, b = np.unique(both), np.unique(np.concatenate([both[drop:], r.integers(0, 2**64, add, np.uint64)]))
        same = len(np.intersect1d(a, b))
        if 100 * same < percent * (len(a) + len(b) - same) or len(a) == same == len(b):
            continue
        larger = max(len(a), len(b))
        i = next(i for i in partenum.instances(larger, percent) if i.low <= larger <= i.high)
        assert len(a) + len(b) - 2 * same <= i.k

        def of(found):
            return found[found >> partenum.BITS == i.number]

        shared = np.intersect1d(of(partenum.signatures(a, percent)), of(partenum.signatures(b, percent)))
        assert len(shared) > i.spare
        assert len(np.intersect1d(partenum.finer(a, percent, {i.number}), partenum.finer(b, percent, {i.number})))


def test_sketches_are_short_and_tell_sets_apart():
    r = np.random.default_rng(3)
    for n in (5, 200, 512, 513, 3000):
        x = np.unique(r.integers(0, 2**64, n, np.uint64))
        near = np.unique(np.concatenate([x[n // 20 :], r.integers(0, 2**64, n // 20, np.uint64)]))
        far = np.unique(r.integers(0, 2**64, n, np.uint64))
        assert len(partenum.sketch(x)) <= max(32, n // 8)
        assert partenum.apart(partenum.sketch(x), partenum.sketch(near)) <= len(np.setxor1d(x, near))
        assert n < 50 or 185 * partenum.apart(partenum.sketch(x), partenum.sketch(far)) > 15 * 2 * n


def test_sizes_of_bands():
    for percent in (50, 85, 99):
        for n in range(1, 700):
            for m in range(-(-percent * n // 100), n + 1):
                own = {i.number: i for i in partenum.instances(n, percent)}
                other = {i.number: i for i in partenum.instances(m, percent)}
                both = [i for k, i in own.items() if k in other and i.low <= n <= i.high]
                k = (n + m) * (100 - percent) // (100 + percent)
                assert both and both[0].k >= k or k == 0 or k < n - m
