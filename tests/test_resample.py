"""Replicates by weights against explicit copies of the clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomscore.operators import pairs, resample


def explicit(sizes, n_boot, seed):
    """Draws as (replicate, part, place) lists, from the counts of each part."""
    out = [[] for _ in range(n_boot)]
    for part, m in enumerate(sizes):
        got = resample.counts(m, resample.share(sizes, part, n_boot, seed), part, seed) if m else np.zeros((n_boot, 0), int)
        for b in range(n_boot):
            for i, times in enumerate(got[b]):
                out[b] += [(part, i)] * int(times)
    return out


@pytest.mark.parametrize("sizes", [[1], [7], [3, 0, 5, 9], [40] * 33])
def test_each_replicate_draws_as_many_as_there_are(sizes):
    assert {len(x) for x in explicit(sizes, 20, 3)} == {sum(sizes)}


def test_draws_are_even():
    """Counts of a cluster have the mean and variance of multinomial draws, in one part and in many."""
    for sizes in ([64], [16, 8, 40]):
        n, boots = 64, 6000
        got = np.concatenate([resample.counts(m, resample.share(sizes, p, boots, 1), p, 1) for p, m in enumerate(sizes)], axis=1)
        assert np.allclose(got.mean(0), 1, atol=0.08) and np.allclose(got.var(0), 1 - 1 / n, atol=0.12)
        assert abs(np.corrcoef(got[:, 0], got[:, -1])[0, 1] + 1 / (n - 1)) < 0.05


def test_chunks_do_not_change_counts():
    draws = resample.share([30, 12], 1, 50, 9)
    whole = resample.counts(12, draws, 1, 9)
    assert (np.concatenate([resample.counts(12, draws[a : a + 7], 1, 9, a) for a in range(0, 50, 7)]) == whole).all()


def scored(spark, n=300):
    """Rows whose pairs lie within a cluster, across clusters, and with repeats on one side."""
    rows = []
    for i in range(n):
        ids = [f"s{i // 2 % 40}:a~b", f"s{i % 17}:b~a"] if i % 5 else []
        rows.append((f"i{i}", f"c{i % 23}" if i % 29 else None, "ab"[i % 2], "xyz"[i % 3], "e1", "e1" if i % 7 < 4 else "e2", ids, None, i))
    return rows, spark.createDataFrame(rows, "item_id string, cluster string, version string, condition string, gold_entity_id string, predicted_entity_id string, pair_ids array<string>, pair_id string, ord long").withColumn("parse_status", F.lit("ok"))


def consistency(rows):
    """Plainly, over explicit copies: (draw, row) pairs."""
    groups = {}
    for draw, r in rows:
        for pid in r[6]:
            groups.setdefault((draw, pid), []).append(r)
    both = n = 0
    for (_, pid), members in groups.items():
        a, b = pid.split(":")[1].split("~")
        x, y = [r for r in members if r[2] == a], [r for r in members if r[2] == b]
        if len(x) == len(y) == 1:
            n, both = n + 1, both + (x[0][4] == x[0][5] and y[0][4] == y[0][5])
    return both / n if n else None


def difference(rows):
    items = {}
    for draw, r in rows:
        if r[3] in "xy":
            items.setdefault((draw, r[0][:2]), {})[r[3]] = int(r[4] == r[5])
    d = [v["x"] - v["y"] for v in items.values() if len(v) == 2]
    return sum(d) / len(d) if d else None


def macro(rows):
    by = {}
    for _, r in rows:
        by.setdefault(r[3], []).append(r[4] == r[5])
    return sum(sum(v) / len(v) for v in by.values()) / len(by)


@pytest.mark.parametrize("whole", [4096, 4])
@pytest.mark.parametrize("name", ["consistency", "paired", "macro"])
def test_statistics_equal_explicit_copies(spark, monkeypatch, whole, name):
    monkeypatch.setattr(resample, "WHOLE", whole)
    rows, df = scored(spark)
    df = df.withColumn("item_id", F.substring("item_id", 1, 2))
    statistic, plain = {"consistency": (resample.consistency(), consistency), "paired": (resample.paired_items("x", "y", "ord"), difference), "macro": (resample.macro_accuracy("condition"), macro)}[name]
    clusters = {}
    for r in rows:
        clusters.setdefault(r[1] or "None", []).append(r)
    names = sorted(clusters)
    if whole > 4:
        parts = {0: names}
        sizes = [len(names)]
    else:
        import hashlib

        parts = {}
        for c in names:
            parts.setdefault(int(hashlib.md5(c.encode()).hexdigest()[:3], 16), []).append(c)
        sizes = [len(parts.get(p, [])) for p in range(4096)]
    drawn = [[] for _ in range(30)]
    for p, own in parts.items():
        got = resample.counts(len(own), resample.share(sizes, p, 30, 5), p, 5)
        for b in range(30):
            for i, times in enumerate(got[b]):
                drawn[b] += [own[i]] * int(times)
    values = [plain([(k, r) for k, c in enumerate(d) for r in clusters[c]]) for d in drawn]
    found = resample.bootstrap(df, "cluster", statistic, n_boot=30, seed=5, alpha=0.1).first()
    real = [v for v in values if v is not None]
    assert found["point"] == pytest.approx(plain([(None, r) for r in rows]))
    assert (found["n_rows"], found["n_clusters"], found["n_boot"], found["n_undefined"]) == (len(rows), len(names), 30, len(values) - len(real))
    assert [found["ci_low"], found["ci_high"]] == pytest.approx([np.percentile(real, 5), np.percentile(real, 95)])


def test_plan_moves_one_row_a_replicate_and_task(spark):
    """No join of clusters and replicates: what is exchanged are clusters' sums and, after a partial sum, replicates."""
    _, df = scored(spark)
    found = resample.bootstrap(df, "cluster", resample.accuracy(), n_boot=50)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan and "Generate" not in plan
    assert found.first()["n_boot"] == 50


def test_no_rows(spark):
    _, df = scored(spark)
    for statistic in (resample.accuracy(), resample.consistency(), resample.macro_accuracy("condition")):
        assert tuple(resample.bootstrap(df.limit(0), "cluster", statistic).first()) == (None, None, None, 0, 0, 0, 0)


def test_pairs_keep_their_cluster(spark):
    """One cluster with both sides of a pair, drawn as often as may be, has that pair in each copy and no other."""
    _, df = scored(spark)
    one = df.filter("cluster = 'c0'")
    n = pairs.complete(pairs.pair_consistency(one)).count()
    summed = resample.consistency().summed(one.withColumn("__c", F.lit("c0")), ("__c",)).first()
    assert summed["n"] == n
