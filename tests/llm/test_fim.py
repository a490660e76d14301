"""Fill-in-middle against plain Python, and the way back."""

import hashlib
import random
import re

import pytest

from loomscore.llm import fim


def plain(doc_id, text, percent=90, spm=20, pattern=None):
    text = text or ""
    units = re.findall(pattern, text) if pattern else list(text)
    n, digest = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent or "".join(units) != text:
        return n, "plain", None, None, text
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    r = random.Random(4)
    marks = ["a", "b ", "\n", "é", "日", "😀", "é", "<", "P>", "S", ">", "<S", "\r\n", " ", "$1", "\\"]
    out = ["".join(r.choice(marks) for _ in range(r.randint(1, 40))) for _ in range(150)]
    return out + [None, "", "<P>", "x<M>y", "<P", "<<S>", "z" * 3000, "😀" * 1024, "ab" * 512 * 7, "q\n" * 40_000]


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_forms_equal_plain_python(spark, block):
    rows = [*enumerate(texts()), (None, "no id here"), (5, "again"), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'old' AS form", "1 AS other")
    got = fim.arranged(df, block=block).withColumn("back", fim.restored()).collect()
    assert set(got[0].asDict()) == {"doc_id", "text", "other", "n", "form", "prefix_units", "middle_units", "output", "back"}
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(((r["doc_id"], r["text"], (r["n"], r["form"], r["prefix_units"], r["middle_units"], r["output"])) for r in got), key=key) == sorted(((d, t, plain(d, t)) for d, t in rows), key=key)
    assert all(r["back"] == (r["text"] or "") for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_units_of_words_and_texts_they_do_not_cover(spark):
    words = r"\s*\S+\s*"
    rows = [(i, " ".join(f"w{j}" for j in range(i))) for i in range(40)] + [(41, " \n "), (42, "two\nlines here ")]
    got = fim.arranged(spark.createDataFrame(rows, "doc_id long, text string"), unit=words, block=4, percent=100).withColumn("back", fim.restored())
    by = {r["doc_id"]: r for r in got.collect()}
    for d, t in rows:
        assert tuple(by[d][c] for c in ("n", "form", "prefix_units", "middle_units", "output")) == plain(d, t, 100, pattern=words), t
        assert by[d]["back"] == t
    assert by[41]["form"] == "plain"


def test_percentages(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "'some text' AS text")
    n = {(p, s): dict(fim.arranged(df, percent=p, spm_percent=s).groupBy("form").count().collect()) for p, s in ((0, 20), (100, 100), (50, 0), (90, 20))}
    assert n[0, 20] == {"plain": 4000} and n[100, 100] == {"spm": 4000} and set(n[50, 0]) == {"plain", "psm"}
    assert 3450 < n[90, 20]["psm"] + n[90, 20]["spm"] < 3750 and 600 < n[90, 20]["spm"] < 850


def test_empty_table_and_no_python(spark):
    empty = fim.arranged(spark.createDataFrame([], "doc_id long, text string")).withColumn("back", fim.restored())
    assert empty.count() == 0
    plan = empty._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("bad", [("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("<", "<S>", "<M>")])
def test_sentinels_that_cannot_be_found_again(bad):
    with pytest.raises(ValueError, match="sentinels"):
        fim.checked(bad)
