"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from loomscore import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows):
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = canonical(df.select(*columns).collect())
    assert rows
    if name in queries.SQL:
        cursor = duck.execute(queries.SQL[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        assert rows == canonical([tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()])


def test_flagship(spark):
    row = queries.flagship(spark, SF).collect()
    assert {r["condition"] for r in row} == {"full_mcq", "target_only_mcq"} and all(r["ok"] == r["denominator"] for r in row)


@pytest.mark.parametrize("name", ["parse_qa_alias", "review_queue"])
def test_the_rosters_aliases_are_worked_out_once(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("flatten(") == 1 and plan.count("regexp_replace(") == 1


def test_the_review_queue_has_all_unmapped_answers(spark):
    ids = {r["ordinal"]: r["parse_status"] for r in queries.parse_qa_alias(spark, SF).collect()}
    log = queries.views.responses(spark, SF).collect()
    names = sorted((f"{r['item_id']}:{r['condition']}:{r['payload_hash'][:8]}", r["raw_text"]) for r in log if ids[r["ordinal"]] == "unmapped")
    assert names and sorted((r["review_id"], r["raw_text"]) for r in queries.review_queue(spark, SF).collect()) == names
