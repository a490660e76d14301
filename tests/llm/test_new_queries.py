"""The registered queries of repair, joins and fill-in-middle against their SQL, on small tables."""

import os

import duckdb
import pytest

from loomscore.llm import queries

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if int(n[2:].split("_")[0]) > 10])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted(map(repr, found.fetchall()))
    assert len(expected) > 50
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == expected
