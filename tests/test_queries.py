"""The queries against their DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from docveil.plans.oracles import SQL
from docveil.plans.queries import queries

SF = "/root/testdata/sf0.001"
TABLES = "nation customer orders lineitem documents".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(queries()) == set(SQL)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["lines", "global_offsets", "resolve_overlaps", "document_entities", "placeholder_key", "anonymized_text", "detect_cases", "recall_by_type", "detect_identities", "highlighted_html", "key_csv", "placeholder_cases", "splice_overlaps", "evaluate_cases", "find_runs"])
def test_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    q = duck.execute(SQL[name])
    at = [[d[0] for d in q.description].index(c) for c in cols]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in q.fetchall())
