"""Every general query with SQL against DuckDB over the smallest tables."""

import os

import duckdb
import pytest

from corpusloom import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings raw_answers scenarios augmentation_context intents source_targets".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{data}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio"):
        return round(float(v), 5)
    return repr(v)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_against_sql(spark, data, duck, name):
    df = Q.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    r = duck.execute(Q.SQL[name])
    at = [x[0] for x in r.description]
    assert sorted(at) == cols
    want = sorted((tuple(plain(row[at.index(c)]) for c in cols) for row in r.fetchall()), key=repr)
    assert sorted((tuple(plain(row[c]) for c in cols) for row in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, data, name):
    assert Q.QUERIES[name](spark, data).count() >= 0
