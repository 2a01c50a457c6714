"""Training-data queries with SQL against DuckDB over the smallest tables."""

import duckdb
import pytest

from corpusloom.llm import queries as Q

TABLES = "documents raw_answers scenarios augmentation_context intents source_targets".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_against_sql(spark, data, duck, name):
    df = Q.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    r = duck.execute(Q.SQL[name])
    at = [x[0] for x in r.description]
    assert sorted(at) == cols
    want = sorted((tuple(row[at.index(c)] for c in cols) for row in r.fetchall()), key=repr)
    assert sorted((tuple(row[c] for c in cols) for row in df.collect()), key=repr) == want


def test_splits_meet_their_conditions(spark, data):
    """Sets stay together and shares come out as near as whole sets allow; there are many right answers, so no SQL."""
    from corpusloom.llm import splits
    from corpusloom.session import table

    rows = splits.assign_splits(table(spark, data, "augmentation_context")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.set_id, set()).add(r.split_new)
    assert rows and all(len(x) == 1 for x in by.values()) and {r.split_new for r in rows} <= {"train", "val", "test"}
