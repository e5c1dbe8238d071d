"""Every query against its SQL text on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_matches_sql(spark, con, name):
    df = entry_module.queries()[name](spark, SF_DIR)
    result = con.execute(entry_module.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.collect(), df.columns) == rows_of(result.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(entry_module.queries()) - set(entry_module.oracle_sql())))
def test_rows_only(spark, name):
    assert entry_module.queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["q_image", "rank", "r_image", "score"]
    assert df.count() > 0
