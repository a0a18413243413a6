"""Every registered query against its SQL in DuckDB."""

import __spark_entry__ as entry
import duckdb
import pytest
from claimlens.plans import pages, registry, views  # noqa: F401

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if x is None or x != x else str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x).removesuffix(" 00:00:00") for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query(spark, db, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), db.execute(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
