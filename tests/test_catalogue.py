"""Every registered query against its oracle on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tracelake.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*' if os.path.isdir(p) else p}')")
    return con


def norm(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.queries()[name](spark, sf_dir)
    want = duck.sql(catalogue.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert norm(map(tuple, df.select(*cols).collect())) == norm(tuple(r[i] for i in at) for r in want.fetchall())


def test_entry(spark):
    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
