"""Each query of the library against its DuckDB counterpart."""

import os

import duckdb
import pandas as pd
import pytest

from commentscan.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame):
    plain = lambda v: None if pd.isna(v) else v.item() if hasattr(v, "item") else v
    return sorted(repr([plain(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False))


def expected(sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con.execute(sql).df()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    got, sql = registry.queries()[name](spark, SF).toPandas(), registry.oracle_sql().get(name)
    if sql is None:  # tested on its own
        assert len(got)
        return
    want = expected(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_flagship(spark):
    done = registry.queries()["flag_by_threshold"](spark, "/root/testdata/sf0.001").toPandas()
    assert done["n_flagged"].sum() == 35 and done["n_docs"].sum() == 200
