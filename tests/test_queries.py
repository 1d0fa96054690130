"""Every query with SQL against DuckDB on the smallest tables, as the driver compares them."""

import os

import duckdb
import pytest

import __spark_entry__
from pairsight.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(str, df.where(df.notna(), None).astype(object).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(name, spark, sf_dir, duck):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"cropResistant", "colorMoment", "marrHildreth", "msTemplate"}))
def test_runs(name, spark, sf_dir):
    out = QUERIES[name](spark, sf_dir).toPandas()
    assert len(out) > 0
    if "error" in out:
        assert out["error"].isna().all()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_sources_name_no_local_paths():
    for root, _, files in os.walk(os.path.dirname(__spark_entry__.__file__) + "/pairsight"):
        for f in files:
            if f.endswith(".py"):
                assert "localCheckpoint" not in open(os.path.join(root, f)).read()
