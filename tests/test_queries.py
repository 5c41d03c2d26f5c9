"""Every registered query against its SQL on the smallest driver tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, TYPES, rows
from fathomline.checks.oracles import ORACLES
from fathomline.checks.queries import REGISTERED

# Tested against dense or exact computations of their own.
BEYOND_SQL = {"embed_fitted", "ivf_codes_recall"}
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(REGISTERED))
def test_query(spark, db, name):
    df = REGISTERED[name](spark, SF)
    got = rows(df.columns, df.collect())
    assert got or name in ("wrong_dims",)
    if name not in ORACLES:
        assert name in BEYOND_SQL
        return
    result = db.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    kinds = {c[0]: str(c[1]) for c in result.description}
    assert sorted(columns) == sorted(df.columns)
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema.fields} == kinds
    assert got == rows(columns, result.fetchall())


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
