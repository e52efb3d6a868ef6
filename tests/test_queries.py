from functools import partial

import duckdb
import pytest

import __spark_entry__ as entry
from tapewise.operators import models
from tests.conftest import SMALL
from tools import check


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in check.TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return connection


@pytest.fixture(scope="module", autouse=True)
def few_trees():
    """The reference SQL of tree queries holds for any number of trees; a few take less time than 300."""
    whole = models.Settings
    models.Settings = partial(whole, trees=5)
    yield
    models.Settings = whole


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_reference_sql(spark, con, name):
    state, note, _ = check.compare(spark, con, name, SMALL)
    assert state == "ok", note


def test_entry_has_one_row_per_ticker(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == len({r["ticker"] for r in rows}) > 0


def test_every_reference_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
