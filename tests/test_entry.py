"""Every registered query against its SQL, on the smallest tables."""

import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as entry
from terracell.plans import queries as observations

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notnull(), None)
    return sorted((tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(observations.SQL))
def test_query_equals_sql(spark, tables, name):
    mine = observations.QUERIES[name](spark, DATA).toPandas()
    other = tables.execute(observations.SQL[name]).fetchdf()
    assert sorted(mine.columns) == sorted(other.columns)
    assert rows(mine) == rows(other)


@pytest.mark.parametrize("name", sorted(set(observations.QUERIES) - set(observations.SQL)))
def test_query_runs(spark, name):
    assert observations.QUERIES[name](spark, DATA).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_guard_tells_what_is_there():
    assert entry._present("terracell.plans.queries")
    assert not entry._present("terracell.nothing.at_all")
    assert bool(entry._corpus()) == (importlib.util.find_spec("terracell.llm") is not None and entry._present("terracell.llm.registry"))


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
