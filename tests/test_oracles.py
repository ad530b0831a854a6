"""Every query of the library on the smallest tables, against DuckDB where it has SQL."""

import os

import duckdb
import pytest

from concordia.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
#: Queries whose result may be empty on tables this small.
MAY_BE_EMPTY = {"link_overlap", "join_as_of", "recall_unread", "graph_orphans", "join_point_in_span"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        path = os.path.join(FOLDER, name)
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value if value is None else str(value)


def table(columns, rows):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return order, sorted(([plain(r[k]) for k in at] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, FOLDER)
    got = table(found.columns, found.collect())
    assert got[1] or name in MAY_BE_EMPTY, "no rows: the comparison would say nothing"
    if name in ORACLES:
        cursor = duck.execute(ORACLES[name])
        assert got == table([d[0] for d in cursor.description], cursor.fetchall())


def test_entry_registers_everything():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
