"""Every registered query runs, and equals its SQL where it has one."""

import datetime
import decimal
import math
import pathlib

import duckdb
import pytest

from lodemill import registry

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in pathlib.Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, int):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 6)
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, oracle, name):
    got = registry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    assert rows
    if name in registry.oracle_sql():
        want = oracle.sql(registry.oracle_sql()[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert rows == sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=str)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_reads_the_given_tables(spark, tmp_path):
    """No query can be built where there are no tables."""
    built = []
    for name, function in registry.queries().items():
        try:
            function(spark, str(tmp_path / "missing"))
            built.append(name)
        except Exception as e:  # noqa: BLE001
            assert "PATH_NOT_FOUND" in str(e) or "TABLE_OR_VIEW_NOT_FOUND" in str(e), name
    assert not built
