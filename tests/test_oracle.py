"""Every registered query against its SQL twin, over whole tables."""

import pytest

import __spark_entry__ as entry_point
from tests.oracle import compare, connect
from wardflow.bindings import catalog

QUERIES = {name: catalog.bound(name) for name in catalog.QUERIES}
CHECKS = {name: catalog.check_sql(name) for name in catalog.CHECKS}


#: Queries whose rows only the larger folders have.
NO_ROWS_HERE: set[str] = set()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_query_has_sql():
    assert set(QUERIES) == set(CHECKS)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_same_rows(spark, con, folder, name):
    df = QUERIES[name](spark, folder)
    assert compare(df, con, CHECKS[name]) is None
    if name not in NO_ROWS_HERE:  # nothing against nothing proves nothing
        assert con.execute(f"SELECT count(*) FROM ({CHECKS[name]})").fetchone()[0] > 0


def test_entry_runs(spark):
    df = entry_point.entry(spark)
    assert df.columns[:2] == ["siDoctor", "DoctorName"] and df.count() > 0


def test_entry_registers_all():
    assert set(QUERIES) <= set(entry_point.queries()) and set(CHECKS) <= set(entry_point.oracle_sql())
