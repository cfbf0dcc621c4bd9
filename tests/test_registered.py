"""Every registered query against its SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

from conftest import ROOT

TABLES = Path("/root/testdata/sf0.001")
sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as registered  # noqa: E402

pytestmark = pytest.mark.skipif(not TABLES.is_dir(), reason="the tables are not here")


@pytest.fixture(scope="module")
def db():
    import compare

    return compare.views(TABLES)


@pytest.mark.parametrize("name", registered.queries())
def test_query_agrees_with_sql(spark, db, name):
    import compare

    rows, _, difference = compare.compare(spark, db, str(TABLES), name)
    assert difference is None
    assert rows > 0


def test_every_sql_has_a_query():
    assert registered.oracle_sql().keys() <= registered.queries().keys()


def test_entry(spark):
    assert registered.entry(spark).count() == 10
