"""Every registered query of the library proper against its SQL, and the rules that bind the registry."""

import os

import compare
import pytest
from gleanery.plans import all_queries, all_sql

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the shared tables")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query_gives_its_sql_rows(spark, con, name):
    assert compare.query_rows(all_queries()[name](spark, SF)) == compare.sql_rows(con, all_sql()[name])


def test_entry_runs_without_the_training_text_operators(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(all_queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
