"""Queries of the subpackage on the smallest tables: against SQL where there is some."""

import os

import pytest

from notefold.llm import queries as Q
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, name):
    compare(spark, FOLDER, Q.queries()[name], Q.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_runs_and_repeats_no_row(spark, name):
    got = [tuple(r) for r in Q.queries()[name](spark, FOLDER).collect()]
    assert len(set(got)) == len(got)
