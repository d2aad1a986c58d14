"""Every registered query that SQL can express, against DuckDB."""

import pytest

from hearthstat.llm import registry
from tests import compare


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    assert compare.differences(df, compare.connect(sf_dir), registry.oracle_sql()[name]) == []


def test_all_thirteen_are_registered():
    assert [int(n[2:].split("_")[0]) for n in registry.queries()] == list(range(1, 14))
