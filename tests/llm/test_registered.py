"""Every registered query with SQL gives the same rows as it."""

import pytest
from oracle import assert_same

from haulframe.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert_same(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], sf_dir)


def test_all_are_registered():
    assert [n for i in range(1, 11) for n in registry.queries() if n.startswith(f"op{i}_")].__len__() == 10
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()
