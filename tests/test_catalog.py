import pytest
from oracle import assert_same

from haulframe.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert_same(catalog.queries()[name](spark, sf_dir), catalog.oracle_sql()[name], sf_dir)


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 50


def test_scans_are_pruned_and_filtered(spark, sf_dir):
    plan = catalog.queries()["delivery_board"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
    assert "l_comment" not in plan.split("== Physical Plan ==")[1]
