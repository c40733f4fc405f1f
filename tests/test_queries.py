"""Every query of the graph engine against its SQL."""

import oracle
import pytest

from weftspark.plans import registry


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, sf_dir, name):
    assert oracle.difference(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], sf_dir) == ""


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
