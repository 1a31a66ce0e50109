"""Every registered query of the core library that has SQL against that SQL on another engine."""

import pytest
from conftest import SF, same_rows

from trivane.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    a, b = same_rows(QUERIES[name](spark, SF), duck.execute(ORACLES[name]))
    assert a == b


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
