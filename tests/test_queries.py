import pytest

from tests.oracle import actual, expected
from tidemill import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    found = actual(queries.queries()[name](spark, SF))
    if name in queries.oracle_sql():
        assert found == expected(SF, queries.oracle_sql()[name])
    else:
        assert found[1]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
