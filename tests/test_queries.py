import pytest

from conftest import DATA, canonical
from graphloom.plans import all as plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    found = plans.QUERIES[name](spark, DATA).toPandas()
    if name not in plans.SQL:
        assert len(found) > 0
        return
    wanted = duck.sql(plans.SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert canonical(found) == canonical(wanted)


def test_entry_module_matches_registry():
    import __spark_entry__ as entry

    assert set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
