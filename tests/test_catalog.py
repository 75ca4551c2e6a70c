"""Every registered query of the reference's operators against its SQL, on the smallest tables."""

import pytest
from conftest import same_rows

from gazeflow.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, small, name):
    got = catalog.queries()[name](spark, small).toPandas()
    if name in catalog.oracle_sql():
        same_rows(got, duck.execute(catalog.oracle_sql()[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
