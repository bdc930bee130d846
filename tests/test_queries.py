"""Every core query against its SQL, on the smallest tables; the others must run and keep their columns."""

import oracle
import pytest

from quern import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return oracle.connect(data)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, data, con, name):
    pdf = catalog.queries()[name](spark, data).toPandas()
    if name in SQL:
        assert oracle.compare(con, pdf, SQL[name]) == ""
    else:
        assert len(pdf.columns) > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
