"""Every query of the engine over the driver's tables, against its SQL where it has one."""

import pytest
from conftest import SF

from compare import same
from marlstone.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        same(df, duck.execute(ORACLE_SQL[name]))
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
