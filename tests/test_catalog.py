"""Every query with SQL gives the SQL's rows."""

import pytest

from tidegrid.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    return value.isoformat()[:19] if hasattr(value, "isoformat") else str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    cursor = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(tuple(map(plain, row)) for row in cursor.fetchall())
    assert sorted(tuple(map(plain, row)) for row in got.select(*columns).collect()) == want
