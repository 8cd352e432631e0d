import os

import pytest

from corpusloom import plans

from .oracle import both

SF = "/root/testdata/sf0.01"
SQL = plans.oracle_sql()


@pytest.mark.skipif(not os.path.exists(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    got, want = both(spark, SF, plans.queries()[name], SQL[name])
    assert got == want
