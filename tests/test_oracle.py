"""Every registered query runs; those with SQL give the oracle's rows."""

import pytest
from compare import difference

from workload import QUERIES, Tables

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    q = QUERIES[name]
    df = q.run(Tables(spark, FOLDER))
    if q.sql:
        assert difference(df, FOLDER, q.sql) is None
    else:
        assert df.count() > 0
