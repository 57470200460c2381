"""Every llm query that SQL can express against its SQL, the others for rows, on the smallest tables."""

import pytest

from skein.llm import queries
from tests.compare import SF, same


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    if name in queries.SQL:
        same(spark, queries.QUERIES[name], queries.SQL[name])
    else:
        assert queries.QUERIES[name](spark, SF).count() > 0
