"""Every core query against its SQL on the smallest tables."""

import pytest

from skein.plans import core_problems, network_queries
from tests.compare import same

CASES = [(n, m) for m in (network_queries, core_problems) for n in m.QUERIES]


@pytest.mark.parametrize("name,module", CASES, ids=[n for n, _ in CASES])
def test_query(spark, name, module):
    same(spark, module.QUERIES[name], module.SQL[name])
