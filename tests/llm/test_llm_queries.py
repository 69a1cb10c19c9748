import os

import oracle
import pytest

from pagelode.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    oracle.same(QUERIES[name](spark, SF), ORACLES[name], oracle.connected(SF))


def test_registered():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {name.split("_")[0] for name in QUERIES} and "pipeline" in QUERIES
