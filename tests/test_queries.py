import os

import oracle
import pytest

from pagelode.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connected(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    oracle.same(QUERIES[name](spark, SF), ORACLES[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0


def test_entry_without_the_training_data_part(spark, monkeypatch):
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "pagelode.llm", None)
    assert set(__spark_entry__.queries()) == set(QUERIES)
    assert set(__spark_entry__.oracle_sql()) == set(ORACLES)
    assert "gated_label" in __spark_entry__.entry(spark).columns
