import __spark_entry__ as e
import pytest
from compare import compare

SF = "/root/testdata/sf0.001"
CORE = [n for m in e._modules() if ".llm" not in m.__name__ for n in m.queries()]


def test_entry(spark):
    assert e.entry(spark).columns


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, name):
    ok, said = compare(spark, SF, name, e.queries()[name], e.oracle_sql().get(name))
    assert ok, said
