import pytest
from compare import FOLDER, differs

from tesselwork.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert differs(catalog.QUERIES[name](spark, FOLDER), catalog.ORACLES[name]) == ""
