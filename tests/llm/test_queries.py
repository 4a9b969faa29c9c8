import re

import pytest

import __spark_entry__
from quillmine.checks.compare import compare
from quillmine.llm import queries
from tests.llm.conftest import SF


def test_every_operator_has_one_query():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()
    assert set(queries.ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", list(queries.ORACLES))
@pytest.mark.parametrize("folder", [SF, SF.replace("0.001", "0.01")])
def test_query_equals_its_sql(spark, name, folder):
    assert compare(queries.QUERIES[name](spark, folder), queries.ORACLES[name], folder) == ""
