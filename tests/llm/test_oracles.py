"""The operators' queries against their SQL over the whole small tables."""

import os

import pytest

from tests.test_oracles import SF, duck, rows  # noqa: F401
from tidemark.llm.queries import ORACLE_SQL, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, duck, name):  # noqa: F811
    df = QUERIES[name](spark, SF)
    other = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(other.columns)
    assert rows(df.columns, df.collect()) == rows(other.columns, other.fetchall())
