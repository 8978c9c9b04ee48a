"""Queries against their SQL twins over whole tables."""

import oracle
import pytest

from bidspan.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_twin(spark, name):
    found = oracle.compare(spark, oracle.duck(SF), name, queries.QUERIES[name], queries.ORACLE[name], SF)
    assert found["ok"], found
