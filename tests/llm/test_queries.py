"""Registered queries against their SQL, on the smallest tables."""

import pytest

from foliospark.llm import queries

from .. import oracle


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, sf_dir, name):
    oracle.same(spark, sf_dir, queries.QUERIES[name], queries.SQL[name])
