"""Queries of this subpackage against their SQL."""

from __future__ import annotations

import pytest
from compare import by_spark, by_sql

from sagebrook.llm.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf_dir, name):
    assert by_spark(QUERIES[name](spark, sf_dir)) == by_sql(ORACLE_SQL[name], sf_dir)
