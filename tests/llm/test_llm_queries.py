from __future__ import annotations

import pytest

import compare
from codelens.llm import oracle
from codelens.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", oracle.build())
def test_query_equals_sql(spark, connection, name):
    assert compare.difference(QUERIES[name](spark, FOLDER), connection, oracle.build()[name]) is None
