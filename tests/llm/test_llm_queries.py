"""The dealt queries with SQL against DuckDB over whole tables."""

from __future__ import annotations

import pytest

from proofmill.llm import queries
from tests.conftest import DATA, answers, rows_of


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):  # noqa: ANN001, ANN201
    got = queries.QUERIES[name](spark, DATA)
    names, expected = answers(queries.ORACLES[name])
    assert sorted(got.columns) == names
    assert rows_of(got) == expected
