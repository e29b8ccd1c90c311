"""Every query of the reference's own operators against DuckDB over whole tables, where SQL can express it."""

from __future__ import annotations

import pytest

from proofmill import registry
from tests.conftest import DATA, answers, rows_of


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):  # noqa: ANN001, ANN201
    got = registry.QUERIES[name](spark, DATA)
    rows = rows_of(got)
    if name not in registry.ORACLES:
        assert rows, "a query without SQL must at least give rows; its own test compares it with brute force"
        return
    names, expected = answers(registry.ORACLES[name])
    assert sorted(got.columns) == names
    assert rows == expected


def test_every_oracle_has_a_query():  # noqa: ANN201
    assert set(registry.ORACLES) <= set(registry.QUERIES)
