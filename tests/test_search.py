"""Keyword search and pages of stored lists, against plain loops."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from proofmill.operators import ledger, lint, paging, postings

WORDS = ["Ann", "ann_b", "50%", "a\\b", "论文", "Éa", "éa", "x\ny", "𝒳𝒴z", "", "ab", "b", "\0", "CAB", "cabin"]
KEYWORDS = ["ann", "AN", "a", "%", "_", "b%n", "a_n", "论", "论文题", "É", "é", "\\", "x_y", "𝒴", "𝒳𝒴z", "", "\0", "nothing", "ann%ann", "%%ab%", "cab"]


def like(text: str | None, keyword: str) -> bool:
    """LIKE with the keyword anywhere, A-Z as a-z."""
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    pattern = "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in low(keyword))
    return text is not None and re.search(pattern, low(text), re.S) is not None


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):  # noqa: ANN001, ANN201
    rng = random.Random(4)
    text = lambda: rng.choice([None, " ".join(rng.choices(WORDS, k=rng.randrange(4)))])
    rows = [(i, text(), text(), "clash") for i in range(1500)] + [(7, "Ann", "Ann", "again")] * 2
    df = spark.createDataFrame(rows, "id int, a string, b string, _row string")
    return rows, df, postings.Index.build(df, ["a", "b"], ["id"], str(tmp_path_factory.mktemp("index") / "i"), 6)


def test_keywords(indexed):  # noqa: ANN001, ANN201
    rows, df, index = indexed
    for k in KEYWORDS:
        want = sorted((i, repr(a), repr(b)) for i, a, b, _ in rows if like(a, k) or like(b, k))
        assert sorted((r.id, repr(r.a), repr(r.b)) for r in index.search(k).collect()) == want, k
        assert df.where(postings.matches(["a", "b"], k)).count() == len(want), k
        found = index.candidates(k)
        assert found is None or found.distinct().count() == found.count() >= len(want)


def test_parts_without_candidates_are_not_read(spark, tmp_path):  # noqa: ANN001, ANN201
    rows = spark.range(8000).select("id", F.concat(F.lit("owner"), F.format_string("%05d", "id")).alias("name"))
    index = postings.Index.build(rows, ["name"], ["id"], str(tmp_path / "i"), 8)
    plan = index.search("r00017")._jdf.queryExecution().toString()
    assert [r.id for r in index.search("r00017").collect()] == [17]
    assert "PartitionFilters: [isnotnull(_part" in plan or re.search(r"PartitionFilters: \[.*_part#\d+ = 0", plan)
    assert index.candidates("r00017").count() == 1
    assert "EqualTo(gram,r00)" in index.candidates("r00017")._jdf.queryExecution().toString()


def test_nothing_to_search(spark, tmp_path):  # noqa: ANN001, ANN201
    index = postings.Index.build(spark.createDataFrame([], "id int, a string"), ["a"], ["id"], str(tmp_path / "i"))
    assert index.search("abc").collect() == index.search("%").collect() == []


def test_filter_takes_a_backslash_as_it_is(spark):  # noqa: ANN001, ANN201
    rows = spark.createDataFrame([("a\\b", "2026-01-01"), ("ab", "2026-01-01")], "subject_id string, created_at string")
    assert [r[0] for r in ledger.apply_filters(rows, {"student": "\\"}, keyword_columns=("subject_id",)).collect()] == ["a\\b"]


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_pages(spark, tmp_path, ranges):  # noqa: ANN001, ANN201
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(9)]), i, "x") for i in range(403)]
    order = [F.desc_nulls_last("v"), F.asc("id")]
    pages = paging.Pages.store(spark.createDataFrame(rows, "v int, id int, _x string"), order, str(tmp_path / "p"), ranges)
    want = [i for v, i, _ in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))]
    assert pages.total == 403 and pages.last() == 51 and pages.last(500) == 1
    for n in (1, 2, 25, 50, 51, 52, 1000):
        assert [r.id for r in pages.page(n).collect()] == want[(n - 1) * 8 : n * 8]
    assert [r.id for r in pages.page(2, 150).collect()] == want[150:300]
    if ranges == 40:
        assert all(len(pages.ranges_of(n)) <= 3 for n in range(1, 52))
    with pytest.raises(ValueError):
        pages.page(0)


def test_pages_of_nothing(spark, tmp_path):  # noqa: ANN001, ANN201
    pages = paging.Pages.store(spark.createDataFrame([], "id int"), [F.asc("id")], str(tmp_path / "p"))
    assert pages.total == pages.last() == 0 and pages.page(1).collect() == []


def test_issues_in_the_order_of_collation(spark):  # noqa: ANN001, ANN201
    messages = ["b", "B", "a", "Z", "é", "f", "-x", "a b"]
    rows = spark.createDataFrame([(1, "R", 1, 1, m) for m in messages], "doc_id int, rule_id string, line int, column int, message string")
    got = [r.message for r in lint.ordered(rows).collect()]
    assert got == ["-x", "a", "a b", "b", "B", "é", "f", "Z"] and got != sorted(messages)
