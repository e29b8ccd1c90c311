"""Rows that repeat an id with another text lose lines and passages of their own text only."""

from __future__ import annotations

from proofmill.llm import decontam, line_dedup, substring_dedup

TEXT = "doc_id long, text string"


def test_line_dedup_keeps_lines_that_only_one_row_has(spark):  # noqa: ANN001, ANN201
    line, alone = "this line is repeated often enough", "a line that no other has at all"
    rows = [(1, f"{line}\nalpha"), (1, f"{alone}\nbeta"), (2, line), (3, line), (1, f"{line}\nalpha"), (3, f"x\n{line}")]
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, TEXT)).collect()]
    assert sorted(got) == sorted([(1, "alpha", 2, 1), (1, f"{alone}\nbeta", 2, 0), (2, "", 1, 1), (3, line, 1, 0), (1, "alpha", 2, 1), (3, f"x\n{line}", 2, 0)])


def test_remove_repeats_keeps_texts_that_only_one_row_has(spark):  # noqa: ANN001, ANN201
    x, y = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    docs = spark.createDataFrame([(1, x), (5, x), (5, y), (7, f"{y}\nown words"), (9, "something else"), (None, x), (9, None), (5, "")], TEXT)
    got = [(r.doc_id, r.text) for r in substring_dedup.remove_repeats(docs).collect()]
    assert sorted(got, key=repr) == sorted([(1, x), (5, ""), (5, y), (7, "\nown words"), (9, "something else"), (None, x), (9, None), (5, "")], key=repr)
    found = {(r.doc_id, r.kind, r.start, r.component_id, r.kept) for r in substring_dedup.repeated_passages(docs).collect() if r.kind == "paragraph"}
    assert found == {(1, "paragraph", 0, 1, True), (5, "paragraph", 0, 1, False), (5, "paragraph", 0, 5, True), (7, "paragraph", 0, 5, False)}


def test_short_items_are_found_as_whole_words(spark):  # noqa: ANN001, ANN201
    items = spark.createDataFrame([(1, "yes"), (2, "forty two"), (3, "?!")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Yes."), (2, "eyes"), (3, "it is forty-two"), (4, "forty twos")], TEXT)
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()} == {(1, 1), (3, 2)}
    assert [r.doc_id for r in decontam.clean(docs, items).collect()] == [2, 4]
    assert decontam.contaminated(docs, items, least=24).collect() == []
