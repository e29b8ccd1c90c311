"""Repeated passages against a brute-force search for all shared windows of words."""

from __future__ import annotations

import random
import re

from proofmill.llm import substring_dedup
from tests.conftest import DATA


def windows(text: str, n: int) -> list[tuple[int, int, str]]:
    """(start, end, words) of every window of n words."""
    words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^ \t\n\x0b\f\r]+", text, re.A)]
    return [(words[i][0], words[i + n - 1][1], " ".join(w for *_, w in words[i : i + n])) for i in range(len(words) - n + 1)]


def shared(texts: dict[int, str], n: int) -> list[tuple[int, int, int, int]]:
    """(doc, start, end, smallest document) of every window of n words that two documents have."""
    holders: dict[str, set[int]] = {}
    for d, t in texts.items():
        for *_, w in windows(t, n):
            holders.setdefault(w, set()).add(d)
    return [(d, s, e, min(holders[w])) for d, t in texts.items() for s, e, w in windows(t, n) if len(holders[w]) > 1]


def places(spans) -> set[tuple[int, int]]:  # noqa: ANN001
    return {(d, i) for d, s, e in spans for i in range(s, e)}


def spliced(seed: int = 7) -> dict[int, str]:
    """Texts without sentence marks that copy stretches of each other and of themselves, cut anywhere."""
    rng = random.Random(seed)
    texts: dict[int, str] = {}
    for d in rng.sample(range(1000), 60):
        words = [f"é{rng.randrange(5000)}" for _ in range(rng.randrange(10, 300))]
        for _ in range(rng.randrange(3)):
            if texts:
                source = rng.choice(list(texts.values())).split()
                at, n = rng.randrange(len(source)), rng.randrange(30, 90)
                to = rng.randrange(len(words) + 1)
                words[to:to] = source[at : at + n]
        texts[d] = "".join(w + rng.choice([" ", "  ", "\n", "\t"]) for w in words)
    texts[2000] = texts[2001] = "again " * 130
    return texts


def test_runs_are_the_windows_that_two_documents_have(spark):  # noqa: ANN001, ANN201
    texts = spliced()
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows = substring_dedup.passage_runs(frame).collect()
    expected = shared(texts, substring_dedup.RUN_WORDS)
    assert len({d for d, *_ in expected}) > 20
    blank = lambda found: {(d, i) for d, i in found if not texts[d][i].isspace()}
    assert blank(places((r.doc_id, r.start, r.end) for r in rows)) == blank(places(x[:3] for x in expected))
    assert sum(r.end - r.start for r in rows) == len(places((r.doc_id, r.start, r.end) for r in rows))
    assert all(r.words == len(texts[r.doc_id][r.start : r.end].split()) for r in rows)
    # What an earlier document has goes, and nothing else does.
    earlier = blank(places(x[:3] for x in expected if x[3] < x[0]))
    assert blank(places((r.doc_id, r.start, r.end) for r in rows if not r.kept)) == earlier
    assert all(r.kept == (r.component_id == r.doc_id) for r in rows)


def test_no_shared_window_of_fifty_words_is_left_out(spark):  # noqa: ANN001, ANN201
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = substring_dedup.repeated_passages(docs).collect()
    expected = shared(texts, 50)
    assert expected and places(x[:3] for x in expected) <= places((r.doc_id, r.start, r.end) for r in rows)


def test_a_document_keeps_only_its_own_part_of_a_run(spark):  # noqa: ANN001, ANN201
    first, second = (". ".join(f"{w} {i} stands in this sentence here" for i in range(12)) + "." for w in ("Alpha", "Omega"))
    texts = {1: f"one\n{first}", 2: f"two\n{first} {second}", 3: f"three\n{second}"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = [(r.doc_id, texts[r.doc_id][r.start : r.end].strip(), r.component_id, r.kept) for r in substring_dedup.passage_runs(frame).collect()]
    assert sorted(rows) == [(1, first, 1, True), (2, first, 1, False), (2, second, 2, True), (3, second, 2, False)]


def test_a_run_inside_text_is_removed_to_its_ends(spark):  # noqa: ANN001, ANN201
    """55 words without a sentence mark, spliced into the middle of other sentences."""
    passage = " ".join(f"shared{i}" for i in range(55))
    texts = {i: f"Own {i} words {i}a {i}b {passage} {i}c go on {i}" for i in range(3)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    left = {r.doc_id: r.text for r in substring_dedup.remove_repeats(frame).collect()}
    assert left[0] == texts[0] and all(left[i] == f"Own {i} words {i}a {i}b  {i}c go on {i}" for i in (1, 2))
