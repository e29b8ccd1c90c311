"""Collocations against a plain count of all phrases, with small shards, ranges and bitmaps, and on awkward rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from proofmill.llm import collocations
from tests.conftest import DATA

SCHEMA = "doc_id long, text string, lang string, n long, phrase string, words string, a string, rank string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs: list[tuple], least: int, share: int = 80, top: int = 2000) -> list[tuple]:
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase."""
    count: dict[str, Counter] = {}
    for lang, text in docs:
        mine = count.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            mine.update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    out = []
    for lang, f in count.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        chosen = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = set()
        for p, a in chosen.items():
            for k in range(2, len(p)):
                dropped |= {q for i in range(len(p) - k + 1) if 100 * a >= share * chosen[q := p[i : i + k]]}
        rows = []
        for p, a in chosen.items():
            if p not in dropped:
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def found(df) -> list[tuple]:  # noqa: ANN001
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def small_shards(monkeypatch):  # noqa: ANN001, ANN201
    monkeypatch.setattr(collocations, "SHARD_TOKENS", 3000)
    monkeypatch.setattr(collocations, "SHARD_WORDS", 400)
    monkeypatch.setattr(collocations, "PART", 100)
    monkeypatch.setattr(collocations, "LEAST_BITS", 64)
    monkeypatch.setattr(collocations, "MOST_BITS", 256)


def test_given_documents(spark):  # noqa: ANN001, ANN201
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [tuple(r) for r in docs.select("lang", "text").collect()]
    for least, top in ((30, 2000), (5, 50)):
        assert found(collocations.collocations(docs, least=least, top=top)) == plain(rows, least, top=top)


def test_small_shards_full_bitmaps_and_awkward_texts(spark, small_shards):  # noqa: ANN001, ANN201
    rng = random.Random(3)
    words = ["the", "The", "a", "ä", "b\x00", "b\x01c", "b", "dé", "漢字", "zz", "\x1f", "x" * 300, *(f"w{i}" for i in range(40))]
    weights = [60, 20, 30, 9, 9, 9, 9, 5, 5, 5, 3, 2, *[1] * 40]
    texts = []
    for _ in range(150):
        text = ""
        for w in rng.choices(words, weights, k=rng.randrange(0, 90)):
            text += w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "!?", "\x0b"])
        texts.append((rng.choice(["en", "en", "en", None, "und", "fr"]), text))
    texts += [("en", None), ("en", ""), (None, " \t\n"), ("xx", "."), ("en", "one two three four five " * 4000), ("en", "no-break " * 50), ("de", "twice seen. " * 9)] * 2
    want = plain(texts, 6)
    assert {r[0] for r in want} >= {"en", "und"} and len(want) > 100
    df = spark.createDataFrame([(1, t, lang, 1, "p", "w", "a", "r") for lang, t in texts], SCHEMA).repartition(5)
    assert found(collocations.collocations(df, least=6)) == want
    assert found(collocations.collocations(df.limit(0), least=6)) == []
    assert found(collocations.collocations(df, least=10**6)) == []


def test_counts_beyond_32_bits_stay_exact(spark):  # noqa: ANN001, ANN201
    big = 9 * 10**13  # 2,000,000 times as much is over 64 bits
    rows = [("en", b"p", big + 7, 1), ("en", b"q", big + 8, 1), ("en", b"p q", big, 2)]
    counted = spark.createDataFrame([(a, b, n) for a, b, n, _ in rows], "lang string, phrase binary, n long")
    totals = spark.createDataFrame([("en", 3 * big)], "lang string, n long")
    docs = spark.createDataFrame([("en", "")], "lang string, text string")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(collocations, "count_phrases", lambda *_: (counted, totals))
        assert found(collocations.collocations(docs)) == [("en", 1, "p q", big, big + 7, big + 8, 3 * big, 2_000_000 * big // (2 * big + 15))]


def test_bitmap_has_all_that_were_put_in(spark):  # noqa: ANN001, ANN201
    rows = [("en", f"w{i} x{i % 7}".encode(), 30) for i in range(3000)]
    bitmap = collocations._bitmap(spark.createDataFrame(rows, "lang string, phrase binary, n long"))
    hashes = lambda lang, ps: collocations._phrase_hash([np.array([collocations._word_hash(lang, p.split()[k]) for p in ps], np.uint64) for k in (0, 1)])
    assert bitmap.has(hashes(b"en", [p for _, p, _ in rows])).all()
    assert bitmap.has(hashes(b"fr", [p for _, p, _ in rows])).mean() < 0.1


def test_ranges_agree_whatever_words_a_task_has():  # noqa: ANN201
    rng = random.Random(6)
    words = sorted({bytes(rng.choices(b"abcd", k=rng.randrange(1, 4))) for _ in range(60)})
    borders = sorted({(rng.choice(words), rng.choice([b"", *words])) for _ in range(12)})
    known: dict = {}
    for _ in range(20):
        names = sorted(rng.sample(words, rng.randrange(2, len(words))))
        trie = collocations._PhraseTrie(b"en", None, None, borders, 5)
        pairs = np.array([i * len(names) + j for i in range(len(names)) for j in range(len(names))])
        for pair, part in zip(pairs, trie._parts(pairs, names), strict=True):
            phrase = names[pair // len(names)], names[pair % len(names)]
            assert part == 5 + sum(b <= phrase for b in borders) == known.setdefault(phrase, part)


def test_borders_split_common_words(spark):  # noqa: ANN001, ANN201
    rows = [("en", b"the", 50_000)] + [("en", f"w{i:03}".encode(), 100) for i in range(300)] + [("fr", f"v{i:03}".encode(), 100) for i in range(200)]
    borders = collocations._borders(spark.createDataFrame(rows, "lang string, phrase binary, n long"), 20)
    (first, en), (second, fr) = borders[b"en"], borders[b"fr"]
    assert en == sorted(en) and fr == sorted(fr) and first == 0 and second == len(en) + 1
    assert sum(w == b"the" for w, _ in en) > 5 and 4 <= sum(w != b"the" for w, _ in en) <= 12 and 2 <= len(fr) <= 8
