"""Near copies of one text against every pair, how many pairs are compared, and texts that share an id."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from proofmill.llm import near_dup


def near_copies(n: int, seed: int = 1) -> list[tuple[int, str]]:
    """A text with 0.5 to 10 percent of its words changed, each time others; and some texts of other sizes."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(n):
        rate, words = rng.uniform(0.005, 0.1), base[: rng.choice([150, 150, 140, 125])]
        rows.append((i, " ".join(f"x{rng.randrange(10**9)}" if rng.random() < rate else w for w in words)))
    return rows


def smallest(rows: list[tuple[int, str]], width: int = 5) -> dict[int, int]:
    sets = {}
    for d, t in rows:
        w = t.lower().split()
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}
    parent = {d: d for d in sets}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in ids}


def test_pairs_compared_grow_with_the_group_and_not_its_square(spark, monkeypatch):  # noqa: ANN001, ANN201
    compared = []
    prune = near_dup._prune

    def counted(pairs, reps, percent):  # noqa: ANN001, ANN202
        compared[-1] += pairs.count()
        return prune(pairs, reps, percent)

    monkeypatch.setattr(near_dup, "_prune", counted)
    for n in (50, 100, 200):
        compared.append(0)
        rows = near_copies(n)
        got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == smallest(rows) and len(set(got.values())) > 10
    assert all(c <= 16 * n for c, n in zip(compared, (50, 100, 200), strict=True)), compared
    assert compared[2] < 10 * compared[0]  # all pairs: 16 times as many


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_the_exact_join_loses_no_pair(spark, percent):  # noqa: ANN001, ANN201
    """All pairs of different labels that reach the threshold meet, whatever their sizes, and those inside one label don't."""
    import numpy as np

    rng = np.random.default_rng(percent)
    pool = rng.integers(-(2**62), 2**62, 400)
    sets, low = {}, 0.7 if percent < 90 else 0.97
    for u in range(90):
        core = pool[: rng.integers(20, 200)]
        own = rng.integers(-(2**62), 2**62, rng.integers(0, 40 if percent < 90 else 3))
        sets[u] = np.unique(np.concatenate((rng.choice(core, max(1, int(len(core) * rng.uniform(low, 1.0))), replace=False), own)))
    labels = {u: int(rng.integers(0, 3)) if u % 2 else u + 10 for u in sets}
    frame = spark.createDataFrame([(u, s.astype("<i8").tobytes(), labels[u]) for u, s in sets.items()], "uid long, grams binary, label long")
    met = {tuple(sorted(r)) for r in near_dup._met(near_dup.prefixes(frame, percent), percent).collect()}
    linked = set()
    for a in sets:
        for b in sets:
            common = len(np.intersect1d(sets[a], sets[b]))
            if a < b and labels[a] != labels[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                linked.add((a, b))
    assert linked and linked <= met and not any(labels[a] == labels[b] for a, b in met)


def test_texts_of_one_id_are_one_document(spark):  # noqa: ANN001, ANN201
    a = " ".join(f"a{i}" for i in range(40))
    b = " ".join(f"b{i}" for i in range(40))
    frame = spark.createDataFrame([(1, a), (5, a), (5, b), (7, b + " x"), (9, ""), (9, "alone here"), (None, b)], "doc_id long, text string")
    for rows in (frame, frame.repartition(5), frame.orderBy(F.desc("text"))):
        got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(rows).collect()), key=str)
        assert got == sorted([(1, 1, True), (5, 1, False), (5, 1, False), (7, 1, False), (9, 9, True), (9, 9, True), (None, None, True)], key=str)
