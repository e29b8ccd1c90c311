"""Embedding near-duplicates against brute force, and on awkward rows."""

from __future__ import annotations

import math

import numpy as np

from proofmill.llm import embedding_dedup
from tests.conftest import DATA

SCHEMA = "vec_id long, embedding array<double>, label int, uid long, key string, h long, t int, dim string, n_links string"


def frame(spark, rows):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 1, "k", 2, 3, "d", "n") for i, v, label in rows], SCHEMA)


def brute(rows, cosine=0.98):  # noqa: ANN001, ANN201
    """(vec_id, links, component) of rows with different ids."""
    good = [(i, np.array(v) / np.linalg.norm(v), label) for i, v, label in rows]
    near = {i: [j for j, w, other in good if j != i and label == other and v @ w >= cosine] for i, v, label in good}
    component = {}
    for i in sorted(near):
        todo = [i]
        while todo:
            if (k := todo.pop()) not in component:
                component[k] = i
                todo += near[k]
    return {i: (len(near[i]), component[i]) for i in near}


def test_groups_of_near_copies_chains_and_other_labels(spark):  # noqa: ANN001, ANN201
    rng, rows = np.random.default_rng(5), []
    for label in range(3):
        for size, noise in ((1, 0), (2, 0.05), (7, 0.13), (30, 0.1), (700 if label == 0 else 3, 0.11)):
            centre = rng.standard_normal(24)
            centre /= np.linalg.norm(centre)
            rows += [(len(rows) + k, list((centre + noise * rng.standard_normal(24) / math.sqrt(24)) * rng.uniform(0.1, 9)), label) for k in range(size)]
    turn = [[math.cos(k * 0.15), math.sin(k * 0.15)] + [0.0] * 22 for k in range(20)]  # a chain: only neighbours are linked
    rows += [(10_000 + k, v, 1) for k, v in enumerate(turn)]
    rows += [(20_000 + k, rows[3][1], 2) for k in range(3)]  # copies of a vector under another label
    want = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicate_vectors(frame(spark, rows)).collect()}
    assert got == want
    assert got[10_005] == (2, 10_000) and got[20_001] == (2, 20_000)


def test_awkward_vectors(spark):  # noqa: ANN001, ANN201
    v, inf, nan = [1.0, 2.0, 3.0], math.inf, math.nan
    rows = [(1, v, 1), (2, v, None), (3, None, 1), (4, [], 1), (5, [0.0] * 3, 1), (6, [1.0, None, 3.0], 1), (7, [1.0, nan, 3.0], 1), (8, [inf, 2.0, 3.0], 1)]
    rows += [(None, v, 1), (9, [1e-300 * x for x in v], 1), (10, [1e300 * x for x in v], 1), (11, [*v, 4.0], 1), (12, v, 2), (13, [-x for x in v], 1)]
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicate_vectors(frame(spark, rows)).collect()]
    assert sorted(got, key=lambda r: r[0] or 0) == [(None, 0, None, True), (1, 2, 1, True), *[(i, 0, i, True) for i in range(2, 9)], (9, 2, 1, False), (10, 2, 1, False), *[(i, 0, i, True) for i in range(11, 14)]]
    assert embedding_dedup.near_duplicate_vectors(frame(spark, [])).collect() == []


def test_rows_that_repeat_an_id_are_judged_by_their_own_vectors(spark):  # noqa: ANN001, ANN201
    rows = [(5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (7, [0.0, 2.0], 1), (8, [1.0, 1.0], 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicate_vectors(frame(spark, rows)).collect())
    assert got == [(5, 1, 5, True), (5, 1, 5, True), (5, 1, 5, True), (7, 1, 5, False), (8, 0, 8, True)]


def test_tables_follow_from_the_number_of_vectors():  # noqa: ANN201
    for n in (1, 1000, 10**6, 10**9):
        k, tables, width = embedding_dedup.tables_for(n, 0.98)
        near, far = embedding_dedup.same_step(embedding_dedup.RATIO), embedding_dedup.same_step(width / math.sqrt(2))
        assert (1 - near**k) ** tables <= embedding_dedup.MISS and n * far**k <= 1 / embedding_dedup.STRAYS
    rng = np.random.default_rng(1)
    shift, steps = rng.uniform(0, 1.6, 200_000), rng.standard_normal(200_000) * 0.2
    assert abs(np.mean(np.floor(shift / 1.6) == np.floor((shift + steps) / 1.6)) - embedding_dedup.same_step(8)) < 0.005


def test_given_vectors_have_no_links(spark):  # noqa: ANN001, ANN201
    rows = embedding_dedup.near_duplicate_vectors(spark.read.parquet(f"{DATA}/embeddings.parquet")).collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/embeddings.parquet").count() and all(r.kept for r in rows)
