"""Staged tables live as long as their scope, and no result takes another's away."""

from __future__ import annotations

from pathlib import Path

import pytest

import corpus_pipeline
from proofmill.llm import common, line_dedup, near_dup
from tests.conftest import DATA


def staged(spark) -> set[Path]:  # noqa: ANN001
    return {p for p in Path(common.shared_dir(spark).removeprefix("file:")).glob("proofmill/*/*") if p.is_dir()}


def test_an_unwritten_result_outlives_other_work(spark):  # noqa: ANN001, ANN201
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = line_dedup.dedup_lines(docs)
    near_dup.near_duplicates(docs).count()
    corpus_pipeline.run(spark, DATA).count()
    assert held.count() == docs.count()


def test_a_scope_leaves_nothing_behind(spark):  # noqa: ANN001, ANN201
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = staged(spark)
    with common.staging(spark):
        near_dup.near_duplicates(docs).count()
        corpus_pipeline.run(spark, DATA).count()
        assert len(staged(spark) - before) == 2  # the two results; what they were made from is gone
    assert staged(spark) == before


def test_scopes_nest_and_close_on_errors(spark):  # noqa: ANN001, ANN201
    before = staged(spark)
    frame = spark.range(3).toDF("x")
    with pytest.raises(RuntimeError), common.staging(spark):
        with common.staging(spark):
            common.stage(frame, "inner")
            kept = common.stage(frame, "kept", keep=True)
        assert kept.count() == 3 and len(staged(spark) - before) == 1
        raise RuntimeError
    assert staged(spark) == before


def test_a_cluster_needs_a_shared_folder():  # noqa: ANN201
    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster)
