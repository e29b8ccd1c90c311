"""Scans, sweeps and rollups over groups that lie in several ranges, against plain loops; the latest record over a stream."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from proofmill.operators import ledger, ranged, rollup
from proofmill.plans import inputs
from proofmill.streaming import latest
from tests.conftest import DATA


@pytest.fixture(scope="module")
def numbered(spark):  # noqa: ANN001, ANN201
    rng = random.Random(1)
    sizes = {"a": 700, "b": 1, "c": 3, None: 150, "d": 900, "e": 2}
    rows = [(k, i, rng.choice([None, i - 2, i + 1, i + 1, i + 1, i + 9])) for k, n in sizes.items() for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, i int, num int")


def groups(rows: list[tuple]) -> dict:
    out: dict = {}
    for k, i, num in sorted(rows, key=lambda r: r[1]):
        out.setdefault(k, []).append((i, num))
    return out


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_numbering_over_ranges(numbered, ranges):  # noqa: ANN001, ANN201
    rows, df = numbered
    never_back, follows = {}, {}
    for k, entries in groups(rows).items():
        e = f = 1
        for i, num in entries:
            never_back[k, i], follows[k, i] = e, f
            e, f = max(e, num if num is not None else e) + 1, (f if num is None else num) + 1
    for f, want in ((ranged.with_expected, never_back), (ranged.with_next_number, follows)):
        got = f(df, ["k"], "num", ["i"], ranges)
        assert got.columns == ["k", "i", "num", "expected"]
        assert {(r.k, r.i): r.expected for r in got.collect()} == want
        assert f(df.limit(0), ["k"], "num", ["i"], ranges).collect() == []


def test_a_group_is_dealt_to_several_tasks(spark):  # noqa: ANN001, ANN201
    r = ranged.Ranged(spark.range(20_000).select(F.lit(1).alias("k"), "id"), ["k"], ["id"], 16)
    sizes = [x[1] for x in r.rows.groupBy("_range").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * sorted(sizes)[8] and r.across.count() == 1


@pytest.mark.parametrize("ranges", [1, 9, 50])
def test_spans_over_ranges(spark, ranges):  # noqa: ANN001, ANN201
    rng = random.Random(2)
    spans = [(k, s, s + rng.choice([-1, 0, 1, 2, 5, 40])) for k, n in (("x", 800), ("y", 2), (None, 90), ("z", 400)) for s in [rng.randrange(3 * n) for _ in range(n)]]
    spans += [("long", 0, 10_000)] + [("long", i, i + 1) for i in range(500)] + [("long", 10_001, 10_002)]
    want = []
    for k in {k for k, *_ in spans}:
        open_ = None
        for _, s, e in sorted((x for x in spans if x[0] == k and x[2] > x[1]), key=lambda x: x[1:]):
            if open_ and s <= open_[1]:
                open_[1] = max(open_[1], e)
            else:
                want.append(open_ := [s, e, k])
    got = ranged.merged_spans(spark.createDataFrame(spans, "k string, start long, end long"), ["k"], ranges)
    assert sorted(map(repr, ((r.start, r.end, r.k) for r in got.collect()))) == sorted(repr(tuple(x)) for x in want)


def test_rollups_of_days_add_up(spark):  # noqa: ANN001, ANN201
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), f"2024-0{rng.randrange(1, 3)}-0{rng.randrange(1, 5)} 10:00:00", rng.choice([None, *(f"s{i}" for i in range(60))])) for _ in range(900)] + [("a", "no time", "s1")]
    facts = spark.createDataFrame(rows, "detection_type string, created_at string, subject_id string")
    one, two = facts.where("created_at < '2024-02'"), facts.where("created_at >= '2024-02'")
    numbers = rollup.subject_numbers(one)
    more = rollup.subject_numbers(facts, numbers)
    known, all_ = ({r.subject_id: r.number for r in x.collect()} for x in (numbers, more))
    assert sorted(all_.values()) == list(range(len(all_))) and known.items() <= all_.items()
    stored = rollup.merge(rollup.rollup(one, more), rollup.rollup(two, more))
    for by in ([], ["detection_type"], ["day"], ["detection_type", "day"]):
        want = facts.withColumn("day", F.to_date(F.col("created_at").try_cast("timestamp"))).groupBy(*by).agg(F.count(F.lit(1)).alias("record_count"), F.countDistinct("subject_id").alias("subject_count"))
        assert sorted(map(repr, rollup.counts(stored, by).collect())) == sorted(map(repr, want.collect()))


def test_latest_records_over_a_stream(spark, tmp_path):  # noqa: ANN001, ANN201
    facts = inputs.facts(spark, DATA).select("subject_id", "detection_type", "id", F.col("created_at").cast("timestamp").alias("created_at"))
    source = str(tmp_path / "in")
    for k in range(4):  # in batches of no order
        facts.where(F.pmod(F.xxhash64("id"), F.lit(4)) == k).coalesce(1).write.mode("append").parquet(source)
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(facts.schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = latest.latest_changes(stream).writeStream.format("memory").queryName("changes").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(300)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    got = {(r.subject_id, r.detection_type, r.id) for r in latest.settled(spark.table("changes")).collect()}
    want = {(r.subject_id, r.detection_type, r.id) for r in ledger.with_latest_rank(facts).where("latest_rank = 1").collect()}
    assert got == want and spark.table("changes").where("change = -1").count() > 0
