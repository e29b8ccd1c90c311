"""Counts of distinct subjects that can be rolled up: bitmaps by type and day, exact and mergeable.

Distinct counts of days don't add up to that of a month, so they are counted anew for every grouping, from all records. A
bitmap of the subjects of each type and day does add up: any grouping of these is a union of stored bitmaps, and a new day
is some more rows. Subjects are numbered once; a bitmap covers 32768 numbers, so its size is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofmill.operators.ranged import Ranged


def subject_numbers(facts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(subject_id, number): what is known, and new numbers from there on for subjects that aren't. Without a gap, so that
    bitmaps are dense; null is no subject."""
    subjects = facts.select("subject_id").where("subject_id is not null").distinct()
    start = 0
    if known is not None:
        subjects = subjects.join(known, "subject_id", "left_anti")
        start = (known.agg(F.max("number")).first()[0] or -1) + 1
    r = Ranged(subjects.withColumn("_all", F.lit(0)), ["_all"], ["subject_id"])
    place = F.row_number().over(Window.partitionBy("_range", "_all").orderBy("subject_id"))
    placed = r.carry(r.rows.withColumn("_j", place), {"_n": F.count(F.lit(1))}, {"_before": (F.sum("_n"), 0)})
    new = placed.select("subject_id", (F.col("_before") + F.col("_j") - 1 + start).cast("long").alias("number"))
    return new if known is None else known.select("subject_id", "number").unionByName(new)


def rollup(facts: DataFrame, numbers: DataFrame, created: str = "created_at") -> DataFrame:
    """(detection_type, day, bucket, record_count, subjects): how many records, and the subjects as bitmaps. Records without
    a subject count as records; they stand in a bucket of null."""
    day = F.to_date(F.col(created).try_cast("timestamp"))
    rows = facts.select("detection_type", day.alias("day"), "subject_id").groupBy("detection_type", "day", "subject_id").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(numbers, "subject_id", "left")
    bucket, bit = F.bitmap_bucket_number("number"), F.bitmap_bit_position("number")
    return rows.groupBy("detection_type", "day", bucket.alias("bucket")).agg(F.sum("n").alias("record_count"), F.bitmap_construct_agg(bit).alias("subjects"))


def merge(*rollups: DataFrame) -> DataFrame:
    """Rollups of different records, over the same numbers, as one."""
    every = rollups[0]
    for other in rollups[1:]:
        every = every.unionByName(other)
    return every.groupBy("detection_type", "day", "bucket").agg(F.sum("record_count").alias("record_count"), F.bitmap_or_agg("subjects").alias("subjects"))


def counts(stored: DataFrame, by: list[str]) -> DataFrame:
    """(by, record_count, subject_count) for any of detection_type and day, or none: unions of the stored bitmaps."""
    one = stored.groupBy(*by, "bucket").agg(F.sum("record_count").alias("record_count"), F.bitmap_or_agg("subjects").alias("subjects"))
    seen = F.when(F.col("bucket").isNotNull(), F.bitmap_count("subjects")).otherwise(0)
    return one.groupBy(*by).agg(F.sum("record_count").alias("record_count"), F.sum(seen).alias("subject_count"))
