"""Pages of an ordered list without sorting all of it.

Rows are dealt to ranges of the order, whose borders Spark samples, and stored so. The ranges' sizes, summed up, tell which
of them a page lies in; only these are read and sorted.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Pages:
    """A stored ordered list. An order that names each row once gives each row one place."""

    def __init__(self, spark: SparkSession, path: str, order: list[Column], schema: StructType) -> None:
        self.spark, self.path, self.order, self.schema = spark, path, order, schema
        sizes = sorted((r[0], r[1]) for r in self._stored().groupBy("_range").count().collect())  # a row a range
        self.ranges = [(k, end - n, end) for (k, n), end in zip(sizes, accumulate(n for _, n in sizes), strict=True)]
        self.total = self.ranges[-1][2] if self.ranges else 0

    @classmethod
    def store(cls, rows: DataFrame, order: list[Column], path: str, ranges: int | None = None) -> Pages:
        dealt = rows.repartitionByRange(*([ranges] if ranges else []), *order).withColumn("_range", F.spark_partition_id())
        dealt.write.partitionBy("_range").parquet(path)
        return cls(rows.sparkSession, path, order, rows.schema)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema]).add("_range", "integer")).parquet(self.path)

    def ranges_of(self, page: int, size: int = 8) -> list[tuple[int, int, int]]:
        """(range, first place, place after the last) of what a page touches; places count from 0."""
        start = (page - 1) * size
        return [r for r in self.ranges if r[1] < start + size and r[2] > start]

    def page(self, page: int, size: int = 8) -> DataFrame:
        """Page ``page``, from 1 on, in order; empty beyond the last."""
        if page < 1 or size < 1:
            raise ValueError("pages count from 1 and have rows")
        touched = self.ranges_of(page, size)
        rows = self._stored().where(F.col("_range").isin([k for k, *_ in touched])).drop("_range").orderBy(*self.order)
        return rows.offset((page - 1) * size - touched[0][1]).limit(size) if touched else rows.limit(0)

    def last(self, size: int = 8) -> int:
        """The number of pages."""
        return -(-self.total // size)
