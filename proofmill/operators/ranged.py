"""Scans over ordered groups that may each be larger than a task.

Rows are dealt by ranges of (keys, order), so a large group lies in several ranges, in order. Each range scans what it has
and sums it up; what a range's group brings along from the ranges before it is a prefix over these sums. Only the first and
the last group of a range can reach beyond it, so there are two sums a range at most, however many rows and groups there
are: they are scanned in one task and broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from proofmill.sources.session import checkpointed


class Ranged:
    """Rows in ranges of (keys, order)."""

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str], ranges: int | None = None) -> None:
        self.keys, self.order = keys, order
        dealt = rows.repartitionByRange(*([ranges] if ranges else []), *keys, *order)
        self.rows = checkpointed(dealt.withColumn("_range", F.spark_partition_id()))
        # The first and the last group of each range: those that are so in several lie in several.
        ends = self.rows.groupBy("_range").agg(F.min(F.struct(*keys)).alias("lo"), F.max(F.struct(*keys)).alias("hi"))
        ends = ends.select("_range", F.explode(F.array("lo", "hi")).alias("k")).groupBy("k").agg(F.countDistinct("_range").alias("n"))
        self.across = checkpointed(ends.where("n > 1").select("k.*"))

    def inside(self, start: int = Window.unboundedPreceding, end: int = Window.currentRow) -> WindowSpec:
        """A group's rows in one range."""
        return Window.partitionBy("_range", *self.keys).orderBy(*self.order).rowsBetween(start, end)

    def carry(self, rows: DataFrame, sums: dict[str, Column], brought: dict[str, tuple[Column, object]]) -> DataFrame:
        """Rows with what the ranges before bring to their group: ``brought`` maps a name to a column over the earlier
        ranges' ``sums`` of the group and to the value where there is none."""
        before = Window.partitionBy(*self.keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in self.keys]
        some = rows.alias("a").join(F.broadcast(self.across).alias("b"), on, "left_semi").groupBy(*self.keys, "_range").agg(*[c.alias(n) for n, c in sums.items()])
        for name, (column, _) in brought.items():
            some = some.withColumn(name, column.over(before))
        some = checkpointed(some.select(*self.keys, "_range", *brought))
        on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*self.keys, "_range"]]
        joined = rows.alias("a").join(F.broadcast(some).alias("b"), on, "left")
        return joined.select("a.*", *[F.coalesce(F.col(f"b.{n}"), F.lit(missing)).alias(n) for n, (_, missing) in brought.items()])


def with_expected(rows: DataFrame, keys: list[str], number: str, order: list[str], ranges: int | None = None) -> DataFrame:
    """Adds ``expected`` of a numbering that never falls back: 1 for a group's first entry, then max(expected, number) + 1.

    With j entries before, that is j + 1 + max(0, the most that any of them is over its place), a step of maxima and sums.
    Ranges bring how many entries they have and how far they are ahead. Null numbers count as entries and change nothing.
    """
    r = Ranged(rows, keys, order, ranges)
    place = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order))
    local = r.rows.withColumn("_j", place).withColumn("_over", F.col(number) - F.col("_j"))
    local = local.withColumn("_ahead", F.max("_over").over(r.inside(end=-1)))
    sums = {"_n": F.count(F.lit(1)), "_most": F.max("_over")}
    total = r.carry(local, sums, {"_before": (F.sum("_n"), 0)})
    # How far a range is ahead is counted from its own first entry; the entries before it come off.
    most = F.max(F.col("_over") - F.col("_before"))
    total = r.carry(total, {"_most": most}, {"_brought": (F.max("_most"), 0)})
    ahead = F.greatest(F.lit(0), F.col("_brought"), F.coalesce(F.col("_ahead") - F.col("_before"), F.lit(0)))
    return total.withColumn("expected", (F.col("_before") + F.col("_j") + ahead).cast("long")).drop("_range", "_j", "_over", "_ahead", "_before", "_brought")


def with_next_number(rows: DataFrame, keys: list[str], number: str, order: list[str], ranges: int | None = None) -> DataFrame:
    """Adds ``expected`` of a numbering that follows what it finds: 1 for a group's first entry, then the number before plus
    1, or where that is null what was expected of it plus 1."""
    r = Ranged(rows, keys, order, ranges)
    place = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order))
    local = r.rows.withColumn("_j", place)
    total = r.carry(local, {"_n": F.count(F.lit(1))}, {"_before": (F.sum("_n"), 0)}).withColumn("_over", F.col(number) - F.col("_j") - F.col("_before"))
    total = total.withColumn("_last", F.last("_over", ignorenulls=True).over(r.inside(end=-1)))
    total = r.carry(total, {"_end": F.max_by("_over", F.when(F.col("_over").isNotNull(), F.col("_j")))}, {"_brought": (F.last("_end", ignorenulls=True), None)})
    return total.withColumn("expected", (F.col("_before") + F.col("_j") + F.coalesce("_last", "_brought", F.lit(0))).cast("long")).drop("_range", "_j", "_over", "_last", "_before", "_brought")


def merged_spans(spans: DataFrame, keys: list[str], ranges: int | None = None) -> DataFrame:
    """(keys, start, end): spans that overlap or touch are one, by a sweep over ranges of starts.

    Each range knows how far the spans before it reach; a span that begins beyond that begins an island. An island is
    named by its first start, so the pieces of one that crosses a border meet again. Spans without a length are left out.
    """
    r = Ranged(spans.where(F.col("end") > F.col("start")).select(*keys, "start", "end"), keys, ["start", "end"], ranges)
    local = r.rows.withColumn("_reach", F.max("end").over(r.inside(end=-1)))
    swept = r.carry(local, {"_far": F.max("end")}, {"_brought": (F.max("_far"), None)})
    reach = F.greatest("_reach", "_brought")
    swept = swept.withColumn("_first", F.when(reach.isNull() | (F.col("start") > reach), F.col("start")))
    swept = swept.withColumn("_own", F.last("_first", ignorenulls=True).over(r.inside()))
    named = r.carry(swept, {"_end": F.max("_first")}, {"_island": (F.max("_end"), None)})
    return named.groupBy(*keys, F.coalesce("_own", "_island").alias("start")).agg(F.max("end").alias("end")).select(*keys, "start", "end")
