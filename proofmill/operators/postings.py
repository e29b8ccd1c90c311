"""Keyword search over stored rows: a posting table of trigrams names candidates, the condition itself decides.

Rows are stored once, in parts by an order; a posting says which rows of a block of a part have a trigram in one of the
searched columns. Postings are sorted by trigram, so a search reads the files and row groups of its own trigrams, then only
the parts that are left. Texts end in two marks, so that a piece of one or two characters is the beginning of a trigram.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from proofmill.sources.session import checkpointed

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_END = "\0\0"
#: Rows in a block: the most that a posting lists.
BLOCK = 4096


def matches(columns: list[str], keyword: str) -> Column:
    """Whether a column has the keyword: ``%`` and ``_`` are wild cards, A-Z and a-z are the same, and null has nothing."""
    pattern = "%" + keyword.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\") + "%"
    return reduce(lambda a, b: a | b, [F.coalesce(_folded(c).like(pattern), F.lit(False)) for c in columns])


def needs(keyword: str) -> list[str]:
    """What a text with the keyword has: trigrams, or the beginning of one for a piece that is shorter."""
    pieces = [p for p in re.split("[%_]", keyword.translate(str.maketrans(_UPPER, _LOWER))) if p]
    grams = {p[i : i + 3] for p in pieces for i in range(len(p) - 2)}
    return sorted(grams | {p for p in pieces if len(p) < 3 and not any(g.startswith(p) for g in grams)})


class Index:
    """Rows and postings in a folder. Columns of the rows that are named _part or _row are not kept."""

    def __init__(self, spark: SparkSession, path: str, columns: list[str], schema: StructType) -> None:
        self.spark, self.path, self.columns = spark, path, columns
        self.schema = StructType([f for f in schema if f.name not in ("_part", "_row")])

    @classmethod
    def build(cls, rows: DataFrame, columns: list[str], order: list[str], path: str, parts: int | None = None) -> Index:
        """Stores them in a new folder. ``order`` says which rows lie together."""
        index = cls(rows.sparkSession, path, columns, rows.schema)
        dealt = rows.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
        row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        dealt.select(*index.schema.names, F.spark_partition_id().alias("_part"), row.alias("_row")).write.partitionBy("_part").parquet(f"{path}/rows")
        # Postings are of the rows as they were stored, so a task that ran twice can't give them other places.
        grams = F.array_distinct(F.concat(*[_trigrams(c) for c in columns]))
        each = index.rows().select("_part", "_row", F.explode(grams).alias("gram"))
        listed = each.groupBy("gram", "_part", F.shiftright("_row", BLOCK.bit_length() - 1).alias("_block")).agg(F.collect_list("_row").alias("rows"))
        listed.repartitionByRange("gram", "_part", "_block").sortWithinPartitions("gram", "_part", "_block").write.parquet(f"{path}/postings")
        return index

    def rows(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema]).add("_row", "long").add("_part", "integer")).parquet(f"{self.path}/rows")

    def candidates(self, keyword: str) -> DataFrame | None:
        """(_part, _row) of rows that have all that the keyword needs; None if it needs nothing."""
        wanted = needs(keyword)
        if not wanted:
            return None
        tests = [F.col("gram") == w if len(w) == 3 else F.col("gram").startswith(w) for w in wanted]
        postings = self.spark.read.schema("gram string, _part int, _block long, rows array<long>").parquet(f"{self.path}/postings")
        need = F.explode(F.array_compact(F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)])))
        hits = postings.where(reduce(lambda a, b: a | b, tests)).select("_part", "_block", "rows", need.alias("need"))
        # No list is longer than a block, and there are as many as trigrams in the keyword, or that begin with a short piece.
        each = hits.groupBy("_part", "_block", "need").agg(F.array_distinct(F.flatten(F.collect_list("rows"))).alias("rows"))
        every = each.groupBy("_part", "_block").agg(F.collect_list("rows").alias("lists")).where(F.size("lists") == len(wanted))
        common = F.aggregate(F.slice("lists", 2, len(wanted)), F.col("lists")[0], F.array_intersect)
        return every.select("_part", F.explode(common).alias("_row"))

    def search(self, keyword: str) -> DataFrame:
        """The stored rows that match. Parts without a candidate are not read."""
        rows, found = self.rows(), self.candidates(keyword)
        if found is not None:
            found = checkpointed(found)
            parts = [r[0] for r in found.select("_part").distinct().collect()]  # at most as many as there are folders
            rows = rows.where(F.col("_part").isin(parts)).join(found, ["_part", "_row"], "left_semi")
        return rows.where(matches(self.columns, keyword)).select(*self.schema.names)


def _folded(column: str) -> Column:
    return F.translate(F.col(column).cast("string"), _UPPER, _LOWER)


def _trigrams(column: str) -> Column:
    grams = F.regexp_extract_all(F.concat(_folded(column), F.lit(_END)), F.lit("(?s)(?=(.{3}))."), F.lit(1))
    return F.coalesce(grams, F.array().cast("array<string>"))
