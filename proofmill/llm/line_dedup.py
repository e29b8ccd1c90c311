"""Line dedup over levelled sorted runs of line hashes, in DataFrame functions only.

A run holds (h1, h2, n_docs, owner) sorted by hash: in how many documents of its batch a line stands, and, in the run
that saw the line first, the largest document id that has it. A new batch is merge-anti-joined with the runs: lines
that none of them holds get their owner here. When a level has ``fanout`` runs they are merged into one of the next
level, so a line is in as many runs as there are levels at most. Batches go from the largest ids to the smallest, so
the owner of a line is the largest id of all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm.common import stage, staging

#: Lines of a batch; a corpus is cut into as many batches as that takes, ``LEAST_BATCHES`` at least.
BATCH_LINES, LEAST_BATCHES = 1_000_000_000, 4
_RUN = "h1 long, h2 long, n_docs long, owner long"
SPACES = " \t\n\x0b\f\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    key = F.btrim(line, F.lit(SPACES))
    # lower() changes only A-Z where all is ASCII, and is much faster than translate().
    return F.when(F.length(key) == F.octet_length(key), F.lower(key)).otherwise(F.translate(key, _UPPER, _UPPER.lower()))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text) to (doc_id, of, pos, h1, h2) for each line whose key has ``min_chars`` code points or more; ``of`` tells
    the texts of one id apart."""
    lines = docs.where("doc_id is not null").select("doc_id", _text_key().alias("of"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keys = lines.where(F.length("line") >= min_chars).select("doc_id", "of", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select("doc_id", "of", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def _text_key() -> Column:
    return F.xxhash64("text")


class LineRuns:
    """The levels of runs. Batches must not share documents, and come from the largest ids to the smallest."""

    def __init__(self, fanout: int = 4) -> None:
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> None:
        """Add a batch: (doc_id, h1, h2), repeated rows allowed."""
        counted = lines.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("top"))
        if old := self.runs():
            seen = reduce(DataFrame.unionByName, old).where("owner is not null").select("h1", "h2")
            fresh = counted.join(seen, ["h1", "h2"], "left_anti").withColumnRenamed("top", "owner")
            again = counted.join(seen, ["h1", "h2"], "left_semi").select("h1", "h2", "n_docs", F.lit(None).cast("long").alias("owner"))
            counted = fresh.unionByName(again)
        else:
            counted = counted.withColumnRenamed("top", "owner")
        self._put(0, counted)

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(stage(run.sortWithinPartitions("h1", "h2"), f"run{level}"))
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self._merged(self.levels[level]), []
            self._put(level + 1, merged)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("owner").alias("owner"))

    def save(self, path: str) -> None:
        """Write the runs and which level each is on to a folder, for batches to come."""
        spark, names = None, []
        for level, runs in enumerate(self.levels):
            for i, run in enumerate(runs):
                spark = run.sparkSession
                names.append((level, f"run-{level}-{i}"))
                run.write.parquet(f"{path}/run-{level}-{i}")
        if spark is not None:
            spark.createDataFrame(names, "level int, name string").coalesce(1).write.json(f"{path}/levels")

    @classmethod
    def load(cls, spark: SparkSession, path: str, fanout: int = 4) -> LineRuns:
        """What ``save`` has written. Runs are read where they lie, so the folder must stay."""
        runs = cls(fanout)
        for row in spark.read.schema("level int, name string").json(f"{path}/levels").orderBy("level", "name").collect():
            while len(runs.levels) <= row.level:
                runs.levels.append([])
            runs.levels[row.level].append(spark.read.schema(_RUN).parquet(f"{path}/{row.name}"))
        return runs

    def counts(self) -> DataFrame | None:
        """(h1, h2, n_docs, owner) over all batches; None before the first."""
        runs = self.runs()
        return runs[0] if len(runs) == 1 else self._merged(runs) if runs else None


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``n_lines``, ``n_dropped`` and the text without lines that other documents keep.

    A key of ``min_chars`` code points found in ``min_docs`` documents loses all its lines but those of the largest
    id that holds it. A null text becomes an empty one, a single empty line. Rows that repeat an id are one document
    where it is counted in how many a key stands, but each loses lines of its own text only.
    Rows without an id are not counted and stay whole. Batches are cut by id, ``BATCH_LINES`` lines each or so. Columns
    ``n_lines`` and ``n_dropped`` of ``docs`` are replaced; all others are kept. An empty table gives no rows.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(f"`{text_col}`", F.lit("")).alias("text"))
    with staging(docs.sparkSession):
        lines = stage(line_hashes(rows.select("doc_id", "text"), min_chars), "lines")
        batches = batches or max(LEAST_BATCHES, -(-lines.count() // BATCH_LINES))
        cuts = lines.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], max(1000, 10 * batches))).first()[0] if batches > 1 else None
        cuts = sorted(set(cuts or []), reverse=True)
        runs = LineRuns()
        for high, low in zip([None, *cuts], [*cuts, None], strict=True):
            part = lines if high is None else lines.where(F.col("doc_id") <= high)
            runs.add(part if low is None else part.where(F.col("doc_id") > low))
        common = stage(runs.counts().where(F.col("n_docs") >= min_docs).select("h1", "h2", "owner"), "common")
        drops = lines.join(common, ["h1", "h2"]).where("doc_id <> owner").select("doc_id", "of", "pos").distinct().groupBy("doc_id", "of").agg(F.sort_array(F.collect_list("pos")).alias("drop"))
        drops = stage(drops, "drops", keep=True)
    # Whole texts meet the places to drop by a merge at every size: skewed ids can be split then.
    return _cut(rows.withColumn("of", _text_key()).join(drops.hint("merge"), ["doc_id", "of"], "left"), names, text_col)


def _cut(rows: DataFrame, names: list[str], text_col: str) -> DataFrame:
    """Lines at the positions ``drop`` go: what is kept are the slices between them."""
    with_lines = rows.select("row", "text", F.split("text", "\n").alias("l"), F.col("drop").alias("d"))
    kept = "flatten(transform(sequence(0, size(d)), k -> slice(l, coalesce(get(d, k - 1), -1) + 2, coalesce(get(d, k), size(l)) - coalesce(get(d, k - 1), -1) - 1)))"
    return with_lines.select(
        *[(F.expr(f"if(d is null, text, array_join({kept}, '\n'))") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in names],
        F.size("l").cast("long").alias("n_lines"),
        F.expr("cast(if(d is null, 0, size(d)) as bigint)").alias("n_dropped"),
    )
