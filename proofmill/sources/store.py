"""Tables of records: scans, look-ups, appends and rewrites; text, JSON and CSV files."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmill.functions.text import extension

#: What a text source may weigh, in bytes, and the file names that it takes (fixed values).
MAX_TEXT_BYTES = 50 * 1024 * 1024
TEXT_EXTENSIONS = (".txt", ".md")


def newest_first(created: str = "created_at", record: str = "id") -> list[Column]:
    """By second, then by the raw timestamp, then by id, so that ties have an order."""
    return [F.date_trunc("second", F.col(created).try_cast("timestamp")).desc_nulls_last(), F.col(created).desc_nulls_last(), F.col(record)]


def scan(table: DataFrame, owner: str | None = None, owner_col: str = "subject_id", created: str = "created_at", record: str = "id") -> DataFrame:
    """All rows, or one owner's, newest first."""
    rows = table if owner is None else table.where(F.col(owner_col) == owner)
    return rows.orderBy(*newest_first(created, record))


def lookup(table: DataFrame, record_id: str, owner: str, owner_col: str = "subject_id", record: str = "id") -> DataFrame:
    """The owner's row of that id; no row if it is another's."""
    return table.where((F.col(record) == record_id) & (F.col(owner_col) == owner))


def summaries(reports: DataFrame, result: str, counters: list[str]) -> DataFrame:
    """Reports with the counters of their JSON summary, 0 where missing, and without the result itself."""
    return reports.select(*[c for c in reports.columns if c != result], *[F.coalesce(F.get_json_object(result, f"$.summary.{c}").try_cast("long"), F.lit(0)).alias(c) for c in counters])


def projected(rows: DataFrame, document: str, fields: dict[str, str]) -> DataFrame:
    """Rows with fields of a JSON column, by name and type, in its place: null where the field is missing, of another type,
    or the JSON is malformed. A field takes the place of a column of its name."""
    kept = [c for c in rows.columns if c != document and c not in fields]
    return rows.select(*[F.col(f"`{c}`") for c in kept], *[F.get_json_object(document, f"$.{name}").try_cast(kind).alias(name) for name, kind in fields.items()])


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def upsert(table: DataFrame, rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Both together, the last row of each key; nulls in a key are a key as well."""
    both = table.unionByName(rows, allowMissingColumns=True)
    last = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def replace_scope(table: DataFrame, rows: DataFrame, scope: list[str]) -> DataFrame:
    """The table without the rows of any scope that ``rows`` has, and ``rows``."""
    scopes = rows.select(*[F.col(c).alias(f"_{c}") for c in scope]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in scope])
    return table.join(scopes, same, "left_anti").unionByName(rows, allowMissingColumns=True)


def insert_missing(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the table hasn't yet, one of each."""
    return rows.dropDuplicates(key).join(table.select(*key), key, "left_anti")


def exists(table: DataFrame, record_id: str, record: str = "id") -> bool:
    """Whether there is a row of that id: what a deletion asks for first."""
    return not table.where(F.col(record) == record_id).isEmpty()


def delete(table: DataFrame, record_id: str, record: str = "id") -> DataFrame:
    return table.where(~F.col(record).eqNullSafe(F.lit(record_id)))


def set_status(table: DataFrame, match: Column, old: str, new: str) -> DataFrame:
    """Rows that match and have the old status get the new one."""
    return table.withColumn("status", F.when(match & (F.col("status") == old), F.lit(new)).otherwise(F.col("status")))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n)."""
    return reduce(DataFrame.unionAll, [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()])


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error): whole files as UTF-8, a row each. Too large a file, a wrong name or malformed bytes give an error
    and no text; an empty file has an empty text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # Spark lists empty files but reads none: they are the names that it lists and has no row of.
    listed = spark.createDataFrame([(unquote(f),) for f in files.inputFiles()], "name string")
    bare = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    empty = listed.join(files.select(bare(F.col("path")).alias("there")), bare(F.col("name")) == F.col("there"), "left_anti")
    raw = files.select("path", "length", "content").unionAll(empty.select(bare(F.col("name")), F.lit(0).cast("long"), F.lit(b"")))
    error = F.when(~extension(F.col("path")).isin(*TEXT_EXTENSIONS), "unsupported file type").when(F.col("length") > MAX_TEXT_BYTES, "file too large").when(~F.is_valid_utf8("content"), "not UTF-8")
    return raw.select("path", F.when(error.isNull(), F.try_validate_utf8("content").cast("string")).alias("text"), error.alias("error"))


def write_csv(rows: DataFrame, path: str) -> None:
    """Every cell in quotes, quotes doubled; each part file begins with a byte order mark and the header."""
    mark = "\ufeff"
    named = rows.select(*[F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")).alias(mark + n if i == 0 else n) for i, n in enumerate(rows.columns)])
    named.write.option("header", "true").option("quoteAll", "true").option("escape", '"').option("emptyValue", "").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.option("ignoreNullFields", "false").json(path)


def write_text(rows: DataFrame, text: str, path: str) -> None:
    rows.select(F.col(text).alias("value")).write.text(path)
