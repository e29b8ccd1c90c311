"""A local session for all tests, and the comparison of a query with DuckDB's answer."""

from __future__ import annotations

import datetime
import decimal
import math
import os
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession

DATA = os.environ.get("PROOFMILL_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory: pytest.TempPathFactory):  # noqa: ANN201
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(shared))
        .config("spark.sql.warehouse.dir", str(shared / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):  # noqa: ANN001, ANN201
    """A value that compares alike from Spark and DuckDB; floats to 9 digits."""
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def rows_of(df: DataFrame) -> list[str]:
    names = sorted(df.columns)
    return sorted(repr([plain(r[c]) for c in names]) for r in df.collect())


def answers(sql: str, folder: str = DATA) -> tuple[list[str], list[str]]:
    """Sorted column names and rows of DuckDB's answer over the tables of a folder."""
    import duckdb

    con = duckdb.connect()
    for table in Path(folder).glob("*.parquet"):
        con.execute(f"create view {table.stem} as select * from read_parquet('{table}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(repr([plain(row[i]) for i in order]) for row in got.fetchall())
