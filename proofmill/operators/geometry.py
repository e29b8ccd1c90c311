"""Findings on pages: unions of rectangles, one annotation per signature, ordering and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.functions.text import page_label


def valid_rect(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, page: Column) -> Column:
    """Finite, not empty, on a page of some size and of a whole number from 1 on."""
    values = (x1, y1, x2, y2, width, height)
    finite = reduce(lambda a, b: a & b, [~F.isnan(x) & (F.abs(x) < float("inf")) for x in values])
    return F.coalesce(finite & (x2 > x1) & (y2 > y1) & (width > 0) & (height > 0) & (page >= 1) & (page == F.floor(page)), F.lit(False))


def union_rects(rects: DataFrame, keys: tuple[str, ...] = ("finding_id", "page_number")) -> DataFrame:
    """The rectangle around all valid ones of each finding and page, and its centre."""
    ok = rects.where(valid_rect(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2", "width", "height", "page_number")]))
    out = ok.groupBy(*keys).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    return out.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2})


def distinct_annotations(annotations: DataFrame, signature: tuple[str, ...] = ("finding_id", "page_number", "x1", "y1", "x2", "y2")) -> DataFrame:
    """One annotation of each signature, one with an anchor if there is any."""
    first = Window.partitionBy(*signature).orderBy(F.col("anchor").isNull(), "anchor")
    return annotations.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.col("page_number").asc_nulls_last(), F.col("y1").asc_nulls_last(), "idx")


def pages(rects: DataFrame) -> DataFrame:
    """(finding_id, pages): its page numbers in order, joined."""
    return rects.groupBy("finding_id").agg(page_label(F.collect_set("page_number")).alias("pages"))


def choose(findings: DataFrame, severity: str | None = None, rule: str | None = None) -> DataFrame:
    rows = findings if severity is None else findings.where(F.col("severity") == severity)
    return rows if rule is None else rows.where(F.col("rule_id") == rule)


def page_of(rows: DataFrame, order: list[Column], page: int, size: int = 8) -> DataFrame:
    """One page of an ordered list, sorted anew; ``paging.Pages`` keeps a list for many pages."""
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)
