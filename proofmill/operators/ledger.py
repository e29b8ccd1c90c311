"""The activity ledger: sources united, the latest record of each subject and type, scopes, filters and statistics."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.functions.scores import date_of, percent_label
from proofmill.operators.postings import matches

LABELS = {"normative": "规范性检测", "duplication": "校内库查重", "ai_review": "AI智能评阅"}
CSV_HEADER = ["记录ID", "学院", "学号", "姓名", "导师", "学生类别", "论文题目", "检测类型", "检测模板", "核心结果", "详情链接", "检测时间"]
CSV_COLUMNS = ["id", "college_name", "student_number", "student_name", "supervisor_name", "student_category", "thesis_title", "detection_type", "template_name", "core_result", "detail_url", "created_at"]


def latest_first(created: str = "created_at", tie: str = "id") -> list[Column]:
    return [F.date_trunc("second", F.col(created).try_cast("timestamp")).desc_nulls_last(), F.col(created).desc_nulls_last(), F.col(tie).desc()]


def with_latest_rank(facts: DataFrame, keys: tuple[str, ...] = ("subject_id", "detection_type"), created: str = "created_at", tie: str = "id") -> DataFrame:
    """latest_rank among all rows of a subject and type, before any filter; is_latest is 1 for the first."""
    ranked = facts.withColumn("latest_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*latest_first(created, tie))))
    return ranked.withColumn("is_latest", (F.col("latest_rank") == 1).cast("int"))


def unite(tasks: DataFrame, duplication: DataFrame, reviews: DataFrame) -> DataFrame:
    """The three sources as one ledger. No text column is read from them."""
    one = tasks.where("status = 'completed'").select(
        F.concat(F.lit("normative:"), "id").alias("id"),
        F.col("id").alias("source_record_id"),
        "subject_id",
        F.coalesce("source_filename", F.lit("规范性检测")).alias("thesis_title"),
        "source_filename",
        F.lit("normative").alias("detection_type"),
        F.coalesce(F.get_json_object("rule_snapshot_json", "$[0].title"), F.lit("规范检测模板")).alias("template_name"),
        F.concat(F.lit("发现 "), F.coalesce(F.json_array_length("issues_json"), F.lit(0)).cast("string"), F.lit(" 项格式问题")).alias("core_result"),
        F.concat(F.lit("/normative-reports/"), "id").alias("detail_url"),
        "created_at",
    )
    two = duplication.select(
        F.concat(F.lit("duplication:"), "id").alias("id"),
        F.col("id").alias("source_record_id"),
        "subject_id",
        F.coalesce("source_filename", F.lit("校内库查重")).alias("thesis_title"),
        "source_filename",
        F.lit("duplication").alias("detection_type"),
        F.lit("校内库查重报告").alias("template_name"),
        F.concat(F.lit("相似度 "), percent_label(F.col("total_similarity_rate"))).alias("core_result"),
        F.concat(F.lit("/duplication-history/"), "id").alias("detail_url"),
        "created_at",
    )
    three = reviews.select(
        F.concat(F.lit("ai_review:"), "id").alias("id"),
        F.col("id").alias("source_record_id"),
        "subject_id",
        "thesis_title",
        "source_filename",
        F.lit("ai_review").alias("detection_type"),
        F.col("template_id").alias("template_name"),
        F.concat("result_label", F.lit("（"), F.col("total_score").cast("string"), F.lit("分）")).alias("core_result"),
        F.concat(F.lit("/ai-review/results/"), "id").alias("detail_url"),
        "created_at",
    )
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return with_latest_rank(reduce(DataFrame.unionByName, [one, two, three]).withColumn("detection_type_label", labels[F.col("detection_type")]))


def with_people(ledger: DataFrame, users: DataFrame) -> DataFrame:
    """Each record with its student, and the supervisor's name or else id. Spark broadcasts the users where they are few."""
    people = users.select(F.col("subject_id"), "username", "role", "college_id", "supervisor_id")
    leaders = users.select(F.col("subject_id").alias("supervisor_id"), F.col("username").alias("_leader"))
    return (
        ledger.join(people.where("role = 'STUDENT'"), "subject_id")
        .join(leaders, "supervisor_id", "left")
        .select(
            *[F.col(c) for c in ledger.columns],
            "college_id",
            F.coalesce("college_id", F.lit("全校")).alias("college_name"),
            F.col("subject_id").alias("student_number"),
            F.col("username").alias("student_name"),
            "supervisor_id",
            F.coalesce("_leader", "supervisor_id", F.lit("")).alias("supervisor_name"),
            F.lit("学生").alias("student_category"),
        )
    )


def in_scope(rows: DataFrame, scope: Mapping[str, str]) -> DataFrame:
    """scope: role, and the id that the role is bound to. School sees all; an unknown role sees nothing."""
    role, own = scope.get("role"), scope.get("id")
    if role == "school":
        return rows
    if role == "supervisor":
        return rows.where(F.col("supervisor_id") == own)
    if role == "college":
        return rows.where(F.col("college_id") == own)
    if role == "student":
        return rows.where((F.col("subject_id") == own) | (F.col("student_name") == own))
    return rows.where(F.lit(False))


def normalize_filters(filters: Mapping[str, object] | None) -> dict[str, object]:
    """Texts are trimmed, empty ones dropped; latest_only is true for true and 'true'."""
    filters = dict(filters or {})
    out: dict[str, object] = {k: v.strip() for k in ("detection_type", "from", "to", "student") if isinstance(v := filters.get(k), str) and v.strip()}
    if filters.get("latest_only") in (True, "true"):
        out["latest_only"] = True
    return out


def apply_filters(rows: DataFrame, filters: Mapping[str, object] | None, created: str = "created_at", keyword_columns: tuple[str, ...] = ("subject_id", "student_name", "thesis_title", "source_filename")) -> DataFrame:
    """The filters that are there. Dates are inclusive and in UTC; a bad one lets nothing through. latest_only is the
    latest of all, not the latest of what the other filters leave."""
    f = normalize_filters(filters)
    day = F.to_date(F.col(created).try_cast("timestamp"))
    if "detection_type" in f:
        rows = rows.where(F.col("detection_type") == f["detection_type"])
    if "from" in f:
        rows = rows.where(day >= date_of(F.lit(f["from"])))
    if "to" in f:
        rows = rows.where(day <= date_of(F.lit(f["to"])))
    if "student" in f:
        rows = rows.where(matches(list(keyword_columns), str(f["student"])))
    if f.get("latest_only"):
        rows = rows.where("latest_rank = 1")
    return rows


def find(ledger: DataFrame, record_id: str) -> DataFrame:
    """The record of that id or source id; both conditions reach the scan."""
    return ledger.where((F.col("id") == record_id) | (F.col("source_record_id") == record_id)).limit(1)


def _today(created: str, today: str) -> Column:
    return F.count_if(F.to_date(F.col(created).try_cast("timestamp")) == F.to_date(F.lit(today)))


def totals(ledger: DataFrame, today: str, created: str = "created_at") -> DataFrame:
    return ledger.agg(F.count(F.lit(1)).alias("record_count"), F.countDistinct("subject_id").alias("subject_count"), _today(created, today).alias("today_count"))


def by_type(ledger: DataFrame, today: str, created: str = "created_at") -> DataFrame:
    """The same per type, the type of the newest record first."""
    out = ledger.groupBy("detection_type").agg(F.count(F.lit(1)).alias("record_count"), F.countDistinct("subject_id").alias("subject_count"), _today(created, today).alias("today_count"), F.max(created).alias("newest"))
    return out.orderBy(F.desc("newest"), "detection_type").drop("newest")


def daily_trend(ledger: DataFrame, created: str = "created_at") -> DataFrame:
    day = F.substring(F.col(created).cast("string"), 1, 10).alias("day")
    return ledger.groupBy(day).agg(F.count(F.lit(1)).alias("record_count"), F.countDistinct("subject_id").alias("subject_count")).orderBy("day")


def ordered(ledger: DataFrame) -> DataFrame:
    return ledger.orderBy(*latest_first())


def csv_rows(ledger: DataFrame) -> DataFrame:
    """The twelve columns of the export under their headings."""
    return ledger.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(h) for c, h in zip(CSV_COLUMNS, CSV_HEADER, strict=True)])
