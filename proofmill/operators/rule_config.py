"""Layered rule configuration: national rules, overridden by the school, overridden by a college."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The national rules and what a draft must have (fixed values).
DEFAULTS = [
    ("NORM-001", "章节顺序", "摘要、关键词、引言、结论、参考文献必须按顺序出现", "{}"),
    ("NORM-002", "标点配对", "检查中英文圆括号、方括号、书名号和引号是否成对", "{}"),
    ("NORM-003", "重复标点", "报告“，，”“。。”“；；”和连续三个以上相同标点", "{}"),
    ("NORM-004", "日期格式", "数字日期仅接受 YYYY-MM-DD", "{}"),
    ("NORM-005", "参考文献", "参考文献后的非空行必须以 [1] 开始并连续递增", "{}"),
    ("TEXT-LONG-SENTENCE", "文本质量", "长句字符阈值", '{"max_chars":120}'),
]
SEVERITIES = ["严重", "一般", "轻微"]
DRAFT_FIELDS = ["rule_id", "title", "category", "severity", "enabled", "message", "params"]
_DRAFT = "struct<rule_id:string,title:string,category:string,severity:string,enabled:string,message:string,params:string>"
COLUMNS = ["rule_id", "title", "category", "severity", "enabled", "match_params", "prompt"]


def national(spark: SparkSession) -> DataFrame:
    rows = [(r, t, c, "medium", True, p, t) for r, c, t, p in DEFAULTS]
    return spark.createDataFrame(rows, "rule_id string, title string, category string, severity string, enabled boolean, match_params string, prompt string")


def latest_overrides(overrides: DataFrame) -> DataFrame:
    """The last override of each scope and rule; a null college is a scope of its own."""
    last = Window.partitionBy("scope_level", "college_id", "rule_id").orderBy(F.desc("updated_at"), F.desc("id"))
    return overrides.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def effective(colleges: DataFrame, overrides: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(college_id, rule columns, source) for every college: of each rule the row of the nearest layer, whole.

    Rules are few, so national and school rows meet the colleges in a broadcast product of two small dimensions; a rule
    id that only an override knows is added.
    """
    base = national(colleges.sparkSession) if base is None else base
    last = latest_overrides(overrides)
    general = base.select(*COLUMNS, F.lit("national").alias("source"), F.lit(0).alias("layer")).unionByName(last.where("scope_level = 'school'").select(*COLUMNS, F.lit("school").alias("source"), F.lit(1).alias("layer")))
    near = Window.partitionBy("rule_id").orderBy(F.desc("layer"))
    general = general.withColumn("_n", F.row_number().over(near)).where("_n = 1").drop("_n")
    own = last.where("scope_level = 'college'").select("college_id", *COLUMNS, F.lit("college").alias("source"), F.lit(2).alias("layer"))
    known = colleges.select("college_id").distinct()
    every = known.join(general, F.lit(True)).unionByName(own.join(known, "college_id", "left_semi"))
    nearest = Window.partitionBy("college_id", "rule_id").orderBy(F.desc("layer"))
    return every.withColumn("_n", F.row_number().over(nearest)).where("_n = 1").drop("_n", "layer").orderBy("college_id", "rule_id")


def parse_drafts(files: DataFrame) -> DataFrame:
    """Files (file_id, json) to (file_id, item_index, fields, errors): a row per item, or one without an index if the
    file is no JSON array."""
    items = F.from_json("json", "array<string>")
    rows = files.select("file_id", F.when(F.col("json").rlike("^\\s*\\["), items).alias("items"))
    bad = rows.where("items is null").select("file_id", F.lit(None).cast("int").alias("item_index"), *[F.lit(None).cast("string").alias(f) for f in DRAFT_FIELDS], F.array(_error("root", "JSON 顶层必须为数组")).alias("errors"))
    each = rows.where("items is not null").select("file_id", F.posexplode("items").alias("item_index", "item")).withColumn("d", F.from_json("item", _DRAFT))
    kind = F.schema_of_variant(F.try_parse_json("item"))
    value = lambda k: F.col(f"d.{k}")
    typed = lambda k: F.schema_of_variant(F.try_variant_get(F.try_parse_json("item"), f"$.{k}", "variant"))
    checks = [F.when(F.coalesce(value(f), F.lit("")) == "", _error(f, f"{f} 缺失")) for f in DRAFT_FIELDS]
    checks.append(F.when(~value("severity").isin(*SEVERITIES), _error("severity", "severity 必须为严重、一般、轻微")))
    checks.append(F.when(typed("enabled").isNotNull() & (typed("enabled") != "BOOLEAN"), _error("enabled", "enabled 必须为布尔值")))
    checks.append(F.when(typed("params").isNotNull() & ~typed("params").startswith("OBJECT"), _error("params", "params 必须为 JSON 对象")))
    errors = F.when(~F.coalesce(kind.startswith("OBJECT"), F.lit(False)), F.array(_error("item", "规则项必须为对象"))).otherwise(F.array_compact(F.array(*checks)))
    good = each.select("file_id", "item_index", *[value(f).alias(f) for f in DRAFT_FIELDS], errors.alias("errors"))
    return good.unionByName(bad)


def _error(field: str, reason: str) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(reason).alias("reason"))


def accepted(drafts: DataFrame) -> DataFrame:
    """Items of files without any error: all of a file or none."""
    faulty = drafts.where(F.size("errors") > 0).select("file_id").distinct()
    return drafts.join(faulty, "file_id", "left_anti").drop("errors")
