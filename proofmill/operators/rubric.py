"""Scale scores and the checklist review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.functions.scores import grade
from proofmill.functions.text import fill, strip
from proofmill.operators import lint

#: Dimensions, weights, points and templates (fixed values).
DIMENSIONS = ["research_topic", "research_method", "research_content", "research_conclusion", "application_value"]
WEIGHTS = {"doctoral": [0.25, 0.25, 0.2, 0.2, 0.1], "master": [0.2, 0.2, 0.25, 0.2, 0.15]}
POINTS = {"section_completeness": 30, "reference_count_and_numbering": 20, "methodology_section": 20, "conclusion_section": 20, "normative_detection_result": 10}
TEMPLATES = {
    "academic_phd_natural_science": (["摘要", "关键词", "引言", "研究方法", "实验与结果", "结论", "参考文献"], 80),
    "academic_phd_humanities_social_science": (["摘要", "关键词", "引言", "文献综述", "研究方法", "主体论证", "结论", "参考文献"], 100),
    "professional_phd": (["摘要", "关键词", "引言", "实践问题", "研究方法", "应用方案", "结论", "参考文献"], 60),
    "academic_master": (["摘要", "关键词", "引言", "研究方法", "分析与讨论", "结论", "参考文献"], 50),
    "professional_master": (["摘要", "关键词", "引言", "实践背景", "方法与方案", "结论", "参考文献"], 30),
}
LABELS = {"section_completeness": "章节完整性", "reference_count_and_numbering": "参考文献数量与编号", "methodology_section": "研究方法章节", "conclusion_section": "结论章节", "normative_detection_result": "规范检测结果"}
METHOD, CONCLUSION, HEADING = "研究方法", "结论", "参考文献"
FINDINGS = {"references": "参考文献条目：{n}/{least}", "method": "缺少研究方法章节", "conclusion": "缺少结论章节"}
MOST_MESSAGES = 5
SIMILARITY = ("LOCAL-CORPUS-SIMILARITY", "相似片段", "与《{title}》存在相似表达", "核对引用来源，并结合研究语境重新组织表达。", "本地样本")
INNOVATION = ("INNOVATION-RUBRIC", "创新性量表", "{label}量表等级为 {level} 级", "结合量表证据和改进计划进行人工复核。", "该维度", "未填写", "创新性维度")
PASS_SCORE, PASS, REVISE = 80, "基础检查通过", "需修改"


def scale_scores(inputs: DataFrame) -> DataFrame:
    """Inputs (…, degree_type, a level 1 to 5 per dimension) with a weighted score per dimension, total_score and
    grade_label. Scores are null where the degree is unknown or a level is not 1 to 5."""
    total: Column = F.lit(0.0)
    parts = {}
    for i, d in enumerate(DIMENSIONS):
        weight = reduce(lambda w, t: w.when(F.col("degree_type") == t, F.lit(WEIGHTS[t][i])), WEIGHTS, F)
        parts[f"{d}_score"] = F.when(F.col(d).between(1, 5), F.round(F.col(d).cast("double") * 20 * weight, 2))
        total = total + parts[f"{d}_score"]
    return inputs.withColumns(parts).withColumn("total_score", F.round(total, 2)).withColumn("grade_label", F.when(F.col("total_score").isNotNull(), grade(F.col("total_score"))))


def templates(spark: SparkSession) -> DataFrame:
    rows = [(k, s, n) for k, (s, n) in TEMPLATES.items()]
    return spark.createDataFrame(rows, "template_id string, required_sections array<string>, minimum_reference_count int")


def checklist(runs: DataFrame, issues: DataFrame | dict[str, dict] | None = None, rubrics: DataFrame | None = None) -> DataFrame:
    """Runs (doc_id, template_id, text) with missing_sections, reference_count, the five scores, total, label, and
    score_items: (key, label, points, score, findings) of each score.

    A section is there if a line is its name or begins with its name and a full-width colon. References are numbered
    lines after the first reference heading. A method section is only asked for where the template asks for one. An
    unknown template gives no row. Of the issues the first five messages are listed; they are joined by doc_id, or where
    they are named by rules found in the same row. Everything else is one projection over the text.
    """
    kinds = templates(runs.sparkSession) if rubrics is None else rubrics
    lines = F.transform(F.split("text", "\r?\n"), strip)
    rows = runs.join(kinds, "template_id").withColumn("_l", lines)
    missing = F.expr("filter(required_sections, s -> not exists(_l, x -> x = s or startswith(x, concat(s, '：'))))")
    head = F.array_position("_l", HEADING)
    after = F.when(head > 0, F.slice("_l", head + 1, F.greatest(F.size("_l"), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns({"missing_sections": missing, "reference_count": F.size(F.filter(after, lambda x: x.rlike("^\\[\\d+\\]")))})
    n_issues, messages = F.lit(0), F.array().cast("array<string>")
    if isinstance(issues, dict):
        places = F.transform(lint.found_in(F.col("text"), issues), lambda x: F.struct(x["line"].alias("line"), x["column"].alias("column"), x["rule_id"].alias("rule_id"), x["message"].alias("message")))
        rows = rows.withColumn("_p", F.coalesce(places, F.array().cast("array<struct<line:bigint,column:bigint,rule_id:string,message:string>>")))
        n_issues, messages = F.size("_p"), F.transform(F.slice(F.array_sort("_p"), 1, MOST_MESSAGES), lambda x: x["message"])
    elif issues is not None:
        first = F.slice(F.array_sort(F.collect_list(F.struct("line", "column", "rule_id", "message"))), 1, MOST_MESSAGES)
        rows = rows.join(issues.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_i"), F.transform(first, lambda x: x["message"]).alias("_m")), "doc_id", "left")
        n_issues, messages = F.coalesce("_i", F.lit(0)), F.coalesce("_m", messages)
    no = lambda s: F.array_contains("missing_sections", s)
    scores = {
        "section_completeness": F.size("missing_sections") == 0,
        "reference_count_and_numbering": F.col("reference_count") >= F.col("minimum_reference_count"),
        "methodology_section": ~no(METHOD),
        "conclusion_section": ~no(CONCLUSION),
        "normative_detection_result": n_issues == 0,
    }
    rows = rows.withColumns({k: F.when(ok, POINTS[k]).otherwise(0) for k, ok in scores.items()})
    rows = rows.withColumn("total_score", reduce(lambda a, b: a + b, [F.col(k) for k in POINTS]))
    label = F.when((F.col("total_score") >= PASS_SCORE) & (F.size("missing_sections") == 0), PASS).otherwise(REVISE)
    if_missing = lambda s, text: F.when(no(s), F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    findings = {
        "section_completeness": F.col("missing_sections"),
        "reference_count_and_numbering": F.array(fill(FINDINGS["references"], n=F.col("reference_count"), least=F.col("minimum_reference_count"))),
        "methodology_section": if_missing(METHOD, FINDINGS["method"]),
        "conclusion_section": if_missing(CONCLUSION, FINDINGS["conclusion"]),
        "normative_detection_result": messages,
    }
    items = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(LABELS[k]).alias("label"), F.lit(POINTS[k]).alias("points"), F.col(k).alias("score"), findings[k].alias("findings")) for k in POINTS])
    return rows.withColumns({"result_label": label, "score_items": items}).select("doc_id", "template_id", "missing_sections", "reference_count", *POINTS, "total_score", "result_label", "score_items")


def source_findings(matches: DataFrame, dimensions: DataFrame) -> DataFrame:
    """(report_id, finding_id, rule_id, category, severity, excerpt, message, suggestion) from the matches (report_id, idx,
    sample_id, title, jaccard_score, excerpt) and scale dimensions (report_id, idx, key, label, level) of reports; idx
    counts from 1. Matches are high from a similarity of 0.5, else medium; dimensions low from level 4, else medium."""
    has = lambda c: F.nullif(F.col(c), F.lit(""))
    number = F.col("idx").cast("string")
    rule, category, message, suggestion, sample = SIMILARITY
    one = matches.select(
        "report_id", F.concat(F.lit("duplication-"), F.coalesce(has("sample_id"), number)).alias("finding_id"), F.lit(rule).alias("rule_id"), F.lit(category).alias("category"),
        F.when(F.col("jaccard_score") >= 0.5, "high").otherwise("medium").alias("severity"), F.coalesce(has("excerpt"), has("title"), F.lit(category)).alias("excerpt"),
        fill(message, title=F.coalesce(has("title"), F.lit(sample))).alias("message"), F.lit(suggestion).alias("suggestion"),
    )
    rule, category, message, suggestion, this, open_, name = INNOVATION
    level = F.coalesce(F.nullif(F.col("level"), F.lit(0)).cast("string"), F.lit(open_))
    two = dimensions.select(
        "report_id", F.concat(F.lit("innovation-"), F.coalesce(has("key"), number)).alias("finding_id"), F.lit(rule).alias("rule_id"), F.lit(category).alias("category"),
        F.when(F.col("level") >= 4, "low").otherwise("medium").alias("severity"), F.coalesce(has("label"), has("key"), F.lit(name)).alias("excerpt"),
        fill(message, label=F.coalesce(has("label"), F.lit(this)), level=level).alias("message"), F.lit(suggestion).alias("suggestion"),
    )
    return one.unionByName(two)
