"""The review workflow: submissions, supervisors' queues, feedback and students' results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUBMITTED, REVIEWED, VIEWED = "submitted_pending_review", "review_completed_feedback", "student_viewed_feedback"


def with_keys(rows: DataFrame, filters: dict[str, object], columns: dict[str, str]) -> DataFrame:
    """A condition for each filter that is there; columns: filter to column."""
    for key, column in columns.items():
        if (value := filters.get(key)) not in (None, ""):
            rows = rows.where(F.col(column) == value)
    return rows


def queue(todos: DataFrame, submissions: DataFrame, supervisor: str | None = None, filters: dict[str, object] | None = None) -> DataFrame:
    """Todos with their submissions, pending ones first, then the newest."""
    s = submissions.select(F.col("id").alias("submission_id"), "batch_id", "student_id", "source_type", "report_id", F.col("status").alias("submission_status"))
    rows = todos.join(s, "submission_id")
    rows = rows if supervisor is None else rows.where(F.col("assignee_id") == supervisor)
    rows = with_keys(rows, filters or {}, {"status": "status", "student_id": "student_id", "source_type": "source_type"})
    return rows.orderBy(F.when(F.col("status") == "pending", 0).otherwise(1), F.desc("created_at"), "id")


def unread(todos: DataFrame, supervisor: str) -> DataFrame:
    return todos.where((F.col("assignee_id") == supervisor) & (F.col("status") != "completed")).agg(F.count(F.lit(1)).alias("n"))


def results(submissions: DataFrame, feedback: DataFrame, student: str | None = None, only_reviewed: bool = False) -> DataFrame:
    """A student's submissions with their feedback, with or without those that have none, newest first."""
    rows = submissions if student is None else submissions.where(F.col("student_id") == student)
    f = feedback.select("submission_id", "annotations", "overall_evaluation", "improvement_suggestions", F.col("created_at").alias("reviewed_at"))
    joined = rows.join(f, rows["id"] == f["submission_id"], "inner" if only_reviewed else "left").drop("submission_id")
    return joined.orderBy(F.date_trunc("second", F.col("created_at").try_cast("timestamp")).desc(), F.desc("created_at"), F.desc("id"))


def orphans(children: DataFrame, parents: DataFrame, on: dict[str, str], where: Column | None = None) -> DataFrame:
    """Children without a parent; on: child column to parent column, a composite key; ``where`` on the parent."""
    p = (parents if where is None else parents.where(where)).select(*[F.col(b).alias(f"_{a}") for a, b in on.items()])
    return children.join(p, reduce(lambda x, y: x & y, [F.col(a) == F.col(f"_{a}") for a in on]), "left_anti")


def attach_sources(submissions: DataFrame, sources: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Each submission with the columns of its report, whose table its source_type names, if the student owns it. One
    join with the united sources instead of a look-up per row; others keep nulls and ``found`` false."""
    every = reduce(DataFrame.unionByName, [t.select(F.lit(k).alias("source_type"), F.col("id").alias("report_id"), F.col("subject_id").alias("student_id"), *columns) for k, t in sources.items()])
    return submissions.join(every.withColumn("found", F.lit(True)), ["source_type", "report_id", "student_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


#: How the kinds of reports are called, and what is said of them (fixed values).
KINDS = {"normative": "规范性检测", "duplication": "校内库查重", "innovation": "创新性评价", "ai_review": "AI智能评阅"}


def own_reports(tasks: DataFrame, duplication: DataFrame, innovation: DataFrame, reviews: DataFrame, subject: str | None = None) -> DataFrame:
    """(key, source_type, report_id, title, summary, created_at): finished reports of all four kinds, one student's or
    everyone's, newest first."""
    digits = lambda x: F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))
    counts = F.map_values(F.from_json("severity_counts_json", "map<string,bigint>"))
    issues = F.coalesce(F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0).cast("long"))), F.lit(0))
    rate = F.floor(F.col("total_similarity_rate") * 1000 + 0.5) / 10
    marked = lambda label, score, grade, none: F.coalesce(F.concat(F.lit(label), digits(score), F.coalesce(F.concat(F.lit(" · "), F.nullif(grade, F.lit(""))), F.lit(""))), F.lit(none))
    scored = lambda key: F.get_json_object("scoring_snapshot_json", f"$.{key}")
    parts = {
        "normative": (tasks.where("status = 'completed'"), F.concat(F.lit("规范问题 "), issues.cast("string"), F.lit(" 项"))),
        "duplication": (duplication, F.when(rate.isNotNull(), F.concat(F.lit("相似度 "), F.format_string("%.1f", rate), F.lit("%"))).otherwise("相似度报告已完成")),
        "innovation": (innovation, marked("创新评分 ", scored("total_score").try_cast("double"), scored("grade_label"), "创新性报告已完成")),
        "ai_review": (reviews, marked("AI 评分 ", F.col("total_score").cast("double"), F.col("result_label"), "AI 评阅报告已完成")),
    }
    rows = []
    for kind, (table, summary) in parts.items():
        names = [F.nullif(F.col(c), F.lit("")) for c in ("source_filename", "thesis_title") if c in table.columns]
        title = F.coalesce(*names, F.concat(F.lit(f"{KINDS[kind]} "), "id"))
        rows.append(table.select(F.concat(F.lit(f"{kind}:"), "id").alias("key"), F.lit(kind).alias("source_type"), F.col("id").alias("report_id"), "subject_id", title.alias("title"), summary.alias("summary"), "created_at"))
    every = reduce(DataFrame.unionByName, rows)
    every = every if subject is None else every.where(F.col("subject_id") == subject)
    return every.orderBy(F.col("created_at").try_cast("timestamp").desc_nulls_last(), "key")


def clean_annotations(annotations: Column) -> Column:
    """Trimmed finding ids and comments, without those that lack one."""
    trimmed = F.transform(annotations, lambda a: F.struct(F.trim(a["finding_id"]).alias("finding_id"), F.trim(a["comment"]).alias("comment")))
    return F.filter(trimmed, lambda a: (F.length(a["finding_id"]) > 0) & (F.length(a["comment"]) > 0))


def submit(batch_id: str, reports: DataFrame, created_at: str) -> tuple[DataFrame, DataFrame]:
    """Submissions and pending todos from reports (id, subject_id, supervisor_id, source_type)."""
    key = F.concat_ws(":", F.lit(batch_id), "source_type", "id")
    made = reports.select(key.alias("id"), F.lit(batch_id).alias("batch_id"), F.col("subject_id").alias("student_id"), "supervisor_id", "source_type", F.col("id").alias("report_id"), F.lit(SUBMITTED).alias("status"), F.lit(created_at).alias("created_at"))
    todos = made.select(F.concat(F.lit("todo:"), "id").alias("id"), F.col("id").alias("submission_id"), F.col("supervisor_id").alias("assignee_id"), F.col("student_id").alias("actor_id"), F.lit("pending").alias("status"), "created_at")
    return made, todos


def review(submissions: DataFrame, todos: DataFrame, feedback: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after new feedback (submission_id, …). A submission that has feedback is locked: its new one is
    left out. Tables are written one by one; there is no transaction over all of them."""
    open_ = new.dropDuplicates(["submission_id"]).join(feedback.select("submission_id"), "submission_id", "left_anti").join(submissions.select(F.col("id").alias("submission_id")), "submission_id", "left_semi")
    done = open_.select(F.col("submission_id").alias("_s"))
    s = submissions.join(done, submissions["id"] == done["_s"], "left").withColumn("status", F.when(F.col("_s").isNotNull(), REVIEWED).otherwise(F.col("status"))).drop("_s")
    t = todos.join(done, todos["submission_id"] == done["_s"], "left").withColumn("status", F.when(F.col("_s").isNotNull(), "completed").otherwise(F.col("status"))).drop("_s")
    return s, t, feedback.unionByName(open_, allowMissingColumns=True)


def view(submissions: DataFrame, submission: str, student: str) -> DataFrame:
    """A first look at feedback moves the status on, once."""
    seen = (F.col("id") == submission) & (F.col("student_id") == student) & (F.col("status") == REVIEWED)
    return submissions.withColumn("status", F.when(seen, VIEWED).otherwise(F.col("status")))


def polish_history(whole: DataFrame, local: DataFrame) -> DataFrame:
    """Both kinds of rewriting results, newest first; columns that one lacks are null."""
    both = whole.withColumn("type", F.lit("whole")).unionByName(local.withColumn("type", F.lit("local")), allowMissingColumns=True)
    return both.orderBy(F.desc("created_at"), "id")


def validate(rows: DataFrame, checks: dict[str, tuple[Column, str]]) -> DataFrame:
    """Adds ``errors``: (field, message) of each check that does not hold; checks: field to (condition, message)."""
    entries = [F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"))) for field, (ok, message) in checks.items()]
    return rows.withColumn("errors", F.array_compact(F.array(*entries)))
