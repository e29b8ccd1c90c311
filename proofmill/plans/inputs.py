"""The provided tables in the shapes of the library's records.

There are no review records among them, so subjects, sources and payloads are derived from ``events`` by expressions that
SQL can repeat: ``SQL`` holds the same derivations as DuckDB common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject_id, username, role, college_id, supervisor_id): a student per user of the events, and seven supervisors."""
    students = table(spark, sf_dir, "events").select("user_id").distinct().selectExpr("cast(user_id as string) subject_id", "'user' || user_id username", "'STUDENT' role", "'college' || user_id % 3 college_id", "'sup' || user_id % 7 supervisor_id")
    leaders = spark.range(5).selectExpr("'sup' || id subject_id", "'leader' || id username", "'SUPERVISOR' role", "cast(null as string) college_id", "cast(null as string) supervisor_id")
    return students.unionByName(leaders)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ledger row per event."""
    return table(spark, sf_dir, "events").selectExpr("cast(event_id as string) id", "cast(user_id as string) subject_id", "event_type detection_type", "ts created_at", "value", "props")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'view'").selectExpr(
        "cast(event_id as string) id", "cast(user_id as string) subject_id", "if(event_id % 5 = 0, 'failed', 'completed') status", "if(event_id % 3 = 0, null, 'f' || event_id || '.txt') source_filename",
        "if(event_id % 2 = 0, '[{\"title\":\"T' || event_id % 4 || '\"}]', '[]') rule_snapshot_json", "if(event_id % 4 = 0, '[]', '[1,2,3]') issues_json",
        "'{\"high\":' || event_id % 3 || ',\"medium\":' || event_id % 5 || ',\"low\":' || event_id % 7 || '}' severity_counts_json", "ts created_at",
    )


def duplication(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'click'").selectExpr("cast(event_id as string) id", "cast(user_id as string) subject_id", "if(event_id % 3 = 0, null, 'd' || event_id) source_filename", "(event_id % 101) / 100.0d total_similarity_rate", "ts created_at")


def innovation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'signup'").selectExpr("cast(event_id as string) id", "cast(user_id as string) subject_id", "'paper ' || event_id thesis_title", "if(event_id % 11 = 0, '{}', '{\"total_score\":' || event_id % 101 || '}') scoring_snapshot_json", "ts created_at")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").selectExpr(
        "cast(event_id as string) id", "cast(user_id as string) subject_id", "'thesis ' || event_id thesis_title", "cast(null as string) source_filename", "'academic_master' template_id", "if(event_id % 2 = 0, '基础检查通过', '需修改') result_label",
        "if(event_id % 6 = 0, null, cast(event_id % 101 as int)) total_score", "'[{\"key\":\"a\",\"score\":' || event_id % 50 || '},{\"key\":\"b\",\"score\":7}]' score_items_json", "ts created_at",
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_id % 4 = 0").selectExpr("cast(event_id as string) id", "'b' || event_id % 9 batch_id", "cast(user_id as string) student_id", "'sup' || user_id % 7 supervisor_id", "event_type source_type", "cast(event_id as string) report_id", "if(event_id % 8 = 0, 'review_completed_feedback', 'submitted_pending_review') status", "ts created_at")


def todos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_id % 4 = 0 or event_id % 30 = 1").selectExpr("'t' || event_id id", "cast(event_id as string) submission_id", "'sup' || user_id % 7 assignee_id", "if(event_id % 8 = 0, 'completed', 'pending') status", "ts created_at")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_id % 8 = 0").selectExpr("cast(event_id as string) submission_id", "'ok ' || event_id % 5 overall_evaluation", "'more' improvement_suggestions", "array(named_struct('finding_id', 'f' || event_id, 'comment', 'c')) annotations", "ts created_at")


SQL = {
    "users": "users as (select distinct user_id::varchar subject_id, 'user' || user_id username, 'STUDENT' as role, 'college' || (user_id % 3) college_id, 'sup' || (user_id % 7) supervisor_id from events union all select 'sup' || i, 'leader' || i, 'SUPERVISOR', null, null from range(5) r(i))",
    "facts": "facts as (select event_id::varchar id, user_id::varchar subject_id, event_type detection_type, ts created_at, value, props from events)",
    "tasks": """tasks as (select event_id::varchar id, user_id::varchar subject_id, case when event_id % 5 = 0 then 'failed' else 'completed' end status, case when event_id % 3 = 0 then null else 'f' || event_id || '.txt' end source_filename,
      case when event_id % 2 = 0 then 'T' || (event_id % 4) end title, case when event_id % 4 = 0 then 0 else 3 end n_issues, event_id % 3 high, event_id % 5 medium, event_id % 7 low, ts created_at from events where event_type = 'view')""",
    "duplication": "duplication as (select event_id::varchar id, user_id::varchar subject_id, case when event_id % 3 = 0 then null else 'd' || event_id end source_filename, (event_id % 101) / 100.0::double total_similarity_rate, ts created_at from events where event_type = 'click')",
    "innovation": "innovation as (select event_id::varchar id, user_id::varchar subject_id, 'paper ' || event_id thesis_title, case when event_id % 11 = 0 then null else (event_id % 101)::double end score, ts created_at from events where event_type = 'signup')",
    "reviews": "reviews as (select event_id::varchar id, user_id::varchar subject_id, 'thesis ' || event_id thesis_title, case when event_id % 2 = 0 then '基础检查通过' else '需修改' end result_label, case when event_id % 6 = 0 then null else (event_id % 101)::int end total_score, (event_id % 50 + 7)::double items, ts created_at from events where event_type = 'purchase')",
    "submissions": "submissions as (select event_id::varchar id, 'b' || (event_id % 9) batch_id, user_id::varchar student_id, 'sup' || (user_id % 7) supervisor_id, event_type source_type, event_id::varchar report_id, case when event_id % 8 = 0 then 'review_completed_feedback' else 'submitted_pending_review' end status, ts created_at from events where event_id % 4 = 0)",
    "todos": "todos as (select 't' || event_id id, event_id::varchar submission_id, 'sup' || (user_id % 7) assignee_id, case when event_id % 8 = 0 then 'completed' else 'pending' end status, ts created_at from events where event_id % 4 = 0 or event_id % 30 = 1)",
    "feedback": "feedback as (select event_id::varchar submission_id, 'ok ' || (event_id % 5) overall_evaluation, ts created_at from events where event_id % 8 = 0)",
}


def sql(names: str, body: str) -> str:
    """A query over the named derivations."""
    return "with recursive " + ",\n".join(SQL[n] for n in names.split()) + "\n" + body
