"""Quality scores: one row per record and metric, then means by subject, metric summaries, histograms and portraits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofmill.functions.scores import decile, item_sum, json_number, normative_score, originality_score, round_half_up
from proofmill.operators.ledger import latest_first, with_latest_rank

METRICS = {"normative": "规范性", "originality": "原创性", "innovation": "创新性", "review_base": "评阅基础"}
#: Sources in the order that settles ties, and the metric of each.
SOURCES = {"normative": "normative", "duplication": "originality", "innovation": "innovation", "ai_review": "review_base"}
_ITEMS = "array<struct<key:string,score:string>>"


def unite(tasks: DataFrame, duplication: DataFrame, innovation: DataFrame, reviews: DataFrame) -> DataFrame:
    """(source_record_id, subject_id, thesis_title, source_filename, detection_type, metric, score, created_at, latest_rank).

    Payloads become typed scores in each branch, so no JSON is carried through the union.
    """
    base = lambda df, kind, title, file, score: df.select(
        F.col("id").alias("source_record_id"), "subject_id", title.alias("thesis_title"), file.cast("string").alias("source_filename"), F.lit(kind).alias("detection_type"), F.lit(SOURCES[kind]).alias("metric"), score.cast("double").alias("score"), "created_at"
    )
    counts = lambda k: F.get_json_object("severity_counts_json", f"$.{k}").try_cast("double")
    items = F.from_json("score_items_json", _ITEMS)
    parts = [
        base(tasks.where("status = 'completed'"), "normative", F.coalesce("source_filename", F.lit("规范性检测")), F.col("source_filename"), normative_score(counts("high"), counts("medium"), counts("low"))),
        base(duplication, "duplication", F.coalesce("source_filename", F.lit("校内库查重")), F.col("source_filename"), originality_score(F.coalesce("total_similarity_rate", F.lit(0.0)))),
        base(innovation, "innovation", F.col("thesis_title"), F.lit(None), json_number(F.col("scoring_snapshot_json"), "$.total_score")),
        base(reviews, "ai_review", F.col("thesis_title"), F.col("source_filename"), F.coalesce(F.col("total_score").cast("double"), item_sum(items))),
    ]
    return with_latest_rank(reduce(DataFrame.unionByName, parts), tie="source_record_id")


def payloads(duplication: DataFrame, reviews: DataFrame) -> DataFrame:
    """(source_record_id, payload_json) of the sources that store columns: JSON objects, missing values as null. Items that
    are JSON text already stay a text inside."""
    whole = {"ignoreNullFields": "false"}
    one = duplication.select(F.col("id").alias("source_record_id"), F.to_json(F.struct("total_similarity_rate"), whole).alias("payload_json"))
    two = reviews.select(F.col("id").alias("source_record_id"), F.to_json(F.struct("total_score", F.col("score_items_json").alias("score_items")), whole).alias("payload_json"))
    return one.unionByName(two)


def ordered(rows: DataFrame, name: str = "student_name", created: str = "created_at") -> DataFrame:
    """By name, each name's newest first."""
    return rows.orderBy(name, *latest_first(created, "source_record_id"))


def subject_scores(scored: DataFrame) -> DataFrame:
    """(subject_id, a column per metric): means without nulls, to one decimal. One pass; no pivot job."""
    mean = lambda m: round_half_up(F.avg(F.when(F.col("metric") == m, F.col("score")))).alias(m)
    return scored.groupBy("subject_id").agg(*[mean(m) for m in METRICS])


def long_scores(subjects: DataFrame) -> DataFrame:
    """(subject_id, metric, score), a row for every metric."""
    return subjects.select("subject_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in METRICS])).alias("x")).select("subject_id", "x.metric", "x.score")


def metric_summary(subjects: DataFrame) -> DataFrame:
    """(metric, average_score, sample_count, missing_count): the mean of the subjects' rounded means."""
    out = long_scores(subjects).groupBy("metric").agg(round_half_up(F.avg("score")).alias("average_score"), F.count("score").alias("sample_count"), F.count_if(F.col("score").isNull()).alias("missing_count"))
    return out


def histogram(subjects: DataFrame) -> DataFrame:
    """(metric, bucket, n) for the deciles that have a score, in their order."""
    rows = long_scores(subjects).where("score is not null").withColumn("bucket", decile(F.col("score")))
    return rows.groupBy("metric", "bucket").agg(F.count(F.lit(1)).alias("n")).orderBy("metric", F.split("bucket", "-")[0].cast("int"))


def portrait(scored: DataFrame) -> DataFrame:
    """One row per subject from records that are filtered already: the latest score of each metric, the overall mean if
    all four are there, what is missing, and the title of the latest record of all (ties by the order of sources).

    A single window pass gives both the latest by metric and the latest of all.
    """
    priority = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("detection_type"))
    first, second, tie = latest_first(tie="source_record_id")
    by_metric = Window.partitionBy("subject_id", "metric").orderBy(first, second, tie)
    by_subject = Window.partitionBy("subject_id").orderBy(first, second, priority, tie)
    ranked = scored.withColumns({"_m": F.row_number().over(by_metric), "_s": F.row_number().over(by_subject)}).where("_m = 1 or _s = 1")
    latest = lambda m: F.max(F.when((F.col("_m") == 1) & (F.col("metric") == m), round_half_up(F.col("score")))).alias(m)
    rows = ranked.groupBy("subject_id").agg(*[latest(m) for m in METRICS], F.max(F.when(F.col("_s") == 1, F.col("thesis_title"))).alias("thesis_title"), F.max(F.when(F.col("_s") == 1, F.col("detection_type"))).alias("latest_source"))
    return completeness(overall(rows))


def overall(rows: DataFrame) -> DataFrame:
    names = list(METRICS)
    present = reduce(lambda a, b: a & b, [F.col(m).isNotNull() for m in names])
    return rows.withColumn("overall_score", F.when(present, round_half_up(reduce(lambda a, b: a + b, [F.col(m) for m in names]) / len(names))))


def completeness(rows: DataFrame) -> DataFrame:
    missing = lambda text: F.array_compact(F.array(*[F.when(F.col(m).isNull(), F.lit(text(m))) for m in METRICS]))
    return rows.withColumns({"missing_metric_keys": missing(lambda m: m), "missing_metric_labels": missing(METRICS.get)}).withColumn("complete", F.size("missing_metric_keys") == 0)
