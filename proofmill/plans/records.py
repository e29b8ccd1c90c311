"""Queries over records: ledger, quality, workflow, rules and stores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.functions.scores import china_time, json_number
from proofmill.operators import geometry, ledger, quality, rubric, rule_config, workflow
from proofmill.operators.layout import with_expected
from proofmill.plans import inputs
from proofmill.plans.inputs import sql, table
from proofmill.sources import store
from proofmill.streaming import trend

QUERIES, ORACLES = {}, {}
TODAY = "2024-01-30"


def query(oracle: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_RANK = "row_number() over (partition by subject_id, detection_type order by date_trunc('second', created_at) desc, created_at desc, id desc) as latest_rank"
_LATEST = f"ranked as (select *, {_RANK} from facts)"


@query(sql("facts", f", {_LATEST} select detection_type, count(*) record_count, count(distinct subject_id) subject_count, count(*) filter (created_at::date = date '{TODAY}') today_count from ranked where latest_rank = 1 group by 1"))
def ledger_latest_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.apply_filters(ledger.with_latest_rank(inputs.facts(spark, sf_dir)), {"latest_only": True})
    return ledger.by_type(rows, TODAY)


def _united(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.unite(inputs.tasks(spark, sf_dir), inputs.duplication(spark, sf_dir), inputs.reviews(spark, sf_dir))


_UNITED = """united as (
  select 'normative:' || id as id, id as source_record_id, subject_id, coalesce(source_filename, '规范性检测') thesis_title, source_filename, 'normative' detection_type, coalesce(title, '规范检测模板') template_name, '发现 ' || n_issues || ' 项格式问题' core_result, created_at from tasks where status = 'completed'
  union all select 'duplication:' || id, id, subject_id, coalesce(source_filename, '校内库查重'), source_filename, 'duplication', '校内库查重报告', '相似度 ' || round(total_similarity_rate * 100, 1) || '%', created_at from duplication
  union all select 'ai_review:' || id, id, subject_id, thesis_title, null, 'ai_review', 'academic_master', result_label || '（' || total_score || '分）', created_at from reviews),
ranked as (select *, row_number() over (partition by subject_id, detection_type order by date_trunc('second', created_at) desc, created_at desc, id desc) latest_rank from united),
people as (select r.*, u.college_id, u.username student_name, u.supervisor_id, coalesce(l.username, u.supervisor_id, '') supervisor_name from ranked r join users u on u.subject_id = r.subject_id and u.role = 'STUDENT' left join users l on l.subject_id = u.supervisor_id)"""
_SOURCES = "users tasks duplication reviews"


@query(sql(_SOURCES, f", {_UNITED} select id, subject_id, thesis_title, detection_type, template_name, core_result, latest_rank, (latest_rank = 1)::int is_latest from ranked"))
def ledger_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _united(spark, sf_dir).select("id", "subject_id", "thesis_title", "detection_type", "template_name", "core_result", "latest_rank", "is_latest")


@query(sql(_SOURCES, f", {_UNITED} select id, subject_id, student_name, college_id, supervisor_id, supervisor_name from people"))
def supervisor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.with_people(_united(spark, sf_dir), inputs.users(spark, sf_dir)).select("id", "subject_id", "student_name", "college_id", "supervisor_id", "supervisor_name")


@query(sql(_SOURCES, f", {_UNITED} select id, latest_rank from people where supervisor_id = 'sup3' and detection_type = 'duplication' and created_at::date between date '2024-01-05' and date '2024-01-20' and (student_name ilike '%1%' or thesis_title ilike '%1%' or subject_id ilike '%1%' or source_filename ilike '%1%')"))
def ledger_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.in_scope(ledger.with_people(_united(spark, sf_dir), inputs.users(spark, sf_dir)), {"role": "supervisor", "id": "sup3"})
    return ledger.apply_filters(rows, {"detection_type": " duplication ", "from": "2024-01-05", "to": "2024-01-20", "student": "1"}).select("id", "latest_rank")


@query(sql(_SOURCES, f", {_UNITED} select count(*) record_count, count(distinct subject_id) subject_count, count(*) filter (created_at::date = date '{TODAY}') today_count from people"))
def ledger_stats_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.totals(ledger.with_people(_united(spark, sf_dir), inputs.users(spark, sf_dir)), TODAY)


@query(sql(_SOURCES, f", {_UNITED} select detection_type, count(*) record_count, count(distinct subject_id) subject_count, count(*) filter (created_at::date = date '{TODAY}') today_count from people where college_id = 'college1' group by 1"))
def ledger_stats_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.in_scope(ledger.with_people(_united(spark, sf_dir), inputs.users(spark, sf_dir)), {"role": "college", "id": "college1"})
    return ledger.by_type(rows, TODAY)


@query(sql("facts", ", d as (select strftime(created_at, '%Y-%m-%d') as day, subject_id from facts) select day, count(*) record_count, count(distinct subject_id) subject_count from d group by 1"))
def ledger_daily_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.daily_trend(inputs.facts(spark, sf_dir))


@query(sql("facts", f", {_LATEST}, g as (select subject_id, detection_type, id as global_id from ranked where latest_rank = 1 and created_at::date between date '2024-01-05' and date '2024-01-20'), f as (select subject_id, detection_type, id as filtered_id from (select *, {_RANK.replace('latest_rank', 'n')} from facts where created_at::date between date '2024-01-05' and date '2024-01-20') where n = 1) select f.subject_id, f.detection_type, f.filtered_id, g.global_id from f left join g on g.subject_id = f.subject_id and g.detection_type = f.detection_type"))
def ledger_latest_global_vs_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest of all and in the range, beside latest in the range."""
    dates = {"from": "2024-01-05", "to": "2024-01-20"}
    facts = inputs.facts(spark, sf_dir)
    of_all = ledger.apply_filters(ledger.with_latest_rank(facts), dates | {"latest_only": True}).select("subject_id", "detection_type", F.col("id").alias("global_id"))
    in_range = ledger.with_latest_rank(ledger.apply_filters(facts, dates)).where("latest_rank = 1").select("subject_id", "detection_type", F.col("id").alias("filtered_id"))
    return in_range.join(of_all, ["subject_id", "detection_type"], "left")


@query(sql(_SOURCES, f", {_UNITED} select id as \"记录ID\", case detection_type when 'normative' then '/normative-reports/' when 'duplication' then '/duplication-history/' else '/ai-review/results/' end || source_record_id as \"详情链接\", regexp_replace(strftime(created_at, '%Y-%m-%d %H:%M:%S.%f'), '\\.?0+$', '') as \"检测时间\", college_id as \"学院\", subject_id as \"学号\", student_name as \"姓名\", supervisor_name as \"导师\", '学生' as \"学生类别\", thesis_title as \"论文题目\", detection_type as \"检测类型\", template_name as \"检测模板\", coalesce(core_result, '') as \"核心结果\" from people"))
def ledger_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.csv_rows(ledger.with_people(_united(spark, sf_dir), inputs.users(spark, sf_dir)))


@query(sql(_SOURCES, f", {_UNITED} select id, source_record_id, detection_type from ranked where source_record_id = '3' or id = '3'"))
def ledger_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.find(_united(spark, sf_dir), "3").select("id", "source_record_id", "detection_type")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.unite(inputs.tasks(spark, sf_dir), inputs.duplication(spark, sf_dir), inputs.innovation(spark, sf_dir), inputs.reviews(spark, sf_dir))


_SCORED = """scored as (
  select id, subject_id, coalesce(source_filename, '规范性检测') title, 'normative' source, 1 as p, 'normative' metric, greatest(0.0::double, 100.0::double - high * 10 - medium * 4 - low) score, created_at from tasks where status = 'completed'
  union all select id, subject_id, coalesce(source_filename, '校内库查重'), 'duplication', 2, 'originality', greatest(0.0::double, least(100.0::double, 100.0::double - total_similarity_rate * 100)), created_at from duplication
  union all select id, subject_id, thesis_title, 'innovation', 3, 'innovation', score, created_at from innovation
  union all select id, subject_id, thesis_title, 'ai_review', 4, 'review_base', coalesce(total_score::double, items), created_at from reviews),
subjects as (select subject_id, """ + ", ".join(f"floor(avg(case when metric = '{m}' then score end) * 10 + 0.5) / 10 as {m}" for m in quality.METRICS) + " from scored group by 1),\nlong as (" + " union all ".join(f"select subject_id, '{m}' as metric, {m} as score from subjects" for m in quality.METRICS) + ")"
_QUALITY = "tasks duplication innovation reviews"


@query(sql(_QUALITY, f", {_SCORED} select * from subjects"))
def quality_student_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.subject_scores(_scored(spark, sf_dir))


@query(sql(_QUALITY, f", {_SCORED} select metric, floor(avg(score) * 10 + 0.5) / 10 average_score, count(score) sample_count, count(*) - count(score) missing_count from long group by 1"))
def quality_metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.metric_summary(quality.subject_scores(_scored(spark, sf_dir)))


@query(sql(_QUALITY, f", {_SCORED} select metric, case when score >= 100 then '100' else (floor(score / 10) * 10)::int || '-' || ((floor(score / 10) * 10)::int + 9) end bucket, count(*) n from long where score is not null group by 1, 2"))
def quality_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.histogram(quality.subject_scores(_scored(spark, sf_dir)))


_ONE = ", ".join(f"max(case when m = 1 and metric = '{m}' then floor(score * 10 + 0.5) / 10 end) as {m}" for m in quality.METRICS)
_ORDER = "date_trunc('second', created_at) desc, created_at desc"
_PORTRAIT = f""", {_SCORED},
r as (select *, row_number() over (partition by subject_id, metric order by {_ORDER}, id desc) m, row_number() over (partition by subject_id order by {_ORDER}, p, id desc) s from scored where created_at::date <= date '2024-01-12'),
l as (select subject_id, {_ONE}, max(case when s = 1 then title end) thesis_title, max(case when s = 1 then source end) latest_source from r group by 1)"""


@query(sql(_QUALITY, _PORTRAIT + " select subject_id, normative, originality, innovation, review_base, thesis_title, latest_source from l"))
def portrait_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.portrait(ledger.apply_filters(_scored(spark, sf_dir), {"to": "2024-01-12"}))
    return rows.select("subject_id", *quality.METRICS, "thesis_title", "latest_source")


@query(sql(_QUALITY, _PORTRAIT + " select subject_id, floor((normative + originality + innovation + review_base) / 4 * 10 + 0.5) / 10 overall_score from l"))
def portrait_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.portrait(ledger.apply_filters(_scored(spark, sf_dir), {"to": "2024-01-12"})).select("subject_id", "overall_score")


@query(sql(_QUALITY, _PORTRAIT + " select subject_id, array_to_string(list_filter([case when normative is null then 'normative' end, case when originality is null then 'originality' end, case when innovation is null then 'innovation' end, case when review_base is null then 'review_base' end], lambda x: x is not null), ',') missing, (normative + originality + innovation + review_base) is not null complete from l"))
def portrait_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.portrait(ledger.apply_filters(_scored(spark, sf_dir), {"to": "2024-01-12"}))
    return rows.select("subject_id", F.array_join("missing_metric_keys", ",").alias("missing"), "complete")


@query("select event_id, (props::json->>'$.k')::double k, strftime(ts + interval 8 hour, '%Y-%m-%d %H:%M') as china from events")
def payload_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number out of JSON text, and the time of day in China."""
    return table(spark, sf_dir, "events").select("event_id", json_number(F.col("props"), "$.k").alias("k"), china_time(F.col("ts")).alias("china"))


@query(sql("submissions todos", "select t.id, t.status, s.student_id, s.source_type from todos t join submissions s on s.id = t.submission_id where t.assignee_id = 'sup2'"))
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.queue(inputs.todos(spark, sf_dir), inputs.submissions(spark, sf_dir), "sup2").select("id", "status", "student_id", "source_type")


@query(sql("todos", "select count(*) n from todos where assignee_id = 'sup2' and status <> 'completed'"))
def review_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.unread(inputs.todos(spark, sf_dir), "sup2")


@query(sql("submissions feedback", "select s.id, s.status, f.overall_evaluation, f.created_at reviewed_at from submissions s left join feedback f on f.submission_id = s.id"))
def student_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.results(inputs.submissions(spark, sf_dir), inputs.feedback(spark, sf_dir)).select("id", "status", "overall_evaluation", "reviewed_at")


@query(sql("submissions todos", "select t.id from todos t where not exists (select 1 from submissions s where s.id = t.submission_id and s.supervisor_id = t.assignee_id)"))
def orphan_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.orphans(inputs.todos(spark, sf_dir), inputs.submissions(spark, sf_dir), {"submission_id": "id", "assignee_id": "supervisor_id"}).select("id")


@query(sql("tasks duplication innovation reviews", """, r as (
  select 'normative' k, id, coalesce(source_filename, '规范性检测 ' || id) title, '规范问题 ' || (high + medium + low) || ' 项' summary, created_at from tasks where status = 'completed'
  union all select 'duplication', id, coalesce(source_filename, '校内库查重 ' || id), '相似度 ' || round(total_similarity_rate * 100, 1) || '%', created_at from duplication
  union all select 'innovation', id, thesis_title, coalesce('创新评分 ' || score::int, '创新性报告已完成'), created_at from innovation
  union all select 'ai_review', id, thesis_title, coalesce('AI 评分 ' || total_score || ' · ' || result_label, 'AI 评阅报告已完成'), created_at from reviews)
  select k || ':' || id as key, k as source_type, id as report_id, title, summary, created_at from r"""))
def own_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = workflow.own_reports(inputs.tasks(spark, sf_dir), inputs.duplication(spark, sf_dir), inputs.innovation(spark, sf_dir), inputs.reviews(spark, sf_dir))
    return rows.drop("subject_id")


@query(sql("duplication reviews", """ select id source_record_id, '{"total_similarity_rate":' || total_similarity_rate || '}' payload_json from duplication
  union all select id, '{"total_score":' || coalesce(total_score::varchar, 'null') || ',"score_items":"[{\\\\"key\\\\":\\\\"a\\\\",\\\\"score\\\\":' || (items - 7)::int || '},{\\\\"key\\\\":\\\\"b\\\\",\\\\"score\\\\":7}]"}' from reviews""".replace("\\\\", "\\")))
def quality_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.payloads(inputs.duplication(spark, sf_dir), inputs.reviews(spark, sf_dir))


@query(sql("innovation", "select id, subject_id, thesis_title, created_at, score as total_score, null::varchar as grade_label from innovation"))
def innovation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every owner's scored papers, newest first, with two fields of their snapshots."""
    return store.scan(store.projected(inputs.innovation(spark, sf_dir), "scoring_snapshot_json", {"total_score": "double", "grade_label": "string"}))


@query(sql("submissions tasks duplication innovation reviews", "select s.id, s.source_type, r.created_at as report_created, r.id is not null as found from submissions s left join (select 'view' t, id, subject_id, created_at from tasks union all select 'click', id, subject_id, created_at from duplication union all select 'signup', id, subject_id, created_at from innovation union all select 'purchase', id, subject_id, created_at from reviews) r on r.t = s.source_type and r.id = s.report_id and r.subject_id = s.student_id"))
def submission_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of all four kinds joined in one go."""
    kinds = {"view": inputs.tasks, "click": inputs.duplication, "signup": inputs.innovation, "purchase": inputs.reviews}
    sources = {k: f(spark, sf_dir).withColumn("report_created", F.col("created_at")) for k, f in kinds.items()}
    return workflow.attach_sources(inputs.submissions(spark, sf_dir), sources, ["report_created"]).select("id", "source_type", "report_created", "found")


@query(sql("facts", "select id, detection_type from facts where subject_id = '7'"))
def history_of_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.scan(inputs.facts(spark, sf_dir), "7").select("id", "detection_type")


@query(sql("facts", "select id, subject_id, value from facts where id in ('12', '2', '40') and subject_id = '7'"))
def record_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one owner's rows, each by its id and its owner; another's id gives none."""
    facts = inputs.facts(spark, sf_dir)
    found = [store.lookup(facts, record, "7") for record in ("12", "2", "40")]
    return reduce(DataFrame.unionAll, found).select("id", "subject_id", "value")


@query("select 'customer' table_name, count(*) n from customer union all select 'events', count(*) from events union all select 'orders', count(*) from orders")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.counts({t: table(spark, sf_dir, t) for t in ("customer", "events", "orders")})


@query("select c_custkey, d as degree_type, total as total_score, case when total >= 90 then '优秀' when total >= 80 then '良好' when total >= 60 then '一般' else '待提升' end grade_label from (select *, round(a * 20 * w1 + b * 20 * w2 + c * 20 * w3 + e * 20 * w4 + f * 20 * w5, 2) as total from (select c_custkey, case when c_custkey % 2 = 0 then 'doctoral' else 'master' end d, c_custkey % 5 + 1 a, c_custkey // 5 % 5 + 1 b, c_custkey // 25 % 5 + 1 c, c_nationkey % 5 + 1 e, c_custkey // 3 % 5 + 1 f from customer) x join (values ('doctoral', 0.25, 0.25, 0.2, 0.2, 0.1), ('master', 0.2, 0.2, 0.25, 0.2, 0.15)) w(t, w1, w2, w3, w4, w5) on w.t = x.d)")
def innovation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "if(c_custkey % 2 = 0, 'doctoral', 'master') degree_type", "c_custkey % 5 + 1 research_topic", "c_custkey div 5 % 5 + 1 research_method", "c_custkey div 25 % 5 + 1 research_content", "c_nationkey % 5 + 1 research_conclusion", "c_custkey div 3 % 5 + 1 application_value")
    return rubric.scale_scores(rows).select("c_custkey", "degree_type", "total_score", "grade_label")


_RULES = " union all ".join(f"select '{r}' rule_id, '{t}' title, 'national' source, 0 layer" for r, _, t, _ in rule_config.DEFAULTS)


@query(f"with colleges as (select distinct 'college' || n_regionkey college_id from nation), base as ({_RULES}), o as (select case when n_nationkey % 2 = 0 then 'college' || n_regionkey end college_id, 'NORM-00' || (n_nationkey % 8 + 1) rule_id, 'own ' || n_nationkey title, n_nationkey k from nation), l as (select * from (select *, row_number() over (partition by college_id, rule_id order by k desc) n from o) where n = 1), every as (select c.college_id, b.rule_id, b.title, b.source, b.layer from colleges c, base b union all select c.college_id, l.rule_id, l.title, 'school', 1 from colleges c, l where l.college_id is null union all select college_id, rule_id, title, 'college', 2 from l where college_id is not null) select college_id, rule_id, title, source from (select *, row_number() over (partition by college_id, rule_id order by layer desc) n from every) where n = 1")
def effective_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    own = nation.selectExpr("cast(n_nationkey as string) id", "if(n_nationkey % 2 = 0, 'college', 'school') scope_level", "if(n_nationkey % 2 = 0, 'college' || n_regionkey, null) college_id", "'NORM-00' || (n_nationkey % 8 + 1) rule_id", "'own ' || n_nationkey title", "'x' category", "'medium' severity", "true enabled", "'{}' match_params", "'' prompt", "n_nationkey updated_at")
    colleges = nation.selectExpr("'college' || n_regionkey college_id").distinct()
    return rule_config.effective(colleges, own).select("college_id", "rule_id", "title", "source")


@query("with recursive l as (select l_orderkey, l_linenumber, l_partkey % 4 + 1 as num, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) j from lineitem), e as (select *, j + greatest(0, coalesce(max(num - j) over (partition by l_orderkey order by j rows between unbounded preceding and 1 preceding), 0)) expected from l) select l_orderkey, j::int as j, num, expected::bigint as expected from e where num <> expected")
def sequence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_partkey % 4 + 1 num")
    from pyspark.sql import Window

    rows = rows.withColumn("j", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")))
    return with_expected(rows, ["l_orderkey"], "num", ["j"]).where("num <> expected").select("l_orderkey", "j", "num", "expected")


@query("select finding_id, page_number, min(x1) x1, min(y1) y1, max(x2) x2, max(y2) y2, (min(x1) + max(x2)) / 2 cx, (min(y1) + max(y2)) / 2 cy from (select l_orderkey finding_id, l_linenumber % 2 + 1 page_number, l_quantity x1, l_discount * 100 y1, l_quantity + l_tax * 100 - 2 x2, l_discount * 100 + 5 y2 from lineitem) where x2 > x1 and y2 > y1 group by 1, 2")
def finding_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rects = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey finding_id", "l_linenumber % 2 + 1 page_number", "l_quantity x1", "l_discount * 100 y1", "l_quantity + l_tax * 100 - 2 x2", "l_discount * 100 + 5 y2", "100.0d width", "100.0d height")
    return geometry.union_rects(rects)


@query("select o_custkey subject_id, kind, count(*) record_count, max(moment) newest from (select o_custkey, 'order' kind, o_orderdate as moment from orders where o_orderstatus in ('O', 'F') union all select o_custkey, 'line', l_shipdate from lineitem join orders on o_orderkey = l_orderkey union all select o_custkey, 'large', o_orderdate from orders where o_totalprice > 200000) group by 1, 2")
def commerce_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's shape on another schema: three sources, one of them a join of two facts."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    one = orders.where("o_orderstatus in ('O', 'F')").select(F.col("o_custkey").alias("subject_id"), F.lit("order").alias("kind"), F.col("o_orderdate").alias("moment"))
    two = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(F.col("o_custkey").alias("subject_id"), F.lit("line").alias("kind"), F.col("l_shipdate").alias("moment"))
    three = orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("subject_id"), F.lit("large").alias("kind"), F.col("o_orderdate").alias("moment"))
    return one.unionByName(two).unionByName(three).groupBy("subject_id", "kind").agg(F.count(F.lit(1)).alias("record_count"), F.max("moment").alias("newest"))


@query("select ts::date as day, event_type kind, count(*) record_count from events group by 1, 2")
def daily_trend_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming trend over a table that is complete."""
    return trend.daily_trend(table(spark, sf_dir, "events"))
