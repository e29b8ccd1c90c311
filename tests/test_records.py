"""Stores, workflow, rules, checklist, findings, ordering and the stream on literal rows."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from proofmill.operators import geometry, ledger, quality, rubric, rule_config, workflow
from proofmill.sources import store
from proofmill.streaming import trend


def tuples(df, *names):  # noqa: ANN001, ANN201
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()]


# Stores


@pytest.fixture(scope="module")
def table(spark):  # noqa: ANN001, ANN201
    rows = [("a", "u1", "2026-08-04T10:00:00.000Z", "new"), ("b", "u1", "2026-08-04T10:00:00.500Z", "new"), ("c", "u2", "2026-08-05T10:00:00.000Z", "old"), ("d", "u1", None, "old"), ("e", "u1", "2026-08-04T10:00:00.500Z", "x")]
    return spark.createDataFrame(rows, "id string, subject_id string, created_at string, status string")


def test_scans_are_newest_first_by_second_then_text_then_id(table):  # noqa: ANN001, ANN201
    assert tuples(store.scan(table), "id") == ["c", "b", "e", "a", "d"]
    assert tuples(store.scan(table, "u1"), "id") == ["b", "e", "a", "d"] and store.scan(table, "nobody").collect() == []


def test_lookup_asks_for_the_owner(table):  # noqa: ANN001, ANN201
    assert tuples(store.lookup(table, "c", "u2"), "id") == ["c"] and store.lookup(table, "c", "u1").collect() == [] and store.lookup(table, "z", "u1").collect() == []


def test_summaries_have_defaults(spark):  # noqa: ANN001, ANN201
    rows = spark.createDataFrame([(1, '{"summary":{"finding_count":3}}'), (2, "{}"), (3, None)], "id int, report_json string")
    out = store.summaries(rows, "report_json", ["finding_count", "rule_count"])
    assert out.columns == ["id", "finding_count", "rule_count"] and tuples(out, *out.columns) == [(1, 3, 0), (2, 0, 0), (3, 0, 0)]


def test_fields_of_a_snapshot(spark):  # noqa: ANN001, ANN201
    rows = spark.createDataFrame([(1, '{"total_score": 71.5, "grade_label": "良好", "more": {}}', "x"), (2, '{"total_score": "high"}', "x"), (3, "{", "x"), (4, None, "x")], "id int, snapshot string, grade_label string")
    out = store.projected(rows, "snapshot", {"total_score": "double", "grade_label": "string"})
    assert out.columns == ["id", "total_score", "grade_label"] and tuples(out, *out.columns) == [(1, 71.5, "良好"), (2, None, None), (3, None, None), (4, None, None)]


def test_append_upsert_and_insert_missing(spark, tmp_path):  # noqa: ANN001, ANN201
    rows = lambda *x: spark.createDataFrame(list(x), "k string, n int, v string")
    old, new = rows(("a", 1, "x"), (None, 1, "y")), rows(("a", 2, "z"), (None, 0, "w"), ("b", 1, "q"))
    assert sorted(tuples(store.upsert(old, new, ["k"], ["n"]), "v")) == ["q", "y", "z"]
    assert sorted(tuples(store.insert_missing(rows(("a", 1, "x")), rows(("a", 2, "z"), ("b", 1, "q"), ("b", 2, "q")), ["k"]), "k")) == ["b"]
    store.append(old, str(tmp_path / "t")), store.append(new, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5


def test_replace_scope_takes_null_as_a_scope(spark):  # noqa: ANN001, ANN201
    rows = lambda *x: spark.createDataFrame(list(x), "level string, college string, rule string")
    old = rows(("school", None, "r1"), ("college", "c1", "r2"), ("college", "c2", "r3"))
    assert sorted(tuples(store.replace_scope(old, rows(("school", None, "n1"), ("college", "c1", "n2")), ["level", "college"]), "rule")) == ["n1", "n2", "r3"]


def test_delete_reports_whether_there_was_a_row(table):  # noqa: ANN001, ANN201
    assert sorted(tuples(store.delete(table, "a"), "id")) == ["b", "c", "d", "e"]
    assert store.exists(table, "a") and not store.exists(table, "z")


def test_status_changes_from_the_old_one_only(table):  # noqa: ANN001, ANN201
    out = store.set_status(table, F.col("subject_id") == "u1", "new", "seen")
    assert dict(tuples(out, "id", "status")) == {"a": "seen", "b": "seen", "c": "old", "d": "old", "e": "x"}


def test_table_counts(table):  # noqa: ANN001, ANN201
    assert dict(tuples(store.counts({"t": table, "none": table.where("false")}), "table_name", "n")) == {"t": 5, "none": 0}


def test_text_files(spark, tmp_path):  # noqa: ANN001, ANN201
    for name, data in (("a.txt", "é\nx".encode()), ("b.MD", b"m"), ("c.pdf", b"p"), ("d.txt", b"\xff\xfe"), ("e.txt", b""), ("f g.pdf", b"")):
        (tmp_path / name).write_bytes(data)
    got = {Path(r.path).name: (r.text, r.error) for r in store.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("é\nx", None), "b.MD": ("m", None), "c.pdf": (None, "unsupported file type"), "d.txt": (None, "not UTF-8"), "e.txt": ("", None), "f g.pdf": (None, "unsupported file type")}


def test_csv_json_and_text_files(spark, tmp_path):  # noqa: ANN001, ANN201
    rows = spark.createDataFrame([('say "hi", you', None, 3)], "`甲` string, `乙` string, n int").coalesce(1)
    store.write_csv(rows, str(tmp_path / "csv")), store.write_json(rows, str(tmp_path / "json")), store.write_text(rows, "甲", str(tmp_path / "text"))
    read = lambda kind: next((tmp_path / kind).glob("part-*")).read_bytes().decode()
    assert read("csv") == '"﻿甲","乙","n"\n"say ""hi"", you","","3"\n'
    assert json.loads(read("json")) == {"甲": 'say "hi", you', "乙": None, "n": 3} and read("text") == 'say "hi", you\n'


# Ledger and quality


def test_scopes(spark):  # noqa: ANN001, ANN201
    rows = spark.createDataFrame([("s1", "amy", "c1", "v1"), ("s2", "bob", "c1", "v2"), ("s3", "s1", "c2", "v1")], "subject_id string, student_name string, college_id string, supervisor_id string")
    seen = lambda **scope: sorted(tuples(ledger.in_scope(rows, scope), "subject_id"))
    assert seen(role="school") == ["s1", "s2", "s3"] and seen(role="supervisor", id="v1") == ["s1", "s3"] and seen(role="college", id="c1") == ["s1", "s2"]
    assert seen(role="student", id="s1") == ["s1", "s3"] and seen(role="student", id="amy") == ["s1"] and seen(role="guest") == [] and seen() == []


def test_filters(spark):  # noqa: ANN001, ANN201
    assert ledger.normalize_filters({"detection_type": " a ", "from": "", "student": 5, "latest_only": "true"}) == {"detection_type": "a", "latest_only": True}
    assert ledger.normalize_filters({"latest_only": "yes"}) == {} and ledger.normalize_filters(None) == {}
    rows = spark.createDataFrame([("1", "2026-08-04T23:59:59Z", "Ann", None), ("2", "2026-08-05T00:00:00Z", None, "x_ANN_y"), ("3", "bad", "Bo", "z")], "subject_id string, created_at string, student_name string, thesis_title string").withColumn("source_filename", F.lit(None).cast("string"))
    got = lambda **f: tuples(ledger.apply_filters(rows, f), "subject_id")
    assert got(**{"from": "2026-08-05"}) == ["2"] and got(to="2026-08-04") == ["1"] and got(to="never") == [] and got(student="ann") == ["1", "2"] and got(student="%") == ["1", "2", "3"]


def test_names_then_newest(spark):  # noqa: ANN001, ANN201
    rows = spark.createDataFrame([("b", "2026-01-01T00:00:00Z", "1"), ("a", "2026-01-01T00:00:00Z", "2"), ("a", "2026-02-01T00:00:00Z", "3"), ("a", None, "4")], "student_name string, created_at string, source_record_id string")
    assert tuples(quality.ordered(rows), "source_record_id") == ["3", "2", "4", "1"]


def test_latest_ranks_break_ties_by_id(spark):  # noqa: ANN001, ANN201
    rows = spark.createDataFrame([("1", "s", "k", "2026-01-01T00:00:00.1Z"), ("2", "s", "k", "2026-01-01T00:00:00.1Z"), ("3", "s", "k", "2026-01-01T00:00:00.9Z"), ("4", "s", "j", None)], "id string, subject_id string, detection_type string, created_at string")
    assert dict(tuples(ledger.with_latest_rank(rows), "id", "latest_rank")) == {"3": 1, "2": 2, "1": 3, "4": 1}


# Workflow


def test_queue_lists_pending_first_then_the_newest(spark):  # noqa: ANN001, ANN201
    todos = spark.createDataFrame([("t1", "s1", "v", "completed", "2026-03-01"), ("t2", "s2", "v", "pending", "2026-01-01"), ("t3", "s3", "v", "pending", "2026-02-01"), ("t4", "none", "v", "pending", "2026-02-01"), ("t5", "s1", "w", "pending", "2026-02-01")], "id string, submission_id string, assignee_id string, status string, created_at string")
    subs = spark.createDataFrame([(f"s{i}", "b", f"u{i}", "ai_review" if i == 3 else "normative", "r", "x") for i in (1, 2, 3)], "id string, batch_id string, student_id string, source_type string, report_id string, status string")
    assert tuples(workflow.queue(todos, subs, "v"), "id") == ["t3", "t2", "t1"]
    assert tuples(workflow.queue(todos, subs, "v", {"status": "pending", "source_type": "normative", "student_id": ""}), "id") == ["t2"]
    assert tuples(workflow.queue(todos, subs), "id") == ["t3", "t5", "t2", "t1"] and workflow.unread(todos, "v").first().n == 3


def test_results_with_and_without_feedback(spark):  # noqa: ANN001, ANN201
    subs = spark.createDataFrame([("a", "u", "2026-01-02T00:00:00Z"), ("b", "u", "2026-01-02T00:00:00Z"), ("c", "u", "2026-01-03T00:00:00Z"), ("d", "w", "2026-01-03T00:00:00Z")], "id string, student_id string, created_at string")
    feedback = spark.createDataFrame([("a", "good", "more", "2026-02-01")], "submission_id string, overall_evaluation string, improvement_suggestions string, created_at string").withColumn("annotations", F.array())
    assert tuples(workflow.results(subs, feedback, "u"), "id", "overall_evaluation") == [("c", None), ("b", None), ("a", "good")]
    assert tuples(workflow.results(subs, feedback, "u", only_reviewed=True), "id", "reviewed_at") == [("a", "2026-02-01")]


def test_a_review_touches_three_tables_once(spark):  # noqa: ANN001, ANN201
    subs = spark.createDataFrame([("a", "u", workflow.SUBMITTED), ("b", "u", workflow.REVIEWED)], "id string, student_id string, status string")
    todos = spark.createDataFrame([("t1", "a", "pending"), ("t2", "b", "completed")], "id string, submission_id string, status string")
    feedback = spark.createDataFrame([("b", "first")], "submission_id string, overall_evaluation string")
    new = spark.createDataFrame([("a", "fine"), ("b", "again"), ("z", "no such")], "submission_id string, overall_evaluation string")
    s, t, f = workflow.review(subs, todos, feedback, new)
    assert dict(tuples(s, "id", "status")) == {"a": workflow.REVIEWED, "b": workflow.REVIEWED} and dict(tuples(t, "id", "status")) == {"t1": "completed", "t2": "completed"}
    assert dict(tuples(f, "submission_id", "overall_evaluation")) == {"a": "fine", "b": "first"}
    seen = workflow.view(s, "a", "u")
    assert dict(tuples(seen, "id", "status")) == {"a": workflow.VIEWED, "b": workflow.REVIEWED}
    assert dict(tuples(workflow.view(seen, "a", "other"), "id", "status"))["a"] == workflow.VIEWED and dict(tuples(workflow.view(subs, "a", "u"), "id", "status"))["a"] == workflow.SUBMITTED


def test_submitting_makes_todos(spark):  # noqa: ANN001, ANN201
    reports = spark.createDataFrame([("r1", "u", "v", "normative")], "id string, subject_id string, supervisor_id string, source_type string")
    made, todos = workflow.submit("b1", reports, "2026-01-01T00:00:00Z")
    assert tuples(made, "id", "student_id", "report_id", "status") == [("b1:normative:r1", "u", "r1", workflow.SUBMITTED)]
    assert tuples(todos, "id", "submission_id", "assignee_id", "actor_id", "status") == [("todo:b1:normative:r1", "b1:normative:r1", "v", "u", "pending")]


def test_annotations_are_trimmed_and_whole(spark):  # noqa: ANN001, ANN201
    rows = spark.sql("select array(named_struct('finding_id', ' f ', 'comment', ' c '), named_struct('finding_id', '', 'comment', 'c'), named_struct('finding_id', 'f', 'comment', '  '), named_struct('finding_id', cast(null as string), 'comment', 'c')) a")
    assert [tuple(x) for x in rows.select(workflow.clean_annotations(F.col("a")).alias("x")).first().x] == [("f", "c")]


def test_validation_lists_every_error(spark):  # noqa: ANN001, ANN201
    rows = spark.createDataFrame([("t", 3), (" ", None)], "title string, level int")
    checks = {"title": (F.length(F.trim("title")) > 0, "no title"), "level": (F.col("level").between(1, 5), "no level")}
    assert [[tuple(e) for e in r.errors] for r in workflow.validate(rows, checks).collect()] == [[], [("title", "no title"), ("level", "no level")]]


def test_polish_history_is_united(spark):  # noqa: ANN001, ANN201
    whole = spark.createDataFrame([("w", "2026-01-01", "basic")], "id string, created_at string, level string")
    local = spark.createDataFrame([("l", "2026-01-02", "ctx")], "id string, created_at string, context string")
    assert tuples(workflow.polish_history(whole, local), "id", "type", "level", "context") == [("l", "local", None, "ctx"), ("w", "whole", "basic", None)]


def test_own_reports(spark):  # noqa: ANN001, ANN201
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    tasks = t([("1", "u", "completed", "", '{"high":1,"medium":2}', "2026-01-01T00:00:00Z"), ("2", "u", "failed", "x", "{}", "2026-01-09T00:00:00Z"), ("3", "w", "completed", "f.txt", None, "2026-01-05T00:00:00Z")], "id string, subject_id string, status string, source_filename string, severity_counts_json string, created_at string")
    dup = t([("1", "u", "d", 0.2704, "2026-01-02T00:00:00Z"), ("2", "u", None, None, "2026-01-02T00:00:01Z")], "id string, subject_id string, source_filename string, total_similarity_rate double, created_at string")
    inn = t([("1", "u", "paper", '{"total_score":88.5,"grade_label":"良好"}', "2026-01-03T00:00:00Z"), ("2", "u", "q", "{}", "2026-01-03T00:00:01Z")], "id string, subject_id string, thesis_title string, scoring_snapshot_json string, created_at string")
    rev = t([("1", "u", None, "thesis", 91, "基础检查通过", "2026-01-04T00:00:00Z")], "id string, subject_id string, source_filename string, thesis_title string, total_score int, result_label string, created_at string")
    assert tuples(workflow.own_reports(tasks, dup, inn, rev, "u"), "key", "title", "summary") == [
        ("ai_review:1", "thesis", "AI 评分 91 · 基础检查通过"), ("innovation:2", "q", "创新性报告已完成"), ("innovation:1", "paper", "创新评分 88.5 · 良好"),
        ("duplication:2", "校内库查重 2", "相似度报告已完成"), ("duplication:1", "d", "相似度 27.0%"), ("normative:1", "规范性检测 1", "规范问题 3 项"),
    ]
    assert workflow.own_reports(tasks, dup, inn, rev).count() == 7


# Rules


def draft(**more) -> dict:  # noqa: ANN003
    return {"rule_id": "R", "title": "t", "category": "c", "severity": "严重", "enabled": True, "message": "m", "params": {}} | more


def test_rule_import_reports_items_and_takes_all_or_nothing(spark):  # noqa: ANN001, ANN201
    files = {
        "good": [draft(), draft(rule_id="S", params={"a": 1})],
        "bad": [draft(), draft(severity="x", title=""), "text", draft(enabled="yes", params=[1]), {k: v for k, v in draft().items() if k != "message"}],
        "object": {"a": 1},
    }
    rows = rule_config.parse_drafts(spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in files.items()] + [("broken", "[1")], "file_id string, json string"))
    errors = {(r.file_id, r.item_index): sorted(tuple(e) for e in r.errors) for r in rows.collect()}
    assert errors[("good", 0)] == errors[("good", 1)] == errors[("bad", 0)] == []
    assert errors[("bad", 1)] == [("severity", "severity 必须为严重、一般、轻微"), ("title", "title 缺失")] and errors[("bad", 2)] == [("item", "规则项必须为对象")]
    assert errors[("bad", 3)] == [("enabled", "enabled 必须为布尔值"), ("params", "params 必须为 JSON 对象")] and errors[("bad", 4)] == [("message", "message 缺失")]
    assert errors[("object", None)] == [("root", "JSON 顶层必须为数组")]
    assert sorted(tuples(rule_config.accepted(rows), "file_id", "rule_id")) == [("good", "R"), ("good", "S")]


def test_the_nearest_layer_gives_the_whole_rule(spark):  # noqa: ANN001, ANN201
    columns = "id string, scope_level string, college_id string, rule_id string, title string, category string, severity string, enabled boolean, match_params string, prompt string, updated_at string"
    row = lambda i, level, college, rule, title, at: (i, level, college, rule, title, "c", "high", False, "{}", "", at)
    over = spark.createDataFrame([row("1", "school", None, "NORM-001", "old", "1"), row("2", "school", None, "NORM-001", "school", "2"), row("3", "college", "c1", "NORM-001", "own", "1"), row("4", "college", "c2", "X-9", "new", "1")], columns)
    got = rule_config.effective(spark.createDataFrame([("c1",), ("c2",)], "college_id string"), over)
    rules = {(r.college_id, r.rule_id): (r.title, r.source) for r in got.collect()}
    assert rules[("c1", "NORM-001")] == ("own", "college") and rules[("c2", "NORM-001")] == ("school", "school") and rules[("c1", "NORM-002")][1] == "national"
    assert rules[("c2", "X-9")] == ("new", "college") and ("c1", "X-9") not in rules and len(rules) == 13
    assert "TEXT-LONG-SENTENCE" in {r for _, r in rules}


# Checklist and findings


def test_the_five_templates_and_items(spark):  # noqa: ANN001, ANN201
    headings, least = rubric.TEMPLATES["academic_master"]
    refs = "\n".join(f"[{i}] x" for i in range(least))
    whole = "\n".join(h + ("：内容" if h == "关键词" else "") for h in headings) + "\n" + refs
    short = whole.replace("结论\n", "结论与展望\n")
    runs = spark.createDataFrame([(1, "academic_master", whole), (2, "academic_master", short), (3, "academic_phd_natural_science", whole), (4, "nothing", whole), (5, "professional_master", "参考文献x\n[1] x")], "doc_id int, template_id string, text string")
    issues = spark.createDataFrame([(1, 9 - i, 1, "R", f"m{i}") for i in range(7)], "doc_id int, line int, column int, rule_id string, message string")
    got = {r.doc_id: r for r in rubric.checklist(runs, issues).collect()}
    assert set(got) == {1, 2, 3, 5}
    scores = lambda r: tuple(r[k] for k in rubric.POINTS)
    assert (scores(got[1]), got[1].total_score, got[1].result_label, got[1].missing_sections, got[1].reference_count) == ((30, 20, 20, 20, 0), 90, "基础检查通过", [], 50)
    assert (scores(got[2]), got[2].total_score, got[2].result_label, got[2].missing_sections) == ((0, 20, 20, 0, 10), 50, "需修改", ["结论"])
    assert (scores(got[3]), got[3].missing_sections, got[3].result_label) == ((0, 0, 20, 20, 10), ["实验与结果"], "需修改")
    assert (scores(got[5]), got[5].reference_count) == ((0, 0, 20, 0, 10), 0)
    items = {x.key: (x.label, x.points, x.score, x.findings) for x in got[1].score_items}
    assert items["reference_count_and_numbering"] == ("参考文献数量与编号", 20, 20, ["参考文献条目：50/50"])
    assert items["normative_detection_result"] == ("规范检测结果", 10, 0, ["m6", "m5", "m4", "m3", "m2"])
    assert [x.findings for x in got[2].score_items][3] == ["缺少结论章节"]


def test_a_high_score_with_a_missing_section_does_not_pass(spark):  # noqa: ANN001, ANN201
    kinds = spark.createDataFrame([("own", ["甲", "乙"], 0)], "template_id string, required_sections array<string>, minimum_reference_count int")
    r = rubric.checklist(spark.createDataFrame([(1, "own", "甲")], "doc_id int, template_id string, text string"), None, kinds).first()
    assert (r.total_score, r.result_label) == (70, "需修改")


def test_findings_of_sources(spark):  # noqa: ANN001, ANN201
    matches = spark.createDataFrame([("r", 1, "s9", "T", 0.5, "cut"), ("r", 2, None, None, 0.49, None)], "report_id string, idx int, sample_id string, title string, jaccard_score double, excerpt string")
    levels = spark.createDataFrame([("r", 1, "k", "L", 4), ("r", 2, None, None, None)], "report_id string, idx int, key string, label string, level int")
    assert tuples(rubric.source_findings(matches, levels), "finding_id", "rule_id", "severity", "excerpt", "message") == [
        ("duplication-s9", "LOCAL-CORPUS-SIMILARITY", "high", "cut", "与《T》存在相似表达"),
        ("duplication-2", "LOCAL-CORPUS-SIMILARITY", "medium", "相似片段", "与《本地样本》存在相似表达"),
        ("innovation-k", "INNOVATION-RUBRIC", "low", "L", "L量表等级为 4 级"),
        ("innovation-2", "INNOVATION-RUBRIC", "medium", "创新性维度", "该维度量表等级为 未填写 级"),
    ]


def test_rectangles_annotations_order_and_pages(spark):  # noqa: ANN001, ANN201
    rect = lambda f, p, x1, y1, x2, y2, w=100.0: (f, p, x1, y1, x2, y2, w, 100.0)
    rows = spark.createDataFrame([rect("a", 1, 1.0, 2.0, 3.0, 4.0), rect("a", 1, 0.0, 3.0, 2.0, 9.0), rect("a", 2, 5.0, 5.0, 5.0, 6.0), rect("a", 0, 1.0, 1.0, 2.0, 2.0), rect("a", 3, float("nan"), 1.0, 2.0, 2.0), rect("a", 4, 1.0, 1.0, float("inf"), 2.0), rect("a", 5, 1.0, 1.0, 2.0, 2.0, 0.0)], "finding_id string, page_number int, x1 double, y1 double, x2 double, y2 double, width double, height double")
    assert tuples(geometry.union_rects(rows), "page_number", "x1", "y1", "x2", "y2", "cx", "cy") == [(1, 0.0, 2.0, 3.0, 9.0, 1.5, 5.5)]
    assert tuples(geometry.pages(rows), "pages") == ["1、2、3、4、5"]
    notes = spark.createDataFrame([("a", 1, 0.0, 0.0, 1.0, 1.0, None), ("a", 1, 0.0, 0.0, 1.0, 1.0, "x"), ("a", 2, 0.0, 0.0, 1.0, 1.0, None)], "finding_id string, page_number int, x1 double, y1 double, x2 double, y2 double, anchor string")
    assert sorted(tuples(geometry.distinct_annotations(notes), "page_number", "anchor"), key=str) == [(1, "x"), (2, None)]
    finds = spark.createDataFrame([(1, None, None, "low", "r"), (2, 2, 5.0, "high", "r"), (3, 2, 1.0, "high", "q"), (4, 1, None, "low", "q"), (5, 2, 1.0, "low", "q")], "idx int, page_number int, y1 double, severity string, rule_id string")
    assert tuples(geometry.ordered(finds), "idx") == [4, 3, 5, 2, 1]
    assert tuples(geometry.choose(finds, "high", "q"), "idx") == [3] and tuples(geometry.choose(finds), "idx") == [1, 2, 3, 4, 5]
    assert tuples(geometry.page_of(finds, [F.desc("idx")], 2, 2), "idx") == [3, 2] and geometry.page_of(finds, [F.col("idx")], 1).count() == 5


def test_scale_scores(spark):  # noqa: ANN001, ANN201
    rows = spark.createDataFrame([("master", 5, 4, 4, 3, 4), ("doctoral", 5, 5, 5, 5, 5), ("x", 5, 5, 5, 5, 5), ("master", 0, 5, 5, 5, 5)], "degree_type string, " + ", ".join(f"{d} int" for d in rubric.DIMENSIONS))
    # 20 x (5 x 0.2 + 4 x 0.2 + 4 x 0.25 + 3 x 0.2 + 4 x 0.15) = 80
    assert tuples(rubric.scale_scores(rows), "total_score", "grade_label") == [(80.0, "良好"), (100.0, "优秀"), (None, None), (None, None)]


# The stream


def test_the_stream_gives_what_the_table_gives(spark, tmp_path):  # noqa: ANN001, ANN201
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type")
    (tmp_path / "in").mkdir()
    for i in range(3):
        events.where(F.pmod(F.hash("ts", "event_type"), F.lit(3)) == i).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = trend.daily_trend(stream, late="60 days").writeStream.format("memory").queryName("trend").outputMode("complete").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    assert sorted(map(tuple, spark.table("trend").collect())) == sorted(map(tuple, trend.daily_trend(events).collect()))
