"""Text lint on literal texts: every rule's issues with their places and words."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from proofmill.operators import lint

HEADINGS = ["摘要", "关键词", "引言", "结论", "参考文献"]


@pytest.fixture(scope="module")
def found(spark):  # noqa: ANN001, ANN201
    def run(text: str, *rules: str) -> list[tuple]:
        rows = lint.issues(spark.createDataFrame([(1, text)], "doc_id int, text string"), {r: {} for r in rules} or None).collect()
        return sorted((r.rule_id, r.severity, r.line, r.column, r.excerpt, r.message, r.suggestion) for r in rows)

    return run


def places(rows: list[tuple]) -> list[tuple]:
    return [(line, column, excerpt) for _, _, line, column, excerpt, *_ in rows]


def test_sections(found):  # noqa: ANN001, ANN201
    assert found("\n".join(HEADINGS), "section_order") == []
    got = found("摘要\n引言\r\n 关键词　\n正文\n参考文献\n引言", "section_order")
    assert got == [
        ("NORM-001", "high", 1, 1, "结论", "缺少必需章节：结论", "补充“结论”并按规定顺序排列"),
        ("NORM-001", "high", 2, 1, "引言", "章节“引言”顺序错误", "请按照“摘要、关键词、引言、结论、参考文献”的顺序调整章节"),
    ]


def test_a_section_before_any_earlier_one_is_out_of_order(found):  # noqa: ANN001, ANN201
    assert places(found("参考文献\n结论\n引言\n关键词\n摘要", "section_order")) == [(1, 1, "参考文献"), (2, 1, "结论"), (3, 1, "引言"), (4, 1, "关键词")]


def test_pairs(found):  # noqa: ANN001, ANN201
    assert found("(a[b]《c》“d”【e】（f）)", "unmatched_pairs") == []
    assert found("x(\r\n y]）", "unmatched_pairs") == [
        ("NORM-002", "high", 1, 2, "(", "标点“(”未成对", "补全与“(”配对的闭合标点"),
        ("NORM-002", "high", 2, 3, "]", "多余的闭合标点“]”", "删除多余的闭合标点，或补全相应的左侧标点"),
        ("NORM-002", "high", 2, 4, "）", "多余的闭合标点“）”", "删除多余的闭合标点，或补全相应的左侧标点"),
    ]


def test_a_closer_that_does_not_fit_pops_nothing(found):  # noqa: ANN001, ANN201
    assert places(found("([)]", "unmatched_pairs")) == [(1, 1, "("), (1, 3, ")")]


def test_straight_quotes_open_only_and_block_what_is_around_them(found):  # noqa: ANN001, ANN201
    assert places(found("(\"a\" it's)", "unmatched_pairs")) == [(1, 1, "("), (1, 2, '"'), (1, 4, '"'), (1, 8, "'"), (1, 10, ")")]
    assert places(found('"(a)"', "unmatched_pairs")) == [(1, 1, '"'), (1, 5, '"')]


def test_repeated_marks(found):  # noqa: ANN001, ANN201
    got = found("甲，，乙。。。丙；；!!??---\n，\n，", "repeated_punctuation")
    assert got == [
        ("NORM-003", "medium", 1, 2, "，，", "存在重复标点“，，”", "保留一个标点即可"),
        ("NORM-003", "medium", 1, 5, "。。", "存在重复标点“。。”", "保留一个标点即可"),
        ("NORM-003", "medium", 1, 5, "。。。", "存在连续 3 个相同标点", "减少重复标点并保留一个规范标点"),
        ("NORM-003", "medium", 1, 9, "；；", "存在重复标点“；；”", "保留一个标点即可"),
        ("NORM-003", "medium", 1, 15, "---", "存在连续 3 个相同标点", "减少重复标点并保留一个规范标点"),
    ]


def test_dates(found):  # noqa: ANN001, ANN201
    got = found("正确 2026-08-03，错误 2026/08/03 和 2026-8-3 与 12026-8-3、2026-8-345、2026-08/03", "invalid_dates")
    assert [(c, e, m, s) for _, _, _, c, e, m, s in got] == [
        (18, "2026/08/03", "数字日期格式不符合 YYYY-MM-DD：2026/08/03", "改为 YYYY-MM-DD，例如 2026-08-03"),
        (31, "2026-8-3", "数字日期格式不符合 YYYY-MM-DD：2026-8-3", "改为 YYYY-MM-DD，例如 2026-08-03"),
        (63, "2026-08/03", "数字日期格式不符合 YYYY-MM-DD：2026-08/03", "改为 YYYY-MM-DD，例如 2026-08-03"),
    ]


def test_references(found):  # noqa: ANN001, ANN201
    assert found("[7] 标题之前\n参考文献\n[1] 甲\n\n [2] 乙", "reference_numbering") == []
    assert found("参考文献\n[2] 甲\n[4] 乙\n  丙\n[6] 丁\n参考文献", "reference_numbering") == [
        ("NORM-005", "medium", 2, 1, "[2] 甲", "参考文献编号应为 [1]，但找到了 [2]", "第一条参考文献应以 [1] 开始"),
        ("NORM-005", "medium", 3, 1, "[4] 乙", "参考文献编号应为 [3]，但找到了 [4]", "下一条参考文献应连续编号为 [3]"),
        ("NORM-005", "medium", 4, 3, "丙", "参考文献第 5 条格式不正确", "下一条参考文献应连续编号为 [5]"),
        ("NORM-005", "medium", 6, 1, "参考文献", "参考文献第 7 条格式不正确", "下一条参考文献应连续编号为 [7]"),
    ]


def test_a_long_list_of_references_keeps_its_count(found):  # noqa: ANN001, ANN201
    text = "参考文献\n" + "\n".join(f"[{i}] x" if i != 600 else "y" for i in range(1, 1300))
    assert [(line, m) for _, _, line, _, _, m, _ in found(text, "reference_numbering")] == [(601, "参考文献第 600 条格式不正确")]


def test_tabs_and_trailing_blanks(found):  # noqa: ANN001, ANN201
    assert found("a\tb\tc\nd", "tabs") == [("NORM-006", "medium", 1, 2, "\t", "包含 Tab 字符", "使用空格替代 Tab")]
    assert found("  a \t\nb\n \nc", "trailing_blanks") == [
        ("NORM-006", "medium", 1, 3, " \t", "存在行尾空格或制表符", "删除行尾空白字符"),
        ("NORM-006", "medium", 3, 2, " ", "存在行尾空格或制表符", "删除行尾空白字符"),
    ]


def test_repeated_words(found):  # noqa: ANN001, ANN201
    got = found("这个 这个 词\na apple  b b b\nab a", "repeated_words")
    assert got == [
        ("NORM-006", "medium", 1, 1, "这个 这个", "存在连续重复词“这个”", "删除重复出现的连续词"),
        ("NORM-006", "medium", 2, 1, "a a", "存在连续重复词“a”", "删除重复出现的连续词"),
        ("NORM-006", "medium", 2, 10, "b b", "存在连续重复词“b”", "删除重复出现的连续词"),
    ]


def test_a_long_run_of_a_word_is_one_issue(found):  # noqa: ANN001, ANN201
    assert places(found("x " + "ab  " * 20000 + "abc ab", "repeated_words")) == [(1, 3, "ab  a")]


def test_banned_words(found):  # noqa: ANN001, ANN201
    assert [(line, c, e, m) for _, _, line, c, e, m, _ in found("显然必须显然\n众所周知", "banned_words")] == [(1, 1, "显然", "包含禁用词“显然”"), (1, 3, "必须", "包含禁用词“必须”"), (1, 5, "显然", "包含禁用词“显然”"), (2, 1, "众所周知", "包含禁用词“众所周知”")]


def test_long_sentences(found):  # noqa: ANN001, ANN201
    a, b = "长" * 121, "句" * 120
    assert found(f"短。 {a}。{b}。\n{b}", "long_sentences") == [("NORM-006", "medium", 1, 3, f"{a}。", "句子长度超过 120 个字符（当前 122 个字符）", "拆分成长短适中的多个句子"), ("NORM-006", "medium", 1, 126, f"{b}。", "句子长度超过 120 个字符（当前 121 个字符）", "拆分成长短适中的多个句子")]
    # A line without a mark at its end counts once as a sentence and once as a line.
    assert places(found(f" {a}", "long_sentences")) == [(1, 1, a), (1, 1, a)]
    assert places(found(f"x。{a}", "long_sentences")) == [(1, 1, f"x。{a}"), (1, 3, a)]


def test_all_rules_their_order_and_counts(spark):  # noqa: ANN001, ANN201
    long = f"这是一个超过一百二十字符的句子{'内容' * 70}。"
    text = "\n".join(["摘要", "关键词", "引言", f"学生提交包含未配对（括号。。{long}", "结论", "参考文献", "[1] 示例文献"])
    docs = spark.createDataFrame([(1, text), (2, " \n　"), (3, None), (4, "\n".join(HEADINGS))], "doc_id int, text string")
    issues = lint.analyze(docs)
    assert [(r.doc_id, r.rule_id, r.category, r.line, r.column) for r in lint.ordered(issues).collect()] == [(1, "NORM-002", "标点配对", 4, 10), (1, "NORM-003", "重复标点", 4, 13), (1, "NORM-006", "文本质量", 4, 15)]
    assert [tuple(r) for r in lint.severity_counts(issues).collect()] == [(1, 1, 2, 0, 3)]


def test_overrides_switch_rules_off_and_set_the_limit(spark):  # noqa: ANN001, ANN201
    docs = spark.createDataFrame([(1, "(" + "长" * 110 + "。")], "doc_id int, text string")
    rules = lambda o: {r.rule_id for r in lint.analyze(docs, o).collect()}
    assert rules(None) == {"NORM-001", "NORM-002"}
    assert rules({"TEXT-LONG-SENTENCE": {"max_chars": 100}, "NORM-001": {"enabled": False}}) == {"NORM-002", "NORM-006"}
    assert rules({"TEXT-LONG-SENTENCE": {"max_chars": 100, "enabled": False}}) == {"NORM-001", "NORM-002"}


def test_a_corpus_is_scanned_once(spark):  # noqa: ANN001, ANN201
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = lint.analyze(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_the_stack_grows_as_the_marks(spark):  # noqa: ANN001, ANN201
    import time

    def took(text: str) -> tuple[float, int]:
        docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
        began = time.perf_counter()
        return time.perf_counter() - began if (n := lint.issues(docs, {"unmatched_pairs": {}}).count()) < 0 else time.perf_counter() - began, n

    deep = "(" * 1000 + "[" * 700 + "]" * 700 + ")" * 999  # over many blocks, in and out again
    assert took(deep)[1] == 1 and took('"' * 500)[1] == 500 and took(")" * 500)[1] == 500 and took("(" * 130 + "]" + ")" * 130)[1] == 1
    took('"' * 4000)
    small, large = took('"' * 4000), took('"' * 40_000)
    assert large[1] == 40_000 and large[0] < 12 * max(small[0], 0.5)


def test_classes_of_other_characters_are_ranges(spark):  # noqa: ANN001, ANN201
    import re

    from proofmill.functions.text import others

    assert others("b!。!") == r"[\x{0}-\x{20}\x{22}-\x{61}\x{63}-\x{3001}\x{3003}-\x{10FFFF}]"
    assert others("\0\1" + chr(0x10FFFF)) == r"[\x{2}-\x{10FFFE}]"
    # A negated class is what takes long.
    plan = lint.found_in(F.col("text"))._jc.toString()
    assert not re.search(r"\[\^[^\]]*。", plan)
