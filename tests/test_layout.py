"""Layout lint on literal lines: every rule's findings with their words, and what has nothing to look at."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from proofmill.functions.text import WHITE_SPACE
from proofmill.operators import layout, lint

SCHEMA = "doc_id int, page_number int, reading_order int, x1 double, y1 double, y2 double, height double, text string"


def page(*texts: str, doc: int = 1, number: int = 1) -> list[tuple]:
    """Lines of one page from the top on; a line of digits stands at the foot."""
    return [(doc, number, i, 0.0, 20.0 * i, 790.0 if t.isdigit() else 20.0 * i + 15, 800.0, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def found(spark):  # noqa: ANN001, ANN201
    def run(rule: str, *rows: list[tuple], most: int = 20) -> list[tuple[str, str, str]]:
        frame = spark.createDataFrame([r for part in rows for r in part], SCHEMA).repartition(3)
        return [(r.text, r.message, r.suggestion) for r in sorted(layout.lint(frame, [rule], most).collect(), key=lambda r: (r.doc_id, r.n))]

    return run


def test_figures_tables_and_formulas_count_up_by_kind_and_chapter(found):  # noqa: ANN001, ANN201
    rows = page("图 1 甲", "Figure 3 乙", "fig. 4 丙", "表 2-1 子", "表 2-3 丑", "表 3-1 寅", "公式 2 天", "图像不是标签", " ", "图 2 丁")
    hint = "请检查是否遗漏、重复或错序编号，并保持同一章节内连续编号。"
    say = lambda name, n, e: f"{name}编号不连续：当前序号为 {n}，同组下一序号应为 {e}。"
    assert found("figure_table_formula_numbering_check", rows) == [
        ("Figure 3 乙", say("图", 3, 2), hint),
        ("表 2-3 丑", say("表", 3, 2), hint),
        ("公式 2 天", say("公式", 2, 1), hint),
        ("图 2 丁", say("图", 2, 5), hint),
    ]


def test_references(found):  # noqa: ANN001, ANN201
    rows = page("[9] 正文里的不算", "参考文献", "[1] 张三. 题目[J]. 2020.", "[3] 李四. 题目[M].", "2. 王五 2019", "Smith, J. A book", "随便一行", "[4] 赵六 1850", "致谢", "[9] 以后不算")
    assert [(t, m) for t, m, _ in found("reference_basic_format_check", rows)] == [
        ("[3] 李四. 题目[M].", "参考文献编号应为 [2]，实际为 [3]。"),
        ("[3] 李四. 题目[M].", "参考文献条目未识别到四位出版年份。"),
        ("2. 王五 2019", "参考文献条目缺少方括号编号。"),
        ("Smith, J. A book", "参考文献条目缺少方括号编号。"),
        ("[4] 赵六 1850", "参考文献条目未识别到四位出版年份。"),
        ("[4] 赵六 1850", "参考文献条目未识别到文献类型标识。"),
    ]


def test_symbols(found):  # noqa: ANN001, ANN201
    rows = page("全角Ａ字母", "中文,中文", "中文，中文 and English, fine", "都有１甲:乙")
    assert [(t, m) for t, m, _ in found("chinese_english_symbol_mix_check", rows)] == [
        ("全角Ａ字母", "检测到全角英文字母或数字。"),
        ("中文,中文", "中文文本中混用了英文半角标点。"),
        ("都有１甲:乙", "检测到全角英文字母或数字。"),
        ("都有１甲:乙", "中文文本中混用了英文半角标点。"),
    ]


def test_keywords(found):  # noqa: ANN001, ANN201
    rows = page("关键词：甲；乙； ；丙", "Key words: a; b", "keywords: a, b, c, d") + page("关键字: 甲、乙", "Keyword: a, b", doc=2)
    assert found("bilingual_keywords_correspondence_check", rows) == [("Key words: a; b", "中英文关键词数量不一致：中文 3 个，英文 2 个。", "请核对中英文关键词并保持数量和含义一一对应。")]


def test_headings(found):  # noqa: ANN001, ANN201
    rows = page("1 绪论", "1.2 背景", "1.3 意义", "1.5 方法", "3 结果", "3.1 一", "3.1.1 二", "4 讨论")
    assert [x for x in found("heading_numbering_sequence_check", rows)] == [
        ("1.2 背景", "标题编号未从 1 开始：在 1 下发现“1.2”。", "请确认该同级标题是否应从“1.1”开始编号。"),
        ("1.5 方法", "标题编号不连续：在 1 下发现“1.5”，应接续为“1.4”。", "请检查标题是否遗漏、重复或错序，并使同级标题按顺序连续编号。"),
        ("3 结果", "标题编号不连续：在 章节 下发现“3”，应接续为“2”。", "请检查标题是否遗漏、重复或错序，并使同级标题按顺序连续编号。"),
    ]


def test_table_of_contents(found):  # noqa: ANN001, ANN201
    rows = page("目录", "绪 论........1", "方法……3", "附录\t9") + page("绪论", "结果", number=2)
    assert [(t, m) for t, m, _ in found("toc_body_heading_consistency_check", rows)] == [("方法……3", "目录条目“方法”未在正文中识别到同名标题。"), ("附录\t9", "目录条目“附录”未在正文中识别到同名标题。")]


def test_required_sections(found):  # noqa: ANN001, ANN201
    whole = page("硕士", "论文 题目") + page("摘 要", "关键词：x", "Contents", "References", number=2)
    assert found("required_section_completeness_check", whole) == []
    bare = page("题目", "Abstract of it", doc=2) + page("博士论文", doc=2, number=2)
    assert [(t, m) for t, m, _ in found("required_section_completeness_check", bare)] == [("题目", "首页未识别到学位论文封面标识。")] + [("题目", f"未识别到必备章节“{x}”。") for x in ("关键词", "目录", "参考文献")]


def test_page_numbers(found):  # noqa: ANN001, ANN201
    rows = [r for n, label in enumerate("1 2 4 5 5".split(), 1) for r in page("text", label, number=n)]
    rows += [(1, 3, 9, 0.0, 0.0, 10.0, 800.0, "77")]  # not at the foot
    assert [(t, m) for t, m, _ in found("page_number_sequence_check", rows)] == [("4", "页码不连续：上一页显示 2，当前页显示 4。"), ("5", "页码不连续：上一页显示 5，当前页显示 5。")]


def test_citations(found):  # noqa: ANN001, ANN201
    rows = page("先引 [1] 再引 [1,3]", "又引 [2-5] 和 [3]", "References", "[9] 之后不算")
    say = lambda e, n: f"正文首次引用序号应为 [{e}]，但识别到 [{n}]。"
    assert [(t, m) for t, m, _ in found("citation_footnote_sequence_check", rows)] == [(rows[0][-1], say(2, 3)), (rows[1][-1], say(4, 2))]


def test_findings_are_capped_by_rule_and_document(found):  # noqa: ANN001, ANN201
    rows = page(*[f"全角Ａ{i}" for i in range(30)]) + page(*[f"全角Ａ{i}" for i in range(3)], doc=2)
    assert len(found("chinese_english_symbol_mix_check", rows)) == 23 and len(found("chinese_english_symbol_mix_check", rows, most=2)) == 4
    with pytest.raises(ValueError):
        found("chinese_english_symbol_mix_check", rows, most=201)


def test_lines_are_read_by_page_order_and_place(spark):  # noqa: ANN001, ANN201
    rows = [(1, 2, 0, 0.0, 0.0, 9.0, 800.0, "e"), (1, 1, 1, 0.0, 5.0, 9.0, 800.0, "c"), (1, 1, 1, 9.0, 5.0, 9.0, 800.0, "d"), (1, 1, 0, 0.0, 9.0, 9.0, 800.0, " a\u00a0"), (1, 1, 1, 5.0, 2.0, 9.0, 800.0, "b"), (1, 1, 0, 0.0, 0.0, 9.0, 800.0, " \u3000")]
    got = layout.gathered(spark.createDataFrame(rows, SCHEMA)).first()
    assert [(x.n, x.text) for x in got.lines] == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")]


def test_runs_and_summary(spark):  # noqa: ANN001, ANN201
    frame = spark.createDataFrame(page("plain text"), SCHEMA)
    runs = {r.rule_id: (r.status, r.message, len(r.findings)) for r in layout.runs(frame).collect()}
    assert runs == {n: ("unsupported", m, 0) for n, m in layout.UNSUPPORTED.items()} | {"chinese_english_symbol_mix_check": ("completed", None, 0), "required_section_completeness_check": ("completed", None, 5)}
    s = layout.summary(layout.runs(frame)).first().asDict()
    assert s == {"doc_id": 1, "rule_count": 9, "completed_rule_count": 2, "unsupported_rule_count": 7, "error_rule_count": 0, "issue_rule_count": 1, "finding_count": 5, "error_finding_count": 0, "warning_finding_count": 5, "info_finding_count": 0, "derived_rule_count": 2}
    empty_section = spark.createDataFrame(page("参考文献", "没有条目", "附录"), SCHEMA)
    assert layout.runs(empty_section, ["reference_basic_format_check"]).first().message == "reference_entries_not_detected"


def test_rule_names():  # noqa: ANN201
    assert layout.select_rules([" page_number_sequence_check ", "", "page_number_sequence_check"]) == ["page_number_sequence_check"]
    with pytest.raises(ValueError):
        layout.select_rules(["nothing"])


def random_lines(seed: int) -> list[str]:
    rng = random.Random(seed)
    figure = lambda: f"{rng.choice(['图', '表', 'Figure', '公式'])} {rng.choice(['', '1-', '2-', '10.'])}{rng.randrange(1, 7)} x"
    heading = lambda: f"{'.'.join(str(rng.randrange(1, 4)) for _ in range(rng.randrange(1, 4)))} 标题{rng.randrange(9)}"
    entry = lambda: f"{heading()} ..... {rng.randrange(1, 30)}"
    cite = lambda: "文" + "".join(f"[{rng.randrange(1, 12)}]" for _ in range(3)) + rng.choice(["", "[99999999999999999999]"])
    return [rng.choice([figure, heading, entry, cite])() for _ in range(rng.choice([1, 40, 700]))]


def plain_findings(texts: list[str]) -> dict[str, list[int]]:
    """Lines (from 0) that each rule finds, in the rule's own order, by loops."""
    out: dict[str, list[int]] = {"figures": [], "headings": [], "citations": [], "toc": []}
    groups: dict = {}
    for i, t in enumerate(texts):
        if m := re.match(r"(图|表|Figure|公式) (?:(\d+)[-.])?(\d+) x$", t):
            groups.setdefault(({"Figure": "图"}.get(m[1], m[1]), m[2]), []).append((i, int(m[3])))
    for entries in groups.values():
        expected = 1
        for i, n in entries:
            out["figures"] += [i] * (n != expected)
            expected = max(expected, n) + 1
    last: dict = {}
    for i, t in enumerate(texts):
        if m := re.match(layout.HEADING, t):
            parent, _, current = m[1].rpartition(".")
            out["headings"] += [i] * (int(current) != last.get(parent, 0) + 1)
            last[parent] = int(current)
    expected, seen = 1, set()
    for i, t in enumerate(texts):
        for n in map(int, re.findall(r"\[(\d+)\]", t)):
            if n < 2**63 and n not in seen:
                seen.add(n)
                out["citations"] += [i] * (n != expected)
                expected = max(expected, n) + 1
    small = lambda t: re.sub(r"\s+", "", t).lower()
    body = {small(t) for t in texts if not re.match(layout.TOC_ENTRY, t)}
    for i, t in enumerate(texts):
        if m := re.match(layout.TOC_ENTRY, t):
            title = re.sub(r"[.．·…\s]+$", "", m[1]).strip()
            out["toc"] += [i] * (title != "" and small(title) not in body)
    return out


FOLDS = {"figures": layout.figure_numbering, "headings": layout.heading_numbering, "citations": layout.citation_sequence, "toc": layout.toc_consistency}


def test_sorted_folds_against_loops(spark):  # noqa: ANN001, ANN201
    texts = {seed: random_lines(seed) for seed in range(24)}
    rows = layout.gathered(spark.createDataFrame([r for d, ts in texts.items() for r in page(*ts, doc=d)], SCHEMA))
    got = rows.select("doc_id", *[F.transform(f(F.col("lines")), lambda x: x["n"] - 1).alias(name) for name, f in FOLDS.items()]).collect()
    assert len(got) == 24
    for r in got:
        assert {name: r[name] for name in FOLDS} == plain_findings(texts[r.doc_id]), r.doc_id
    assert all(any(r[name] for r in got) for name in FOLDS)


@pytest.mark.parametrize("name", sorted(FOLDS))
def test_time_grows_as_the_lines(spark, name):  # noqa: ANN001, ANN201
    text = {"figures": "图 {0}-2 x", "headings": "{0}.2 标题", "citations": "文[{0}]", "toc": "章{0} .... 3"}[name]

    def took(n: int) -> float:
        rows = spark.createDataFrame(page(*[text.format(n - i) for i in range(n)]), SCHEMA)
        lines = layout.gathered(rows).cache()
        lines.count()
        began = time.perf_counter()
        assert lines.select(F.size(FOLDS[name](F.col("lines"))).alias("k")).first().k > 0
        lines.unpersist()
        return time.perf_counter() - began

    took(2000)
    small, large = took(2000), took(20_000)
    assert large < 12 * max(small, 0.4)


def test_lines_end_with_a_line_feed_and_one_carriage_return(spark):  # noqa: ANN001, ANN201
    texts = ["a\r\n\nb\r", "\r\r\n\n\r", "a\nb\n", "", "x\ry", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = sorted((r.doc_id, r.line, r.text) for r in lint.lines(docs).collect())
    assert got == [(i, n, t) for i, text in enumerate(texts) if text is not None for n, t in enumerate(re.split("\r?\n", text), 1)]


def test_any_white_space_at_the_ends_goes(spark):  # noqa: ANN001, ANN201
    texts = [f"{c}a{c}b{d}" for c in WHITE_SPACE for d in ("", c)] + [f"\u00fc{c}" for c in WHITE_SPACE] + list(WHITE_SPACE)
    got = layout.gathered(spark.createDataFrame(page(*texts), SCHEMA)).first()
    assert [x.text for x in got.lines] == [t.strip(WHITE_SPACE) for t in texts if t.strip(WHITE_SPACE)]


def test_words_of_sections_and_covers_with_white_space_inside(found):  # noqa: ANN001, ANN201
    rule = "required_section_completeness_check"
    # The cover's words go on in the next line; a Kelvin sign is a k in lower case, a long s is no s.
    assert found(rule, page("硕 士 论", "\u3000文", "A b\u00a0S\u3000tract", "\u212aEY WORDS", "C ontents", "Bibliography of it")) == []
    bare = page("硕士", "论", "Ab\u017ftract", "Bib", "目", "文 录", number=1) + page("硕士论文", "the references", number=2)
    assert [m for _, m, _ in found(rule, bare)] == ["首页未识别到学位论文封面标识。"] + [f"未识别到必备章节“{x}”。" for x in ("摘要", "关键词", "目录", "参考文献")]


def test_entries_of_contents_end_with_a_digit_and_wide_characters_are_found_in_any_text(found):  # noqa: ANN001, ANN201
    assert [t for t, _, _ in found("toc_body_heading_consistency_check", page("甲\r\r12", "乙....3", "丙....x", "丁....", "戊 4", "己  5"))] == ["甲\r\r12", "乙....3", "己  5"]
    edges = ["Ａ", "Ｚ", "ａ", "ｚ", "０", "９", "\u4e00,\u9fff", "\u9fff;\u4e00"]
    assert [t for t, _, _ in found("chinese_english_symbol_mix_check", page(*edges, "\uff0f", "\uff5b", "ü,ü", "a,b", "中,a"))] == edges


def test_long_lines_of_plain_prose_take_little_time(spark):  # noqa: ANN001, ANN201
    """A pattern that tries every place, or a text made compact for the sake of its beginning, takes over 20 microseconds a line of 1000 characters."""
    rows = spark.createDataFrame(page(*["word of prose, " * 66] * 20), SCHEMA)
    many = layout.gathered(rows).crossJoin(spark.range(2000)).selectExpr("id as doc_id", "lines").repartition(1).cache()
    many.count()

    def took(frame):  # noqa: ANN001, ANN202
        began = time.perf_counter()
        frame.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    toc, sections = (many.select(f(F.col("lines")).alias("k")) for f in (lambda x: layout._lacks("toc_body_heading_consistency_check", x), layout.required_sections))
    took(toc), took(sections)
    few = took(toc), took(sections)
    many.unpersist()
    assert max(few) < 40_000 * 20e-6, few
