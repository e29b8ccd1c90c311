"""Lint of positioned lines. Input: (doc_id, page_number, reading_order, y1, y2, x1, height, text); blank lines don't count.

A document's lines are gathered into one row in reading order, once; each rule is an expression from that array to an
array of findings, and a second one says whether there was anything to look at. So the lines are read once and dealt
out once, however many rules run. A finding is (doc_id, rule_id, severity, n, page_number, reading_order, text, message,
suggestion).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.functions.text import WHITE_SPACE, compact, fill, let, matches, scan, strip

#: Patterns and words of the rules (fixed values).
REFERENCE_HEADING = "(?i)^(参考文献|references|bibliography)$"
NEXT_SECTION = "(?i)^(致谢|附录|acknowledg(e)?ments?|appendix)"
REFERENCE = "^\\s*\\[(\\d+)]\\s*(.+)$"
UNNUMBERED = "^\\s*(?:\\d+[.)、]|[A-Z][A-Za-z .'-]{1,40}[,:])"
YEAR = "(?<!\\d)(?:19|20)\\d{2}(?!\\d)"
KIND = "\\[[A-Z]{1,3}(?:/[A-Z]{1,3})?]"
KEYWORDS = "(?i)^\\s*(关键词|关键字|key\\s*words?|keywords?)\\s*[:：]\\s*(.+)$"
OBJECT = "(?iU)^\\s*(图|figure|fig\\.?|表|table|公式|式|equation)\\s*(\\d+)(?:\\s*[-.]\\s*(\\d+))?\\b"
CITATION = "\\[(\\d+(?:\\s*[,，、-]\\s*\\d+)*)]"
WIDE, MIXED = "[Ａ-Ｚａ-ｚ０-９]", "[\\u4e00-\\u9fff][,;:!?][\\u4e00-\\u9fff]"
#: What every text has that WIDE or MIXED finds something in.
WIDE_OR_HAN = "[\\u4e00-\\u9fff\\uff10-\\uff5a]"
COVER_WORDS = ["学位论文", "硕士论文", "博士论文"]
REQUIRED = {"摘要": ["摘要", "abstract"], "关键词": ["关键词", "关键字", "keywords", "key words"], "目录": ["目录", "contents"], "参考文献": ["参考文献", "references", "bibliography"]}
#: Lines that may begin with one of these words when they are compact; white space can stand anywhere in them.
REQUIRED_LINE = "(?iU)^\\s*(?:" + "|".join("\\s*".join(w.replace(" ", "")) for words in REQUIRED.values() for w in words) + ")"
MAX_FINDINGS = 20

#: What findings say, and what they suggest (fixed values).
MESSAGES = {
    "numbering": ("{name}编号不连续：当前序号为 {number}，同组下一序号应为 {expected}。", "请检查是否遗漏、重复或错序编号，并保持同一章节内连续编号。"),
    "reference_bracket": ("参考文献条目缺少方括号编号。", "请以“[序号]”开头，并按正文出现顺序连续编号。"),
    "reference_number": ("参考文献编号应为 [{expected}]，实际为 [{number}]。", "请调整参考文献编号，使其从 [1] 起连续递增。"),
    "reference_year": ("参考文献条目未识别到四位出版年份。", "请补充规范的出版或发表年份。"),
    "reference_kind": ("参考文献条目未识别到文献类型标识。", "请按采用的 GB/T 7714 模板补充如 [J]、[M]、[D] 等文献类型标识。"),
    "wide": ("检测到全角英文字母或数字。", "请将英文字母和阿拉伯数字统一为半角字符。"),
    "mixed": ("中文文本中混用了英文半角标点。", "请根据院校规范统一使用中文全角标点，英文或公式内容除外。"),
    "keywords": ("中英文关键词数量不一致：中文 {zh} 个，英文 {en} 个。", "请核对中英文关键词并保持数量和含义一一对应。"),
    "heading_first": ("标题编号未从 1 开始：在 {under} 下发现“{number}”。", "请确认该同级标题是否应从“{expected}”开始编号。"),
    "heading_next": ("标题编号不连续：在 {under} 下发现“{number}”，应接续为“{expected}”。", "请检查标题是否遗漏、重复或错序，并使同级标题按顺序连续编号。"),
    "toc": ("目录条目“{title}”未在正文中识别到同名标题。", "请核对目录与正文标题是否一致；如为换行标题，请人工确认。"),
    "cover": ("首页未识别到学位论文封面标识。", "请确认封面页包含学位论文类型与题名；非标准模板或扫描件可能无法识别。"),
    "section": ("未识别到必备章节“{name}”。", "请确认论文包含该章节；扫描件或非标准标题可能导致无法识别。"),
    "page": ("页码不连续：上一页显示 {previous}，当前页显示 {current}。", "请核对页码起始页、连续性和页码格式。"),
    "citation": ("正文首次引用序号应为 [{expected}]，但识别到 [{number}]。", "请核对正文引注、脚注与参考文献编号的连续性。"),
}
#: What a rule without anything to look at says (fixed values).
UNSUPPORTED = {
    "figure_table_formula_numbering_check": "figure_table_formula_labels_not_detected",
    "reference_basic_format_check": "reference_section_not_detected",
    "bilingual_keywords_correspondence_check": "bilingual_keywords_not_detected",
    "heading_numbering_sequence_check": "heading_numbering_candidates_not_detected",
    "toc_body_heading_consistency_check": "toc_not_detected",
    "page_number_sequence_check": "page_numbers_not_detected",
    "citation_footnote_sequence_check": "citations_not_detected",
}
NO_ENTRIES = "reference_entries_not_detected"
#: Which lines are numbered headings, and which are entries of a table of contents: parameters, as layouts differ.
HEADING = "^(\\d+(?:\\.\\d+){0,3})[\\s、.．]+\\S.{0,88}$"
#: An entry's last character is a digit; a line without one is not tried at each of its places.
TOC_ENTRY = "^(?=(?s:.*+)(?<=\\d))(.*\\S)\\s*(?:[.．·…]{2,}|\\t|\\s{2,})\\s*\\d+$"

_FINDING = "struct<n:int,page_number:bigint,reading_order:bigint,text:string,message:string,suggestion:string>"
_LINE = ("page_number", "reading_order", "y1", "x1", "y2", "height", "text")


def gathered(rows: DataFrame) -> DataFrame:
    """(doc_id, lines): a document's lines with text, trimmed, in reading order, numbered from 1 as ``n``."""
    # Stripping goes through the whole text, so it is left to texts with white space at an end.
    text = F.col("text")
    blank = reduce(lambda a, b: a | b, [text.startswith(c) | text.endswith(c) for c in WHITE_SPACE])
    kept = rows.withColumn("text", F.when(blank, strip(text)).otherwise(text)).where("text <> ''")
    line = F.struct(*[F.col(c).cast("long" if c in _LINE[:2] else "string" if c == "text" else "double").alias(c) for c in _LINE])
    sorted_ = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return sorted_.select("doc_id", F.transform("lines", lambda x, i: x.withField("n", i + 1)).alias("lines"))


def with_expected(rows: DataFrame, keys: list[str], number: str, order: list[str]) -> DataFrame:
    """Adds ``expected``: 1 for a group's first entry, then max(expected + 1, number + 1). With j entries before, that is
    j + 1 + max(0, max over them of (number - their rank)), a running maximum."""
    by = Window.partitionBy(*keys).orderBy(*order)
    ranked = rows.withColumn("_j", F.row_number().over(by))
    ahead = F.max(F.col(number) - F.col("_j")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return ranked.withColumn("expected", F.col("_j") + F.greatest(F.lit(0), F.coalesce(ahead, F.lit(0)))).drop("_j")


def _finding(line: Column, says: str, **values: Column) -> Column:
    message, suggestion = (fill(t, **values) for t in MESSAGES[says])
    return F.struct(line["n"].alias("n"), line["page_number"].alias("page_number"), line["reading_order"].alias("reading_order"), line["text"].alias("text"), message.alias("message"), suggestion.alias("suggestion"))


def _some(*checks: tuple[Column, Column]) -> Column:
    """The findings whose conditions hold."""
    return F.array_compact(F.array(*[F.when(ok, finding) for ok, finding in checks])).cast(f"array<{_FINDING}>")


def _with(lines: Column, keep: Callable[[Column], Column], **fields: Callable[[Column], Column]) -> Column:
    """The lines that ``keep`` takes, with fields computed from their texts."""
    chosen = F.filter(lines, lambda x: keep(x["text"]))
    return F.transform(chosen, lambda x: reduce(lambda y, f: y.withField(f, fields[f](x["text"])), fields, x))


def _in_sequence(entries: Column, says: str, **values: Callable[[Column], Column]) -> Column:
    """Findings for entries whose ``number`` is not the one expected: 1, then max(expected + 1, number + 1)."""

    def step(acc: Column, x: Column) -> Column:
        bad = _finding(x, says, expected=acc["s"], **{k: f(x) for k, f in values.items()})
        return F.struct((F.greatest(acc["s"], x["number"]) + 1).alias("s"), F.when(x["number"] == acc["s"], acc["out"]).otherwise(F.concat(acc["out"], F.array(bad))).alias("out"))

    return scan(entries, F.lit(1).cast("long"), step, _FINDING)


def _number(pattern: str, group: int) -> Callable[[Column], Column]:
    return lambda t: F.nullif(F.regexp_extract(t, pattern, group), F.lit("")).try_cast("long")


def figure_numbering(lines: Column) -> Column:
    kind = lambda t: F.lower(F.regexp_extract(t, OBJECT, 1))
    name = lambda t: F.when(kind(t).isin("图", "figure", "fig", "fig."), "图").when(kind(t).isin("表", "table"), "表").otherwise("公式")
    first, second = _number(OBJECT, 2), _number(OBJECT, 3)
    number, chapter = lambda t: F.coalesce(second(t), first(t)), lambda t: F.when(second(t).isNotNull(), first(t))
    group = lambda t: F.concat_ws(":", name(t), chapter(t).cast("string"))
    entries = _with(lines, lambda t: t.rlike(OBJECT), name=name, number=number, group=group)

    # Sorted by group, one fold counts them all; what it finds goes back to the order in which groups begin.
    keyed = F.array_sort(F.transform(entries, lambda x: F.struct(x["group"].alias("group"), x["n"].alias("n"), x.alias("x"))))

    def step(acc: Column, y: Column) -> Column:
        x, s = y["x"], acc["s"]
        same = s["group"].eqNullSafe(y["group"])
        expected, first = F.when(same, s["expected"]).otherwise(F.lit(1).cast("long")), F.when(same, s["first"]).otherwise(y["n"])
        state = F.struct(y["group"].alias("group"), first.alias("first"), (F.greatest(expected, x["number"]) + 1).alias("expected"))
        bad = F.struct(first.alias("first"), y["n"].alias("n"), _finding(x, "numbering", expected=expected, name=x["name"], number=x["number"]).alias("f"))
        return F.struct(state.alias("s"), F.when(x["number"] == expected, acc["out"]).otherwise(F.concat(acc["out"], F.array(bad))).alias("out"))

    start = F.expr("cast(null as struct<group:string,first:int,expected:bigint>)")
    return F.transform(F.array_sort(scan(keyed, start, step, f"struct<first:int,n:int,f:{_FINDING}>")), lambda y: y["f"])


def _section(lines: Column) -> Column:
    """Lines after the first reference heading and before the next section."""
    head = F.array_position(F.transform(lines, lambda x: x["text"].rlike(REFERENCE_HEADING)), True)

    def of(after: Column) -> Column:
        end = F.array_position(F.transform(after, lambda x: x["text"].rlike(NEXT_SECTION)), True)
        return F.when(end > 0, F.slice(after, F.lit(1), (end - 1).cast("int"))).otherwise(after)

    rest = F.when(head > 0, F.slice(lines, (head + 1).cast("int"), F.greatest(F.size(lines), F.lit(1)))).otherwise(F.slice(lines, 1, 0))
    return let(rest, of)


def reference_format(lines: Column) -> Column:
    number, body = _number(REFERENCE, 1), lambda t: F.regexp_extract(t, REFERENCE, 2)

    def step(acc: Column, x: Column) -> Column:
        t, e = x["text"], acc["s"]
        entry, n = t.rlike(REFERENCE), number(x["text"])
        bad = _some(
            (~entry & t.rlike(UNNUMBERED), _finding(x, "reference_bracket")),
            (entry & (n != e), _finding(x, "reference_number", expected=e, number=n)),
            (entry & ~body(t).rlike(YEAR), _finding(x, "reference_year")),
            (entry & ~body(t).rlike(KIND), _finding(x, "reference_kind")),
        )
        return F.struct(F.when(entry, F.greatest(e, n) + 1).otherwise(e).alias("s"), F.concat(acc["out"], bad).alias("out"))

    return scan(_section(lines), F.lit(1).cast("long"), step, _FINDING)


def symbol_mix(lines: Column) -> Column:
    # Texts of ASCII have neither.
    rows = F.filter(lines, lambda x: (F.octet_length(x["text"]) > F.length(x["text"])) & x["text"].rlike(WIDE_OR_HAN))
    return F.flatten(F.transform(rows, lambda x: _some((x["text"].rlike(WIDE), _finding(x, "wide")), (x["text"].rlike(MIXED), _finding(x, "mixed")))))


def _keywords(lines: Column) -> tuple[Column, Column]:
    """The first line of keywords in Chinese and in English, with their number."""
    words = lambda t: F.size(F.filter(F.split(F.regexp_extract(t, KEYWORDS, 2), "[,，;；、]"), lambda w: F.length(strip(w)) > 0))
    rows = _with(lines, lambda t: t.rlike(KEYWORDS), zh=lambda t: F.regexp_extract(t, KEYWORDS, 1).isin("关键词", "关键字"), words=words)
    return F.get(F.filter(rows, lambda x: x["zh"]), F.lit(0)), F.get(F.filter(rows, lambda x: ~x["zh"]), F.lit(0))


def bilingual_keywords(lines: Column) -> Column:
    zh, en = _keywords(lines)
    return let(F.struct(zh.alias("zh"), en.alias("en")), lambda b: _some((b["zh"]["words"] != b["en"]["words"], _finding(b["en"], "keywords", zh=b["zh"]["words"], en=b["en"]["words"]))))


def heading_numbering(lines: Column, pattern: str = HEADING) -> Column:
    """Numbered headings count up from 1 below each parent."""
    number = lambda t: F.regexp_extract(t, pattern, 1)
    rows = _with(lines, lambda t: t.rlike(pattern), number=number, parent=lambda t: F.regexp_extract(number(t), "^(.*)\\.\\d+$", 1), current=lambda t: F.regexp_extract(number(t), "(\\d+)$", 1).try_cast("long"))

    keyed = F.array_sort(F.transform(rows, lambda x: F.struct(x["parent"].alias("parent"), x["n"].alias("n"), x.alias("x"))))

    def of(ys: Column) -> Column:
        def one(y: Column, i: Column) -> Column:
            x, parent, last = y["x"], y["parent"], F.get(ys, i - 1)
            under = F.when(parent == "", F.lit("章节")).otherwise(parent)
            name = lambda k: F.concat_ws(".", F.nullif(parent, F.lit("")), k.cast("string"))
            first, before = ~last["parent"].eqNullSafe(parent), last["x"]["current"]
            return _some(
                (first & (x["current"] != 1), _finding(x, "heading_first", under=under, number=x["number"], expected=name(F.lit(1)))),
                (~first & (x["current"] != before + 1), _finding(x, "heading_next", under=under, number=x["number"], expected=name(before + 1))),
            )

        return F.array_sort(F.flatten(F.transform(ys, one)))

    return let(keyed, of)


def toc_consistency(lines: Column, entry: str = TOC_ENTRY) -> Column:
    """Entries of a table of contents whose title is no line of the body."""
    title = lambda t: strip(F.regexp_replace(F.regexp_extract(t, entry, 1), "[.．·…\\s]+$", ""))

    def keyed(x: Column, wanted: Column, name: Column) -> Column:
        return F.struct(compact(F.when(wanted, name).otherwise(x["text"])).alias("key"), wanted.alias("entry"), x["n"].alias("n"), name.alias("title"), x.alias("x"))

    # Sorted by text, a line of the body stands before the entries that name it.
    rows = F.transform(lines, lambda x: let(F.struct(x.alias("x"), x["text"].rlike(entry).alias("e"), title(x["text"]).alias("t")), lambda y: keyed(y["x"], y["e"], y["t"])))

    def step(acc: Column, y: Column) -> Column:
        absent = y["entry"] & (y["title"] != "") & ~acc["s"].eqNullSafe(y["key"])
        out = F.when(absent, F.concat(acc["out"], F.array(_finding(y["x"], "toc", title=y["title"])))).otherwise(acc["out"])
        return F.struct(F.when(y["entry"], acc["s"]).otherwise(y["key"]).alias("s"), out.alias("out"))

    return F.array_sort(scan(F.array_sort(rows), F.lit(None).cast("string"), step, _FINDING))


def required_sections(lines: Column) -> Column:
    # A text is made compact only where a word may be found in it.
    small = F.transform(F.filter(lines, lambda x: x["text"].rlike(REQUIRED_LINE)), lambda x: compact(x["text"]))
    first = F.get(lines, F.lit(0))
    page = F.filter(lines, lambda x: x["page_number"] == F.get(lines, F.lit(0))["page_number"])
    starts = lambda t, words: reduce(lambda a, b: a | b, [t.startswith(w) for w in words])
    has = lambda t, words: reduce(lambda a, b: a | b, [t.contains(w) for w in words])
    # A word can go on in the next line; its last character is in one.
    ended = F.exists(page, lambda x: has(x["text"], sorted({w[-1] for w in COVER_WORDS})))
    cover = F.when(ended, let(F.array_join(F.transform(page, lambda x: compact(x["text"])), ""), lambda t: has(t, COVER_WORDS))).otherwise(False)
    absent = lambda ts, words: ~F.exists(ts, lambda t: starts(t, words))
    sections = let(small, lambda ts: _some(*[(absent(ts, words), _finding(first, "section", name=F.lit(name))) for name, words in REQUIRED.items()]))
    return F.concat(_some((~cover, _finding(first, "cover"))), sections)


def _pages(lines: Column) -> Column:
    """Lines of digits alone in the bottom part of their page."""
    low = F.filter(lines, lambda x: (x["y2"] >= x["height"] * 0.85) & x["text"].rlike("^[0-9]+$"))
    return F.transform(low, lambda x: x.withField("number", x["text"].try_cast("long")))


def page_numbers(lines: Column) -> Column:
    def of(xs: Column) -> Column:
        one = lambda x, i: _some(((i > 0) & (x["number"] != F.get(xs, i - 1)["number"] + 1), _finding(x, "page", previous=F.get(xs, i - 1)["number"], current=x["number"])))
        return F.flatten(F.transform(xs, one))

    return let(_pages(lines), of)


def _citing(lines: Column) -> Column:
    """The lines before the reference heading that cite numbers."""
    head = F.array_position(F.transform(lines, lambda x: x["text"].rlike(REFERENCE_HEADING)), True)
    body = F.when(head > 0, F.slice(lines, F.lit(1), (head - 1).cast("int"))).otherwise(lines)
    return F.filter(body, lambda x: x["text"].contains("[") & x["text"].rlike(CITATION))


def _cited(lines: Column) -> Column:
    """The numbers cited before the reference heading, in order, with their lines."""
    numbers = lambda t: F.flatten(F.transform(F.regexp_extract_all(t, F.lit(CITATION), F.lit(0)), lambda m: F.regexp_extract_all(m, F.lit("\\d+"), F.lit(0))))
    return F.flatten(F.transform(_citing(lines), lambda x: F.transform(numbers(x["text"]), lambda v: x.withField("number", v.try_cast("long")))))


def citation_sequence(lines: Column) -> Column:
    """Numbers cited before the reference heading appear for the first time in the order 1, 2, 3."""

    keyed = F.array_sort(F.transform(_cited(lines), lambda x, i: F.struct(x["number"].alias("number"), i.alias("i"), x.alias("x"))))
    # A number that is too long for one is none.
    firsts = let(keyed, lambda ys: F.filter(ys, lambda y, j: y["number"].isNotNull() & ~F.get(ys, j - 1)["number"].eqNullSafe(y["number"])))
    ordered = F.array_sort(F.transform(firsts, lambda y: F.struct(y["i"].alias("i"), y["x"].alias("x"))))
    return _in_sequence(F.transform(ordered, lambda y: y["x"]), "citation", number=lambda x: x["number"])


RULES: dict[str, Callable[[Column], Column]] = {
    "figure_table_formula_numbering_check": figure_numbering,
    "reference_basic_format_check": reference_format,
    "chinese_english_symbol_mix_check": symbol_mix,
    "bilingual_keywords_correspondence_check": bilingual_keywords,
    "heading_numbering_sequence_check": heading_numbering,
    "toc_body_heading_consistency_check": toc_consistency,
    "required_section_completeness_check": required_sections,
    "page_number_sequence_check": page_numbers,
    "citation_footnote_sequence_check": citation_sequence,
}
#: Every rule's severity and how its evidence comes about (fixed values).
SEVERITY, EVIDENCE = "warning", "derived"


def select_rules(names: list[str]) -> list[str]:
    """Trimmed and distinct, in the order given; an unknown one is an error."""
    wanted = list(dict.fromkeys(n.strip() for n in names if n.strip()))
    if unknown := [n for n in wanted if n not in RULES]:
        raise ValueError(f"unknown rules: {unknown}")
    return wanted


def _lacks(rule: str, lines: Column) -> Column:
    """Why a rule has nothing to look at in a document; null if it has."""
    some = lambda pattern: F.exists(lines, lambda x: x["text"].rlike(pattern))
    ready = {
        "figure_table_formula_numbering_check": lambda: some(OBJECT),
        "reference_basic_format_check": lambda: some(REFERENCE_HEADING),
        "bilingual_keywords_correspondence_check": lambda: reduce(lambda a, b: a.isNotNull() & b.isNotNull(), _keywords(lines)),
        "heading_numbering_sequence_check": lambda: some(HEADING),
        "toc_body_heading_consistency_check": lambda: some(TOC_ENTRY),
        "page_number_sequence_check": lambda: F.size(_pages(lines)) >= 2,
        "citation_footnote_sequence_check": lambda: F.size(_citing(lines)) > 0,
    }
    if rule not in ready:
        return F.lit(None).cast("string")
    lack = F.when(~ready[rule](), F.lit(UNSUPPORTED[rule]))
    if rule == "reference_basic_format_check":
        entries = F.exists(_section(lines), lambda x: x["text"].rlike(REFERENCE) | x["text"].rlike(UNNUMBERED))
        lack = F.coalesce(lack, F.when(~entries, F.lit(NO_ENTRIES)))
    return lack


def runs(rows: DataFrame, names: list[str] | None = None, most: int = MAX_FINDINGS) -> DataFrame:
    """(doc_id, rule_id, status, message, findings) for every rule chosen: completed, or unsupported with the reason. At
    most ``most`` findings of a rule, the first ones; a report's feature, 1 to 200."""
    if not 1 <= most <= 200:
        raise ValueError("max_findings must be 1 to 200")
    chosen = select_rules(names if names is not None else list(RULES))

    def run(name: str, lines: Column) -> Column:
        none = F.array().cast(f"array<{_FINDING}>")
        return let(
            _lacks(name, lines),
            lambda lack: F.struct(F.lit(name).alias("rule_id"), F.when(lack.isNull(), "completed").otherwise("unsupported").alias("status"), lack.alias("message"), F.when(lack.isNull(), F.slice(RULES[name](lines), 1, most).cast(f"array<{_FINDING}>")).otherwise(none).alias("findings")),
        )

    each = gathered(rows).select("doc_id", F.explode_outer(F.array(*[run(n, F.col("lines")) for n in chosen])).alias("r"))
    return each.select("doc_id", "r.*")


def findings_of(runs: DataFrame) -> DataFrame:
    found = runs.select("doc_id", "rule_id", F.explode_outer("findings").alias("f")).where("f is not null")
    return found.select("doc_id", "rule_id", F.lit(SEVERITY).alias("severity"), "f.*")


def lint(rows: DataFrame, names: list[str] | None = None, most: int = MAX_FINDINGS) -> DataFrame:
    return findings_of(runs(rows, names, most))


def summary(runs: DataFrame) -> DataFrame:
    """A row per document with the ten counters of a report; errors end a job here, so none are counted."""
    n = F.size("findings")
    done = F.count_if(F.col("status") == "completed")
    counted = {
        "rule_count": F.count(F.lit(1)),
        "completed_rule_count": done,
        "unsupported_rule_count": F.count_if(F.col("status") == "unsupported"),
        "error_rule_count": F.count_if(F.col("status") == "error"),
        "issue_rule_count": F.count_if(n > 0),
        "finding_count": F.sum(n),
        **{f"{s}_finding_count": F.sum(F.when(F.lit(SEVERITY == s), n).otherwise(0)) for s in ("error", "warning", "info")},
        "derived_rule_count": F.count_if((F.col("status") == "completed") & F.lit(EVIDENCE == "derived")),
    }
    return runs.groupBy("doc_id").agg(*[c.cast("long").alias(k) for k, c in counted.items()])
