"""Text lint: located issues of six families of rules over many documents.

A rule is an expression: from a line, or from all lines of a text, to an array of issues. All chosen rules are evaluated
in one pass over a document's row and exploded once, so a corpus is read once and never shuffled. An issue is (doc_id,
rule_id, category, severity, line, column, excerpt, message, suggestion).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.functions.text import fill, let, matches, others, scan, strip, strip_left

#: Rules, sections, words and pairs (fixed values).
SECTIONS = ["摘要", "关键词", "引言", "结论", "参考文献"]
BANNED_WORDS = ["显然", "众所周知", "必须"]
PAIRS = {"(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "“": "”", '"': '"', "'": "'"}
CATEGORIES = {"NORM-001": "章节顺序", "NORM-002": "标点配对", "NORM-003": "重复标点", "NORM-004": "日期格式", "NORM-005": "参考文献", "NORM-006": "文本质量"}
RUN_CLASS = "[，。；！？!?,.、:;：…·~—-]"
MAX_SENTENCE = 120
ISSUE = ["doc_id", "rule_id", "category", "severity", "line", "column", "excerpt", "message", "suggestion"]
_KIND = "struct<rule_id:string,severity:string,line:bigint,column:bigint,excerpt:string,message:string,suggestion:string>"


#: What issues say, and what they suggest (fixed values).
MESSAGES = {
    "section_missing": ("缺少必需章节：{name}", "补充“{name}”并按规定顺序排列"),
    "section_order": ("章节“{name}”顺序错误", "请按照“摘要、关键词、引言、结论、参考文献”的顺序调整章节"),
    "closer": ("多余的闭合标点“{mark}”", "删除多余的闭合标点，或补全相应的左侧标点"),
    "opener": ("标点“{mark}”未成对", "补全与“{mark}”配对的闭合标点"),
    "repeated": ("存在重复标点“{mark}”", "保留一个标点即可"),
    "run": ("存在连续 {n} 个相同标点", "减少重复标点并保留一个规范标点"),
    "date": ("数字日期格式不符合 YYYY-MM-DD：{value}", "改为 YYYY-MM-DD，例如 2026-08-03"),
    "reference_form": ("参考文献第 {expected} 条格式不正确", "下一条参考文献应连续编号为 [{expected}]"),
    "reference_number": ("参考文献编号应为 [{expected}]，但找到了 [{actual}]", "下一条参考文献应连续编号为 [{expected}]"),
    "reference_first": ("", "第一条参考文献应以 [1] 开始"),
    "tab": ("包含 Tab 字符", "使用空格替代 Tab"),
    "trailing": ("存在行尾空格或制表符", "删除行尾空白字符"),
    "word_twice": ("存在连续重复词“{word}”", "删除重复出现的连续词"),
    "banned": ("包含禁用词“{word}”", "改写为更客观、规范的表达"),
    "long": ("句子长度超过 {most} 个字符（当前 {n} 个字符）", "拆分成长短适中的多个句子"),
}


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, text): lines end with a line feed, with or without a carriage return."""
    # Splitting at one character needs no pattern.
    parts = F.when(F.col(text_col).contains("\r"), F.split(text_col, "\r?\n")).otherwise(F.split(text_col, "\n"))
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(parts).alias("_n", "text")).select("doc_id", (F.col("_n") + 1).alias("line"), "text")


def _issue(rule: str, severity: str, line: Column, column: Column | int, excerpt: Column, says: str, **values: Column) -> Column:
    message, suggestion = (fill(t, **values) for t in MESSAGES[says])
    column = column if isinstance(column, Column) else F.lit(column)
    return F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), line.cast("long").alias("line"), column.cast("long").alias("column"), excerpt.alias("excerpt"), message.alias("message"), suggestion.alias("suggestion"))


def _some(ok: Column, issue: Column) -> Column:
    return F.when(ok, F.array(issue)).otherwise(F.array().cast(f"array<{_KIND}>"))


def _lead(text: Column) -> Column:
    """How much white space a line begins with."""
    return F.length(text) - F.length(strip_left(text))


def section_order(rows: Column, sections: list[str] = SECTIONS) -> Column:
    """Missing required headings, and headings before one that should precede them."""

    def of(trimmed: Column) -> Column:
        at = [F.array_position(trimmed, s) for s in sections]
        entries = []
        for k, name in enumerate(sections):
            before = F.greatest(F.lit(0), F.lit(0), *at[:k])
            missing = _issue("NORM-001", "high", F.lit(1), 1, F.lit(name), "section_missing", name=F.lit(name))
            early = _issue("NORM-001", "high", at[k], 1, F.lit(name), "section_order", name=F.lit(name))
            entries.append(F.when(at[k] == 0, missing).when(at[k] < before, early))
        return F.array_compact(F.array(*entries))

    return let(F.transform(rows, strip), of)


#: Marks of a block that is folded over the stack.
BLOCK = 256


def unmatched_pairs(rows: Column) -> Column:
    """A stack over the brackets of a whole text. A closer that doesn't fit is reported and pops nothing; straight quotes
    open only, so each is reported and blocks what is around it. Marks carry their line and column through the fold."""
    marks = "".join(PAIRS) + "".join(v for v in PAIRS.values() if v not in PAIRS)
    opens = F.lit("".join(PAIRS))
    wants = F.create_map(*[F.lit(x) for pair in PAIRS.items() for x in pair])
    pattern = "[" + "".join("\\" + c if c in "[]()" else c for c in marks) + "]"
    place = lambda i: lambda m: F.struct((i + 1).alias("line"), (m["start"] + 1).alias("col"), m["value"].alias("value"))
    found = F.flatten(F.transform(rows, lambda t, i: F.transform(matches(t, pattern), place(i))))
    none = F.array().cast("array<struct<line:int,col:int,value:string>>")
    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(xs) / BLOCK).cast("int") - 1, F.lit(0))), lambda k: F.slice(xs, k * BLOCK + 1, F.lit(BLOCK)))

    def in_block(stack: Column, marks: Column) -> Column:
        """What a block of marks does to the stack: how much of it is left, what is put on it, and the closers that don't fit."""

        def fold(acc: Column, x: Column) -> Column:
            own = F.size(acc["own"]) > 0
            top = F.when(own, F.try_element_at(acc["own"], F.lit(-1))["value"]).otherwise(F.get(stack, acc["left"] - 1)["value"])
            is_open = opens.contains(x["value"])
            fits = ~is_open & F.coalesce(wants[top] == x["value"], F.lit(False))
            return F.struct(
                F.when(fits & ~own, acc["left"] - 1).otherwise(acc["left"]).alias("left"),
                F.when(is_open, F.concat(acc["own"], F.array(x))).when(fits & own, F.slice(acc["own"], 1, F.greatest(F.size(acc["own"]) - 1, F.lit(0)))).otherwise(acc["own"]).alias("own"),
                F.when(is_open | fits, acc["extra"]).otherwise(F.concat(acc["extra"], F.array(x))).alias("extra"),
            )

        return F.aggregate(marks, F.struct(F.size(stack).alias("left"), none.alias("own"), none.alias("extra")), fold)

    def over(acc: Column, marks: Column) -> Column:
        stack = lambda r: F.concat(F.slice(acc["stack"], F.lit(1), r["left"]), r["own"])
        return let(in_block(acc["stack"], marks), lambda r: F.struct(stack(r).alias("stack"), F.concat(acc["extra"], r["extra"]).alias("extra")))

    extra = lambda x: _issue("NORM-002", "high", x["line"], x["col"], x["value"], "closer", mark=x["value"])
    left = lambda x: _issue("NORM-002", "high", x["line"], x["col"], x["value"], "opener", mark=x["value"])
    # A fold copies its state at every step: inside a block that is what the block has added, over blocks once for each.
    start = F.struct(none.alias("stack"), none.alias("extra"))
    return F.aggregate(let(found, cut), start, over, lambda r: F.concat(F.transform(r["extra"], extra), F.transform(r["stack"], left)))


def repeated_punctuation(text: Column, line: Column) -> Column:
    two = lambda m: _issue("NORM-003", "medium", line, m["start"] + 1, F.substring(m["value"], 1, 2), "repeated", mark=F.substring(m["value"], 1, 2))
    three = lambda m: _issue("NORM-003", "medium", line, m["start"] + 1, m["value"], "run", n=F.length(m["value"]))
    return F.concat(F.transform(matches(text, "([，。；])\\1+"), two), F.transform(matches(text, f"({RUN_CLASS})\\1{{2,}}"), three))


def invalid_dates(text: Column, line: Column) -> Column:
    found = matches(text, "(?<!\\d)\\d{4}[-/]\\d{1,2}[-/]\\d{1,2}(?!\\d)")
    bad = F.filter(found, lambda m: ~m["value"].rlike("^\\d{4}-\\d{2}-\\d{2}$"))
    return F.transform(bad, lambda m: _issue("NORM-004", "low", line, m["start"] + 1, m["value"], "date", value=m["value"]))


def reference_numbering(rows: Column, heading: str = "参考文献") -> Column:
    """Entries after the first reference heading count up from 1; what is expected next follows the number found."""

    def of(head: Column) -> Column:
        entry = lambda t, i: F.struct((i + 1).alias("line"), t.alias("text"), F.nullif(F.regexp_extract(t, "^(?U:\\s*)\\[(\\d+)\\]", 1), F.lit("")).try_cast("long").alias("n"))
        after = F.filter(F.transform(rows, entry), lambda x: (head > 0) & (x["line"] > head) & (F.length(strip(x["text"])) > 0))

        def step(acc: Column, x: Column) -> Column:
            e, n = acc["s"], x["n"]
            column = F.when(n.isNotNull(), F.lit(1)).otherwise(_lead(x["text"]) + 1)
            at = ("NORM-005", "medium", x["line"], column, strip(x["text"]))
            bad = F.when(n.isNull(), _issue(*at, "reference_form", expected=e)).otherwise(_issue(*at, "reference_number", expected=e, actual=n))
            bad = F.when(e == 1, bad.withField("suggestion", F.lit(MESSAGES["reference_first"][1]))).otherwise(bad)
            return F.struct((F.coalesce(n, e) + 1).alias("s"), F.when(F.coalesce(n == e, F.lit(False)), acc["out"]).otherwise(F.concat(acc["out"], F.array(bad))).alias("out"))

        return scan(after, F.lit(1).cast("long"), step, _KIND)

    return let(F.array_position(F.transform(rows, strip), heading), of)


def tabs(text: Column, line: Column) -> Column:
    return _some(text.contains("\t"), _issue("NORM-006", "medium", line, F.instr(text, "\t"), F.lit("\t"), "tab"))


def trailing_blanks(text: Column, line: Column) -> Column:
    """The column is where the line's first word begins, not where the blanks do; a blank line counts to its end."""
    blanks = F.regexp_extract(text, "((?U:\\s)+)\\z", 1)
    return _some(text.rlike("[ \\t]\\z"), _issue("NORM-006", "medium", line, _lead(text) + 1, blanks, "trailing"))


def repeated_words(text: Column, line: Column) -> Column:
    """A word and white space and the same again. No boundary is asked for after it: 'a apple' counts."""
    # Nothing in it is given back: for that Java would go a call deeper at each repetition, until the executor's stack ends.
    pattern = "(?:^|(?U:\\s))([\\p{L}0-9]++)(?:(?U:\\s++)\\1)++"

    def issue(m: Column) -> Column:
        word, value = F.regexp_extract(m["value"], pattern, 1), F.regexp_replace(m["value"], "^(?U:\\s)", "")
        column = m["start"] + F.length(m["value"]) - F.length(value) + 1
        return _issue("NORM-006", "medium", line, column, F.substring(value, F.lit(1), F.length(word) * 2 + 1), "word_twice", word=word)

    return F.transform(matches(text, pattern), issue)


def banned_words(text: Column, line: Column, words: list[str] = BANNED_WORDS) -> Column:
    found = matches(text, "|".join(f"\\Q{w}\\E" for w in words))
    return F.transform(found, lambda m: _issue("NORM-006", "medium", line, m["start"] + 1, m["value"], "banned", word=m["value"]))


def long_sentences(text: Column, line: Column, most: int = MAX_SENTENCE) -> Column:
    """Sentences over the limit; and lines over it that end without a mark, once more."""
    issue = lambda column, value: _issue("NORM-006", "medium", line, column, value, "long", most=F.lit(most), n=F.length(value))
    # Only a run of so many characters can be one, and it is tried from its own start on alone.
    inside = others("。！？!?\n")
    each = F.filter(matches(text, f"(?<!{inside}){inside}{{{max(most, 1)},}}+[。！？!?]?"), lambda m: F.length(strip(m["value"])) > most)
    whole = strip(text)
    open_end = _some(~text.rlike("[。！？!?](?U:\\s)*\\z") & (F.length(whole) > most), issue(1, whole))
    none = F.array().cast(f"array<{_KIND}>")
    return F.when(F.length(text) > most, F.concat(F.transform(each, lambda m: issue(m["start"] + 1, strip(m["value"]))), open_end)).otherwise(none)


#: Rules over all lines of a text, and rules over a line and its number.
TEXT_RULES: dict[str, Callable[..., Column]] = {"section_order": section_order, "unmatched_pairs": unmatched_pairs, "reference_numbering": reference_numbering}
LINE_RULES: dict[str, Callable[..., Column]] = {
    "repeated_punctuation": repeated_punctuation,
    "invalid_dates": invalid_dates,
    "tabs": tabs,
    "trailing_blanks": trailing_blanks,
    "repeated_words": repeated_words,
    "banned_words": banned_words,
    "long_sentences": long_sentences,
}


def found_in(text: Column, rules: dict[str, dict] | None = None) -> Column:
    """Array of the issues of a text by the rules named, with what their functions take besides; all rules if none are named."""
    chosen = {name: {} for name in (*TEXT_RULES, *LINE_RULES)} if rules is None else rules
    of_line = [(LINE_RULES[n], more) for n, more in chosen.items() if n in LINE_RULES]

    def found(rows: Column) -> Column:
        parts = [TEXT_RULES[n](rows, **more) for n, more in chosen.items() if n in TEXT_RULES]
        if of_line:
            parts.append(F.flatten(F.transform(rows, lambda t, i: F.concat(*[f(t, i + 1, **more) for f, more in of_line]))))
        return F.concat(*parts)

    return let(F.split(text, "\r?\n"), found)


def issues(docs: DataFrame, rules: dict[str, dict] | None = None) -> DataFrame:
    """The issues of ``found_in``, a row each."""
    # explode_outer, since Spark infers a filter on the size from explode and computes all of it a second time for that.
    each = docs.select("doc_id", F.explode_outer(found_in(F.col("text"), rules)).alias("x")).where("x is not null").select("doc_id", "x.*")
    names = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    return each.withColumn("category", names[F.col("rule_id")]).select(*ISSUE)


def analyze(docs: DataFrame, overrides: dict[str, dict] | None = None) -> DataFrame:
    """All issues of all documents with a text that isn't blank. Rules are fixed; with ``overrides`` ({rule_id: {enabled,
    max_chars}}) a rule can be switched off and the sentence limit set."""
    docs = docs.where(F.length(strip(F.coalesce("text", F.lit("")))) > 0)
    off = {r for r, o in (overrides or {}).items() if o.get("enabled") is False}
    rules: dict[str, dict] = {name: {} for name in (*TEXT_RULES, *LINE_RULES)}
    rules["long_sentences"] = {"most": (overrides or {}).get("TEXT-LONG-SENTENCE", {}).get("max_chars", MAX_SENTENCE)}
    if "TEXT-LONG-SENTENCE" in off:
        del rules["long_sentences"]
    out = issues(docs, rules)
    return out.where(~F.col("rule_id").isin(*off)) if off else out


def ordered(issues: DataFrame) -> DataFrame:
    """By place, then rule and message in the order of Unicode's collation."""
    return issues.orderBy("doc_id", "line", "column", *[F.collate(c, "UNICODE") for c in ("rule_id", "message")])


def severity_counts(issues: DataFrame) -> DataFrame:
    """(doc_id, high, medium, low, total)."""
    return issues.groupBy("doc_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")], F.count(F.lit(1)).alias("total"))
