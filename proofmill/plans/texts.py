"""Queries over texts: similarity, writing risk, lint, checklist and rewriting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.functions.text import char_ngrams, normalized
from proofmill.operators import layout, lint, rewrite, rubric, similarity
from proofmill.plans.inputs import table

QUERIES, ORACLES = {}, {}
THRESHOLD = 0.3
#: Lines that some of the documents have.
_LICENCES = ["All rights reserved.", "Released under the MIT License."]


def query(oracle: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _norm(t: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({t}), '[\s\p{{Z}}]+', ' ', 'g'), '[\p{{P}}\p{{S}}]', '', 'g'))"


def _grams(t: str) -> str:
    return f"case when length({t}) = 0 then [] when length({t}) <= 5 then [{t}] else list_distinct(list_transform(range(1, length({t}) - 3), lambda i: {t}[i:i + 4])) end"


def _paragraphs(name: str, source: str, key: str) -> str:
    return rf"""{name}_l as (select {key} as id, unnest(range(0, len(s))) as ord, unnest(s) as raw from (select {key}, string_split(text, chr(10)) as s from {source})),
{name}_o as (select *, coalesce(sum(length(raw) + 1) over (partition by id order by ord rows between unbounded preceding and 1 preceding), 0) as before, regexp_replace(raw, '^[\s\p{{Z}}]+', '') as lead from {name}_l),
{name} as (select id, ord, regexp_replace(lead, '[\s\p{{Z}}]+$', '') as body, (before + length(raw) - length(lead))::bigint as s, (before + length(raw) - length(lead) + length(regexp_replace(lead, '[\s\p{{Z}}]+$', '')))::bigint as e from {name}_o where length(regexp_replace(lead, '[\s\p{{Z}}]+$', '')) > 0)"""


_SETS = f"""{_paragraphs("dp", "documents", "doc_id")}, {_paragraphs("bp", "benchmark", "item_id")},
dg as (select id, ord, s, e, unnest(g) as gram, len(g) as n from (select *, {_grams("t")} as g from (select *, {_norm("body")} as t from dp))),
bg as (select id, ord, s, e, unnest(g) as gram, len(g) as n from (select *, {_grams("t")} as g from (select *, {_norm("body")} as t from bp))),
pp as (select dg.id as doc_id, dg.ord, dg.s as "start", dg.e as "end", bg.id as sample_id, bg.ord as so, bg.s as sample_start, bg.e as sample_end, count(*) / (dg.n + bg.n - count(*)) as score from dg join bg on bg.gram = dg.gram group by dg.id, dg.ord, dg.s, dg.e, bg.id, bg.ord, bg.s, bg.e, dg.n, bg.n),
pp2 as (select doc_id, ord, "start", "end", sample_id, so, sample_start, sample_end, score from pp),
best as (select * exclude (so, k) from (select *, row_number() over (partition by doc_id, ord, sample_id order by score desc, so) as k from pp2 where score >= {THRESHOLD}) where k = 1),
dw as (select doc_id, unnest(g) as gram, len(g) as n from (select doc_id, {_grams("t")} as g from (select doc_id, {_norm("text")} as t from documents))),
bw as (select item_id, unnest(g) as gram, len(g) as n from (select item_id, {_grams("t")} as g from (select item_id, {_norm("text")} as t from benchmark))),
whole as (select doc_id, item_id as sample_id, count(*) / (dw.n + bw.n - count(*)) as score from dw join bw on bw.gram = dw.gram group by doc_id, item_id, dw.n, bw.n),
pairs as (select doc_id, sample_id, round(max(score), 6) as jaccard_score from (select doc_id, sample_id, score from whole union all select doc_id, sample_id, score from best) group by 1, 2 having round(max(score), 6) >= {THRESHOLD}),
top as (select * from (select *, row_number() over (partition by doc_id order by jaccard_score desc, sample_id) as rank from pairs) where rank <= 5),
iv as (select distinct b.doc_id, b."start", b."end" from best b join top t on t.doc_id = b.doc_id and t.sample_id = b.sample_id),
cut as (select *, case when "start" > max("end") over (partition by doc_id order by "start", "end" rows between unbounded preceding and 1 preceding) then 1 else 0 end as new from iv),
isl as (select *, sum(new) over (partition by doc_id order by "start", "end") as i from cut),
merged as (select doc_id, min("start") as "start", max("end") as "end" from isl group by doc_id, i),
cov as (select doc_id, sum("end" - "start")::bigint as m from merged group by 1),
rate as (select d.doc_id, length({_norm("d.text")})::bigint as effective_characters, coalesce(m, 0)::bigint as matched_characters, case when length({_norm("d.text")}) > 0 then round(least(1.0::double, coalesce(m, 0)::double / length({_norm("d.text")})), 6) else 0.0 end as total_similarity_rate from documents d left join cov on cov.doc_id = d.doc_id)"""


@query(f"select doc_id, len({_grams('t')})::int as n_grams from (select doc_id, {_norm('text')} as t from documents)")
def doc_ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(char_ngrams(normalized(F.col("text")))).alias("n_grams"))


@query(f"with {_SETS} select doc_id, sample_id, jaccard_score from pairs")
def doc_similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.document_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), THRESHOLD)


@query(f"with {_SETS} select doc_id, sample_id, jaccard_score, rank::int as rank from top")
def doc_similarity_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.best_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), THRESHOLD).drop("spans")


@query(f'with {_SETS} select doc_id, ord::int as ord, sample_id, "start", "end", sample_start, sample_end, score from best')
def paragraph_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.best_paragraphs(similarity.paragraphs(table(spark, sf_dir, "documents")), similarity.paragraphs(table(spark, sf_dir, "benchmark"), "item_id"), THRESHOLD)


@query('with i as (select l_partkey as k, l_orderkey % 1000 as "start", l_orderkey % 1000 + l_quantity::bigint as "end" from lineitem), c as (select *, case when "start" > max("end") over (partition by k order by "start", "end" rows between unbounded preceding and 1 preceding) then 1 else 0 end as new from i where "end" > "start"), s as (select *, sum(new) over (partition by k order by "start", "end" rows unbounded preceding) as n from c) select k, min("start") as "start", max("end") as "end" from s group by k, n')
def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_partkey k", "l_orderkey % 1000 start", "l_orderkey % 1000 + cast(l_quantity as long) end")
    return similarity.merged_spans(rows, ["k"])


@query(f"with {_SETS} select * from rate")
def similarity_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similarity_rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), THRESHOLD)


def _hits(phrases: list[str]) -> str:
    return " + ".join(f"(length(low) - length(replace(low, '{p}', ''))) // {len(p)}" for p in phrases)


def _to3(x: str) -> str:
    """Half up in decimals, as Spark rounds a double."""
    return f"round(({x})::varchar::decimal(24, 12), 3)::double"


_RISK = rf"""with b as (select doc_id, text, lower(text) as low, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_norm("x")}), lambda x: length(x) > 0) as p, list_transform(list_filter(list_transform(regexp_split_to_array(text, '[。！？.!?；;\n]+'), lambda x: {_norm("x")}), lambda x: length(x) > 0), lambda x: length(x)::double) as l, greatest(length({_norm("text")}), 1) as size from documents),
f as (select doc_id, round(least(100.0, case when len(p) > 0 then (len(p) - len(list_distinct(p)))::double / len(p) * 100 else 0 end), 5) as a,
  case when len(l) > 1 then round(greatest(0.0, least(100.0, (1 - (case when list_avg(l) > 0 then list_stddev_pop(l) / list_avg(l) else 1 end)) * 100)), 5) else 0.0 end as b,
  round(least(100.0, ({_hits(similarity.TEMPLATE_CONNECTORS)})::double / size * 900), 5) as c, round(least(100.0, ({_hits(similarity.VAGUE_PHRASES)})::double / size * 1200), 5) as d from b)
select doc_id, {_to3('a')} as paragraph_duplication_rate, {_to3('b')} as sentence_length_low_variation, c as template_connector_density, d as vague_phrase_density, {_to3('round((a * 0.35 + b * 0.25 + c * 0.2 + d * 0.2)::varchar::decimal(24, 12), 5)')} as risk_score from f"""


@query(_RISK)
def writing_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded to 3 places more, as the engines add up in another order."""
    rows = similarity.writing_risk(table(spark, sf_dir, "documents"))
    return rows.withColumns({c: F.round(c, 3) for c in ("paragraph_duplication_rate", "sentence_length_low_variation", "risk_score")})


_LINES = r"l as (select doc_id, unnest(range(1, len(s) + 1)) as line, unnest(s) as t from (select doc_id, regexp_split_to_array(text, '\r?\n') as s from documents))"


@query(rf"with {_LINES}, s as (select doc_id, line, unnest(regexp_extract_all(t, '[^。！？!?]+[。！？!?]?')) as v from l), e as (select doc_id, line, trim(v) as v from s union all select doc_id, line, trim(t) from l where not regexp_matches(trim(t), '[。！？!?]$')) select doc_id, line, length(v)::int as n from e where length(v) > 120")
def lint_long_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lint.issues(table(spark, sf_dir, "documents"), {"long_sentences": {}})
    return found.select("doc_id", "line", F.length("excerpt").alias("n"))


#: Words that the next word equals or begins with, as far as one match goes; then matches in order, none inside another.
_TWICE = rf"""{_LINES},
t as (select doc_id, line, t, regexp_extract_all(t, '\S+') as w, regexp_extract_all(t, '\s*\S+') as p from l),
c0 as (select doc_id, line, w, unnest(range(1, len(w))) as i from t),
c1 as (select doc_id, line, i, list_filter(range(i + 1, len(w) + 1), lambda j: not coalesce(w[j] = w[i] and starts_with(w[j + 1], w[i]), false))[1] as e from c0 where starts_with(w[i + 1], w[i]) and regexp_full_match(w[i], '[\p{{L}}0-9]+')),
c2 as (select doc_id, line, list({{'i': i, 'e': e}} order by i) as c from c1 group by 1, 2),
r as (select doc_id, line, c, c[1] as x from c2 union all select doc_id, line, c, list_filter(c, lambda y: y.i > x.e)[1] from r where len(list_filter(c, lambda y: y.i > x.e)) > 0),
twice as (select r.doc_id, r.line, t.w[x.i] as word, t.t, coalesce(list_sum(list_transform(p[:x.i - 1], lambda y: length(y))), 0) + length(p[x.i]) - length(w[x.i]) as pos from r join t on t.doc_id = r.doc_id and t.line = r.line)"""


@query(f"""with recursive {_TWICE} select doc_id, line::bigint as line, (pos + 1)::bigint as "column", substr(t, pos::int + 1, 2 * length(word) + 1) as excerpt, '存在连续重复词“' || word || '”' as message from twice""")
def lint_repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.issues(table(spark, sf_dir, "documents"), {"repeated_words": {}}).select("doc_id", "line", "column", "excerpt", "message")


_QUOTES = r"""with d as (select doc_id, text, unnest(range(1, length(text) + 1)) as i from documents where regexp_matches(text, '["'']'))
select doc_id, text[i] as mark, count(*) as n from d where text[i] in ('"', '''') group by 1, 2"""


@query(_QUOTES)
def lint_straight_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight quotes never close, so each one is unmatched."""
    found = lint.issues(table(spark, sf_dir, "documents"), {"unmatched_pairs": {}}).where(F.col("excerpt").isin('"', "'"))
    return found.groupBy("doc_id", F.col("excerpt").alias("mark")).agg(F.count(F.lit(1)).alias("n"))


#: The stack as a recursion over the marks of each text.
_STACK = r"""m as (select doc_id, text, list_filter(list_transform(range(1, length(text) + 1), lambda i: {'p': i, 'c': text[i]}), lambda x: contains('()（）[]【】《》“”"' || chr(39), x.c)) as marks
  from documents where regexp_matches(text, '[()（）\[\]【】《》“”"'']')),
r as (select doc_id, marks, 1 as i, []::struct(p bigint, c varchar)[] as stack, []::struct(p bigint, c varchar)[] as extra from m
  union all select doc_id, marks, i + 1,
    case when contains('(（[【《“"' || chr(39), marks[i].c) then list_append(stack, marks[i]) when fits then stack[:len(stack) - 1] else stack end,
    case when contains('(（[【《“"' || chr(39), marks[i].c) or fits then extra else list_append(extra, marks[i]) end
  from (select *, coalesce(stack[len(stack)].c || marks[i].c in ('()', '（）', '[]', '【】', '《》', '“”'), false) as fits from r where i <= len(marks))),
e as (select doc_id, unnest(extra) as x, '多余的闭合标点“' as a, '”' as b from r where i = len(marks) + 1 union all select doc_id, unnest(stack), '标点“', '”未成对' from r where i = len(marks) + 1)
select e.doc_id, 'NORM-002' as rule_id, 'high' as severity, (length(h) - length(replace(h, chr(10), '')) + 1)::bigint as line, (length(regexp_replace(h, '^(.|\n)*\n', '')) + 1)::bigint as "column", x.c as excerpt, a || x.c || b as message
from (select e.*, substr(m.text, 1, x.p - 1) as h from e join m on m.doc_id = e.doc_id) e"""


@query(f"with recursive {_STACK}")
def lint_unmatched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lint.issues(table(spark, sf_dir, "documents"), {"unmatched_pairs": {}})
    return found.select("doc_id", "rule_id", "severity", "line", "column", "excerpt", "message")


@query(rf"with {_LINES}, f as (select doc_id, min(line) filter (trim(t) = 'All rights reserved.') as a, min(line) filter (trim(t) = 'Released under the MIT License.') as b from l group by 1) select doc_id, case when a is null then 'All rights reserved.' end as first_missing, case when b is null then 'Released under the MIT License.' end as second_missing, coalesce(b < a, false) as wrong_order from f")
def lint_section_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule with headings that these texts have."""
    names = _LICENCES
    docs = table(spark, sf_dir, "documents")
    found = lint.issues(docs, {"section_order": {"sections": names}})
    lack = lambda s: F.max(F.when((F.col("excerpt") == s) & F.col("message").startswith("缺少"), F.col("excerpt")))
    per = found.groupBy("doc_id").agg(lack(names[0]).alias("first_missing"), lack(names[1]).alias("second_missing"), F.bool_or(F.col("message").endswith("顺序错误")).alias("wrong_order"))
    return docs.select("doc_id").join(per, "doc_id", "left").withColumn("wrong_order", F.coalesce("wrong_order", F.lit(False)))


@query()
def lint_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.analyze(table(spark, sf_dir, "documents"))


def _runs(marks: str, least: int) -> str:
    return "|".join(("\\" + c if c in "?.-" else c) + f"{{{least},}}" for c in marks)


_STACKED = _STACK.replace("r as (", "sr as (").replace("from r where", "from sr where").split("select e.doc_id, 'NORM-002'")[0].strip()
#: Every rule's issues as one number per line or text; these texts have no reference heading, so that rule adds none.
_SEVERITIES = rf"""with recursive {_TWICE}, {_STACKED},
d as (select doc_id from documents where length(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13))) > 0),
s as (select doc_id, 5 - (bool_or(trim(t) = '摘要')::int + bool_or(trim(t) = '关键词')::int + bool_or(trim(t) = '引言')::int + bool_or(trim(t) = '结论')::int + bool_or(trim(t) = '参考文献')::int) as high,
  sum(len(regexp_extract_all(t, '{_runs("，。；", 2)}')) + len(regexp_extract_all(t, '{_runs(lint.RUN_CLASS[1:-1], 3)}')) + contains(t, chr(9))::int + regexp_matches(t, '[ ' || chr(9) || ']$')::int
    + len(regexp_extract_all(t, '{"|".join(lint.BANNED_WORDS)}'))
    + len(list_filter(regexp_extract_all(t, '[^。！？!?]+[。！？!?]?'), lambda x: length(trim(x)) > 120)) + (length(trim(t)) > 120 and not regexp_matches(trim(t), '[。！？!?]$'))::int) as medium,
  sum(len(list_filter(regexp_extract_all(' ' || t || ' ', '[^0-9][0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}[^0-9]'), lambda x: not regexp_full_match(x[2:len(x) - 1], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')))) as low
  from l group by 1),
n as (select doc_id, count(*) as k from e group by 1), w as (select doc_id, count(*) as k from twice group by 1),
a as (select s.doc_id, s.high + coalesce(n.k, 0) as high, s.medium + coalesce(w.k, 0) as medium, s.low from s join d on d.doc_id = s.doc_id left join n on n.doc_id = s.doc_id left join w on w.doc_id = s.doc_id)
select doc_id, high::bigint as high, medium::bigint as medium, low::bigint as low, (high + medium + low)::bigint as total from a"""


@query(_SEVERITIES)
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.severity_counts(lint.analyze(table(spark, sf_dir, "documents")))


_CHECKLIST = rf"""with {_LINES}, g as (select doc_id, 2 - (bool_or(trim(t) = '{_LICENCES[0]}')::int + bool_or(trim(t) = '{_LICENCES[1]}')::int) as missing, sum(len(list_filter(regexp_extract_all(t, '[^。！？!?]+[。！？!?]?'), lambda x: length(trim(x)) > 120)) + (length(trim(t)) > 120 and not regexp_matches(trim(t), '[。！？!?]$'))::int) as n from l group by 1),
c as (select doc_id, missing::int as missing, 0 as reference_count, case when missing = 0 then 30 else 0 end as section_completeness, 20 as methodology_section, case when n = 0 then 10 else 0 end as normative_detection_result from g)
select *, section_completeness + normative_detection_result + 60 as total_score, case when missing = 0 then '基础检查通过' else '需修改' end as result_label from c"""


@query(_CHECKLIST)
def checklist_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checklist with a template whose sections these texts have, and their long sentences as issues."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("own").alias("template_id"), "text")
    kinds = spark.createDataFrame([("own", _LICENCES, 0)], "template_id string, required_sections array<string>, minimum_reference_count int")
    rows = rubric.checklist(docs, {"long_sentences": {}}, kinds)
    return rows.select("doc_id", F.size("missing_sections").alias("missing"), "reference_count", "section_completeness", "methodology_section", "normative_detection_result", "total_score", "result_label")


_KINDS = list(rubric.TEMPLATES)
_REQUIRED = ", ".join("[" + ", ".join(f"'{s}'" for s in rubric.TEMPLATES[k][0]) + "]" for k in _KINDS)
#: What the checklist must find in texts whose sections and references are known: (doc_id >> i) & 1 says if section i is there.
_BY_TEMPLATE = rf"""with {_LINES}, g as (select doc_id, sum(len(list_filter(regexp_extract_all(t, '[^。！？!?]+[。！？!?]?'), lambda x: length(trim(x)) > 120)) + (length(trim(t)) > 120 and not regexp_matches(trim(t), '[。！？!?]$'))::int) as n from l group by 1),
k as (select doc_id, n, [{", ".join(f"'{k}'" for k in _KINDS)}][doc_id % 5 + 1] as template_id, [{_REQUIRED}][doc_id % 5 + 1] as secs, [{", ".join(str(rubric.TEMPLATES[k][1]) for k in _KINDS)}][doc_id % 5 + 1] as least from g),
m as (select *, [secs[i] for i in range(1, len(secs) + 1) if not (doc_id % 3 = 0 or (doc_id >> (i - 1)) & 1 = 1)] as missing from k),
r as (select *, case when list_contains(missing, '参考文献') then 0 else doc_id * 7 % 120 end as refs from m),
p as (select *, case when len(missing) = 0 then 30 else 0 end as a, case when refs >= least then 20 else 0 end as b, case when list_contains(missing, '研究方法') then 0 else 20 end as c, case when list_contains(missing, '结论') then 0 else 20 end as d, case when n = 0 then 10 else 0 end as e from r)
select doc_id, template_id, array_to_string(missing, ',') as missing, refs::int as reference_count, a as section_completeness, b as reference_count_and_numbering, c as methodology_section, d as conclusion_section, e as normative_detection_result, a + b + c + d + e as total_score,
  case when a + b + c + d + e >= 80 and len(missing) = 0 then '基础检查通过' else '需修改' end as result_label, '参考文献条目：' || refs::bigint || '/' || least as reference_finding, least(n, 5)::int as n_messages from p"""


@query(_BY_TEMPLATE)
def checklist_by_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five templates over texts that some of their sections and up to 119 references are added to."""
    of = F.expr("cast(doc_id % 5 as int) + 1")
    docs = table(spark, sf_dir, "documents").withColumn("template_id", F.element_at(F.array(*map(F.lit, _KINDS)), of))
    docs = docs.withColumn("s", F.element_at(F.array(*[F.array(*map(F.lit, rubric.TEMPLATES[k][0])) for k in _KINDS]), of))
    there = "doc_id % 3 = 0 or (shiftright(doc_id, i) & 1) = 1"
    name = "if(i % 2 = 1 and doc_id % 2 = 1 and i < size(s) - 1, concat(x, '：', doc_id), x)"
    entries = "transform(if(doc_id * 7 % 120 > 0, sequence(1L, doc_id * 7 % 120), array()), k -> concat('[', k, '] entry'))"
    text = F.expr(f"array_join(concat(array(text, '[1] before the heading'), filter(transform(s, (x, i) -> if({there}, {name}, null)), x -> x is not null), {entries}), '\n')")
    rows = rubric.checklist(docs.select("doc_id", "template_id", text.alias("text")), {"long_sentences": {}})
    finding = lambda i: F.get("score_items", F.lit(i))["findings"]
    return rows.select("doc_id", "template_id", F.array_join("missing_sections", ",").alias("missing"), "reference_count", *rubric.POINTS, "total_score", "result_label", F.get(finding(1), F.lit(0)).alias("reference_finding"), F.size(finding(4)).alias("n_messages"))


def _layout_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lint.lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", (F.expr("(line - 1) div 40") + 1).alias("page_number"), "line", "text").selectExpr("doc_id", "page_number", "line reading_order", "0.0d x1", "cast((line - 1) % 40 * 20 as double) y1", "cast((line - 1) % 40 * 20 + 15 as double) y2", "800.0d height", "text")


@query()
def layout_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.lint(_layout_rows(spark, sf_dir))


@query(rf"with {_LINES}, c as (select doc_id, lower(regexp_replace(t, '[\s\p{{Z}}]+', '', 'g')) as k from l), m as (select doc_id, unnest([case when not bool_or(starts_with(k, '摘要') or starts_with(k, 'abstract')) then '摘要' end, case when not bool_or(starts_with(k, '目录') or starts_with(k, 'contents')) then '目录' end]) as missing from c where k <> '' group by 1) select doc_id, missing from m where missing is not null")
def layout_required_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.lint(_layout_rows(spark, sf_dir), ["required_section_completeness_check"])
    return found.select("doc_id", F.regexp_extract("message", "“(摘要|目录)”", 1).alias("missing")).where("missing <> ''")


@query(r"select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]{2,}', ' ', 'g'), '!{2,}', '!', 'g'), '\?{2,}', '?', 'g'), ',{2,}', ',', 'g'), ';{2,}', ';', 'g'), '。{2,}', '。', 'g'), '！{2,}', '！', 'g'), '，{2,}', '，', 'g') as polished from documents")
def rewrite_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """These texts have no Han characters and no blanks at line ends, so the SQL leaves those two passes out."""
    return rewrite.basic(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "polished")


@query()
def layout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.summary(layout.runs(_layout_rows(spark, sf_dir)))


@query()
def rewrite_enhanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rewrite.polish(table(spark, sf_dir, "documents").select("doc_id", "text"), "enhanced", [("MIT License", "MIT licence")])
    return rows.select("doc_id", "polished", F.size("changes").alias("n_changes"))


@query()
def rewrite_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rewrite.polish_local(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "standard")
    return rows.select("conv_id", "turn", "polished", F.size("changes").alias("n_changes"), F.size("segments").alias("n_segments"))
