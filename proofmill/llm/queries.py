"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm import collocations, conversations, decontam, embedding_dedup, html_text, line_dedup, near_dup, packing, quality_model, rules, secrets, substring_dedup, token_count


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = rules.decide(rules.evaluate(_table(spark, sf_dir, "documents")))
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(_table(spark, sf_dir, "conversations"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_packing": op5_packing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_token_counts": op7_token_counts,
    "op8_html_text": op8_html_text,
    "op9_quality_rules": op9_quality_rules,
    "op10_line_dedup": op10_line_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_phrase_collocations": op13_phrase_collocations,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP9 = rf"""
with d as (
  select doc_id, coalesce(text, '') as t, {_WORDS} as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents),
win as (
  select doc_id, i, w[i] as a, w[i + 1] as b, w[i + 2] as c
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
rep as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as k from win) where k > 1),
cov as (
  select doc_id, count(distinct i + o) as n from rep, (values (0), (1), (2)) x(o) group by doc_id),
m as (
  select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words,
    len(l) as n_lines, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) as n_upper, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) as n_letters
  from d left join cov on cov.doc_id = d.doc_id),
b as (
  select *, (case when n_words < 50 then 1 else 0 end) + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
    + (case when n_symbols > 0.3 * n_words then 4 else 0 end) + (case when 10 * n_dup_lines > 5 * n_lines then 8 else 0 end)
    + (case when word_chars < 2 * n_words or word_chars > 15 * n_words then 16 else 0 end)
    + (case when n_upper > 0.5 * n_letters and n_letters > 0 then 32 else 0 end) + (case when n_letters < 0.4 * word_chars then 64 else 0 end) as bits
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & 3 <> 0 as base_failed, bits = 0 as kept, bits::bigint as fail_bits from b
"""

_OP2 = rf"""
with recursive d as (select doc_id, list_transform({_WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as w from documents),
s as (
  select distinct doc_id, array_to_string(w[i:least(i + 3, len(w))], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w) + 1, 2)))) as i from d)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (
  select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (
  select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= 80 * (a.n + b.n - k)),
r as (
  select doc_id, doc_id as c from documents union select r.doc_id, e.y from r join e on e.x = r.c)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.c as component_id, d.doc_id = c.c as kept
from documents d left join n on n.doc_id = d.doc_id join (select doc_id, min(c) as c from r group by doc_id) c on c.doc_id = d.doc_id
"""

_OP10 = r"""
with l as (
  select doc_id, unnest(range(1, len(s) + 1)) as pos, unnest(s) as line, len(s) as n
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as s from documents)),
k as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
c as (
  select key, max(doc_id) as owner from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
j as (
  select k.*, c.owner is not null and c.owner <> k.doc_id as dropped from k left join c on c.key = k.key)
select doc_id, any_value(n)::bigint as n_lines, count(*) filter (dropped) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
from j group by doc_id
"""

_OP12 = """
with recursive e as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
n as (
  select vec_id, label, v, sqrt(list_inner_product(v, v)) as norm from e),
p as (
  select a.vec_id as x, b.vec_id as y from n a join n b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id
  where a.norm > 0 and b.norm > 0 and list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
r as (
  select vec_id, vec_id as c from embeddings union select r.vec_id, p.y from r join p on p.x = r.c),
k as (
  select x, count(*) as n_links from p group by x)
select e.vec_id, coalesce(k.n_links, 0)::bigint as n_links, c.c::bigint as component_id, e.vec_id = c.c as kept
from embeddings e left join k on k.x = e.vec_id join (select vec_id, min(c) as c from r group by vec_id) c on c.vec_id = e.vec_id
"""

ORACLES: dict[str, str] = {"op10_line_dedup": _OP10, "op12_embedding_near_dedup": _OP12, "op2_minhash_near_dedup": _OP2, "op9_quality_rules": _OP9}
