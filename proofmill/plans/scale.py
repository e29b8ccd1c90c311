"""Queries of the forms that hold for groups larger than a task: ranged scans, sweeps and rolled-up counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.operators import ledger, paging, postings, ranged, rollup
from proofmill.plans import inputs, records
from proofmill.plans.inputs import sql, table
from proofmill.sources.session import checkpointed, new_folder

QUERIES, ORACLES = {}, {}


def query(oracle: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


#: All lines in one group, in the order of their orders.
_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


@query(
    f"with l as (select l_orderkey, l_linenumber, l_orderkey + l_partkey % 50 as num, row_number() over (order by {', '.join(_ORDER)}) as j, {', '.join(_ORDER[2:])} from lineitem), "
    "e as (select *, j + greatest(0, coalesce(max(num - j) over (order by j rows between unbounded preceding and 1 preceding), 0)) as expected from l) select l_orderkey, l_linenumber, num, expected::bigint as expected from e"
)
def sequence_of_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.lit("all").alias("k"), *_ORDER, F.expr("l_orderkey + l_partkey % 50").alias("num"))
    return ranged.with_expected(rows, ["k"], "num", _ORDER).select("l_orderkey", "l_linenumber", "num", "expected")


@query(
    f"with l as (select l_orderkey, l_linenumber, case when l_partkey % 5 > 0 then l_orderkey % 1000 end as num, row_number() over (order by {', '.join(_ORDER)}) as j from lineitem), "
    "e as (select *, j + coalesce(last_value(num - j ignore nulls) over (order by j rows between unbounded preceding and 1 preceding), 0) as expected from l) select l_orderkey, l_linenumber, num, expected::bigint as expected from e"
)
def next_number_of_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.lit("all").alias("k"), *_ORDER, F.expr("case when l_partkey % 5 > 0 then l_orderkey % 1000 end").alias("num"))
    return ranged.with_next_number(rows, ["k"], "num", _ORDER).select("l_orderkey", "l_linenumber", "num", "expected")


@query(
    'with i as (select l_orderkey * 20 + l_linenumber as "start", l_orderkey * 20 + l_linenumber + l_quantity::bigint as "end" from lineitem), c as (select *, case when "start" > max("end") over (order by "start", "end" rows between unbounded preceding and 1 preceding) then 1 else 0 end as new from i where "end" > "start"), '
    's as (select *, sum(new) over (order by "start", "end" rows unbounded preceding) as n from c) select \'all\' as k, min("start") as "start", max("end") as "end" from s group by n'
)
def merged_spans_of_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("'all' k", "l_orderkey * 20 + l_linenumber start", "l_orderkey * 20 + l_linenumber + cast(l_quantity as long) end")
    return ranged.merged_spans(rows, ["k"])


@query(
    sql(
        "facts",
        ", d as (select *, created_at::date as day from facts) select 'all' as kind, '' as name, count(*) record_count, count(distinct subject_id) subject_count from d "
        "union all select 'type', detection_type, count(*), count(distinct subject_id) from d group by detection_type union all select 'day', day::varchar, count(*), count(distinct subject_id) from d group by day "
        "union all select 'month', strftime(day, '%Y-%m'), count(*), count(distinct subject_id) from d group by 2",
    )
)
def ledger_rolled_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counts of distinct subjects from one stored rollup."""
    facts = inputs.facts(spark, sf_dir)
    stored = checkpointed(rollup.rollup(facts, checkpointed(rollup.subject_numbers(facts))))
    months = stored.withColumn("day", F.date_format("day", "yyyy-MM"))
    parts = [("all", stored, None), ("type", stored, "detection_type"), ("day", stored, "day"), ("month", months, "day")]
    out = [rollup.counts(s, [by] if by else []).select(F.lit(kind).alias("kind"), (F.col(by).cast("string") if by else F.lit("")).alias("name"), "record_count", "subject_count") for kind, s, by in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


#: Keywords of all kinds: a rare one, wild cards, some that are shorter than a trigram, other scripts, and one that nothing has.
_KEYWORDS = ["user1", "F12", "s_s 3%1", "9", "R4", "is%", "é", "论", "no such"]
_PEOPLE_COLUMNS = ["subject_id", "student_name", "thesis_title", "source_filename"]
_ANY = " or ".join(f"coalesce({c} ilike '%' || k || '%', false)" for c in _PEOPLE_COLUMNS)


@query(sql(records._SOURCES, f", {records._UNITED} select k as keyword, id, latest_rank from people, (values {', '.join(f'({k!r})' for k in _KEYWORDS)}) w(k) where {_ANY}"))
def ledger_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger indexed once and searched for several keywords."""
    rows = ledger.with_people(records._united(spark, sf_dir), inputs.users(spark, sf_dir)).select("id", "latest_rank", *_PEOPLE_COLUMNS)
    index = postings.Index.build(rows, _PEOPLE_COLUMNS, ["subject_id", "id"], new_folder(spark, "postings"))
    return reduce(DataFrame.unionAll, [index.search(k).select(F.lit(k).alias("keyword"), "id", "latest_rank") for k in _KEYWORDS])


_BY_PRICE = ["l_extendedprice desc", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


@query(
    f"with l as (select *, row_number() over (order by {', '.join(_BY_PRICE)}) - 1 as i, (count(*) over () + 7) // 8 as last from lineitem) "
    "select i // 8 + 1 as page, l_orderkey, l_linenumber, l_extendedprice from l where i // 8 + 1 in (1, greatest(last // 2, 1), last)"
)
def pages_of_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page, the one in the middle and the last, of eight lines each, the dearest first."""
    order = [F.desc("l_extendedprice"), *[F.asc(c) for c in _BY_PRICE[1:]]]
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity")
    pages = paging.Pages.store(rows, order, new_folder(spark, "pages"))
    wanted = sorted({1, max(pages.last() // 2, 1), max(pages.last(), 1)})
    return reduce(DataFrame.unionAll, [pages.page(n).select(F.lit(n).cast("long").alias("page"), "l_orderkey", "l_linenumber", "l_extendedprice") for n in wanted])
