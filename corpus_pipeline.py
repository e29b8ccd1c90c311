"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame. What a stage needs in between is deleted before it returns;
its frame rests on small tables that live as long as the caller's ``common.staging`` scope, or else as the application.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm import common, decontam, line_dedup, near_dup, packing, rules

#: SQL has neither sequence of approximate stages nor a tokenizer; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' policy keeps. Null, empty and blank texts have too few words and go; each row is judged
    by its own text, whatever its id."""
    return rules.keep_good(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that other documents keep; n_chars follows. All rows stay: a null text becomes an empty
    one, rows that repeat an id are one document, and those without an id keep all their lines."""
    done = line_dedup.dedup_lines(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near-duplicates. Rows that repeat its id all stay, as do rows without an id
    and rows without words, which are in no group."""
    verdict = near_dup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(verdict, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; each row is judged by its own text. Without items all stay."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens. Null and empty texts are one token, and every row is packed for itself."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", repeated_lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again by the next."""

    def through(k: int) -> DataFrame:
        """What the first k stages return; what stage k has read is deleted once its own result is written."""
        if not k:
            return spark.read.parquet(f"{sf_dir}/documents.parquet")
        with common.staging(spark):
            name, stage = STAGES[k - 1]
            return common.stage(stage(spark, through(k - 1), sf_dir), name, keep=True)

    return through(len(STAGES))
