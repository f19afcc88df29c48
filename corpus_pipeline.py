"""Corpus pipeline: quality rules, near-duplicates, personal data, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; each but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import mixing, neardup, packing, pii, quality
from veilspark.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the trees keep."""
    docs = docs.select(*COLUMNS)
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels"))).filter("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8. Rows without a doc_id and rows without words stay;
    rows that repeat a doc_id are told apart by their text, and of rows equal in both one stays."""
    docs = docs.select(*COLUMNS)
    found = materialize(neardup.near_duplicates(docs, size=5), "near")
    key = ["doc_id", "text_hash"]
    known = docs.withColumn("text_hash", F.xxhash64("text")).join(found.filter("not stays").select(*key), key, "left_anti")
    equal = found.filter("stays and n_shingles > 0 and doc_id is not null").groupBy(*key).count().filter("count > 1").select(*key)
    return known.join(equal, key, "left_anti").union(known.join(equal, key, "left_semi").dropDuplicates(key)).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data replaced by their kind; n_chars follows the new text."""
    clean = pii.redact(pii.detect(docs.select(*COLUMNS))).drop("pii")
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose source, language and topic shares are tempered, nine tenths of the tokens at most."""
    return mixing.mix(docs.select(*COLUMNS)).filter("sampled").select(*COLUMNS)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2,048 words."""
    return packing.pack(docs.select(*COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("personal data", personal_data),
    ("source mixing", source_mixing),
    ("packing", best_fit),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i}")
    return docs
