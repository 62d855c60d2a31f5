"""A corpus pipeline of five stages: language, near duplicates, repeated passages, leaks, packing.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame,
which ``run`` writes as Parquet to the shared folder and reads again for the next one.

Defined cases: an empty table goes through all stages as an empty table; a null text is no
language and goes at the first stage; rows repeated whole are near duplicates of one another, and one
stays; rows that share a doc_id, or have none, are judged each by its own text, and passages are not cut
out of them, for doc_id names the text to cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import chaining, containment, langid, ngram_join, packing
from factweave.llm.queries import tokenizer_files
from factweave.llm.shared import small, stash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without any language; profiles are learned from the rows that name theirs."""
    docs = docs.select(*COLUMNS)
    found = langid.identify(docs, langid.learn(docs), keep_text=True)
    return found.where(langid.accepted(F.col("score"), F.col("lang_pred"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component: the one with the smallest doc_id, and of rows that repeat it whole, one.

    Rows are told apart by all their columns, not by doc_id alone, so rows that share a doc_id, or have none, are
    judged each by its own text.
    """
    docs = docs.select(*COLUMNS)
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(*COLUMNS).alias("row"))
    found = stash(ngram_join.join_components(docs.select(name.alias("doc_id"), "text")).where("n_shingles > 0"), "components")
    same = (F.col("doc_id").eqNullSafe(F.col("_id"))) & (F.xxhash64(*COLUMNS) == F.col("_row"))
    pair = lambda df: df.select(F.col("doc_id.id").alias("_id"), F.col("doc_id.row").alias("_row"))
    gone = stash(pair(found.where("doc_id != component_id")).distinct(), "gone")
    # Few names are broadcast, so that the texts stay where they are; many are joined by a shuffle.
    kept = docs.join(small(gone, gone.count()), same, "left_anti")
    twice = stash(pair(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")), "twice")
    n = twice.count()
    if not n:
        return kept
    return kept.join(small(twice, n), same, "left_anti").unionByName(kept.join(small(twice, n), same, "left_semi").dropDuplicates())


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of fifty words or more that an earlier document has; texts left blank go."""
    docs = docs.select(*COLUMNS)
    cut = chaining.without_passages(docs, stash(chaining.passages(docs), "passages"))
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    docs = docs.select(*COLUMNS)
    leaks = containment.hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return containment.without_leaks(docs, leaks).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document left, with their places in sequences."""
    return packing.pack_documents(docs, *tokenizer_files())


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Profiles, chaining and tokens can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
