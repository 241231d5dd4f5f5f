"""Corpus pipeline: quality rules, language identification, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return the columns of
documents (doc_id, text, lang, source, n_chars; other columns of the input are left out). Rows are told apart by a hash of all
these columns (``rid``), so null and repeated doc_ids are no trouble; rows equal in all of them count as one row given
more than once: quality and language keep or drop them alike, and near-duplicates keeps one. Null and empty texts go at the quality
stage; given to a later one, they are of no language there, are near no other, have no passages, and are packed as the end id alone.
Very long texts are handled whole. Ties go to the smaller doc_id. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.langid import UNKNOWN, identify
from quire.llm.neardup import near_duplicates
from quire.llm.packing import pack, tokenizer_path
from quire.llm.quality import score_quality
from quire.llm.substring import without_repeats
from quire.llm.tables import written

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
#: A document is kept if its words are of one language by this mean probability.
SURE = 0.5


def documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, and rid."""
    docs = docs.select(*(F.col(c).cast(t).alias(c) for c, t in COLUMNS.items()))
    return docs.withColumn("rid", F.xxhash64(*COLUMNS, *(F.col(c).isNull() for c in COLUMNS)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    docs = documents(docs)
    kept = score_quality(docs, key="rid").where("kept").select(F.col("doc_id").alias("rid"))
    return docs.join(kept, "rid", "left_semi").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of one identified language; a null lang is filled with it."""
    docs = documents(docs)
    found = identify(docs, tag="rid").where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= SURE))
    found = found.groupBy("rid").agg(F.min("lang_pred").alias("lang_pred"))
    return docs.join(found, "rid").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that of the smallest doc_id (rows without one last)."""
    docs = documents(docs)
    found = near_duplicates(docs, key="rid").select(F.col("doc_id").alias("rid"), F.col("component_id").alias("component")).distinct()
    named = docs.select("rid", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("order")).distinct()
    first = named.join(found, "rid").groupBy("component").agg(F.min(F.struct("order", "rid")).alias("first")).select(F.col("first.rid").alias("rid"))
    return docs.join(first, "rid", "left_semi").dropDuplicates(["rid"]).select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 20 words or more that stand earlier in the corpus; n_chars follows the text."""
    docs = documents(docs)
    left = without_repeats(docs, carry=("lang", "source", "n_chars"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("rest.n_chars")).cast("long")
    return left.select("doc_id", "text", "rest.lang", "rest.source", n_chars.alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids in sequences of at most 2048: a row a piece, with the ids themselves."""
    return pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("language", language), ("near_duplicate", near_duplicate), ("passages", passages), ("packing", packing)]
#: Trained models decide in two stages, so SQL can't say which rows stay.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
