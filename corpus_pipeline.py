"""A corpus pipeline of five of the operators of ``ledgerloom.llm``: documents in, packed sequences of ids out."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import language_id, packing, quality_rules, secret_scans, simhash
from ledgerloom.llm.common import checkpoint_dir, cut, read
from ledgerloom.llm.queries import tokenizer_file

#: The language stage rejects documents without a letter and those whose best language has less than this share of the words.
LEAST_SHARE = 0.3


#: Keys of rows up to which they are sent to all tasks, so that texts needn't be shuffled to them.
BROADCAST_IDS = 2_000_000


def _row() -> Column:
    """What tells rows apart: the doc_id, those that are null last, and the text. Rows equal in both are copies."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text"))


def _among(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows (with ``_row``) that are (left_semi) or aren't (left_anti) among the distinct ``keys`` (``_row``)."""
    keys = cut(keys.select("_row"))
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys
    return rows.join(keys, "_row", how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs, read(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language, with ``lang`` as predicted."""
    return language_id.keep(docs, language_id.learn(docs), LEAST_SHARE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id (null ids last; then by a hash of the text).

    Groups go by text alone: of distinct texts that share a doc_id or have none, each group keeps one.
    """
    rows = docs.withColumn("_row", _row())
    groups = cut(simhash.near_duplicates(rows, key="_row").select("_row", (F.col("_row") == F.col("component_id")).alias("stays")))
    # Equal texts have equal fingerprints, so a key is in one group.
    keys = cut(groups.groupBy("_row").agg(F.max("stays").alias("stays"), F.count("*").alias("n")))
    kept = _among(rows, keys.filter("not stays"), "left_anti")
    often = keys.filter("stays and n > 1")
    if not often.isEmpty():
        kept = _among(kept, often, "left_anti").unionByName(_among(kept, often, "left_semi").dropDuplicates(["_row"]))
    return kept.drop("_row")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return secret_scans.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece of a packed sequence."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("language ID", language),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secrets),
    ("best-fit packing", pack),
]

#: SQL can't express the forest, the random field or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder as Parquet and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
