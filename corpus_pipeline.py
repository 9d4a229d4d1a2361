"""A corpus pipeline of five stages over documents; each works on all that the stage before it kept.

Every stage but the last returns the columns of documents. Quality and decontamination judge rows by id
and text, line_dedup takes rows with the same id and text for one document. Near-duplicates (five words to
a shingle, similarity 0.8) go by doc_id, where what befalls one of several rows with the same id befalls
all; rows without an id are never near-duplicates of others and stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidejoin.llm.bpe import bpe_round_trip
from tidejoin.llm.decontaminate import contamination
from tidejoin.llm.lines import dedup_lines
from tidejoin.llm.minhash import near_duplicates
from tidejoin.llm.quality import quality_verdicts
from tidejoin.llm.queries import byte_bpe_path, table
from tidejoin.llm.staging import few, scratch, staged


#: Ids of rejected rows (with a hash each) up to which they are broadcast, so that no text is shuffled; Spark shuffles both sides beyond.
BROADCAST_ROWS = 1_000_000


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs without the ids in rejected."""
    gone = few(staged(rejected.select(F.col("doc_id").alias("__gone")).distinct(), "rejected"), BROADCAST_ROWS)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone"]), "left_anti")


def without_rows(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs without the rows whose id and text (by its hash, mark) are in rejected."""
    gone = few(staged(rejected.select(F.col("doc_id").alias("__gone"), F.col("mark").alias("__mark")).distinct(), "rejected"), BROADCAST_ROWS)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone"]) & (F.xxhash64(docs["text"].cast("string")) == gone["__mark"]), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the isolation forest rejects go."""
    return without_rows(docs, quality_verdicts(docs, table(spark, sf_dir, "labels")).where("NOT kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines seen before, or within two edits (one for five characters) of one seen before, go; documents left without a word go."""
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the least id."""
    return without(docs, near_duplicates(docs).where("NOT kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return without_rows(docs, contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids and digests of ids and decoded text of what is left."""
    return bpe_round_trip(docs, byte_bpe_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]
#: The forest and the vocabulary are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet before the next; what a stage has staged on its way is removed after it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch():
            docs = staged(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
