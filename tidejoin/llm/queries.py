"""Queries of the numbered operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidejoin.llm.attention import language_scores
from tidejoin.llm.bpe import bpe_round_trip
from tidejoin.llm import decontaminate, fixity, lines, manifest, negatives, pivots, toxicity
from tidejoin.llm.minhash import near_duplicates
from tidejoin.llm.pii import personal_data
from tidejoin.llm.quality import COUNTS, quality_verdicts
from tidejoin.llm.suffixes import repeated_passages

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.audit_pages(table(spark, sf_dir, "pages"))


def op5_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = toxicity.held_out(F.col("doc_id"), 5, 0)
    model = toxicity.fit(docs.where(~held), table(spark, sf_dir, "labels").where(~held))
    found = toxicity.toxicity(docs, model)
    return found.select("doc_id", held.alias("held_out"), "score", "predicted", F.size("starts").alias("n_passages"))


def op6_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), byte_bpe_path())


def op7_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", F.transform("scores", lambda x: F.round(x, 2)).alias("scores"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_classes(table(spark, sf_dir, "documents"))


def op2_line_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_members(table(spark, sf_dir, "documents"))


def op8_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_scores(table(spark, sf_dir, "documents"), "NOT coalesce(crc32(cast(cast(doc_id AS string) AS binary)) % 7 = 2, false)")
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return negatives.hard_negatives(rows, F.col("id") % 100 == 0, positives=5, negatives=10, low=30, high=90)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.document_manifest(table(spark, sf_dir, "documents")).drop("steps")


QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op2_line_members": op2_line_members,
    "op3_minhash": op3_minhash,
    "op4_warc_fixity": op4_warc_fixity,
    "op5_toxic_segments": op5_toxic_segments,
    "op6_bpe_tree": op6_bpe_tree,
    "op7_quality_forest": op7_quality_forest,
    "op8_attention_scores": op8_attention_scores,
    "op9_decontaminate": op9_decontaminate,
    "op10_personal_data": op10_personal_data,
    "op11_pivot_topk": op11_pivot_topk,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": lines.SQL,
    "op2_line_members": lines.MEMBERS_SQL,
    "op4_warc_fixity": fixity.SQL,
    "op9_decontaminate": decontaminate.SQL,
    "op11_pivot_topk": pivots.SQL,
    "op12_hard_negatives": negatives.SQL,
    "op13_merkle_manifest": manifest.SQL,
}
