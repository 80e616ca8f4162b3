"""A training-data pipeline of five stages over the table ``documents``.

Each stage takes the documents its predecessor kept and returns the columns of ``documents``; the last returns encoded texts.
Stages are written as Parquet and read again in between.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscore.llm import decontamination, near_dup, pieces, quality, ragged, suffix_dedup
from gridscore.llm.components import stored

#: Repeated passages are cut from this many bytes on: fifty short words.
REPEATED_BYTES = 200
NEAR = near_dup.Settings(percent=80)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy accepts, as they are."""
    into = ragged.spare_name(docs.columns, "_ledger")
    rows = quality.ledger(docs, carry=docs.columns, into=into)
    return rows.where(quality.passes(F.col(f"{into}.failures"))).drop(into)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, as it is. Documents without words stay."""
    found = stored(near_dup.near_duplicates(docs, settings=NEAR), "groups")
    kept = found.where("kept").groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n"))
    kept = stored(kept, "kept")
    same = docs["doc_id"].eqNullSafe(F.col("_id"))
    if kept.where("_n > 1").isEmpty():
        return docs.join(kept, same, "left_semi")
    # Ids that repeat: rows that also repeat the text are one document.
    once = docs.join(kept.where("_n = 1"), same, "left_semi")
    return once.union(docs.join(kept.where("_n > 1"), same, "left_semi").dropDuplicates(["doc_id", "text"]))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that repeat anywhere; characters are never cut in half. ``n_chars`` follows."""
    _, texts = suffix_dedup.repeated_spans(docs, length=REPEATED_BYTES)
    key, kept, spans = (ragged.spare_name(docs.columns, name) for name in ("_key", "_kept", "_spans"))
    content = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn(key, F.unhex(F.substring(F.sha2(content, 256), 1, 32)))
    rows = rows.join(texts.select(F.col("text_key").alias(f"{key}2"), F.col("spans").alias(spans)), F.col(key) == F.col(f"{key}2"), "left").drop(key, f"{key}2")
    changed = ragged.annotate(
        rows.where(F.col(spans).isNotNull()), "text", suffix_dedup.KEPT, lambda t, s: suffix_dedup.compute_kept(t, s, whole_characters=True), docs.columns, kept, [spans],
    )
    changed = changed.withColumn("text", F.col(f"{kept}.kept").cast("string")).drop(kept)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.where(F.col(spans).isNull()).select(docs.columns).union(changed.select(docs.columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs, as they are."""
    into = ragged.spare_name(docs.columns, "_found")
    rows = decontamination.find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=docs.columns, into=into)
    return rows.where(F.col(f"{into}.n_hit") == 0).drop(into)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, the piece ids of the text and their number."""
    rows = pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", F.size("encoded.ids").cast("bigint").alias("n_pieces"), "encoded.n_byte_pieces", "encoded.ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_encoding", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded texts of ``documents`` after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
