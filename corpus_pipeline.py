"""Corpus pipeline: from raw documents to token ids, in stages that are each written and read again.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.llm import byte_bpe, compression_quality
from recordmill.llm.common import materialize, prepare, without
from recordmill.llm.decontaminate import contained_items
from recordmill.llm.jaccard_join import jaccard_groups
from recordmill.llm.line_dedup import dedup_lines


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose compression score is at least one half; null and empty texts score as empty text."""
    prepare(spark)
    model = compression_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(compression_quality.score(model, docs) >= 0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines, ``n_chars`` counted anew.

    Documents of which no text is left go; those that had none before stay.
    """
    prepare(spark)
    rows = dedup_lines(docs)
    gone = (F.col("lines_removed") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    rows = rows.where(~F.coalesce(gone, F.lit(False)))
    size = F.when(F.col("lines_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return rows.withColumn("n_chars", size).select(docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates (five-word shingles, similarity 0.8 or more): the smallest id.

    Rows with a null id stay; of rows that repeat an id of a group's smallest document all stay.
    """
    prepare(spark)
    groups = jaccard_groups(docs)
    return without(docs, groups.where("doc_id <> component_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Rows with a null id stay."""
    prepare(spark)
    found = contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of every text, and the digest of the decoded bytes."""
    prepare(spark)
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    n_tokens = (F.octet_length("ids") / 4).cast("bigint")
    return rows.select("doc_id", n_tokens.alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("decontamination", decontamination),
    ("byte_level_bpe", byte_level_bpe),
]

#: Compression and tokens are beyond SQL; the stages are tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
