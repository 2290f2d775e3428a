"""Import of chunk files: read, stamp, append, tier, embed, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.functions.models import Embedder, embed_texts
from quizmill.operators import retrieve as RT
from quizmill.operators.evidence import backfill_tier
from quizmill.operators.shape import chunk_key
from quizmill.sources import chunks as K


def ingest(
    spark: SparkSession, directory: str, table: str, embed: Embedder, model: str, dim: int,
    source_tier: str | None = None, default_tier: str = "tier_2", pattern: str = "*.json",
    batch_size: int = 32,
) -> tuple[DataFrame, dict[str, int]]:
    """Append the readable chunks of a folder to ``table``; returns them embedded, and counts."""
    scanned = K.scan_chunk_json(spark, directory, source_tier=source_tier, pattern=pattern)
    counts = K.append_with_stats(scanned, table)
    stored = spark.read.parquet(table)
    stored = backfill_tier(stored.withColumn("chunk_id", F.coalesce(F.nullif(chunk_key(stored), F.lit("")), F.md5("content"))), default_tier)
    return embed_missing(stored, None, embed, model, dim, batch_size), counts


def embed_missing(
    chunks: DataFrame, vectors: DataFrame | None, embed: Embedder, model: str, dim: int,
    batch_size: int = 32, overwrite: bool = False,
) -> DataFrame:
    """Chunks with ``embedding`` and ``embedding_model`` filled where they were missing."""
    todo = RT.embedding_candidates(chunks, vectors, "chunk_id", overwrite)
    new = embed_texts(todo, "chunk_id", "text", embed, model, batch_size)
    checked = RT.check_dimension(new.where(F.col("embedding").isNotNull()), dim)
    table = chunks if vectors is None else K.upsert_columns(chunks, vectors, "chunk_id")
    return K.upsert_columns(table, checked, "chunk_id")
