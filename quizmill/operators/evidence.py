"""Evidence policy: eligible tiers, rank limits, first-wins de-duplication, tier back-fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quizmill import constants as C
from quizmill.functions import text as X


def is_eligible(tier: Column, source_tier: Column, allow_legacy: bool = True) -> Column:
    allowed = ["Tier 1", "Tier 2"] + ([C.LEGACY_TIER] if allow_legacy else [])
    return X.document_tier(tier, source_tier).isin(allowed)


def top_rows(
    df: DataFrame, item: str | list[str], order: list, limit: Column | int, most: int,
    rank: str = "rank",
) -> DataFrame:
    """First rows per item. ``most`` is the literal bound that lets each task cut early."""
    keys = [item] if isinstance(item, str) else item
    numbered = df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    kept = numbered.where(F.col("_rn") <= most)
    if not isinstance(limit, int):
        kept = kept.where(F.col("_rn") <= limit)
    return kept.drop(*([rank] if rank in df.columns else [])).withColumnRenamed("_rn", rank)


def eligible_evidence(
    df: DataFrame, item: str, order: list, limit: Column | int, allow_legacy: bool = True
) -> DataFrame:
    """Approved documents in rank order, cut at the evidence limit of their item."""
    most = limit if isinstance(limit, int) else max(r[3] for r in C.RETRIEVAL_POLICY)
    ok = df.where(is_eligible(F.col("tier"), F.col("source_tier"), allow_legacy))
    return top_rows(ok, item, order, limit, most)


def text_key(text: Column) -> Column:
    """Short key for grouping by whole texts: the texts themselves are not shuffled."""
    return F.sha2(text, 256)


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in the given order; copies are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("r")
    )
    return best.select(*keys, "r.*")


def backfill_tier(df: DataFrame, tier: str) -> DataFrame:
    """Set the source tier where neither tier field is filled."""
    empty = (X.first_text(F.col("source_tier")) == "") & (X.first_text(F.col("tier")) == "")
    return df.withColumn(
        "source_tier", F.when(empty, F.lit(tier)).otherwise(F.col("source_tier"))
    )


def backfill_count(df: DataFrame) -> DataFrame:
    """Dry run: how many rows a back-fill would set."""
    empty = (X.first_text(F.col("source_tier")) == "") & (X.first_text(F.col("tier")) == "")
    return df.agg(F.count_if(empty).alias("would_set"), F.count(F.lit(1)).alias("rows"))
