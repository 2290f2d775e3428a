"""Cleaning of finished question sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmill import constants as C
from quizmill.functions import text as X


def has_all_fields(names: tuple[str, ...] = ("question", "thinking", "answer")) -> Column:
    keep = F.lit(True)
    for n in names:
        keep = keep & (X.first_text(F.col(n)) != "")
    return keep


def has_no_error(marker: str = C.ERROR_ANSWER) -> Column:
    return ~F.contains(F.coalesce("answer", F.lit("")), F.lit(marker))


def split_counts(df: DataFrame, keep: Column, by: list[str]) -> DataFrame:
    """Kept and removed rows per group, in one aggregation."""
    return df.groupBy(*by).agg(
        F.count_if(keep).alias("kept"), F.count_if(~keep).alias("removed")
    )
