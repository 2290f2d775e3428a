"""Cleaning and merging of finished question sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.functions.text import answer_tag
from quizmill.operators import clean
from quizmill.operators.merge_ids import merge_unique_ids
from quizmill.sources.jsonl import read_strict


def curate_outputs(rows: DataFrame, tagged: bool = False) -> DataFrame:
    """Complete, error-free rows with unique ids.

    ``rows``: id, file, line, question, thinking, answer. With ``tagged`` the answer is taken
    out of its tag first.
    """
    if tagged:
        rows = rows.withColumn("answer", answer_tag(F.col("answer")))
    kept = rows.where(clean.has_all_fields() & clean.has_no_error())
    return merge_unique_ids(kept)


def merge_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of several files in path and line order, with unique ids."""
    return merge_unique_ids(read_strict(spark, path, schema, keep_place=True))
