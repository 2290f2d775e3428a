"""Small typed JSON side tables: lists of objects, lists of ids, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.sources.jsonl import path_exists


def read_json_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per side-table file: its path and its text. Empty when there is none."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "file string, value string")
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), "value"
    )


def object_list(texts: DataFrame, fields: str, keep: list[str]) -> DataFrame:
    """Rows of JSON arrays of objects; any other JSON gives none."""
    is_list = F.schema_of_variant(F.try_parse_json("value")).startswith("ARRAY")
    rows = F.explode(F.from_json("value", f"array<struct<{fields}>>"))
    return texts.where(is_list).select(*keep, rows.alias("r")).select(*keep, "r.*")


def id_list(texts: DataFrame, keep: list[str]) -> DataFrame:
    """Ids of JSON arrays as text, empty ones left out."""
    values = F.try_variant_get(F.try_parse_json("value"), "$", "array<string>")
    ids = texts.select(*keep, F.explode(values).alias("id"))
    return ids.where((F.col("id") != "") & ~F.col("id").isin("0", "false"))


def counters(texts: DataFrame, keep: list[str]) -> DataFrame:
    """Non-negative whole numbers of JSON objects; other entries are dropped."""
    values = F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>")
    rows = texts.select(*keep, F.explode(values).alias("name", "v"))
    number = F.when(F.schema_of_variant("v") == "BIGINT", F.try_variant_get("v", "$", "bigint"))
    return rows.select(*keep, "name", number.alias("n")).where("n >= 0")
