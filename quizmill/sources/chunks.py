"""Chunk files in, chunk tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = T.StructType([
    T.StructField("uuid", T.StringType()),
    T.StructField("headers", T.ArrayType(T.StringType())),
    T.StructField("content", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("type", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("tier", T.StringType()),
    T.StructField("source_tier", T.StringType()),
])
CORRUPT = "_corrupt_record"


def scan_chunk_json(
    spark: SparkSession, directory: str, source_tier: str | None = None,
    schema: T.StructType = CHUNK, pattern: str = "*.json",
) -> DataFrame:
    """All rows of all chunk files below a folder, unreadable files as one corrupt row each.

    A file holds one object or an array of objects.
    """
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    rows = (
        spark.read.schema(full)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(directory)
        .select(
            "*",
            F.col("_metadata.file_name").alias("_source_file"),
            F.col("_metadata.file_path").alias("_source_path"),
        )
    )
    if source_tier:
        rows = rows.withColumn(
            "source_tier", F.coalesce(F.nullif("source_tier", F.lit("")), F.lit(source_tier))
        )
    return rows


def read_chunk_json(spark: SparkSession, directory: str, **options) -> DataFrame:
    """Readable chunk rows with their provenance."""
    rows = scan_chunk_json(spark, directory, **options)
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def import_stats(scanned: DataFrame) -> DataFrame:
    """Files seen, files with rows, unreadable files and rows, in one aggregation."""
    good = F.col(CORRUPT).isNull()
    return scanned.agg(
        F.countDistinct("_source_path").alias("files"),
        F.countDistinct(F.when(good, F.col("_source_path"))).alias("files_with_rows"),
        F.count_if(~good).alias("bad_files"),
        F.count_if(good).alias("rows"),
        F.sum(F.length("content")).alias("characters"),
    )


def append_with_stats(scanned: DataFrame, path: str) -> dict[str, int]:
    """Append the readable rows to a Parquet table; row counts come from the same pass."""
    seen = Observation()
    good = F.col(CORRUPT).isNull()
    counted = scanned.observe(
        seen, F.count_if(good).alias("rows"), F.count_if(~good).alias("bad_files")
    )
    counted.where(good).drop(CORRUPT).write.mode("append").parquet(path)
    return dict(seen.get)


def read_collection(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A whole stored collection without its storage id."""
    return spark.read.format(fmt).load(path).drop("_id")


def upsert_columns(
    table: DataFrame, updates: DataFrame, key: str, order: list[str] | None = None
) -> DataFrame:
    """Take the updates' columns where the key matches, keep the table's elsewhere.

    Of updates that repeat a key the greatest in ``order`` counts (by default, of a hash of the
    row), so the table keeps its number of rows.
    """
    changed = [c for c in updates.columns if c != key]
    rank = F.struct(*order) if order else F.xxhash64(*changed)
    new = updates.groupBy(key).agg(F.max_by(F.struct(*changed), rank).alias("_new"))
    joined = table.join(new, key, "left")
    out = {
        c: F.coalesce(F.col("_new")[c], F.col(c)) if c in table.columns else F.col("_new")[c]
        for c in changed
    }
    return joined.withColumns(out).drop("_new")
