"""Expert label files."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill import constants as C
from quizmill.functions.text import strip, tristate


def parse_labels(rows: DataFrame, order: list[str]) -> DataFrame:
    """Label texts as nullable booleans, one row per (method, id); the last usable row wins."""
    labels = [
        (tristate(F.col(f)) if f in rows.columns else F.lit(None).cast("boolean")).alias(f)
        for f in C.AUDIT_FIELDS
    ]
    clean = rows.select(
        strip(F.col("method")).alias("method"), strip(F.col("id")).alias("id"), *labels, *order
    ).where(
        (F.col("method") != "") & (F.col("id") != "") & F.coalesce(*C.AUDIT_FIELDS).isNotNull()
    )
    last = clean.groupBy("method", "id").agg(
        F.max_by(F.struct(*C.AUDIT_FIELDS), F.struct(*order)).alias("r")
    )
    return last.select("method", "id", "r.*")


def read_audit_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labels of audit files; file order decides between duplicate keys.

    Quotes inside a field are doubled and fields may hold line breaks. Columns are taken by name,
    so files may have them in different orders.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
    )
    # the first line of each file, from the task that reads its beginning
    first = lines.where("start = 0").groupBy("path").agg(F.min_by("value", "at").alias("head"))
    heads = first.groupBy("head").agg(F.collect_list("path").alias("paths"))
    # one row per distinct header line
    parts = [_read_alike(spark, [unquote(p) for p in row.paths]) for row in heads.collect()]
    if not parts:
        raise ValueError("Expert audit CSV: no file found")
    rows = parts[0]
    for other in parts[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    return parse_labels(rows, ["_file", "_at"])


def _read_alike(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of files with the same header."""
    raw = spark.read.csv(
        paths, header=True, quote='"', escape='"', multiLine=True, mode="FAILFAST", enforceSchema=False
    )
    names = {c.strip().lstrip("﻿"): c for c in raw.columns}
    if not {"method", "id"} <= set(names):
        raise ValueError("Expert audit CSV requires columns: method,id")
    return raw.select(
        *[F.col(f"`{c}`").alias(n) for n, c in names.items()],
        F.col("_metadata.file_path").alias("_file"),
        F.monotonically_increasing_id().alias("_at"),
    )
