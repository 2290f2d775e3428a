"""Comparison of experiment methods over finished records and expert labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill import constants as C
from quizmill.operators import rates
from quizmill.sources.audit import read_audit_csv
from quizmill.sources.jsonl import read_strict
from quizmill.storage import materialize


@dataclass
class Evaluation:
    metrics: DataFrame
    counts: DataFrame
    distributions: DataFrame


def completed(verified: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Both sets in one table, tagged by where they came from."""
    return verified.withColumn("origin", F.lit("verified")).unionByName(
        quarantine.withColumn("origin", F.lit("quarantine")), allowMissingColumns=True
    )


def with_labels(records: DataFrame, labels: DataFrame) -> DataFrame:
    """Records with their expert labels, joined on (method, id); unlabelled ones stay."""
    marked = labels.select(
        "method", "id", F.struct(*C.AUDIT_FIELDS).alias("labels"), F.lit(True).alias("audited")
    )
    joined = records.join(marked, ["method", "id"], "left")
    return joined.withColumn("audited", F.coalesce("audited", F.lit(False)))


def evaluate(records: DataFrame, labels: DataFrame, samples: int = C.BOOTSTRAP_SAMPLES) -> Evaluation:
    """All rates, counts and distributions per method.

    Needs ``method, id, origin, draft, refs, validation, difficulty, level``. The records are
    read once: their texts are judged before the labels join, and what is left of each is kept for rates,
    counts and distributions.
    """
    internal = rates.internal_values(
        F.col("draft"), F.col("refs"), F.col("origin"), F.col("validation")
    )
    judged = records.select("method", "id", "origin", "difficulty", "level", F.struct(
        *[value.alias(name) for name, value in internal.items()]
    ).alias("internal"))
    df = materialize(with_labels(judged, labels), "judged")
    internal = {name: F.col("internal")[name] for name in internal}
    expert = {f"expert:{f}": F.col("labels")[f] for f in C.AUDIT_FIELDS}
    # A few rows per method: written once, so that no later step reads the records again.
    both = materialize(
        rates.rates_by_method(df, {**internal, **expert}, "", [*range(7), *range(20, 27)]), "rates"
    )
    section = F.when(F.col("metric").startswith("expert:"), "expert").otherwise("internal")
    long = both.withColumn("section", section).withColumn(
        "metric", F.regexp_replace("metric", "^expert:", "")
    )
    return Evaluation(
        metrics=rates.with_intervals(rates.with_seeds(long), samples),
        counts=rates.method_counts(df),
        distributions=rates.distribution(df, "difficulty").unionByName(rates.distribution(df, "level")),
    )


RECORD = (
    "id string, question string, options map<string,string>, answer string, "
    "evidence_refs array<struct<chunk_id: string, source_kind: string>>, "
    "metadata struct<question_type: string, difficulty: string, experiment_method: string>, "
    "validation struct<evidence_status: string, single_best_answer: string, "
    "distractor_quality: string, emobench_status: string>"
)


def record_rows(df: DataFrame) -> DataFrame:
    """Record files in the column form of :func:`evaluate`."""
    return df.select(
        "id", "origin",
        F.col("metadata.experiment_method").alias("method"),
        F.col("metadata.difficulty").alias("difficulty"),
        F.col("metadata.question_type").alias("level"),
        F.struct("question", "options", "answer").alias("draft"),
        F.col("evidence_refs").alias("refs"), "validation",
    )


def evaluate_files(
    spark: SparkSession, verified: str, quarantine: str, audit: str | None,
    samples: int = C.BOOTSTRAP_SAMPLES,
) -> Evaluation:
    """The comparison from record files (all methods together) and an optional label file."""
    records = completed(
        read_strict(spark, verified, RECORD), read_strict(spark, quarantine, RECORD)
    )
    labels = (
        read_audit_csv(spark, audit)
        if audit
        else spark.createDataFrame(
            [], "method string, id string, " + ", ".join(f"{f} boolean" for f in C.AUDIT_FIELDS)
        )
    )
    return evaluate(record_rows(records), labels, samples)
