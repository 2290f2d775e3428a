"""The corpus pipeline: stages over ``documents``, each written and read again by the next.

toxicity       documents that it scores 0.5 or more go
quality        documents that fail the base rule or are judged unfit go
near_copies    one row of each class of near copies stays: the one with the smallest id, null last; of rows
               that share it, one
repeats        passages of 50 bytes or more that an earlier document has go; documents left without
               text stay, with an empty one
packing        a row per piece of a document in a sequence of at most 4,096 tokens

The first four return the columns of ``documents``, whatever their names. Their languages, sources and
ids are carried along and never looked at.

A stage of ``STAGES`` begins when its predecessor's result is written, and deletes the intermediate tables of
the stages before it. The functions below can be called by themselves; they delete nothing.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.llm import jaccard, packing, quality, suffixes, toxicity
from quizmill.session import ship_package
from quizmill.storage import forget_intermediates, group, group_path, materialize, new_path

SCRATCH = "pipeline_stages"


def _keyed(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The documents with a key of each row, written before use (ids may be null or repeated), and the
    key's name, which no column has."""
    key = "_row"
    while key in docs.columns:
        key += "_"
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), name), key


def _keep(rows: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """The rows of ``kept``, in their own columns."""
    return rows.join(kept.select(key), key, "left_semi").drop(key)


def clean_toxicity(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    model = toxicity.fit_folds(spark, docs.select("doc_id", "text"), sf_dir)
    rows = docs.select("text", F.struct("*").alias("own"))  # apart from the model's columns
    return toxicity.score(rows, model, passages=False).where(F.col("score") < 0.5).select("own.*")


def clean_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    rows, key = _keyed(docs, "quality_rows")
    return _keep(rows, quality.label(rows.select(key, "text"), key).where("kept"), key)


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    rows, key = _keyed(docs, "near_rows")
    classes = jaccard.classify(rows.select(key, "text"), key)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), key)
    ordered = rows.select(key, order.alias("first")).join(classes.select(key, "component_id"), key)
    return _keep(rows, ordered.groupBy("component_id").agg(F.min("first")[key].alias(key)), key)


def cut_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    cut = suffixes.remove_repeats(docs)
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.char_length("text").cast("bigint")}
    return cut.select(*(own.get(c, F.col("rest")[c]).alias(c) for c in docs.columns))


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack(docs)


def _stage(work):
    """The stage, free of what earlier ones left behind; its own intermediates lie in a group."""

    @functools.wraps(work)
    def run(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = "/".join(group_path(spark, SCRATCH).rsplit("/", 2)[1:])
        if not any(left in path for path in docs.inputFiles()):
            forget_intermediates(spark, SCRATCH)
        with group(SCRATCH):
            return work(spark, docs, sf_dir)

    return run


STAGES = [
    ("toxicity", _stage(clean_toxicity)),
    ("quality", _stage(clean_quality)),
    ("near_copies", _stage(drop_near_copies)),
    ("repeats", _stage(cut_repeats)),
    ("packing", _stage(pack)),
]

#: The model of the first stage and the packing are not SQL; tests replay the stages by brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline_{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
