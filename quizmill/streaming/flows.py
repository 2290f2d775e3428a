"""Continuous forms of the gate, the issue counter and the anchor filter.

Every record is written exactly once across restarts: the micro-batches of the gate and of the issue counter
write to folders of their own, replaced when a batch is run again; the anchor filter writes through the
engine's file log. State by key is on the executors' disks (RocksDB) and its changes in the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quizmill import constants as C
from quizmill.functions import records as R

#: Rows of counts held before they are summed.
SUM_ROWS = 200_000

ITEM = (
    "id string, level string, difficulty string, question string, options map<string,string>, "
    "answer string, cited array<string>, rationale_short string, audit_steps array<string>, "
    "distractor_analysis map<string,string>, clinical_case string, case_summary string, "
    "refs array<struct<chunk_id: string, source_kind: string, score: double>>, "
    "report_list array<struct<judge: string, passed: boolean, issues: array<string>, "
    "feedback: string, blocking: boolean>>"
)


def read_json_stream(
    spark: SparkSession, path: str, schema: str, files_per_trigger: int = 5
) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(path)
    )


def gate(items: DataFrame) -> DataFrame:
    issues = R.gate_issues(
        R.draft_of(), F.col("refs"), F.col("level"), F.col("difficulty"), F.col("report_list")
    )
    return items.withColumn("reasons", issues).withColumn("verdict", R.verdict(F.col("reasons")))


def stream_gate(items: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Gate items as they arrive; verified and quarantined ones go to their own folders."""

    def flush(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for name in ("verified", "quarantine"):
            part = batch.where(F.col("verdict") == name)
            part.write.mode("overwrite").json(f"{out}/{name}/batch_id={batch_id}")
        batch.unpersist()

    return (
        gate(items).writeStream.foreachBatch(flush)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """State on the executors' disks, with its changes written at each batch; for queries started inside."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts within a task, so that a frequent issue is a row a batch of rows."""
    for batch in batches:
        found = batch.column(0).value_counts()
        yield pa.RecordBatch.from_arrays(
            [found.field("values"), found.field("counts").cast(pa.int64())], names=["issue", "n"]
        )


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each issue of a task, with the number of the micro-batch. Memory holds the task's issues."""
    number = int(TaskContext.get().getLocalProperty("streaming.sql.batchId"))
    held: list[pa.RecordBatch] = []
    size, limit = 0, SUM_ROWS

    def total() -> list[pa.RecordBatch]:
        found = pa.Table.from_batches(held).group_by("issue").aggregate([("n", "sum")])
        return found.select(["issue", "n_sum"]).rename_columns(["issue", "n"]).to_batches()

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size > limit:
            held = total()
            size = sum(b.num_rows for b in held)
            limit = 2 * size + SUM_ROWS
    for batch in total() if held else []:
        yield batch.append_column("batch", pa.array(np.full(batch.num_rows, number)))


def stream_recurring_issues(
    events: DataFrame, out: str, checkpoint: str, threshold: int = C.REPEAT_THRESHOLD,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Emit each issue once, in the batch in which its running count reaches the threshold.

    A micro-batch reads and changes the state of its own issues only; what was emitted before is never
    read again. The state is the engine's own aggregation: the count, and how much of it the issue's last
    batch added, so that the batch that crosses the threshold is known and no Python runs by key. ``out`` gets
    (issue, support), a folder a batch. The threshold is fixed for a checkpoint.
    """
    counts = events.select("issue").mapInArrow(_counted, "issue string, n long").where("issue IS NOT NULL")
    once = counts.repartition("issue").mapInArrow(_summed, "issue string, n long, batch long")
    totals = once.groupBy("issue").agg(F.sum("n").alias("support"), F.max_by("n", "batch").alias("added"))
    crossed = totals.where((F.col("support") >= threshold) & (F.col("support") - F.col("added") < threshold))

    def flush(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    with _rocksdb(events.sparkSession):
        return (
            crossed.select("issue", "support").writeStream.outputMode("update").foreachBatch(flush)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )


class _Once(StatefulProcessor):
    """The first row of a key that is not in the initial state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "used boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.used.update((True,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = next((part.head(1) for part in rows if len(part)), None)
        if first is not None and not self.used.exists():
            self.used.update((True,))
            yield first

    def close(self) -> None:
        pass


def stream_unused_anchors(
    chunks: DataFrame, out: str, checkpoint: str, trigger: dict | None = None, used: DataFrame | None = None
) -> StreamingQuery:
    """Pass each chunk id on once, also over restarts, and none of ``used`` (chunk_id), from which the first
    state is filled. The ids lie on the executors' disks; memory holds a bounded part of them.

    Without ``used`` no Python runs by key. The two forms keep different states, and the engine refuses one on
    the other's checkpoint: a stream that began with ``used`` goes on with a table, be it empty."""
    spark = chunks.sparkSession
    named = chunks.where("chunk_id IS NOT NULL")
    if used is None:
        once = named.dropDuplicates(["chunk_id"])
    else:
        known = used.select("chunk_id").where("chunk_id IS NOT NULL").distinct()
        once = named.groupBy("chunk_id").transformWithStateInPandas(
            _Once(), chunks.schema, "Append", "None", initialState=known.groupBy("chunk_id")
        )
    with _rocksdb(spark):
        return (
            once.writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
