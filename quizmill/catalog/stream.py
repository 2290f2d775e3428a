"""Streams T01 to T03, run to the end of their input and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizmill.catalog import views as V
from quizmill.catalog.shape import items_with_reports
from quizmill.catalog.validate import GATE
from quizmill.storage import new_path
from quizmill.streaming import flows

QUERIES, ORACLE = {}, {}


def query(name, views="", sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = V.with_views(views, sql.strip()) if views else sql
        return fn
    return register


@query("T01_stream_gate", "recs reports", GATE + """
SELECT id, CASE WHEN len(issues) = 0 THEN 'verified' ELSE 'quarantine' END AS sink, array_to_string(issues, '|') AS reasons FROM gate""")
def t01(spark, d):
    base = new_path(spark, "stream-gate")
    items = items_with_reports(spark, d).drop("doc_id", "reports", "source", "lang", "method", "origin")
    items.repartition("id").write.json(f"{base}/in")
    stream = flows.read_json_stream(spark, f"{base}/in", flows.ITEM, files_per_trigger=3)
    flows.stream_gate(stream, f"{base}/out", f"{base}/state").awaitTermination()
    out = None
    for name in ("verified", "quarantine"):
        part = spark.read.schema("id string, reasons array<string>").json(
            f"{base}/out/{name}/*"
        ).select("id", F.lit(name).alias("sink"), F.array_join("reasons", "|").alias("reasons"))
        out = part if out is None else out.unionByName(part)
    return out


@query("T02_stream_recurring_issues", "fails", "SELECT issue FROM fails GROUP BY issue HAVING count(*) >= 3")
def t02(spark, d):
    base = new_path(spark, "stream-issues")
    V.fails(spark, d).repartitionByRange("seq").write.json(f"{base}/in")
    schema = "issue string, seq bigint, feedback string"
    files = len(spark.read.schema(schema).json(f"{base}/in").inputFiles())  # as many as the data asks for
    stream = flows.read_json_stream(spark, f"{base}/in", schema, files_per_trigger=max(1, -(-files // 3)))
    flows.stream_recurring_issues(stream, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("issue")


@query("T03_stream_used_anchors", "chunks", "SELECT chunk_id, source FROM chunks")
def t03(spark, d):
    """The second run starts from the first one's state and gets all chunks again."""
    base = new_path(spark, "stream-anchors")
    docs = V.chunks(spark, d).select("chunk_id", "source")
    for _ in range(2):
        docs.repartition(3).write.mode("append").json(f"{base}/in")
        stream = flows.read_json_stream(spark, f"{base}/in", "chunk_id string, source string")
        flows.stream_unused_anchors(stream, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out")
