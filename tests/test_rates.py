"""Rates, intervals and the report."""

import pytest
from pyspark.sql import functions as F

from quizmill.operators import rates


def test_intervals(spark):
    rows = [("a", 0, 0, 1), ("b", 1, 1, 1), ("c", 200, 150, 13), ("d", 200, 150, 13), ("e", 50, 0, 7)]
    df = spark.createDataFrame(rows, "name string, n bigint, k bigint, seed bigint")
    got = {r["name"]: r for r in rates.with_intervals(df).collect()}
    assert got["a"]["value"] is None and got["a"]["ci95_low"] is None
    assert (got["b"]["value"], got["b"]["ci95_low"], got["b"]["ci95_high"]) == (1.0, 1.0, 1.0)
    c = got["c"]
    assert c["value"] == 0.75 and abs(c["ci95_low"] - 0.69) < 0.02 and abs(c["ci95_high"] - 0.81) < 0.02
    assert [c["ci95_low"], c["ci95_high"]] == [got["d"]["ci95_low"], got["d"]["ci95_high"]]
    assert (got["e"]["ci95_low"], got["e"]["ci95_high"]) == (0.0, 0.0)
    with pytest.raises(ValueError):
        rates.with_intervals(df, samples=99)


@pytest.mark.parametrize("status, want", [("pass", True), ("fail", False), ("not_applicable", False), ("not_run", None), (None, None)])
def test_judge_status(spark, status, want):
    col = rates.judge_status(F.lit(status).cast("string"))
    assert spark.range(1).select(col.alias("x")).first()["x"] is want


def test_yield_and_report(spark):
    metrics = spark.createDataFrame(
        [("full", "record_yield", 0.5, 0.25, 0.75), ("full", "schema_valid_rate", 1.0, 1.0, 1.0)],
        "method string, metric string, value double, ci95_low double, ci95_high double",
    )
    counts = spark.createDataFrame([("full", 2)], "method string, n_completed bigint")
    lines = [r["text"] for r in rates.markdown_table(metrics, counts).orderBy("line").collect()]
    assert lines[2] == "| full | 2 | 50.0% [25.0, 75.0] | 100.0% [100.0, 100.0] | — | — |"
