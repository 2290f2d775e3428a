"""Streams with state: stopped, given more and started again."""

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from quizmill.streaming import flows

EVENT = "issue string, seq bigint"
CHUNK = "chunk_id string, source string"


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_issues_over_restarts(spark, tmp_path):
    pick, counts, emitted = random.Random(2), Counter(), {}
    names = [f"issue {k}" for k in range(30)] + [None]
    for run in range(3):
        for part in range(2):  # each file is a micro-batch
            events = [pick.choice(names) for _ in range(25)] + ["hot"] * 3000
            write(tmp_path / "in", f"{run}-{part}", [{"issue": e, "seq": 1} for e in events])
            counts.update(e for e in events if e is not None)
            emitted.update({e: n for e, n in counts.items() if n >= 3 and e not in emitted})
        stream = flows.read_json_stream(spark, str(tmp_path / "in"), EVENT, files_per_trigger=1)
        query = flows.stream_recurring_issues(stream, str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        assert sorted(r["issue"] for r in rows) == sorted(emitted)  # each once
        assert all(counts[r["issue"]] >= r["support"] >= 3 for r in rows)
    # a batch reads the rows of its own files, not what was emitted before
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    assert [p["numInputRows"] for p in progress] == [3025, 3025]
    plan = query._jsq.explainInternal(False) if hasattr(query._jsq, "explainInternal") else ""
    assert str(tmp_path / "out") not in plan
    assert all(s["customMetrics"].get("rocksdbPutCount", 1) for p in progress for s in p["stateOperators"])


def test_anchors_over_restarts_and_earlier_jobs(spark, tmp_path):
    done = spark.createDataFrame([("c1",), ("c2",), ("c2",), (None,)], "chunk_id string")
    seen = set()
    for run, ids in enumerate([["c1", "c3", "c3", None], ["c3", "c2", "c4"], ["c1", "c5", "c4", "c6"]]):
        write(tmp_path / "in", str(run), [{"chunk_id": c, "source": f"s{run}"} for c in ids])
        stream = flows.read_json_stream(spark, str(tmp_path / "in"), CHUNK)
        flows.stream_unused_anchors(stream, str(tmp_path / "out"), str(tmp_path / "state"), used=done).awaitTermination()
        seen |= {c for c in ids if c and c not in ("c1", "c2")}
        got = [r["chunk_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
        assert sorted(got) == sorted(seen)
    assert spark.read.parquet(str(tmp_path / "out")).where(F.col("chunk_id") == "c3").first()["source"] == "s0"


def test_settings_are_given_back(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    with flows._rocksdb(spark):
        assert "RocksDB" in spark.conf.get(key)
    assert spark.conf.get(key, None) == before


def test_anchors_without_earlier_ids_need_no_python_by_key(spark, tmp_path):
    seen = set()
    for run, ids in enumerate([["c1", "c3", "c3", None], ["c3", "c2"], ["c1", "c5"]]):
        write(tmp_path / "in", str(run), [{"chunk_id": c, "source": f"s{run}"} for c in ids])
        stream = flows.read_json_stream(spark, str(tmp_path / "in"), CHUNK)
        query = flows.stream_unused_anchors(stream, str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination()
        seen |= {c for c in ids if c}
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        assert sorted(r["chunk_id"] for r in rows) == sorted(seen)
    assert [s["operatorName"] for p in query.recentProgress for s in p["stateOperators"]][0] == "dedupe"


def test_recurring_issues_need_no_python_by_key(spark, tmp_path):
    """Issues that cross in the middle, at once and far over the threshold; a run without new files; another key order."""
    runs = [["a", "b", "b", None], ["a", "b", "hot", "hot", "hot", "c"], [], ["a", "b", "hot", "c", "c"], ["c", "a"]]
    counts, emitted = Counter(), {}
    for run, issues in enumerate(runs):
        if issues:
            write(tmp_path / "in", str(run), [{"issue": i, "seq": n} for n, i in enumerate(issues)])
        counts.update(i for i in issues if i)
        emitted |= {i: n for i, n in counts.items() if n >= 3 and i not in emitted}
        stream = flows.read_json_stream(spark, str(tmp_path / "in"), EVENT)
        query = flows.stream_recurring_issues(stream, str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        assert sorted((r["issue"], r["support"]) for r in rows) == sorted(emitted.items())
    assert [s["operatorName"] for p in query.recentProgress for s in p["stateOperators"]][0] == "stateStoreSave"
