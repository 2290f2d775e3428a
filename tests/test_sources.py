"""Readers and state files."""

import pytest

from quizmill.sources import audit, chunks, jsonl, playbook, sidecars, sinks


def test_strict_reader_names_file_and_line(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"id": "1"}\n\n[3]\n{"id": "2"}\n', encoding="utf-8")
    got = jsonl.read_strict(spark, str(f), "id string").collect()
    assert sorted(r["id"] for r in got) == ["1", "2"]
    f.write_text('{"id": "1"}\n\n{"id": \n{"id": "2"}\n', encoding="utf-8")
    with pytest.raises(Exception, match=r"a\.jsonl at line 3"):
        jsonl.read_strict(spark, str(f), "id string").collect()
    assert jsonl.read_strict(spark, str(tmp_path / "none"), "id string").count() == 0


def test_lenient_reader_skips(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"id": "PSY-000007"}\nnot json\n{"id": "PSY-000021"}\n', encoding="utf-8")
    assert sorted(r["id"] for r in jsonl.read_lenient(spark, str(f), "id string").collect()) == ["PSY-000007", "PSY-000021"]


def test_line_numbers_over_many_blocks(spark, tmp_path):
    f = tmp_path / "big.txt"
    f.write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(1, 3001)), encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = jsonl.numbered_lines(spark, str(f)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["line"], int(r["value"].split()[1])) for r in rows) == [(i, i) for i in range(1, 3001)]


def test_audit_csv(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text(
        "﻿method,id,key_correct,other\n full , 1 ,pass,x\nfull,1,0,x\nfull,2,maybe,x\n,3,pass,x\nfull,4,TRUE,\n",
        encoding="utf-8",
    )
    got = {(r["method"], r["id"]): r["key_correct"] for r in audit.read_audit_csv(spark, str(f)).collect()}
    assert got == {("full", "1"): False, ("full", "4"): True}
    f.write_text("a,b\n1,2\n", encoding="utf-8")
    with pytest.raises(ValueError):
        audit.read_audit_csv(spark, str(f))


def test_audit_csv_with_quotes_line_breaks_and_other_column_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'method,id,note,key_correct\nfull,1,"said ""no, never"" twice",fail\nfull,2,"two\nlines",pass\n', encoding="utf-8"
    )
    (tmp_path / "b.csv").write_text("key_correct,id,method\n0,3,full\n1,1,full\n", encoding="utf-8")
    got = {r["id"]: r["key_correct"] for r in audit.read_audit_csv(spark, str(tmp_path)).collect()}
    assert got == {"1": True, "2": True, "3": False}


def test_audit_csv_with_odd_file_names(spark, tmp_path):
    folder = tmp_path / "a b+c%20d"
    folder.mkdir()
    for k in range(3):
        (folder / f"x {k}+.csv").write_text(f"method,id,key_correct\nfull,{k},true\n" + "full,9,x\n" * 100, encoding="utf-8")
    assert sorted(r["id"] for r in audit.read_audit_csv(spark, str(folder)).collect()) == ["0", "1", "2"]


def test_upsert_keeps_the_number_of_rows(spark):
    table = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    new = spark.createDataFrame([("a", 10, 1), ("a", 20, 2), ("c", 30, 1)], "k string, v int, at int")
    got = chunks.upsert_columns(table, new, "k", ["at"])
    assert sorted((r["k"], r["v"]) for r in got.collect()) == [("a", 20), ("a", 20), ("b", 3)]
    assert chunks.upsert_columns(table, new.drop("at"), "k").count() == 3


def test_import_twice(spark, tmp_path):
    from quizmill.plans.ingest import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('[{"uuid": "u1", "content": "some words"}, {"content": "same"}, {"content": "same"}]')
    embed = lambda texts: [[1.0] * 4 for _ in texts]
    for n in (3, 6):
        table, _ = ingest(spark, str(tmp_path / "in"), str(tmp_path / "table"), embed, "m", 4)
        assert table.count() == n and table.where("embedding IS NULL").count() == 0


def test_chunk_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text('[{"content": "x", "source_tier": ""},\n {"content": "y", "source_tier": "t"}]', encoding="utf-8")
    (tmp_path / "sub" / "b.json").write_text('{"content": "z"}', encoding="utf-8")
    (tmp_path / "sub" / "c.json").write_text('[{"content": ', encoding="utf-8")
    (tmp_path / "d.txt").write_text("no", encoding="utf-8")
    scanned = chunks.scan_chunk_json(spark, str(tmp_path), source_tier="tier_1")
    rows = chunks.read_chunk_json(spark, str(tmp_path), source_tier="tier_1").collect()
    assert sorted((r["content"], r["source_tier"], r["_source_file"]) for r in rows) == [
        ("x", "tier_1", "a.json"), ("y", "t", "a.json"), ("z", "tier_1", "b.json")]
    stats = chunks.import_stats(scanned).first().asDict()
    assert stats == {"files": 3, "files_with_rows": 2, "bad_files": 1, "rows": 3, "characters": 3}


def test_playbook_round_trip(spark):
    text = ("<!-- v -->\n## A B\n[evi-00001] helpful=1 harmful=0 :: First rule.\nprose\n"
            "[evi-00002] helpful=0 harmful=2 :: Second.\n\n## EMPTY\n## C\n[x-1] helpful=0 harmful=0 :: Third :: more\n")
    books = spark.createDataFrame([("b", text)], "book string, text string")
    rules = playbook.parse_playbook(books)
    rows = [(r["section"], r["bullet_id"], r["helpful"], r["harmful"], r["content"]) for r in rules.orderBy("pos").collect()]
    assert rows == [("A B", "evi-00001", 1, 0, "First rule."), ("A B", "evi-00002", 0, 2, "Second."), ("C", "x-1", 0, 0, "Third :: more")]
    again = playbook.parse_playbook(playbook.render_playbook(rules))
    assert [r["content"] for r in again.orderBy("pos").collect()] == [r[4] for r in rows]
    with pytest.raises(Exception, match="rulebook"):
        playbook.parse_playbook(spark.createDataFrame([("b", "no rules")], "book string, text string")).collect()


def test_counters_keep_whole_numbers(spark):
    df = spark.createDataFrame([('{"a": 3, "b": -1, "c": "x", "d": 1.5, "e": 0}',), ("[1]",)], "value string")
    assert sorted((r["name"], r["n"]) for r in sidecars.counters(df, []).collect()) == [("a", 3), ("e", 0)]


def test_state_versions(spark, tmp_path):
    base = str(tmp_path / "state")
    assert sinks.load_state(spark, base) is None
    sinks.save_state(spark.range(3), base)
    (tmp_path / "state" / "v=2").mkdir()  # a write that did not finish
    assert sinks.load_state(spark, base).count() == 3
    assert sinks.save_state(spark.range(5), base) == 3
    assert sinks.load_state(spark, base).count() == 5


def test_groups_of_intermediates(spark):
    from pathlib import Path

    from quizmill import storage

    with storage.group("one"):
        inside = storage.materialize(spark.range(3), "t")
        path = storage.new_path(spark, "x")
    outside = storage.materialize(spark.range(4), "t")
    assert path.startswith(storage.group_path(spark, "one")) and inside.count() == 3
    storage.forget_intermediates(spark, "one")
    assert not Path(storage.group_path(spark, "one")).exists() and outside.count() == 4


def test_imports_write_and_embed_only_what_is_new(spark, tmp_path):
    import json

    from quizmill.plans.collection import ChunkCollection

    log, folder, base = tmp_path / "log", tmp_path / "in", tmp_path / "base"
    folder.mkdir()

    def embed(texts):
        with open(log, "a") as f:
            f.writelines(json.dumps(t) + "\n" for t in texts)
        if "fails once" in texts and open(log).read().count('"fails once"') == 1:
            raise ValueError("down")
        return [[float(len(t)), 1.0] for t in texts]

    def put(name, rows):
        (folder / name).write_text(json.dumps(rows))

    def run():
        before = log.read_text() if log.exists() else ""
        files = {p for p in base.rglob("*.parquet")}
        report = ChunkCollection(spark, str(base), embed, "m", 2, buckets=8, batch_size=1).import_folder(str(folder))
        texts = sorted(json.loads(x) for x in log.read_text()[len(before):].splitlines())
        return report, texts, {str(p) for p in base.rglob("*.parquet")} - {str(p) for p in files}

    def stored():
        rows = ChunkCollection(spark, str(base), embed, "m", 2).read().collect()
        return {r["chunk_id"]: (r["content"], r["title"], r["embedding"] and r["embedding"][0]) for r in rows}

    put("a.json", [{"uuid": f"u{k}", "content": "x" * (k + 1)} for k in range(20)] + [{"content": "same"}, {"content": "same"}, {"content": " "}])
    report, texts, _ = run()
    assert report["changed"] == 22 and len(texts) == report["embedded"] == 21
    assert run() == ({"changed": 0, "buckets": 0, "embedded": 0}, [], set())
    # a new text, a new title of an old text, and a text whose batch fails once
    put("b.json", [{"uuid": "u3", "content": "changed"}, {"uuid": "u4", "content": "xxxxx", "title": "t"}, {"uuid": "n", "content": "fails once"}])
    put("a.json", [{"uuid": "u7", "content": "x" * 8}])
    report, texts, files = run()
    assert report["changed"] == 3 and report["buckets"] <= 3 and texts == ["changed", "fails once"]
    assert len({p.split("bucket=")[1][0] for p in files if "bucket=" in p}) == report["buckets"]
    now = stored()
    assert len(now) == 23 and now["u3"] == ("changed", None, 7.0) and now["u4"] == ("xxxxx", "t", 5.0) and now["n"][2] is None
    report, texts, _ = run()
    assert report == {"changed": 0, "buckets": 1, "embedded": 1} and texts == ["fails once"]
    assert stored()["n"][2] == 10.0 and run()[0]["buckets"] == 0


def test_a_stopped_import_is_not_seen(spark, tmp_path, monkeypatch):
    from quizmill.plans.collection import ChunkCollection
    from quizmill.sources import sinks

    store = ChunkCollection(spark, str(tmp_path / "base"), lambda t: [[1.0] for _ in t], "m", 1, buckets=4)
    rows = spark.createDataFrame([(f"u{k}", f"text {k}") for k in range(9)], "uuid string, content string")
    columns = {c: chunks.CHUNK[c].dataType for c in chunks.CHUNK.names if c not in rows.columns}
    from pyspark.sql import functions as F
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in columns.items()})
    store.import_rows(rows.limit(3))
    before = sorted(r["chunk_id"] for r in store.read().collect())

    def killed(*a):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(sinks, "save_state", killed)
        store.import_rows(rows)
    assert sorted(r["chunk_id"] for r in store.read().collect()) == before
    assert store.import_rows(rows)["changed"] == 6 and store.read().count() == 9


def test_collection_drops_what_is_stored_before_rows_are_moved(spark, tmp_path):
    from pyspark.sql import functions as F

    from quizmill.plans.collection import ChunkCollection

    store = ChunkCollection(spark, str(tmp_path / "base"), lambda t: [[1.0] for _ in t], "m", 1, buckets=4)

    def rows(*texts):
        own = spark.createDataFrame([(f"c{k}", t) for k, t in texts], "uuid string, content string")
        empty = {c: F.lit(None).cast(chunks.CHUNK[c].dataType) for c in chunks.CHUNK.names if c not in own.columns}
        return own.withColumns(empty)

    first = rows((1, "a"), (1, "a"), (2, "b"), (2, "c"), (3, "d"))
    report = store.import_rows(first)
    assert (report["changed"], report["embedded"]) == (3, 3)
    assert set(store.import_rows(first).values()) == {0}
    assert store.incoming(first, store.read()).count() == 0
    again = store.incoming(rows((1, "a"), (2, "b"), (2, "c"), (3, "e"), (4, "f")), store.read())
    assert sorted((r["chunk_id"], r["content"]) for r in again.collect()) == [("c3", "e"), ("c4", "f")]
    report = store.import_rows(rows((3, "e"), (4, "f")))
    assert (report["changed"], report["embedded"]) == (2, 2) and store.read().count() == 4


def test_strict_lines_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f'{{"n": {i}}}\n' for i in range(50)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # sizes of text files say nothing about their blocks
    try:
        rows = jsonl.read_strict(spark, str(tmp_path), "n int")
        assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["n"] for r in rows.collect()) == list(range(50))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
