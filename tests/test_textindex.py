"""Stored indexes against searches that read every text."""

import random

import pytest
from pyspark.sql import functions as F

from quizmill.operators import retrieve as RT
from quizmill.operators import textindex
from quizmill.operators.textindex import SubstringIndex, TextIndex
from quizmill.storage import materialize

SCHEMA = "doc_id string, content string, title string, summary string, keywords array<string>"
WORDS = ["stress", "sleep", "memory", "stresses", "Sleepless", "é", "a", "ab", "trẻ em", "anxiety-free", "x_1", "the", "the", "the", "the"]


def corpus(spark, n=300, seed=3):
    pick = random.Random(seed)
    rows = [(f"d{k:04d}", " ".join(pick.choices(WORDS, k=pick.randrange(1, 40))), pick.choice([None, "Title " + pick.choice(WORDS)]), None,
             pick.choice([None, [], ["key one", pick.choice(WORDS)]])) for k in range(n)]
    rows += [("z1", None, None, None, None), ("z2", "", "", "", []), ("z3", "only\tonce  rareword", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


ASKED = [
    (1, "stress and sleep"), (2, "rareword"), (3, "the"), (4, ""), (5, None), (6, "no such term zzz"), (7, "THE rareword memory"),
    (8, "a"), (9, "ress less y-f"), (10, "tr ẻ"), (11, " é x_ "), (12, "the the the stresses anxiety"),
]


def queries(spark):
    return spark.createDataFrame(ASKED, "query_id bigint, query string")


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "doc_id", "score", "rank").collect())


@pytest.mark.parametrize("block", [1000, 20])
def test_ranking_is_that_of_a_full_search(spark, tmp_path, block):
    texts = corpus(spark)
    index = TextIndex.build(texts, str(tmp_path / "index"), block=block)
    want = rows(RT.text_topk(queries(spark), texts, 5))
    assert len(want) > 30
    assert rows(index.search(queries(spark), 5)) == want
    again = TextIndex(spark, str(tmp_path / "index"))
    assert rows(again.search(queries(spark).where("query_id = 7"), 5)) == [r for r in want if r[0] == 7]


def test_bounds_leave_blocks_out(spark, tmp_path):
    rows_of = [(f"d{k:05d}", "common word " * (1 + k % 3) + ("needle " * 3 if k % 400 == 7 else ""), None, None, None) for k in range(2000)]
    texts = spark.createDataFrame(rows_of, SCHEMA)
    index = TextIndex.build(texts, str(tmp_path / "index"), block=50)
    asked = spark.createDataFrame([(1, "needle common"), (2, "needle")], "query_id bigint, query string")
    got = index.search(asked, 2)
    assert rows(got) == rows(RT.text_topk(asked, texts, 2))
    all_pairs, scored = index.pairs
    assert all_pairs > 40 and scored <= 10


def test_one_term_reads_one_folder(spark, tmp_path):
    index = TextIndex.build(corpus(spark), str(tmp_path / "index"))
    assert index.postings().select("bucket").distinct().count() > 10
    found = index.postings_of(spark.createDataFrame([("rareword",)], "term string"))
    assert found.select("bucket").distinct().count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:60]


def test_empty_tables(spark, tmp_path):
    none = corpus(spark).limit(0)
    text, parts = TextIndex.build(none, str(tmp_path / "a")), SubstringIndex.build(none, str(tmp_path / "b"))
    assert rows(text.search(queries(spark), 3)) == [] and rows(parts.search(queries(spark), 3)) == []
    text = TextIndex.build(corpus(spark), str(tmp_path / "c"))
    assert rows(text.search(queries(spark).limit(0), 3)) == []


@pytest.mark.parametrize("min_chars", [1, 2])
def test_parts_of_words(spark, tmp_path, min_chars):
    texts = corpus(spark)
    index = SubstringIndex.build(texts, str(tmp_path / "index"), depth=7)
    want = rows(RT.keyword_match(queries(spark), texts, 7, min_chars=min_chars))
    assert len(want) > 40
    assert rows(index.search(queries(spark), 7, min_chars=min_chars)) == want
    with pytest.raises(ValueError, match="depth"):
        index.search(queries(spark), 8)


def test_only_words_with_the_rarest_sequence_are_tested(spark, tmp_path):
    texts = corpus(spark)
    index = SubstringIndex.build(texts, str(tmp_path / "index"))
    asked = spark.createDataFrame([("sses",), ("qqq",)], "word string")
    assert [tuple(r) for r in index.candidates(asked).collect()] == [("sses", "stresses")]
    plan = index.search(queries(spark), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan


def test_index_tables_are_not_moved_to_few_asked_words(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = SubstringIndex.build(corpus(spark), str(tmp_path / "index"), depth=7)
        asked = spark.createDataFrame([("sses",), ("a",)], "word string")
        plan = index.candidates(asked)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_words_that_begin_late_are_ruled_out(spark, tmp_path, monkeypatch):
    plans = {}

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().logical().toString()
        return materialize(df, name)

    monkeypatch.setattr(textindex, "materialize", kept)
    texts = spark.createDataFrame([(i, f"w{i}a same") for i in range(60)], "doc_id bigint, content string").selectExpr(
        "*", "'' AS title", "'' AS summary", "array('') AS keywords")
    index = SubstringIndex.build(texts, str(tmp_path / "index"), depth=7)
    asked = spark.createDataFrame([(1, "a"), (2, "5"), (3, "𝒳")], "query_id bigint, query string")
    found = index.search(asked, 7)
    assert rows(found) == rows(RT.keyword_match(asked, texts, 7))
    assert "dense_rank" in plans["first"]


def test_postings_are_not_moved_to_few_asked_terms(spark, tmp_path, monkeypatch):
    joins = {}

    def kept(df, name):
        joins[name] = df._jdf.queryExecution().executedPlan().toString()
        return materialize(df, name)

    index = TextIndex.build(corpus(spark), str(tmp_path / "index"))
    monkeypatch.setattr(textindex, "materialize", kept)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index.search(queries(spark), 3)
        assert "SortMergeJoin" not in joins["bounds"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
