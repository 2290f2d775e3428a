"""The inverted file against a full search."""

import numpy as np
import pytest

from quizmill.operators import retrieve as RT
from quizmill.operators.vectorindex import VectorIndex, _whole

VECTORS = "id string, embedding array<float>"


def clustered(n, dim, seed, near=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    return centres[rng.integers(0, 20, n)] + near * rng.normal(size=(n, dim))


def frames(spark, corpus, asked):
    odd = [("odd1", None), ("odd2", [0.0] * 8), ("odd3", [1.0, 2.0]), ("odd4", [])]
    docs = [(f"d{k:05d}", v.tolist()) for k, v in enumerate(corpus)] + odd
    queries = [(f"q{k}", v.tolist()) for k, v in enumerate(asked)] + odd
    c = spark.createDataFrame(docs, VECTORS).withColumnRenamed("id", "doc_id")
    return c, spark.createDataFrame(queries, VECTORS).withColumnRenamed("id", "query_id")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_blocks_of_lists():
    assert _whole(np.array([1, 1, 1, 1, 1, 2, 2, 3]), 2) == [2, 4, 5, 7]
    assert _whole(np.array([1, 1, 1]), 2) == [2] and _whole(np.array([1]), 2) == [] and _whole(np.array([], int), 2) == []


@pytest.mark.parametrize("near", [0.05, 3.0])
def test_answers_are_those_of_a_full_search(spark, tmp_path, near):
    corpus = np.vstack([clustered(900, 8, 1, near), np.tile(clustered(1, 8, 2), (60, 1))])
    docs, queries = frames(spark, corpus, np.vstack([clustered(25, 8, 1, near), corpus[-1:], -corpus[:1]]))
    index = VectorIndex.build(docs, str(tmp_path / "index"), 8, block=16)
    want = rows(RT.vector_topk(queries.where("size(embedding) = 8"), docs.where("size(embedding) = 8"), 7))
    assert len(want) == 27 * 7
    assert rows(index.search(queries, 7)) == want
    every, scored = index.pairs
    assert index.blocks().selectExpr("sum(size(docs))").first()[0] == 960
    assert scored <= every and (near > 1 or scored < 0.35 * every)
    # fewer vectors than asked for: all of them
    assert len(rows(VectorIndex(spark, str(tmp_path / "index")).search(queries.limit(1), 2000))) == 960


def test_empty_tables(spark, tmp_path):
    docs, queries = frames(spark, clustered(10, 8, 3), clustered(2, 8, 4))
    index = VectorIndex.build(docs.limit(0), str(tmp_path / "a"), 8)
    assert rows(index.search(queries, 3)) == []
    index = VectorIndex.build(docs, str(tmp_path / "b"), 8)
    assert rows(index.search(queries.limit(0), 3)) == []
