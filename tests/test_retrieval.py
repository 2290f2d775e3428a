"""Top-k by all three paths against brute force; pairing against sequential greedy."""

import math
import random
import re

import pytest

from quizmill.operators import matching
from quizmill.operators import retrieve as RT

PATHS = ["queries", "corpus", "blocks"]
WORDS = ["sun", "moon", "star", "sea", "été", "cloud", "wind", "rain", "Tree", "leaf"]


def vectors(rng, n, dim=4):
    return [(i, [rng.uniform(-1, 1) for _ in range(dim)]) for i in range(n)]


def cosine(a, b):
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / (na * nb)


@pytest.mark.parametrize("path", PATHS)
def test_vector_topk(spark, path, monkeypatch):
    rng = random.Random(5)
    q, c = vectors(rng, 7), vectors(rng, 60)
    extra = [(100, [0.0] * 4), (101, None), (102, [1.0, 2.0])]  # never match
    qd = spark.createDataFrame(q, "query_id bigint, embedding array<float>")
    cd = spark.createDataFrame(c + extra, "doc_id bigint, embedding array<float>").repartition(3)
    got = {}
    for r in RT.vector_topk(qd, cd, 5, force=path).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    for i, v in q:
        want = sorted(((round(cosine(v, w), 5), -j) for j, w in c), reverse=True)[:5]
        assert [d for _, d, _ in sorted(got[i])] == [-j for _, j in want]
        assert [round(s, 4) for *_, s in sorted(got[i])] == pytest.approx([s for s, _ in want], abs=1e-3)


def texts(rng, n, size):
    return [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, size)))) for i in range(n)]


def brute_bm25(q, c, k):
    tok = {i: re.findall(r"\w+", t.lower()) for i, t in c}
    mean = sum(map(len, tok.values())) / len(tok)
    out = {}
    for qid, text in q:
        scored = []
        for i, words in tok.items():
            s = 0.0
            for w in set(re.findall(r"\w+", text.lower())):
                df, tf = sum(w in t for t in tok.values()), words.count(w)
                if tf:
                    idf = math.log(1 + (len(tok) - df + 0.5) / (df + 0.5))
                    s += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
            if s > 0:
                scored.append((-round(s, 6), i))
        out[qid] = [i for _, i in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("path", PATHS)
def test_text_topk(spark, path):
    rng = random.Random(6)
    q, c = texts(rng, 5, 4), texts(rng, 40, 12)
    qd = spark.createDataFrame(q, "query_id bigint, query string")
    cd = spark.createDataFrame(c, "doc_id bigint, content string").repartition(3)
    got = {}
    for r in RT.text_topk(qd, cd, 6, fields=("content",), force=path).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got == brute_bm25(q, c, 6)


@pytest.mark.parametrize("path", PATHS)
def test_keyword_match(spark, path):
    rng = random.Random(7)
    q, c = texts(rng, 6, 2), texts(rng, 300, 3)
    qd = spark.createDataFrame(q, "query_id bigint, query string")
    cd = spark.createDataFrame(c, "doc_id bigint, content string").repartition(3)
    got = {}
    for r in RT.keyword_match(qd, cd, 4, fields=("content",), force=path).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    want = {
        i: [j for j, t in c if any(w in t.lower() for w in x.lower().split())][:4] for i, x in q
    }
    assert got == {i: v for i, v in want.items() if v}


@pytest.mark.parametrize("path", PATHS)
def test_similar_failures(spark, path):
    """Older memory wins a tie; the level alone is enough for a match; judges are kept apart."""
    items = [("i1", "evidence", "theory", "sun moon star"), ("i2", "safety", "emotion", "xyz")]
    memory = [
        (1, "evidence", "emotion", "sun moon star"), (2, "evidence", "theory", "sun moon star"),
        (3, "evidence", "theory", "sun moon star"), (4, "evidence", "theory", "other words"),
        (5, "safety", "emotion", "nothing"), (6, "safety", "theory", "nothing"),
    ]
    a = spark.createDataFrame(items, "item_id string, judge string, level string, question string")
    b = spark.createDataFrame(memory, "seq bigint, judge string, level string, question string")
    got = sorted((r["item_id"], r["rank"], r["seq"], r["score"]) for r in RT.similar_failures(a, b, force=path).collect())
    assert got == [("i1", 1, 2, 1.15), ("i1", 2, 3, 1.15), ("i1", 3, 1, 1.0), ("i2", 1, 5, 0.15)]


def greedy(rules, threshold):
    pairs = []
    for s in {r[1] for r in rules}:
        mine = sorted(r for r in rules if r[1] == s)
        edges = [
            (-(2 if a[2] == b[2] else round(cosine(a[2], b[2]), 6)), a[0], b[0])
            for i, a in enumerate(mine) for b in mine[i + 1:]
        ]
        used = set()
        for score, a, b in sorted(edges):
            if -score >= threshold and not {a, b} & used:
                used |= {a, b}
                pairs.append((s, a, b))
    return sorted(pairs)


@pytest.mark.parametrize("local", [200_000, 0])
def test_similar_pairs(spark, local, monkeypatch):
    monkeypatch.setattr(matching, "LOCAL_ROWS", local)
    rng, rules, i = random.Random(8), [], 0
    for section in range(4):
        base = [[float(rng.randint(-3, 3)) or 1.0 for _ in range(3)] for _ in range(9)]
        for v in base + base[:3] + base[:2] + [base[0]] * 2:  # copies, some in odd numbers
            i += 1
            rules.append((i, section, v))
    df = spark.createDataFrame(rules, "rule_id bigint, section int, embedding array<double>")
    got = matching.similar_pairs(df, threshold=0.5, depth=2)
    assert sorted((r["section"], r["left_id"], r["right_id"]) for r in got.collect()) == greedy(rules, 0.5)


def test_refused_pair_leaves_both_free(spark):
    """1-2 is closest but was not approved: 1 and 2 still pair with others."""
    approved = spark.createDataFrame(
        [("s", 1, 3, 0.95), ("s", 2, 4, 0.93), ("s", 3, 4, 0.9), ("s", 5, 6, 0.5)],
        "section string, left_id bigint, right_id bigint, score double",
    )
    got = matching.similar_pairs(None, approved=approved)
    assert sorted((r["left_id"], r["right_id"]) for r in got.collect()) == [(1, 3), (2, 4)]
    best = matching.similar_pairs(None, approved=approved, max_pairs=1).collect()
    assert [(r["left_id"], r["right_id"]) for r in best] == [(1, 3)]


def test_shared_words_of_a_wide_vocabulary(monkeypatch):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from quizmill.operators.topk import WordOverlap

    rng = np.random.default_rng(5)

    def texts(n, most, vocabulary):
        rows = [np.unique(np.minimum(rng.zipf(1.2, rng.integers(0, most)) + rng.integers(0, 2), vocabulary)) for _ in range(n)]
        return pa.table({"words": pa.array([[f"w{x}" for x in r] for r in rows], pa.list_(pa.string())), "level": ["a"] * n})

    kernel = WordOverlap()
    q, c = texts(60, 40, 300), texts(90, 40, 300)
    want = [[len(set(a) & set(b)) for b in c["words"].to_pylist()] for a in q["words"].to_pylist()]
    for dense, hits in ((256, 4_000_000), (3, 50), (0, 1)):
        monkeypatch.setattr(WordOverlap, "DENSE", dense)
        monkeypatch.setattr(WordOverlap, "HITS", hits)
        assert kernel.common(kernel.side(q), kernel.side(c)).tolist() == want
    monkeypatch.undo()
    # 200,000 words: as a table of rows and words the queries alone would be 1.6 GB
    wide = [pa.table({"words": pa.array([[f"w{x}" for x in np.unique(rng.integers(0, 200_000, 300))] for _ in range(n)]), "level": ["a"] * n}) for n in (2048, 1900)]
    sides = [kernel.side(t) for t in wide]
    tracemalloc.start()
    kernel.score(*sides)
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


def test_several_judges_of_an_item(spark):
    from pyspark.sql import functions as F

    from quizmill.operators import retrieve as RT

    memory = spark.createDataFrame(
        [(1, "e", "x", "red green blue"), (2, "e", "y", "red green"), (3, "b", "x", "blue blue sky"), (4, "e", "x", "none at all")],
        "seq bigint, judge string, level string, question string",
    )
    items = spark.createDataFrame(
        [("i|1", "x", "red blue green", ["e", "b"]), ("i2", "y", None, ["e"]), ("i3", "x", "sky", [])],
        "item_id string, level string, question string, judges array<string>",
    )
    long = items.withColumn("judge", F.explode("judges")).drop("judges").withColumn("item_id", F.concat_ws("#", "item_id", "judge"))
    want = sorted((*r["item_id"].split("#"), r["seq"], r["score"], r["rank"]) for r in RT.similar_failures(long, memory).collect())
    got = RT.similar_failures(items, memory).select("item_id", "judge", "seq", "score", "rank").collect()
    assert sorted(tuple(r) for r in got) == want and len(want) > 4


def test_unused_anchors_up_to_a_third_of_the_corpus(spark):
    from pyspark.sql import functions as F

    from quizmill.operators import retrieve as RT

    docs = spark.range(3000).selectExpr("concat('c', id) AS chunk_id", "id % 7 AS source").repartition(7)
    used = docs.where("source = 3").select("chunk_id").union(docs.where("source = 3").select("chunk_id"))
    free = sorted((r["o"], r["chunk_id"]) for r in docs.where("source <> 3").select(F.md5("chunk_id").alias("o"), "chunk_id").collect())
    for n in (0, 1, 1000, 5000):
        got = RT.sample_unused(docs, used, n, order=F.md5("chunk_id"))
        assert sorted(r["chunk_id"] for r in got.collect()) == sorted(c for _, c in free[:n])
        assert got.columns == ["chunk_id", "source"]
    assert RT.sample_unused(docs.limit(0), used, 5).count() == 0


@pytest.mark.parametrize("path", PATHS)
def test_a_table_searched_for_its_own_rows(spark, path):
    """Also in blocks, where both sides are shuffled."""
    from quizmill.storage import materialize

    rows = [(i, i % 3, v) for i, v in vectors(random.Random(9), 40)]
    table = materialize(spark.createDataFrame(rows, "id bigint, section bigint, embedding array<float>"), "own")
    found = RT.vector_topk(
        table.withColumnRenamed("id", "node"), table.withColumnRenamed("id", "partner"), 1, "node", "partner", group="section", force=path
    )
    assert sorted((r["node"], r["partner"]) for r in found.collect()) == [(i, i) for i in range(40)]


def test_blocks_meet_within_their_groups_only(spark):
    """A judge's memories are copied for the blocks of that judge's questions alone."""
    from pyspark.sql import functions as F

    from quizmill.operators import topk

    # four groups in buckets of their own
    names = spark.range(60).selectExpr("concat('g', id) AS group").withColumn("b", F.pmod(F.xxhash64("group"), F.lit(topk.BUCKETS)).cast("int"))
    names = [r["group"] for r in names.groupBy("b").agg(F.min("group").alias("group")).orderBy("b").limit(4).collect()]
    group = F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 4 + 1).cast("int"))
    side = spark.range(400).select("id", group.alias("group"), F.array(F.lit("sun"), F.col("id").cast("string")).alias("words"))
    bucket = F.pmod(F.xxhash64("group"), F.lit(topk.BUCKETS)).cast("int")
    plan = topk._blocks(
        side.withColumn("_bucket", bucket), side.where(F.col("group") != names[0]).withColumn("_bucket", bucket), 50
    )
    assert sorted(n for _, *n in plan) == [[2, 2]] * 3


def test_texts_of_evidence_join_after_the_choice(spark):
    items = spark.createDataFrame([(1, "theory", 2), (2, "clinical_scenario", 3)], "query_id bigint, level string, evidence_limit int")
    pages = spark.createDataFrame([(f"c{i}", "  " if i == 2 else f"text {i}") for i in range(8)], "chunk_id string, page_content string")
    rows = [(q, f"c{i}", "tier_1", "tier_1", "textbook", 1.0 / (i + 1), i + 1) for q in (1, 2) for i in range(6)]
    kind = "query_id bigint, chunk_id string, tier string, source_tier string, source_kind string, score double, rank bigint"
    found, reserved = spark.createDataFrame(rows, kind), spark.createDataFrame([(2, "c7", "tier_1", "tier_1", "dsm5", 0.5, 1)], kind)
    want = RT.compose_evidence(items, reserved.join(pages, "chunk_id"), found.join(pages, "chunk_id"))
    got = RT.compose_evidence(items, reserved, found, pages=pages)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert [r["chunk_id"] for r in got.orderBy("query_id", "rank").collect()] == ["c0", "c1", "c7", "c0", "c1"]
