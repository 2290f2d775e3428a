"""The conversation trie against a walk over explicit prefixes."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizmill.llm import trie
from quizmill.llm.chains import run_along

SCHEMA = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("conv_id", "turn")]
    + [T.StructField(c, T.StringType()) for c in ("role", "text")]
    + [T.StructField(c, T.LongType()) for c in ("depth", "x", "pos", "_part", "size", "first")]
)


def by_hand(rows):
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            talks[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in talks.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + ts[h:]
    members, kids, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c in sorted(rebuilt):
        ts = tuple(rebuilt[c])
        ends[ts].append(str(c))
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
            if d:
                kids[ts[: d - 1]].add(ts[:d])
    out = []
    for node, own_members in members.items():
        below = [n for n in members if n[: len(node)] == node]
        out.append((
            own_members[0], len(node), members[node[:-1]][0] if node else None, len(own_members), len(kids[node]),
            sum(not kids[n] for n in below), sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n),
            hashlib.sha256(",".join(ends[node]).encode()).hexdigest(),
        ))
    return Counter(out)


def some(seed, n):
    """Conversations that share much: few texts, copies, gaps in the ids, odd values."""
    pick, rows, last = random.Random(seed), [], []
    for c in pick.sample(range(3 * n), n):
        if last and pick.random() < 0.4:
            talk = last[: pick.randrange(len(last) + 1)] + [("user", "more é")] * pick.randrange(3)
        else:
            talk = [(pick.choice(["user", "assistant", None, ""]), pick.choice(["hi", "ho ho", None, "", "ü"])) for _ in range(pick.randrange(1, 13))]
        last = talk
        for k, (role, text) in enumerate(talk):
            rows.append((c, None if k == 0 and c % 2 else k, role, text))
    pick.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[7] * 6) for r in rows], SCHEMA)


def found(spark, rows):
    return Counter(tuple(r) for r in trie.nodes(*trie.rebuild(trie.turns(frame(spark, rows)))).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_small_tries(spark, seed):
    rows = some(seed, 60)
    assert found(spark, rows) == by_hand(rows)


def test_odd_rows(spark):
    rows = [
        (0, None, "user", "first"), (0, 0, None, None), (0, 0, "user", "tie"), (0, 0, "user", "tie"), (0, 0, "user", "a tie"),
        (1, 0, "user", "first"), (None, 0, "user", "nobody's"), (None, None, None, None), (7, 3, "user", "x" * 200_000),
        (8, 3, "user", "x" * 200_000), (9, -2, "user", "x"), (10, 5, "", ""), (11, 5, "", ""), (5, 1, "a", "bc"), (6, 1, "ab", "c"),
        *((20, k, "user", f"turn {k % 7}") for k in range(700)), *((c, k, "user", f"turn {k % 7}") for c in (21, 23, 25) for k in range(60)),
    ]
    assert found(spark, rows) == by_hand(rows)
    assert not found(spark, [])
    assert not found(spark, [(None, 1, "user", "x")])


def test_many_copies_have_one_list_of_ends(spark, monkeypatch):
    rows = [(c, k, "user", f"t{k}") for c in range(0, 15_000, 5) for k in range(2)]
    got = found(spark, rows)
    ids = ",".join(str(c) for c in range(0, 15_000, 5))
    assert (0, 2, 0, 3000, 0, 1, 2999 * 2, hashlib.sha256(ids.encode()).hexdigest()) in got and len(got) == 3
    monkeypatch.setattr(trie, "PIECE", 50)
    assert found(spark, rows) == got


def test_running_values_of_a_chain_over_many_tasks(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(5000).select(
            F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 40).alias("chain"), "id", (F.xxhash64("id") % 1000).alias("v")
        )
        got = run_along(rows.withColumn("w", F.col("v")), "chain", ["id"], {"v": "sum", "w": "xor"}, "test").collect()
        parts = run_along(rows, "chain", ["id"], {"v": "sum"}, "test")
        assert parts.count() == 5000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    values = {r.id: (r.chain, r.v) for r in rows.collect()}
    sums, xors = Counter(), Counter()
    want = {}
    for i in sorted(values):
        c, v = values[i]
        sums[c] += v
        xors[c] ^= v
        want[i] = (c, sums[c], xors[c])
    assert {r.id: (r.chain, r.v, r.w) for r in got} == want
