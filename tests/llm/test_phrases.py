"""Collocations against counts of every phrase."""

import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).parent))

from odd_rows import TEXTS, words  # noqa: E402

from quizmill.llm import phrases  # noqa: E402

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ("shard", "hash", "n", "phrase", "width", "score", "rank")]
)
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, support=10, longest=3, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(SMALL)):
            ws = re.findall(r"[^ \t]+", piece)
            n[lang] += len(ws)
            for w in range(1, longest + 1):
                f[lang].update(tuple(ws[i : i + w]) for i in range(len(ws) - w + 1))
    out = []
    for lang, counts in f.items():
        found = {p: c for p, c in counts.items() if len(p) > 1 and c >= support}
        rows_of = []
        for p, a in found.items():
            around = [c for q, c in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * c >= 50 * a for c in around):
                continue
            score, _, le, r = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows_of.append((-score, -a, " ".join(p).encode(), le, r))
        for rank, (score, a, p, le, r) in enumerate(sorted(rows_of)[:top], 1):
            out.append((lang, rank, p.decode(), -a, le, r, n[lang], -score))
    return Counter(out)


def texts(seed, n):
    pick, out = random.Random(seed), []
    common = words(12, seed)
    for k in range(n):
        some = [pick.choice(common) if pick.random() < 0.8 else w for w in words(pick.randrange(60), seed * 1000 + k)]
        for at in range(0, len(some) - 1, 9):
            some[at] += pick.choice([",", ".", "\n", "!", "", " \t", "\x0b", "\x1c", "\xa0"])
        out.append((k, " ".join(some), pick.choice(["en", "en", None, "", "de"])))
    return out


ODD = [(i, t, "xx") for i, t in TEXTS] + [(k, "A b A b A b, a B\ta b a  B a;b", None) for k in (1, 1, None, None)] + [
    (50, "hot pair " * 3000, "en"), (51, None, None), (52, "é É é É ß ẞ " * 6, "fr"), *((60 + k, "New York City", "en") for k in range(12)),
    *((80 + k, "New York", "en") for k in range(9)),
]


def found(spark, rows, **how):
    return Counter(tuple(r) for r in phrases.collocations(spark.createDataFrame([(*r, *[7] * 7) for r in rows], SCHEMA), **how).collect())


def test_phrases(spark, monkeypatch):
    rows = texts(1, 150) + ODD
    want = by_hand(rows)
    assert len(want) > 50 and ("en", "new york") not in {(r[0], r[2]) for r in want}
    assert found(spark, rows) == want
    # the bounds on memory change nothing
    monkeypatch.setattr(phrases, "CHUNK", 300)
    monkeypatch.setattr(phrases, "HELD", 40)
    assert found(spark, rows, bits=10) == want


@pytest.mark.parametrize("how", [{"longest": 2, "shards": 1}, {"longest": 4, "support": 4, "shards": 7, "top": 40}])
def test_other_parameters(spark, how):
    rows = texts(2, 100)
    assert found(spark, rows, **how) == by_hand(rows, **{k: v for k, v in how.items() if k != "shards"})


def test_nothing_to_find(spark):
    assert not found(spark, [])
    assert not found(spark, [(1, None, None), (2, " . ", "en"), (3, "only once", "en")])


def test_scores_past_64_bits(spark):
    big = 9_000_000_000_000
    rows = [("en", "a b", 2, big), ("en", "a", 1, big + 7), ("en", "b", 1, big * 3)]
    counted = spark.createDataFrame(rows, "lang string, phrase string, width int, n long")
    total = spark.createDataFrame([("en", 5 * big)], "lang string, total long")
    (row,) = phrases.rank(counted, total, 3, 10).collect()
    assert row.score == 1000000 * big * big // ((big + 7) * big * 3) and row.n == 5 * big


def test_parts_cut_between_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(phrases, "CHUNK", 20)
    text = b"one two. three four five six seven eight nine ten; eleven\n" * 5 + b"x" * 100
    parts = list(phrases._parts(pa.array(["en"]), pa.array([text], pa.binary())))
    assert len(parts) > 5 and sum(len(p.hashes) for p in parts) == 56
    assert np.unique(np.concatenate([p.phrases(2)[1][p.phrases(2)[0]] for p in parts if len(p.hashes) > 1])).size == 8
