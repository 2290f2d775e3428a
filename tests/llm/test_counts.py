"""Operators on single texts: BPE, toxicity, quality, token files and packing."""

import hashlib
import re
import sys
import zlib
from collections import Counter
from itertools import pairwise
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))

from odd_rows import TEXTS, docs, words  # noqa: E402

from quizmill.llm import bpe, packing, quality, rans, tokens, toxicity  # noqa: E402


def ids_of(text):
    t = Tokenizer.from_file(tokens.default_path())
    return [*t.encode(text or "", add_special_tokens=False).ids, tokens.END_ID]


def test_bpe_is_tiktoken(spark):
    worker = bpe.worker(P.path(bpe.RANKS), P.PATTERN)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=worker.ranks, special_tokens={})
    got = bpe.decode(bpe.encode(docs(spark))).collect()
    assert len(got) == len(TEXTS)
    want = Counter((i, tuple(own.encode_ordinary(t or "")), (t or "").encode()) for i, t in TEXTS)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.decoded)) for r in got) == want
    assert bpe.encode(docs(spark, [])).count() == 0


def test_bpe_long_and_short_words_agree():
    worker = bpe.worker(P.path(bpe.RANKS), P.PATTERN)
    for word in ["theatres", "aaaaaaaaab", "Straßenbahn", "ouououououthth", "x" * 63]:
        worker.known.clear()
        worker.learn([word])
        if word.encode() not in worker.ranks:
            assert np.frombuffer(worker.known[word], "<u4").tolist() == worker.contract(word.encode())


def test_bpe_of_long_texts_and_many_long_words():
    worker = bpe.worker(P.path(bpe.RANKS), P.PATTERN)
    ids = np.random.default_rng(1).integers(0, 256, 9_000_000)
    letters = [bytes([b]) for b in range(256)]
    coded = np.array([worker.ranks[x] for x in letters], "<u4")[ids].tobytes()
    assert worker.decode([coded[:8], b"", coded, coded[-12:]]) == [bytes(x.astype(np.uint8)) for x in (ids[:2], ids[:0], ids, ids[-3:])]
    many = ["".join(words(30, k))[:60] for k in range(6000)]
    many = sorted({w for w in many if len(w.encode()) <= bpe.LONG})
    worker.known.clear()
    worker.learn(many)
    for w in many[::100]:
        assert np.frombuffer(worker.known[w], "<u4").tolist() == worker.contract(w.encode())


@pytest.mark.parametrize("text", ["a\x1cb c", "it's DON'T 's", "a\xa0b ﬁ ３４ Ⅷ½", "<|endoftext|>x", "a<|startoftext|>B <|endoftext|><|endoftext|>\n< |endoftext|>", "<|EndOfText|> <|endoftext", "\x00 \x85 é́", "İSTANBUL, ΣΑΣ. Straße, Ǆ. ªº. x.y, 's.", ""])
def test_words_have_the_ids_of_whole_texts(text):
    got = np.frombuffer(tokens.encoder(tokens.default_path()).ids(text.encode()), "<u4").tolist()
    assert got == ids_of(text)


def test_token_files(spark, tmp_path):
    path = str(tmp_path / "files")
    rans.write(docs(spark), path)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in rans.read(spark, path).collect())
    names = [r[1] for r in got]
    assert names == sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i or 0))
    assert all(a[0] + a[2] == b[0] for a, b in pairwise(got)) and got[0][0] == 0
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ((i, ids_of(t)) for i, t in TEXTS))
    assert Counter(r[1:] for r in got) == want


def test_ids_are_counted_where_they_are_made(spark):
    some = docs(spark).repartition(3)
    made = rans.tokenized(some, "doc_id", "text", tokens.default_path(), tokens.END_ID)
    rows = made.where("ids IS NOT NULL").collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in some.collect())
    want = np.bincount(np.concatenate([np.frombuffer(bytes(r.ids), "<u2") for r in rows]))
    got = {r.id: r.n for r in rans._counts(made).collect()}
    assert got == {int(i): int(want[i]) for i in np.flatnonzero(want)}


def test_token_files_of_an_empty_table(spark, tmp_path):
    rans.write(docs(spark, []), str(tmp_path / "files"))
    assert rans.read(spark, str(tmp_path / "files")).count() == 0


def test_rans_round_trip_and_checkpoints(monkeypatch):
    monkeypatch.setattr(rans, "LANES", 16)
    monkeypatch.setattr(rans, "SEGMENT", 16 * 8)
    pick = np.random.default_rng(3)
    for n in (0, 1, 15, 16, 17, 128, 129, 1000):
        ids = np.minimum(pick.zipf(1.4, n), 300)
        counts = np.bincount(ids, minlength=2)
        freq = rans.shares(counts)
        assert ((freq > 0) == (counts > 0)).all() and (not n or freq.sum() == 1 << rans.SCALE)
        coder = rans.Coder(freq)
        payload = coder.encode(ids)
        assert (coder.decode(payload) == ids).all()
        for k in range(n // 128):
            assert (coder.decode(payload, k, 1) == ids[128 * k : 128 * (k + 1)]).all()


def test_damaged_block_is_noticed(spark, tmp_path):
    path = str(tmp_path / "files")
    rans.write(docs(spark), path)
    blocks = spark.read.parquet(f"{path}/blocks").withColumn("crc32", quality.F.col("crc32") + 1)
    blocks.write.parquet(str(tmp_path / "bad" / "blocks"))
    spark.read.parquet(f"{path}/freq").write.parquet(str(tmp_path / "bad" / "freq"))
    with pytest.raises(Exception, match="damaged block"):
        rans.read(spark, str(tmp_path / "bad")).count()


def test_packing(spark):
    rows = TEXTS + [(100 + k, " ".join(words(k * 7 % 900, k))) for k in range(60)]
    got = packing.pack(docs(spark, rows)).collect()
    assert sum(r.length for r in got) == sum(len(ids_of(t)) for _, t in rows)
    for name in {i for i, _ in rows} - {19}:
        ids = ids_of(dict(rows)[name])
        own = sorted((r for r in got if r.doc_id == name), key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist()
        assert all(r.doc_tokens == len(ids) for r in own) and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    sequences = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= packing.CAPACITY
    assert len(sequences) <= sum(sequences.values()) / packing.CAPACITY + 3
    assert packing.pack(docs(spark, [])).count() == 0


def test_patterns_hold_every_piece_with_little_waste():
    lengths = list(range(32, 4096, 32))
    demand = [1 + k * 37 % 101 for k in range(len(lengths))]
    found = packing.patterns(lengths, demand, 4096)
    made = sum(n * column for n, column in found)
    assert made.tolist() == demand
    assert all((column * np.array(lengths)).sum() <= 4096 for _, column in found)
    bound = -(-sum(a * b for a, b in zip(lengths, demand, strict=True)) // 4096)
    assert sum(n for n, _ in found) <= bound * 1.02 + 2


def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    return *base, len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality_counts(spark):
    more = [(50, "a b c a b c a b"), (51, "a a a a"), (52, "#x $y\nx\n \nx\n"), (53, "x y z " * 30)]
    got = quality.label(docs(spark, TEXTS + more)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r.doc_id, *(r[c] for c in names)) for r in got) == Counter((i, *brute_quality(t)) for i, t in TEXTS + more)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.label(docs(spark, [])).count() == 0


def test_quality_verdict_follows_the_rules(spark):
    def prose(k):
        w = words(120, k)
        return ". ".join(" ".join(w[i : i + 9]).capitalize() for i in range(0, 120, 9)) + "."

    good = [(k, prose(k)) for k in range(60)]
    bad = [(100 + k, prose(k).replace(" ", "### ")) for k in range(8)]
    got = {r.doc_id: r.kept for r in quality.label(docs(spark, good + bad)).collect()}
    assert all(got[i] for i, _ in good) and not any(got[i] for i, _ in bad)


def test_segments_are_the_maximal_ones():
    def brute(x):
        """Split at the best segment, on both sides, again and again."""
        best = max(
            ((sum(x[a:b]), -(b - a), -a, a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1)), default=None
        )
        if best is None or best[0] <= 0:
            return []
        _, _, _, a, b = best
        return [(k, j, s) for k, j, s in brute(x[:a])] + [(a, b - 1, best[0])] + [(k + b, j + b, s) for k, j, s in brute(x[b:])]

    pick = np.random.default_rng(1)
    for _ in range(200):
        n = int(pick.integers(0, 14))
        x = np.where(pick.random(n) < 0.4, pick.integers(1, 9, n) + pick.random(n), toxicity.GAP)
        given = [(k, float(v)) for k, v in enumerate(x) if v != toxicity.GAP]
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.segments(given)]
        assert got == [(a, b, round(s, 6)) for a, b, s in brute(x.tolist())]


def test_every_occurrence_is_scored():
    model = toxicity.Model(odds={"vilest ": 3.0, "grubling ": 4.0})
    filler = ["word"] * 50
    text = " ".join(["vilest", *filler, "vilest", "grubling", *filler, "grubling", *filler, *["vilest", "grubling"] * 5])
    n, found = toxicity.Scanner(model).scan(text)
    assert n == 164 and found == [(0, 0, 3.0), (51, 52, 7.0), (103, 103, 4.0), (154, 163, 35.0)]
    assert toxicity.Scanner(model).scan(" ".join(["vilest"] * 50)) == (50, [(0, 49, 150.0)])


def test_toxicity_learns_and_finds(spark):
    def text(k, bad):
        w = words(60, k)
        if bad:
            w[10], w[40] = "vilest", "grubling"
        return " ".join(w)

    rows = [(k, text(k, k % 4 == 0)) for k in range(160)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in rows if k < 120], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows), labels)
    got = toxicity.score(docs(spark, rows + TEXTS), model).collect()
    scores = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id >= 120}
    assert all((scores[k].score >= 0.5) == (k % 4 == 0) for k in range(120, 160))
    found = scores[120].passages
    assert any("vilest" in scores[120].text.lower()[p.start : p.end] for p in found)
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows) + len(TEXTS)
    empty = [r.score for r in got if not (r.text or "").strip()]
    assert max(empty) == min(empty) == min(r.score for r in got)
    assert toxicity.score(docs(spark, []), model).count() == 0


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark), none)
    assert {r.score for r in toxicity.score(docs(spark), model).collect()} == {0.0}


def test_held_out_fold(spark):
    rows = docs(spark, [(k, "") for k in range(50)]).select("doc_id", toxicity.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_hashes_of_bytes(spark):
    got = bpe.decode(bpe.encode(docs(spark, [(1, "é\n")]))).select(quality.F.sha2("decoded", 256).alias("s")).first()
    assert got.s == hashlib.sha256("é\n".encode()).hexdigest()


def test_words_survive_a_full_table():
    coder = tokens.Encoder(tokens.default_path(), limit=40)
    for seed in range(60):
        text = " ".join(words(30, seed % 7) + words(5, seed)) + " <|endoftext|>, end."
        assert np.frombuffer(coder.ids(text.encode()), "<u4").tolist() == ids_of(text)
        assert len(coder.words) <= 40 + 60 and len(coder.words.older[0]) <= 40 + 60


def test_bpe_takes_older_words_back(monkeypatch):
    """A full table becomes the older one: frequent words are not learned again, ids stay the same."""
    worker = bpe.Bpe(P.path(bpe.RANKS), P.PATTERN)
    monkeypatch.setattr(bpe, "KNOWN", 50)
    learned, learn = [], worker.learn
    monkeypatch.setattr(worker, "learn", lambda words: (learned.extend(words), learn(words)))
    texts = [" often met" + "".join(f" w{k}x{j}" for j in range(20)) for k in range(20)]
    got = [worker.encode([t])[0] for t in texts]
    assert learned.count(" often") == learned.count(" met") == 1
    assert len(worker.known) + len(worker.older) <= 2 * (50 + 100)
    assert got == bpe.Bpe(P.path(bpe.RANKS), P.PATTERN).encode(texts)
