"""Token counts against the tokenizers library."""

import random
import sys
from collections import Counter
from pathlib import Path

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))

from odd_rows import TEXTS, docs, words  # noqa: E402

from quizmill.llm import counts  # noqa: E402

PATH = P.path(counts.BYTE_BPE)
LIBRARY = Tokenizer.from_file(PATH)
PIECES = [
    "<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "\t", "\r\n", "'s", "'S", "don't", "'ll", "\x1c", "\x85", "\xa0",
    "࢏", "՘", "\U000323b0", "a" * 50, "é", "日本語", "🙂", "１", "½", "​", "ß", "Ǆ", ".", "..", "12", " the",
]


def by_library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def test_rows(spark):
    texts = [*TEXTS, (100, "x<|endoftext|> y <|endoftext|><|endoftext|>\n"), (101, " ".join(words(1500, 5)))]
    got = counts.count_tokens(docs(spark, texts)).collect()
    want = Counter((i, len((t or "").encode()), by_library(t), by_library(t) > 1024) for i, t in texts)
    assert Counter(tuple(r) for r in got) == want
    assert any(r.over_limit for r in got) and not all(r.over_limit for r in got)
    assert counts.count_tokens(docs(spark, [])).count() == 0


def test_odd_characters():
    pick, count = random.Random(3), counts.counter(PATH).count
    for _ in range(4000):
        odd = [chr(pick.choice([pick.randrange(0xD800), pick.randrange(0xE000, 0x110000)])) for _ in range(3)]
        text = "".join(pick.choices(PIECES + odd, k=pick.randrange(14)))
        assert count(text) == by_library(text), repr(text)


def test_long_words_and_a_full_table(monkeypatch):
    pick, counter = random.Random(4), counts.Counter(PATH)
    for text in ["".join(pick.choices("abeth", k=20_000)), "a" * 30_001, "=" * 9_999, "é" * 5_000]:
        assert counter.count(text) == by_library(text)
    monkeypatch.setattr(counts, "KNOWN", 10)
    for seed in range(20):
        text = " ".join(words(40, seed))
        assert counter.count(text) == by_library(text)


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        counts.Counter(P.path("word_bpe_49k.json"))
