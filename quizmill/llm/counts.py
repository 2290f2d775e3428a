"""Token counts of whole texts by byte-pair merging, without making ids.

A word (a match of the byte-level pattern) begins as one symbol a byte, in a linked list. A heap holds the
ranks of its neighbouring pairs; the pair of least rank, the leftmost of equal ones, is popped and merged
until no pair of the merge table is left. A word's count is its bytes less its merges; a text's count is
the sum over its words. Strings of the file's added tokens are cut out first and count as one token each,
as the tokenizers library does unless told otherwise.

Words already met in this worker are looked up; the table is emptied between texts once it holds ``KNOWN``
words, which bounds memory and changes no result. A word of n bytes takes some 100 n bytes while its pairs
are merged.

Defined results: a null or empty text has no bytes and no tokens; rows with a null id, repeated rows and
an empty table pass through. Only the id and the text are read. Bytes that are not UTF-8 count as the
replacement character.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

from quizmill.llm.tokens import _byte_letters

BYTE_BPE = "byte_bpe_50k.json"
KNOWN = 500_000
LIMIT = 1024


def _newer(cls: str) -> frozenset[str]:
    """Letters and numbers of ``regex`` that an older Unicode table of the library does not have."""
    drop = normalizers.Replace(Regex(f"[{cls}]"), "")
    found: set[str] = set()
    for a in range(0, 0x110000, 8192):
        block = "".join(chr(c) for c in range(a, a + 8192) if not 0xD800 <= c < 0xE000)
        left, own = drop.normalize_str(block) if block else "", regex.sub(f"[{cls}]", "", block)
        if left != own:
            found |= set(left) ^ set(own)
    return frozenset(found)


class Counter:
    """Counts by one tokenizers file of the byte-level kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (
            model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True)
            and not split["add_prefix_space"] and not spec.get("normalizer") and not model.get("ignore_merges")
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
            and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
        )
        vocab = model["vocab"]
        self.byte = [vocab.get(x) for x in _byte_letters()]
        if not plain or None in self.byte:
            raise ValueError(f"{path}: only plain byte-level BPE files are counted by merging")
        #: (left id << 32) + right id to rank << 32, and the id that each rank makes.
        self.merges: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[a] << 32) + vocab[b], rank << 32)
            self.made.append(vocab[a + b])
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.newer = _newer(r"\p{L}\p{N}")
        self.maybe_newer = re.compile(f"[{min(self.newer, default=chr(0x10FFFF))}-\U0010ffff]").search
        self.known: dict[str, int] = {}

    def merge(self, word: bytes) -> int:
        """The number of tokens of one word."""
        rank_of, made = self.merges.get, self.made
        ids = list(map(self.byte.__getitem__, word))
        n = len(ids)
        heap = []
        for k in range(n - 1):
            rank = rank_of((ids[k] << 32) + ids[k + 1])
            if rank is not None:
                heap.append(rank + k)
        heapify(heap)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        merged = 0
        while heap:
            top = heappop(heap)
            k = top & 0xFFFFFFFF
            j = after[k]
            # a pair that has changed since it was pushed has another rank or none
            if j < 0 or ids[k] < 0 or rank_of((ids[k] << 32) + ids[j]) != top - k:
                continue
            merged += 1
            own = made[top >> 32]
            ids[k], ids[j] = own, -1
            j = after[k] = after[j]
            if j >= 0:
                before[j] = k
                rank = rank_of((own << 32) + ids[j])
                if rank is not None:
                    heappush(heap, rank + k)
            i = before[k]
            if i >= 0:
                rank = rank_of((ids[i] << 32) + own)
                if rank is not None:
                    heappush(heap, rank + i)
        return n - merged

    def words(self, text: str) -> list[str]:
        if not text.isascii() and self.maybe_newer(text) and not self.newer.isdisjoint(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.find(text)

    def count(self, text: str) -> int:
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        parts, total = [text], 0
        if self.added is not None and self.added.search(text):
            parts = self.added.split(text)
            total = len(parts) - 1
        for part in parts:
            words = self.words(part)
            try:
                total += sum(map(known.__getitem__, words))
            except KeyError:
                for word in set(words).difference(known):
                    known[word] = self.merge(word.encode())
                total += sum(map(known.__getitem__, words))
        return total


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """This worker's counter; later tasks of the worker find the words of earlier ones."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; no shuffle."""
    path = path or public_tokenizers.path(BYTE_BPE)
    schema = T.StructType(
        [docs.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            sizes, found = [], []
            for value in batch.column(1):
                raw = value.as_buffer()
                data = raw.to_pybytes() if raw is not None else b""
                sizes.append(len(data))
                found.append(count(data.decode("utf-8", "replace")) if data else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.int64())], names=schema.names
            )

    counted = docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(run, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op11_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
