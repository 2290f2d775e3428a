"""Byte-level BPE, encoded and decoded by DuckDB queries inside Spark tasks.

A tokenizer's file gives the rank of every token's bytes. Its merge table has a row for every way to cut
a token into two tokens. A task splits texts by the tokenizer's pattern and sends the words that it
hasn't met yet, as rows of (word, position, id), into one recursive query: each step joins
neighbouring ids to the merge table and contracts every word's leftmost pair of least rank; words
without such a pair are done. Decoding joins ids to the tokens and aggregates them in order.

Words longer than ``LONG`` bytes, whose steps would each pass over all their positions, are contracted
pair by pair with a heap, in the same order. At ``KNOWN`` words the table of known words becomes the older one,
from which words that are met again are taken back; the one before goes.
Words go to queries by the rows that their steps may have, and ids are decoded in runs of ``RUN``, joined in
order, so a text may be of any length. All of these bound time and memory and change no result.

Defined results: a null or empty text has no ids and decodes to nothing; repeated rows and null ids of
rows pass through; an empty table gives an empty result. Only the id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANKS = "byte_bpe_multi_50k.tiktoken"
LONG = 64
KNOWN = 350_000
#: Words of one query, and bytes of text handled at a time.
WORDS, CHUNK = 40_000, 1_000_000
#: Rows that one query's steps may have, and ids that one query decodes; one word or id at least.
ROWS, RUN = 2_500_000, 500_000

#: ``spot``: word * 65536 + position; ``next``, ``after``: spot and id of the neighbour to the right.
CONTRACT = """
WITH RECURSIVE steps(step, spot, id, next, after) AS (
    SELECT 0, spot, id, next, after FROM letters
    UNION ALL
    SELECT s.step + 1, s.spot,
        CASE WHEN s.spot = p.spot THEN p.merged ELSE s.id END,
        CASE WHEN s.spot = p.spot THEN r.next ELSE s.next END,
        CASE WHEN s.spot = p.spot THEN r.after WHEN s.next = p.spot THEN p.merged ELSE s.after END
    FROM (
        SELECT spot >> 16 AS word, arg_min(spot, rank) AS spot, arg_min(next, rank) AS next,
            min(rank) >> 16 AS merged
        FROM (
            SELECT n.spot, n.next, m.merged * 65536 + (n.spot & 65535) AS rank
            FROM steps n JOIN merges m ON m.pair = n.id * 4294967296 + n.after
        ) GROUP BY 1
    ) p JOIN steps s ON s.spot >> 16 = p.word JOIN steps r ON r.spot = p.next
    WHERE s.spot <> p.next
)
SELECT word, list(id ORDER BY spot) AS ids
FROM (SELECT *, spot >> 16 AS word FROM steps)
    SEMI JOIN (SELECT spot >> 16 AS word, max(step) AS step FROM steps GROUP BY 1) USING (word, step)
GROUP BY word
"""
DECODE = """
SELECT text, string_agg(letters, '' ORDER BY place) AS decoded
FROM ids JOIN tokens USING (id) GROUP BY text
"""


class Bpe:
    """Encoder and decoder of one worker."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            lines = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.byte = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs, merged = [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs.append((left << 32) + right)
                    merged.append(rank)
        self.db = duckdb.connect(
            config={"threads": 1, "memory_limit": "200MB", "temp_directory": "", "preserve_insertion_order": False}
        )
        self.fill("merges", {"pair": pairs, "merged": merged})
        self.fill("tokens", {
            "id": list(self.ranks.values()), "letters": [t.decode("latin-1") for t in self.ranks],
        })

    def fill(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        by_query = []
        for word, data in zip(words, raw, strict=True):
            whole = self.ranks.get(data)
            if whole is not None:
                self.known[word] = whole.to_bytes(4, "little")
            elif len(data) > LONG:
                self.known[word] = b"".join(i.to_bytes(4, "little") for i in self.contract(data))
            else:
                by_query.append((word, data))
        for part in self.parts(by_query):
            sizes = np.array([len(d) for _, d in part])
            word = np.repeat(np.arange(len(part)), sizes)
            spot = (word << 16) + np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            ids = self.byte[np.frombuffer(b"".join(d for _, d in part), np.uint8)]
            last = np.append(word[1:] != word[:-1], True)
            self.fill("letters", {
                "spot": spot, "id": ids, "next": pa.array(np.append(spot[1:], 0), mask=last),
                "after": pa.array(np.append(ids[1:], 0), mask=last),
            })
            got = self.db.sql(CONTRACT).to_arrow_table().combine_chunks()
            lists = got.column("ids").chunk(0)
            values, ends = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
            for k, w in enumerate(got.column("word").to_pylist()):
                self.known[part[w][0]] = values[ends[k] : ends[k + 1]].tobytes()

    def parts(self, words: list[tuple[str, bytes]]) -> Iterator[list[tuple[str, bytes]]]:
        """Words in lists for one query each: a word of n bytes has up to n rows, then one less a step."""
        part, rows = [], 0
        for word in words:
            n = len(word[1])
            own = n * (n + 1) // 2
            if part and (len(part) >= WORDS or rows + own > ROWS):
                yield part
                part, rows = [], 0
            part.append(word)
            rows += own
        if part:
            yield part

    def contract(self, data: bytes) -> list[int]:
        """The same contraction of one long word, by a heap of (rank, place)."""
        ids = [int(self.byte[b]) for b in data]
        n = len(ids)
        span = [data[k : k + 1] for k in range(n)]
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap: list[tuple[int, int, bytes]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] >= 0:
                both = span[k] + span[after[k]]
                rank = self.ranks.get(both)
                if rank is not None:
                    heapq.heappush(heap, (rank, k, both))

        for k in range(n):
            offer(k)
        while heap:
            rank, k, both = heapq.heappop(heap)
            j = after[k] if ids[k] >= 0 else -1
            if j < 0 or span[k] + span[j] != both:
                continue
            ids[k], span[k], ids[j] = rank, both, -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            offer(before[k])
            offer(k)
        return [i for i in ids if i >= 0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as unsigned 32-bit little-endian bytes."""
        split = [self.find(t) for t in texts]
        if len(self.known) > KNOWN:
            self.known, self.older = {}, self.known
        fresh = set().union(*split) - self.known.keys()
        again = fresh & self.older.keys()
        if again:
            self.known |= {w: self.older[w] for w in again}
            fresh -= again
        if fresh:
            self.learn(list(fresh))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def decode(self, coded: list[bytes]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in coded]
        pieces: list[tuple[int, bytes]] = []
        held = 0
        for text, ids in enumerate(coded):
            for a in range(0, len(ids), 4 * RUN):
                piece = ids[a : a + 4 * RUN]
                if held + len(piece) > 4 * RUN:
                    self.decode_run(pieces, out)
                    pieces, held = [], 0
                pieces.append((text, piece))
                held += len(piece)
        if pieces:
            self.decode_run(pieces, out)
        return [b"".join(parts) for parts in out]

    def decode_run(self, pieces: list[tuple[int, bytes]], out: list[list[bytes]]) -> None:
        """Add what the pieces of texts stand for to their texts, of each text one piece at most."""
        sizes = np.array([len(c) // 4 for _, c in pieces])
        self.fill("ids", {
            "text": np.repeat(np.array([t for t, _ in pieces]), sizes),
            "place": np.arange(sizes.sum()),
            "id": np.frombuffer(b"".join(c for _, c in pieces), "<u4").astype(np.int64),
        })
        for text, decoded in self.db.execute(DECODE).fetchall():
            out[text].append(decoded.encode("latin-1"))


_workers: dict[tuple[str, str], Bpe] = {}


def worker(path: str, pattern: str) -> Bpe:
    if (path, pattern) not in _workers:
        _workers[path, pattern] = Bpe(path, pattern)
    return _workers[path, pattern]


def _lists(column: pa.Array, empty: str | bytes, most: int) -> Iterator[list]:
    """Values (null: ``empty``) in lists of bounded size."""
    held, size = [], 0
    for value in column:
        held.append(value.as_py() or empty)
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
    pattern: str = public_tokenizers.PATTERN, decoded: bool = False,
) -> DataFrame:
    """(id, ids): the token ids of every text, as unsigned 32-bit little-endian bytes. With ``decoded``
    also the bytes that the ids are decoded to, by the same worker, which holds its tables once."""
    path = path or public_tokenizers.path(RANKS)
    names = ["ids", "decoded"][: 1 + decoded]
    schema = T.StructType([docs.schema[id_col], *(T.StructField(c, T.BinaryType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker(path, pattern)
        for batch in batches:
            columns: list[list[bytes]] = [[] for _ in names]
            for texts in _lists(batch.column(1), "", CHUNK):
                ids = bpe.encode(texts)
                columns[0] += ids
                if decoded:
                    columns[1] += bpe.decode(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.binary()) for c in columns)], names=schema.names
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(
    coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids",
    path: str | None = None, pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """(id, ids, decoded): the bytes that ``encode``'s ids stand for."""
    path = path or public_tokenizers.path(RANKS)
    schema = T.StructType(
        [coded.schema[id_col], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker(path, pattern)
        for batch in batches:
            out = [x for ids in _lists(batch.column(1), b"", 2 * CHUNK) for x in bpe.decode(ids)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=schema.names
            )

    return coded.select(id_col, ids_col).mapInArrow(run, schema)


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, decoded=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
