"""Collocated phrases by partitioned mining (SON).

The corpus is dealt into ``SHARDS`` shards of equal share by the id's hash. A phrase found ``support`` times
is found at least support / SHARDS times in some shard, so each shard is mined completely at that lowered
support, level by level: a phrase is counted in a shard if the two phrases one word shorter inside it are
frequent there. Phrases frequent in any shard are the candidates, and a last pass counts all of them over
the whole corpus, word for word. (Shards as small as a task would lower a fixed support to one and prune
nothing; so there are few, and Spark mines each over all tasks.)

Mining counts 64-bit hashes; two phrases of one hash can only add a candidate, never lose one. Tasks
know frequent phrases from bitmaps of ``1 << BITS`` bits, whatever the corpus; more phrases than bits let
more through to the exact counts, which alone decide. Counts are gathered in tasks before they are
shuffled, so a hot phrase or language is a row a task.

Defined results: a null text is an empty one, a null language is ``und``; repeated rows count each; rows
with a null id count. An empty table gives an empty result. Other columns are not read. A text is held in
parts of some ``CHUNK`` bytes cut between pieces; a single piece is held whole.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizmill.llm.shingles import LETTERS, U, mix, numbers
from quizmill.storage import materialize

SUPPORT, LONGEST, TOP = 10, 3, 2000
SHARDS = 3
BITS = 27
#: Bytes of text held split at a time, and hashes held before their counts are given out (strings: a tenth).
CHUNK, HELD = 1_000_000, 3_000_000
#: A candidate goes where the part of it that a longer one leaves is at most half.
INSIDE = 50
#: Parts of a language whose first rows are found apart.
PARTS = 256

#: Small letters for A-Z, one mark between pieces, one between words.
FLAT = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
FACTORS = numbers(8, 11)


class Part:
    """Text of one language: where its words are, and hashes of the phrases that begin at each word."""

    def __init__(self, lang: str, text: bytes):
        self.lang, self.text = lang, re.sub(b"  +", b" ", text) if b"  " in text else text
        data = np.frombuffer(self.text, np.uint8)
        letters = np.flatnonzero((data != 32) & (data != 10))
        first = np.flatnonzero(np.diff(letters, prepend=-2) > 1)
        self.starts, self.ends = letters[first], letters[np.append(first[1:], len(letters))[: len(first)] - 1] + 1
        place = np.arange(len(letters)) - np.repeat(first, np.diff(first, append=len(letters)))
        powers = numbers(int(place.max(initial=0)) + 1, 2)
        self.hashes = mix(np.add.reduceat(LETTERS[data[letters]] * powers[place], first)) if len(first) else np.zeros(0, U)
        #: Words from each word to the end of its piece.
        heads = np.unique(np.append(np.searchsorted(self.starts, np.flatnonzero(data == 10)), len(first)))
        at = np.arange(len(first))
        self.room = heads[np.searchsorted(heads, at, side="right")] - at if len(first) else at
        self.seed = U(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))

    def phrases(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(whether a phrase of ``width`` words begins at each word, its hash)."""
        n = max(0, len(self.hashes) - width + 1)
        out = np.full(n, self.seed, U)
        for k in range(width):
            out += self.hashes[k : n + k] * FACTORS[k]
        return self.room[:n] >= width, mix(out + U(width))

    def strings(self, width: int, which: np.ndarray) -> list[bytes]:
        """The phrases of ``width`` words at the places marked in ``which``."""
        at, text = np.flatnonzero(which), self.text
        return [text[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at + width - 1].tolist(), strict=True)]


def _parts(langs: pa.Array, texts: pa.Array) -> Iterator[Part]:
    """Texts, joined within their language and cut between pieces, in parts of some CHUNK bytes."""
    held: dict[str, list[bytes]] = {}
    sizes: Counter[str] = Counter()
    for lang, text in zip(langs.to_pylist(), texts, strict=True):
        raw = text.as_buffer()
        if raw is None:
            continue
        data = raw.to_pybytes().translate(FLAT)
        at = 0
        while at < len(data):
            end = len(data) if len(data) - at <= CHUNK else data.find(b"\n", at + CHUNK) % (len(data) + 1)
            held.setdefault(lang, []).append(data[at:end])
            sizes[lang] += end - at
            at = end
            if sizes[lang] >= CHUNK:
                yield Part(lang, b"\n".join(held.pop(lang)))
                sizes[lang] = 0
    for lang, some in held.items():
        yield Part(lang, b"\n".join(some))


def _split(batch: pa.RecordBatch) -> Iterator[tuple[int, Part]]:
    """(shard, part) of a batch of (shard, lang, text)."""
    shards = batch.column(0).to_numpy()
    for shard in np.unique(shards).tolist():
        rows = pa.array(np.flatnonzero(shards == shard))
        for part in _parts(batch.column(1).take(rows), batch.column(2).take(rows)):
            yield shard, part


def _spot(hashes: np.ndarray, shard: int | None, bits: int) -> np.ndarray:
    """The bit of each hash; of a shard's own table if ``shard`` is given."""
    own = hashes if shard is None else mix(hashes + numbers(shard + 1, 12)[-1])
    return own & U((1 << bits) - 1)


def _marked(table: np.ndarray, hashes: np.ndarray, shard: int | None, bits: int) -> np.ndarray:
    spot = _spot(hashes, shard, bits)
    return (table[(spot >> U(6)).astype(np.int64)] >> (spot & U(63))) & U(1) > 0


def bitmap(found: DataFrame, by_shard: bool, bits: int):
    """A broadcast bitmap of the hashes of ``found`` (shard, hash): 2 to the power ``bits`` bits."""

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, hashes = (c.to_numpy() for c in batch.columns)
            for shard in np.unique(shards).tolist():
                spot = _spot(hashes[shards == shard].view(U), shard if by_shard else None, bits)
                slots, at = np.unique(spot >> U(6), return_inverse=True)
                words = np.zeros(len(slots), U)
                np.bitwise_or.at(words, at, U(1) << (spot & U(63)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slots.astype(np.int64)), pa.array(words.view(np.int64))], names=["slot", "word"]
                )

    def block(key: tuple, rows: pa.Table) -> pa.Table:
        out = np.zeros(1 << 14, np.int64)
        out[rows.column("slot").to_numpy() & ((1 << 14) - 1)] = rows.column("word").to_numpy()
        return pa.table({"block": [key[0].as_py()], "words": [out.tobytes()]})

    words = found.select("shard", "hash").mapInArrow(spots, "slot long, word long").groupBy("slot").agg(F.bit_or("word").alias("word"))
    blocks = words.withColumn("block", F.shiftright("slot", 14)).groupBy("block").applyInArrow(block, "block long, words binary")
    table = np.zeros(max(1 << 14, 1 << (bits - 6)), np.int64)
    for row in blocks.collect():  # blocks of 128 KB, 1 << (bits - 3) bytes together
        table[row.block << 14 : (row.block + 1) << 14] = np.frombuffer(row.words, np.int64)
    return found.sparkSession.sparkContext.broadcast(table.view(U))


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    """Sums of ``n``. Tasks have summed what they held, so rows go to their keys as they are."""
    return rows.repartition(*keys).groupBy(*keys).agg(F.sum("n").alias("n"))


def mine(docs: DataFrame, width: int, shorter, least: int, bits: int) -> DataFrame:
    """(shard, hash) of the phrases of ``width`` words that a shard holds ``least`` times; ``shorter`` is
    the shards' bitmap of frequent phrases one word shorter (none for single words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for shard, some in held.items():
                hashes, counts = np.unique(np.concatenate(some), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(hashes), shard, np.int32)), pa.array(hashes.view(np.int64)), pa.array(counts)],
                    names=["shard", "hash", "n"],
                )
            held.clear()

        for batch in batches:
            for shard, part in _split(batch):
                which, hashes = part.phrases(width)
                if shorter is not None:
                    ok = _marked(shorter.value, part.phrases(width - 1)[1], shard, bits)
                    which &= ok[: len(which)] & ok[1 : len(which) + 1]
                held.setdefault(shard, []).append(hashes[which])
                size += len(held[shard][-1])
                if size > HELD:
                    yield from rows()
                    size = 0
        yield from rows()

    counted = _summed(docs.mapInArrow(run, "shard int, hash long, n long"), "shard", "hash")
    return counted.where(F.col("n") >= least).select("shard", "hash")


def count_candidates(docs: DataFrame, tables: dict[int, object], bits: int) -> DataFrame:
    """(lang, phrase, width, n): exact counts of every phrase that ``tables`` (by width) let through;
    width 0 has the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, width), found in held.items():
                if found:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(found)), pa.array(list(found), pa.binary()),
                        pa.array([width] * len(found), pa.int32()), pa.array(list(found.values()), pa.int64()),
                    ], names=["lang", "phrase", "width", "n"])
            held.clear()

        for batch in batches:
            for part in _parts(batch.column(1), batch.column(2)):
                held.setdefault((part.lang, 0), Counter())[b""] += len(part.hashes)
                for width, table in tables.items():
                    fits, hashes = part.phrases(width)
                    which = fits & _marked(table.value, hashes, None, bits)
                    held.setdefault((part.lang, width), Counter()).update(part.strings(width, which))
                if sum(map(len, held.values())) > HELD // 10:
                    yield from rows()
        yield from rows()

    schema = "lang string, phrase binary, width int, n long"
    return _summed(docs.mapInArrow(run, schema), "lang", "phrase", "width")


def _first(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    best = W.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= top)


def collocations(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT,
    longest: int = LONGEST, top: int = TOP, shards: int = SHARDS, bits: int = BITS,
) -> DataFrame:
    """Each language's first ``top`` phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n, score."""
    rows = docs.select(
        F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int").alias("shard"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )
    least = -(-support // shards)
    tables, shorter = {}, None
    for width in range(1, longest + 1):
        frequent = materialize(mine(rows, width, shorter, least, bits), "frequent")
        tables[width] = bitmap(frequent, False, bits)
        if shorter is not None:
            shorter.unpersist()
        shorter = bitmap(frequent, True, bits) if width < longest else None
    counted = count_candidates(rows, tables, bits).where((F.col("n") >= support) | (F.col("width") == 0))
    counted = materialize(counted.withColumn("phrase", F.col("phrase").cast("string")), "counted")
    total = counted.where("width = 0").select("lang", F.col("n").alias("total"))
    return rank(counted.where("width > 0"), total, longest, top)


def rank(counted: DataFrame, total: DataFrame, longest: int, top: int) -> DataFrame:
    """Scores of the phrases of ``counted`` (lang, phrase, width, n), which holds all of their parts."""
    own = counted.where("width > 1").select("lang", "phrase", "width", F.col("n").alias("a"), F.split("phrase", " ", -1).alias("w"))
    cut = own.select("lang", "phrase", "width", "a", "w", F.explode(F.sequence(F.lit(1), F.col("width") - 1)).alias("k")).select(
        "lang", "phrase", "width", "a", "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("width")), " ").alias("tail"),
    )
    heads = counted.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = counted.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    exact = "(1000000BD * cast(a AS decimal(16,0)) * cast(a AS decimal(16,0))) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))"
    scored = (
        cut.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("score", F.expr(exact))
        .groupBy("lang", "phrase", "width", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    inner = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("width") - 1),
        lambda size: F.transform(
            F.sequence(F.lit(1), F.col("width") - size + 1), lambda at: F.array_join(F.slice("w", at, size), " ")
        ),
    ))
    around = own.where("width > 2").select("lang", "a", F.explode(inner).alias("phrase"))
    around = around.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = (
        scored.join(around, ["lang", "phrase"], "left")
        .where(F.col("longer").isNull() | (100 * F.col("longer") < INSIDE * F.col("a")))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("part"))
    )
    best = _first(_first(kept, ["lang", "part"], top), ["lang"], top)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))


#: All phrases of one to three words counted outright.
SQL = r"""
WITH p AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
g AS (SELECT lang, 1 AS width, unnest(w) AS phrase FROM p
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM p WHERE len(w) > 1
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM p WHERE len(w) > 2),
f AS (SELECT lang, width, phrase, count(*) AS n, string_split(phrase, ' ') AS w FROM g GROUP BY lang, width, phrase HAVING count(*) >= 10),
t AS (SELECT lang, count(*) AS n FROM g WHERE width = 1 GROUP BY lang),
k AS (SELECT lang, width, phrase, n AS a, w, unnest(range(1, width)) AS k FROM f WHERE width > 1),
c AS (SELECT k.lang, k.width, k.phrase, k.a, min({'s': (1000000::HUGEINT * k.a * k.a) // (l.n::HUGEINT * r.n), 'k': k.k, 'l': l.n, 'r': r.n}) AS c
    FROM k JOIN f AS l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1:k.k], ' ')
    JOIN f AS r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k.k + 1:], ' ') GROUP BY ALL),
i AS (SELECT lang, phrase, max(n) AS longer FROM (
    SELECT lang, n, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM f WHERE width = 3) GROUP BY ALL),
o AS (SELECT c.lang, c.phrase, c.a, c.c.l AS l, c.c.r AS r, t.n, c.c.s::BIGINT AS score,
    row_number() OVER (PARTITION BY c.lang ORDER BY c.c.s DESC, c.a DESC, c.phrase) AS rank
    FROM c JOIN t ON t.lang = c.lang LEFT JOIN i ON i.lang = c.lang AND i.phrase = c.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * c.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
"""
