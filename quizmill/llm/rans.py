"""Token-id files coded by a static range asymmetric numeral system (rANS).

One table of token frequencies is shared by all files. A table's rows are cut into blocks of whole
documents; each block is coded by itself, by ``LANES`` interleaved coders with 64-bit states and
32-bit words, and carries a checkpoint (all states and the place in the word stream) before every
``SEGMENT`` ids, so that reading can begin at any of them, and a checksum.

File format, in ``path``:

* ``freq`` (Parquet): ``id``, ``freq`` - the shares of 2**SCALE of all ids that occur.
* ``blocks`` (Parquet, one row per block, ascending by id in each file and from file to file):
  ``part`` (file order), ``block`` (order in the file), ``begin`` (ids before it in the file),
  ``n_tokens``, ``doc_ids``, ``lengths`` (ids per document), ``payload``, ``crc32`` (of payload).
* ``payload``: little-endian; int64 number of ids, int64 number of words, int64 number of checkpoints,
  per checkpoint an int64 place in the words and ``LANES`` uint64 states, then the uint32 words.

The ids' counts over all documents (each task counts what it encodes), the order and the sums before each file are Spark jobs.
Defined results: a null or empty text has the end id only; null ids sort first; repeated ids keep one
entry per row; an empty table writes no block. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizmill.llm import tokens
from quizmill.storage import materialize, new_path

SCALE = 20
LANES = 4096
SEGMENT = LANES * 256
#: A block is closed once it holds so many ids; a longer document makes a longer block.
BLOCK = SEGMENT
LOW = 1 << 31


def shares(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Whole shares of 2**scale in proportion to ``counts``, at least 1 where a count isn't 0."""
    total, room = int(counts.sum()), 1 << scale
    if not total:
        return np.zeros(len(counts), np.int64)
    out = np.where(counts > 0, np.maximum(1, counts.astype(float) * room // total), 0).astype(np.int64)
    # what is over or missing is spread over the largest shares
    while (over := int(out.sum()) - room) != 0:
        order = np.argsort(-out)[: abs(over)]
        step = max(1, abs(over) // len(order))
        out[order] += step if over < 0 else -np.minimum(out[order] - 1, step)
    return out


class Coder:
    """Codes and decodes blocks by one table of shares, indexed by id."""

    def __init__(self, freq: np.ndarray, scale: int = SCALE):
        self.scale = np.uint64(scale)
        self.freq = freq.astype(np.uint64)
        ends = np.cumsum(freq)
        self.start = (ends - freq).astype(np.uint64)
        self.most = self.freq << np.uint64(63 - scale)
        # id of each slot; bounded by 2**scale
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.mask = np.uint64((1 << scale) - 1)

    def encode(self, ids: np.ndarray) -> bytes:
        n, w32, low32 = len(ids), np.uint64(32), np.uint64(0xFFFFFFFF)
        freq, start, most = self.freq[ids], self.start[ids], self.most[ids]
        state = np.full(LANES, LOW, np.uint64)
        words: list[np.ndarray] = []
        marks, total = [], 0
        for at in range((n - 1) // LANES * LANES if n else -1, -1, -LANES):
            f, live = freq[at : at + LANES], state[: min(LANES, n - at)]
            full = live >= most[at : at + LANES]
            if full.any():
                out = (live[full] & low32).astype(np.uint32)
                words.append(out)
                total += len(out)
                live[full] >>= w32
            q = live // f
            live[:] = (q << self.scale) + (live - q * f) + start[at : at + LANES]
            if at % SEGMENT == 0:
                marks.append((total, state.copy()))
        marks.reverse()
        head = np.array([n, total, len(marks)], np.int64).tobytes()
        # words are read in the opposite order of steps, so places are counted from the end
        points = b"".join(np.int64(total - t).tobytes() + s.tobytes() for t, s in marks)
        return head + points + b"".join(x.tobytes() for x in reversed(words))

    def decode(self, payload: bytes, first: int = 0, segments: int | None = None) -> np.ndarray:
        """The ids from checkpoint ``first`` on, of ``segments`` segments (None: all)."""
        n, total, count = np.frombuffer(payload, np.int64, 3).tolist()
        size = 8 + 8 * LANES
        words = np.frombuffer(payload, np.uint32, total, 24 + count * size)
        begin = first * SEGMENT
        end = n if segments is None else min(n, (first + segments) * SEGMENT)
        out = np.zeros(max(0, end - begin), np.uint32)
        if not len(out):
            return out
        place = int(np.frombuffer(payload, np.int64, 1, 24 + first * size)[0])
        state = np.frombuffer(payload, np.uint64, LANES, 32 + first * size).copy()
        low, w32 = np.uint64(LOW), np.uint64(32)
        for at in range(begin, end, LANES):
            live = state[: min(LANES, end - at)]
            slot = live & self.mask
            ids = self.slots[slot]
            out[at - begin : at - begin + len(live)] = ids
            live[:] = self.freq[ids] * (live >> self.scale) + slot - self.start[ids]
            need = np.flatnonzero(live < low)
            if len(need):
                live[need] = (live[need] << w32) | words[place : place + len(need)]
                place += len(need)
        return out


def tokenized(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int) -> DataFrame:
    """A row of ids for each text, and a row of all ids' counts (``n``, by id; the others null) for each task."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.BinaryType()), T.StructField("n", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sums, key = tokens.encoder(path, end_id), np.zeros(0, np.int64), None
        width = "<u2" if coder.narrow else "<u4"
        for batch in batches:
            out, key = [], batch.schema.field(0).type
            for text in batch.column(1):
                buffer = text.as_buffer()
                ids = coder.ids(buffer.to_pybytes() if buffer is not None else b"")
                out.append(np.frombuffer(ids, "<u4").astype("<u2").tobytes() if coder.narrow else ids)
            coded = np.frombuffer(b"".join(out), width)
            for at in range(0, len(coded), SEGMENT):
                sums = _added(sums, np.bincount(coded[at : at + SEGMENT]))
            columns = [batch.column(0), pa.array(out, pa.binary()), pa.nulls(len(out), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        if key is not None:
            counts = pa.array([sums.astype("<i8").tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(1, key), pa.nulls(1, pa.binary()), counts], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(run, schema)


def _added(sums: np.ndarray, more: np.ndarray) -> np.ndarray:
    if len(more) > len(sums):
        sums, more = more, sums
    sums[: len(more)] += more
    return sums


def _counts(made: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0):
                sums = _added(sums, np.frombuffer(x.as_buffer(), "<i8").copy())
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["id", "n"])

    counted = made.where("n IS NOT NULL").select("n").mapInArrow(run, "id long, n long")
    return counted.groupBy("id").agg(F.sum("n").alias("n"))


def write(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
    vocabulary: str | None = None, end_id: int = tokens.END_ID,
) -> None:
    """Write the ids of all texts to ``path`` in ascending order of the documents' ids."""
    spark = docs.sparkSession
    vocabulary = vocabulary or tokens.default_path()
    width = "<u2" if tokens.encoder(vocabulary, end_id).narrow else "<u4"
    made = materialize(tokenized(docs, id_col, text_col, vocabulary, end_id), "ids")
    # at most one row per entry of the vocabulary
    found = {r.id: r.n for r in _counts(made).collect()}
    counts = np.zeros(max(found, default=-1) + 1, np.int64)
    counts[list(found)] = list(found.values())
    freq = shares(counts)
    spark.createDataFrame(
        [(int(i), int(freq[i])) for i in np.flatnonzero(freq)], "id long, freq long"
    ).coalesce(1).write.parquet(f"{path}/freq")

    ids = made.where("ids IS NOT NULL").select("doc_id", "ids")
    kind = ids.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField(c, T.LongType()) for c in ("part", "block", "begin", "n_tokens")]
        + [T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("lengths", T.ArrayType(T.LongType())),
           T.StructField("payload", T.BinaryType()), T.StructField("crc32", T.LongType())]
    )
    arrow = pa.schema(
        [(c, pa.int64()) for c in ("part", "block", "begin", "n_tokens")]
        + [("doc_ids", pa.list_(_arrow(kind))), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary()), ("crc32", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, block, begin = Coder(freq), TaskContext.get().partitionId(), 0, 0
        names, held, size = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal block, begin, names, held, size
            payload = coder.encode(np.concatenate(held))
            row = [part, block, begin, size, names, [len(x) for x in held], payload, zlib.crc32(payload)]
            block, begin, names, held, size = block + 1, begin + size, [], [], 0
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema=arrow)

        for batch in batches:
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(x.as_buffer().to_pybytes(), width)
                names.append(name)
                held.append(own)
                size += len(own)
                if size >= BLOCK:
                    yield close()
        if held:
            yield close()

    ordered = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, schema).write.option("compression", "none").parquet(f"{path}/blocks")


def _arrow(kind: T.DataType) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32()}.get(kind.simpleString(), pa.string())


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32 and ids (unsigned 32-bit)."""
    rows = spark.read.parquet(f"{path}/freq").collect()  # one row per entry of the vocabulary
    freq = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        freq[r.id] = r.freq
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    kind = blocks.schema["doc_ids"].dataType.elementType
    schema = T.StructType(
        [T.StructField("doc_id", kind)]
        + [T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")]
        + [T.StructField("ids", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for batch in batches:
            for k in range(batch.num_rows):
                offset, doc_ids, lengths, payload, crc = (batch.column(c)[k] for c in range(5))
                payload = payload.as_buffer().to_pybytes()
                if zlib.crc32(payload) != crc.as_py():
                    raise ValueError(f"damaged block at {offset.as_py()}")
                ids, n = coder.decode(payload).astype("<u4"), np.array(lengths.as_py())
                ends = np.cumsum(n)
                raw = [ids[e - m : e].tobytes() for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.values, pa.array(offset.as_py() + ends - n), pa.array(n),
                     pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(raw, pa.binary())],
                    names=schema.names,
                )

    # one row of two numbers per file
    joined = blocks.join(F.broadcast(before), "part").select(
        (F.col("before") + F.col("begin")).alias("offset"), "doc_ids", "lengths", "payload", "crc32"
    )
    return joined.mapInArrow(run, schema)


def op8_rans(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "rans")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
