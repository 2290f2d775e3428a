"""Packing by cutting-stock column generation.

A document's ids are cut at every ``capacity`` ids. What is left is cut once more, into a piece whose
length is a multiple of ``unit`` and a tail shorter than ``unit``, so that few lengths exist and
patterns fill sequences to the last id. The lengths' histogram (a few hundred rows, whatever the
corpus) goes to the driver. There a linear program over patterns is solved by column generation: a
knapsack dynamic program prices new patterns. The rounded solution says how many sequences follow
each pattern, the few pieces that rounding leaves are packed first-fit by falling length, and every
piece finds its place from its rank among the pieces of its length, by arithmetic.

Defined results: a null or empty text has the end id only. Repeated rows are packed each on their own.
A null id stays null. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizmill.llm import tokens
from quizmill.storage import materialize

CAPACITY = 4096
UNIT = 32


def cuts(n: int, capacity: int = CAPACITY, unit: int = UNIT) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    out = [(s, capacity) for s in range(0, n - capacity + 1, capacity)]
    at = n - n % capacity
    for length in (n % capacity // unit * unit, n % unit):
        if length:
            out.append((at, length))
            at += length
    return out


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int) -> DataFrame:
    """Every piece with its checksum and its rank among the equal lengths of its task."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind)]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "part", "rank")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen, part = tokens.encoder(path, end_id), {}, TaskContext.get().partitionId()
        for batch in batches:
            rows: list[tuple] = []
            for at, text in enumerate(batch.column(1)):
                buffer = text.as_buffer()
                ids = coder.ids(buffer.to_pybytes() if buffer is not None else b"")
                n = len(ids) // 4
                for start, length in cuts(n):
                    rank = seen.get(length, 0)
                    seen[length] = rank + 1
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    rows.append((at, start, length, crc, n, part, rank))
            if rows:
                at, *rest = zip(*rows, strict=True)
                columns = [batch.column(0).take(pa.array(at)), *(pa.array(c, pa.int64()) for c in rest)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(run, schema)


def best_pattern(lengths: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """Knapsack: how often each length goes into one sequence, for the greatest sum of values."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        gain = np.where(lengths <= c, best[np.maximum(c - lengths, 0)] + values, -1.0)
        k = int(gain.argmax())
        best[c] = best[c - 1]
        if gain[k] > best[c] + 1e-12:
            best[c], choice[c] = gain[k], k
    counts, c = np.zeros(len(lengths), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[choice[c]] += 1
            c -= lengths[choice[c]]
    return counts


def patterns(lengths: list[int], demand: list[int], capacity: int) -> list[tuple[int, np.ndarray]]:
    """(number of sequences, pieces of each length in one) that hold every demanded piece."""
    size, need = np.array(lengths, np.int64), np.array(demand, np.int64)
    unit = int(np.gcd.reduce([*lengths, capacity]))
    small, room = size // unit, capacity // unit
    basis = np.diag((capacity // size).astype(float))
    for _ in range(50 * len(lengths)):
        price = np.linalg.solve(basis.T, np.ones(len(size)))
        column = best_pattern(small, price, room)
        if price @ column <= 1 + 1e-9:
            break
        now = np.linalg.solve(basis, need.astype(float))
        step = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(step > 1e-9, now / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    times = np.floor(np.linalg.solve(basis, need.astype(float)) + 1e-9).clip(0).astype(np.int64)
    out, left = [], need.copy()
    for k, n in enumerate(times):
        column = np.rint(basis[:, k]).astype(np.int64)
        used = column > 0
        n = min(int(n), int((left[used] // column[used]).min())) if used.any() else 0
        if n:
            out.append((n, column))
            left -= n * column
    return out + first_fit(size, left, capacity)


def first_fit(size: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """The pieces that rounding leaves: a few for each pattern."""
    out, left = [], left.copy()
    order = np.argsort(-size)
    while left.any():
        column, room = np.zeros(len(size), np.int64), capacity
        for k in order:
            n = min(int(left[k]), room // int(size[k]))
            column[k], room = n, room - n * int(size[k])
        used = column > 0
        times = int((left[used] // column[used]).min())
        out.append((times, column))
        left -= times * column
    return out


def layout(histogram: dict[int, int], capacity: int = CAPACITY, unit: int = UNIT) -> dict[int, np.ndarray]:
    """By length, rows of (end rank, first rank, pieces in a sequence, first sequence, offset)."""
    groups = (
        [x for x in histogram if x == capacity],
        sorted(x for x in histogram if x < capacity and x % unit == 0),
        sorted(x for x in histogram if x % unit),
    )
    places: dict[int, list[tuple]] = {x: [] for x in histogram}
    ranks, first = dict.fromkeys(histogram, 0), 0
    for lengths in groups:
        if not lengths:
            continue
        for times, column in patterns(lengths, [histogram[x] for x in lengths], capacity):
            offset = 0
            for x, each in zip(lengths, column.tolist(), strict=True):
                if each:
                    begin, ranks[x] = ranks[x], ranks[x] + times * each
                    places[x].append((ranks[x], begin, each, first, offset))
                    offset += each * x
            first += times
    return {x: np.array(rows, np.int64) for x, rows in places.items()}


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    path: str | None = None, end_id: int = tokens.END_ID,
) -> DataFrame:
    """One row per piece: its place in its document, its checksum, and its place in a sequence."""
    cut = materialize(pieces(docs, id_col, text_col, path or tokens.default_path(), end_id), "pieces")
    totals = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in totals.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = layout(histogram)
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(
        "length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    ranked = cut.join(before, ["length", "part"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("before")).alias("rank")
    )
    schema = T.StructType(
        ranked.schema.fields[:5]
        + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (2, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                rows = where[x]
                row = rows[np.searchsorted(rows[:, 0], rank[at], side="right")]
                inner = rank[at] - row[:, 1]
                sequence[at] = row[:, 3] + inner // row[:, 2]
                offset[at] = row[:, 4] + inner % row[:, 2] * x
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=schema.names
            )

    return ranked.mapInArrow(place, schema)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
