"""A stored inverted file of vectors with exact answers.

A bounded sample gives centroids; a vector belongs to the list of its nearest one, and a list is cut by
the angle to its centroid into blocks of at most ``BLOCK`` vectors. Angles are distances on the sphere:
a query at angle a from a centroid is at least max(lo - a, a - hi) from all vectors whose angles
lie in lo..hi. A search scores the nearest blocks first; the k-th cosine found rules out
every block that this bound keeps below it, and only the others are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizmill.operators.evidence import top_rows
from quizmill.operators.retrieve import usable_vector
from quizmill.operators.topk import Cosine, _best, _candidates, _ids
from quizmill.storage import materialize

#: Vectors of a block, most vectors that centroids are fitted on, most lists.
BLOCK, SAMPLE, LISTS = 500, 20_000, 1024
#: Queries scored together, and blocks of a query that are scored before any is ruled out.
TOGETHER, FIRST = 512, 4


def _unit(vectors: pa.Array) -> np.ndarray:
    """Rows of length one. The same arithmetic as in a full search, so cosines agree to the last bit."""
    return Cosine().side(pa.table({"embedding": vectors}))


def _centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means, begun with spread sample vectors."""
    centres = sample[:: max(1, len(sample) // lists)][:lists]
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres)
    return centres


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


@dataclass
class VectorIndex:
    """The index under ``path``; ``pairs`` says after a search how many (query, block) pairs there were
    and how many were scored."""

    spark: SparkSession
    path: str
    pairs: tuple[int, int] | None = None

    @classmethod
    def build(cls, corpus: DataFrame, path: str, dim: int, doc_id: str = "doc_id", block: int = BLOCK) -> VectorIndex:
        """Write the index of the vectors of length ``dim`` that have a direction; ids must be distinct."""
        usable = corpus.where(usable_vector("embedding") & (F.size("embedding") == dim)).select(F.col(doc_id).alias("doc"), "embedding")
        n = usable.count()
        picked = usable.orderBy(F.xxhash64("doc")).limit(SAMPLE).select("embedding").toArrow()  # SAMPLE rows at most
        spark = corpus.sparkSession
        sample = _unit(picked["embedding"]) if picked.num_rows else np.zeros((1, dim))
        centres = _centroids(sample, max(1, min(LISTS, math.isqrt(n), len(sample) // 4)))
        shared = spark.sparkContext.broadcast(centres)  # LISTS vectors at most
        kinds = {f.name: f.dataType for f in usable.schema}

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cosines = _unit(batch.column(1)) @ shared.value.T
                    near = cosines.argmax(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns, pa.array(near), pa.array(_angles(cosines[np.arange(len(near)), near]))],
                        names=["doc", "embedding", "list", "angle"],
                    )

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, made, held = TaskContext.get().partitionId(), 0, None
            for batch in batches:
                held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                yield from blocks(held, part, made, False)
                lists = held.column("list").to_numpy()
                done = _whole(lists, block)
                made += len(done)
                held = held.slice(done[-1]) if done else held
            if held is not None and held.num_rows:
                yield from blocks(held, part, made, True)

        def blocks(rows: pa.RecordBatch, part: int, made: int, all_rows: bool) -> Iterator[pa.RecordBatch]:
            lists, angles = rows.column("list").to_numpy(), rows.column("angle").to_numpy()
            ends = _whole(lists, block) + ([rows.num_rows] if all_rows else [])
            at = 0
            for k, end in enumerate(dict.fromkeys(ends)):
                if end > at:
                    own = rows.slice(at, end - at)
                    flat = own.column("embedding").flatten()
                    yield pa.RecordBatch.from_arrays([
                        pa.array([(part << 32) + made + k]), pa.array([int(lists[at])]), pa.array([angles[at:end].min()]),
                        pa.array([angles[at:end].max()]),
                        pa.ListArray.from_arrays(pa.array([0, end - at], pa.int32()), own.column("doc")),
                        pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat),
                    ], names=["block", "list", "lo", "hi", "docs", "flat"])
                at = end

        schema = T.StructType([*usable.schema, T.StructField("list", T.LongType()), T.StructField("angle", T.DoubleType())])
        out = T.StructType([
            T.StructField("block", T.LongType()), T.StructField("list", T.LongType()), T.StructField("lo", T.DoubleType()),
            T.StructField("hi", T.DoubleType()), T.StructField("docs", T.ArrayType(kinds["doc"])),
            T.StructField("flat", T.ArrayType(kinds["embedding"].elementType)),
        ])
        dealt = usable.mapInArrow(assign, schema).repartitionByRange("list", "angle", "doc").sortWithinPartitions("list", "angle", "doc")
        dealt.mapInArrow(cut, out).write.mode("overwrite").parquet(f"{path}/blocks")
        rows = [(k, c.tolist()) for k, c in enumerate(centres)]
        spark.createDataFrame(rows, "list long, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        return cls(spark, path)

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")

    def search(self, queries: DataFrame, k: int, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
        """(query, document, score, rank) as ``retrieve.vector_topk`` gives them."""
        centres = self.spark.read.parquet(f"{self.path}/centres").orderBy("list").toArrow()  # LISTS rows at most
        table = np.array(centres["centre"].to_pylist())
        shared = self.spark.sparkContext.broadcast(table)
        asked = queries.where(usable_vector("embedding") & (F.size("embedding") == table.shape[1])).select(F.col(query_id).alias("query"), "embedding")

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    angles = pa.array(list(_angles(_unit(batch.column(1)) @ shared.value.T)), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([batch.column(0), angles], names=["query", "angles"])

        kind = asked.schema["query"]
        angles = asked.mapInArrow(near, T.StructType([kind, T.StructField("angles", T.ArrayType(T.DoubleType()))]))
        each = angles.select("query", F.posexplode("angles").alias("list", "a"))
        away = F.greatest(F.col("lo") - F.col("a"), F.col("a") - F.col("hi"), F.lit(0.0))
        bounds = each.join(self.blocks().select("block", "list", "lo", "hi"), "list").select("query", "block", "a", F.cos(F.least(away, F.lit(math.pi))).alias("bound"))
        bounds = materialize(bounds, "bounds")
        before = top_rows(bounds, "query", [F.desc("bound"), "a", "block"], FIRST, FIRST).select("query", "block")
        found = materialize(self._score(before, asked, k), "found")
        least = top_rows(found, "query", [F.desc("score"), "doc"], k, k).where(F.col("rank") == k).select("query", F.col("score").alias("least"))
        rest = bounds.join(before, ["query", "block"], "left_anti").join(least, "query", "left")
        # scores are rounded to six decimals, angles are right to more
        rest = materialize(rest.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 2e-6)).select("query", "block"), "rest")
        self.pairs = bounds.count(), before.count() + rest.count()
        best = top_rows(found.unionByName(self._score(rest, asked, k)), "query", [F.desc("score"), "doc"], k, k)
        return best.select(F.col("query").alias(query_id), F.col("doc").alias(doc_id), "score", F.col("rank").cast("bigint").alias("rank"))

    def _score(self, pairs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
        """The best ``k`` of each (query, block) pair."""
        rows = self.blocks()
        schema = T.StructType([asked.schema["query"], T.StructField("doc", rows.schema["docs"].dataType.elementType), T.StructField("score", T.DoubleType())])
        groups = max(1, math.ceil(asked.count() / TOGETHER))
        wanted = pairs.withColumn("group", F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int"))
        left = wanted.join(asked, "query").select("block", "group", "query", "embedding")
        right = rows.select("block", "docs", "flat").join(wanted.select("block", "group").distinct(), "block")
        right = right.select(*(F.col(c).alias(c) for c in right.columns))  # columns apart from those of ``left``

        def meet(_, q: pa.Table, c: pa.Table) -> pa.Table:
            docs = c["docs"].combine_chunks().flatten()
            if not q.num_rows or not len(docs):
                return pa.table({"query": q["query"].slice(0, 0), "doc": docs.slice(0, 0), "score": pa.array([], pa.float64())})
            flat = c["flat"].combine_chunks().flatten()
            size = len(flat) // len(docs)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(docs) + 1, dtype=np.int32) * size), flat)
            scores = Cosine().score(_unit(q["embedding"].combine_chunks()), _unit(vectors))
            # ties go by id: columns in the order of ids
            order = np.argsort(_ids(pa.table({"doc": docs}), "doc"), kind="stable")
            scores = scores[:, order]
            who, where = _candidates(scores, k)
            who, score, where = _best(who, scores[who, where], where, k)
            return pa.table({"query": q["query"].combine_chunks().take(pa.array(who)), "doc": docs.take(pa.array(order[where])), "score": score})

        return left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(meet, schema)


def _whole(lists: np.ndarray, block: int) -> list[int]:
    """Ends of the blocks that are whole: of one list, and full or followed by another list."""
    ends: list[int] = []
    at = 0
    turns = np.flatnonzero(lists[1:] != lists[:-1]) + 1
    for turn in [*turns.tolist(), len(lists)]:
        last = turn == len(lists)
        while turn - at > block or (turn - at == block) or (not last and turn > at):
            at = min(at + block, turn)
            ends.append(at)
    return ends
