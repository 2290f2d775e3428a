"""Stored word indexes: texts are read and split once, for any number of query batches.

``TextIndex`` ranks by BM25. Documents are dealt into blocks of about ``BLOCK`` by the hash of their id;
a posting row is one term in one block, so a term of every document is many rows of bounded size.
A row also has the greatest count of the term in one document of the block and the shortest of those
documents: together a bound on what the term can add there. A search first scores, for each query,
the blocks of the highest bounds; the k-th score found then rules out every block whose bound
is lower, and only the others are read. Rare terms weigh most, so their blocks come first.

``SubstringIndex`` finds the first documents by id that hold a word as part of any of their words. It keeps,
for every distinct word, the first ``depth`` ids that have it, and which words hold each sequence of one to
three characters. A search takes the rarest sequence of the asked word, tests the words that have
it, and merges the ids of those that begin early enough: no text is looked at again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizmill.functions import text as X
from quizmill.operators.evidence import top_rows
from quizmill.operators.retrieve import searchable, words
from quizmill.operators.topk import BLOCK_BYTES, Bm25, _best, _candidates, _flat, _ids, _measure, _round6
from quizmill.storage import materialize

FIELDS = ("content", "title", "summary", "keywords")
BLOCK = 1000
#: Folders by the hash of the term: a search with few terms reads the folders of its terms.
BUCKETS = 32
#: Queries scored together in a task, and blocks of a query that are scored before any is ruled out.
TOGETHER, FIRST = 256, 2
K1, B = Bm25.k1, Bm25.b
#: Asked words that are sent to the index instead of the index to them.
ASKED_ROWS = 200_000


def _sent(asked: DataFrame) -> DataFrame:
    """A table of asked words, broadcast if it is proven small; reads little more than the bound."""
    rows, total = _measure(asked.limit(ASKED_ROWS + 1))
    return F.broadcast(asked) if rows <= ASKED_ROWS and total <= BLOCK_BYTES else asked


def _postings(doc_type: T.DataType):
    """Index rows of one block: a row of its documents (no term), then one of each term."""
    schema = T.StructType([
        T.StructField("term", T.StringType()), T.StructField("block", T.LongType()),
        T.StructField("slots", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType())),
        T.StructField("most", T.IntegerType()), T.StructField("shortest", T.IntegerType()),
        T.StructField("docs", T.ArrayType(doc_type)), T.StructField("lengths", T.ArrayType(T.IntegerType())),
    ])

    def index(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc")
        docs = rows["doc"].combine_chunks()
        tokens, row = _flat(rows["tokens"])
        length = np.bincount(row, minlength=len(docs)).astype(np.int32)
        coded = tokens.dictionary_encode()
        terms, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pair, counts = np.unique(code * len(docs) + row, return_counts=True)
        term, slot = pair // max(1, len(docs)), (pair % max(1, len(docs))).astype(np.int32)
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        ends = pa.array(np.append(first, len(term)).astype(np.int32))
        n, counts = len(first), counts.astype(np.int32)
        most = np.maximum.reduceat(counts, first) if n else counts
        shortest = np.minimum.reduceat(length[slot], first) if n else counts
        lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (slot, counts)]
        block = pa.array([key[0].as_py()] * (n + 1), pa.int64())
        none = pa.array([None], pa.int32())
        ids = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
        sizes = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), pa.array(length))
        return pa.table([
            pa.concat_arrays([pa.nulls(1, pa.string()), terms.take(pa.array(term[first])).cast(pa.string())]), block,
            *(pa.concat_arrays([pa.nulls(1, v.type), v]) for v in lists),
            pa.concat_arrays([none, pa.array(most, pa.int32())]), pa.concat_arrays([none, pa.array(shortest, pa.int32())]),
            pa.concat_arrays([ids, pa.nulls(n, ids.type)]), pa.concat_arrays([sizes, pa.nulls(n, sizes.type)]),
        ], names=schema.names)

    return index, schema


@dataclass
class TextIndex:
    """A BM25 index under ``path``; ``pairs`` says after a search how many (query, block) pairs there
    were and how many were scored."""

    spark: SparkSession
    path: str
    pairs: tuple[int, int] | None = None

    @classmethod
    def build(
        cls, corpus: DataFrame, path: str, doc_id: str = "doc_id", fields: tuple[str, ...] = FIELDS, block: int = BLOCK
    ) -> TextIndex:
        """Write the index of ``corpus``; ids must be distinct."""
        docs = corpus.select(F.col(doc_id).alias("doc"), words(searchable(list(fields))).alias("tokens"))
        blocks = max(1, math.ceil(corpus.count() / block))
        index, schema = _postings(docs.schema["doc"].dataType)
        dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc"), F.lit(blocks)))
        rows = dealt.groupBy("block").applyInArrow(index, schema)
        bucket = F.when(F.col("term").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        rows.withColumn("bucket", bucket).write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/postings")
        made = cls(corpus.sparkSession, path)
        terms = made.rows(docs.schema["doc"].dataType).where("bucket >= 0").groupBy("term").agg(F.sum(F.size("slots")).alias("df"))
        # the column without values keeps the ids' type, also of an empty index
        terms.withColumn("doc", F.lit(None).cast(docs.schema["doc"].dataType)).write.mode("overwrite").parquet(f"{path}/terms")
        return made

    def terms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/terms")

    def rows(self, doc_type: T.DataType) -> DataFrame:
        schema = _postings(doc_type)[1].add("bucket", T.IntegerType())
        return self.spark.read.schema(schema).parquet(f"{self.path}/postings")

    def postings(self) -> DataFrame:
        return self.rows(self.terms().schema["doc"].dataType).where("bucket >= 0")

    def postings_of(self, asked: DataFrame) -> DataFrame:
        """The postings in the folders of the ``term`` column's terms."""
        used = asked.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("b")).distinct()
        return self.postings().where(F.col("bucket").isin([r["b"] for r in used.collect()]))  # BUCKETS at most

    def blocks(self) -> DataFrame:
        return self.rows(self.terms().schema["doc"].dataType).where("bucket = -1").select("block", "docs", "lengths")

    def size(self) -> tuple[int, float]:
        """Documents and their mean number of words."""
        lengths = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)
        n, total = self.blocks().agg(F.sum(F.size("docs")), F.sum(lengths)).first()
        return n or 0, (total or 0) / n if n else 1.0

    def search(
        self, queries: DataFrame, k: int, query_id: str = "query_id", doc_id: str = "doc_id", text: str = "query"
    ) -> DataFrame:
        """(query, document, score, rank) as ``retrieve.text_topk`` gives them."""
        n, mean = self.size()
        mean = mean or 1.0
        terms = self.terms()
        idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        asked = queries.select(F.col(query_id).alias("query"), F.explode(F.array_distinct(words(F.col(text)))).alias("term"))
        asked = materialize(asked.join(terms, "term").select("query", "term", idf.alias("idf")), "asked")
        postings = self.postings_of(asked)
        norm = K1 * (1 - B + B * F.col("shortest") / mean)
        bounds = (
            postings.select("term", "block", "most", "shortest").join(_sent(asked), "term")
            .groupBy("query", "block")
            .agg(F.sum(F.col("idf") * F.col("most") * (K1 + 1) / (F.col("most") + norm)).alias("bound"))
        )
        bounds = materialize(bounds, "bounds")
        before = top_rows(bounds, "query", [F.desc("bound"), "block"], FIRST, FIRST)
        found = materialize(self._score(before, asked, postings, k, mean), "found")
        least = top_rows(found, "query", [F.desc("score"), "doc"], k, k).where(F.col("rank") == k).select(
            "query", F.col("score").alias("least")
        )
        # bounds hold before rounding to six decimals
        rest = bounds.join(before.select("query", "block"), ["query", "block"], "left_anti").join(least, "query", "left")
        rest = materialize(rest.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-6)), "rest")
        self.pairs = bounds.count(), before.count() + rest.count()
        found = found.unionByName(self._score(rest, asked, postings, k, mean))
        best = top_rows(found, "query", [F.desc("score"), "doc"], k, k)
        return best.select(F.col("query").alias(query_id), F.col("doc").alias(doc_id), "score", F.col("rank").cast("bigint").alias("rank"))

    def _score(self, pairs: DataFrame, asked: DataFrame, postings: DataFrame, k: int, mean: float) -> DataFrame:
        """The best ``k`` of each (query, block) pair."""
        kinds = {"query": asked.schema["query"].dataType, "doc": self.blocks().schema["docs"].dataType.elementType}
        schema = T.StructType([*(T.StructField(c, t) for c, t in kinds.items()), T.StructField("score", T.DoubleType())])
        groups = max(1, math.ceil(asked.select("query").distinct().count() / TOGETHER))
        group = F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int")
        wanted = pairs.select("query", "block").withColumn("group", group)
        left = wanted.join(asked, "query").select("block", "group", "query", "term", "idf")
        lists = postings.select("term", "block", "slots", "counts").join(_sent(left.select("term", "block", "group").distinct()), ["term", "block"])
        own = self.blocks().join(wanted.select("block", "group").distinct(), "block")
        right = lists.select("block", "group", "term", "slots", "counts", *(F.lit(None).cast(own.schema[c].dataType).alias(c) for c in ("docs", "lengths")))
        right = right.unionByName(own, allowMissingColumns=True)
        right = right.select(*(F.col(c).alias(c) for c in right.columns))  # columns apart from those of ``left``

        def meet(_, q: pa.Table, p: pa.Table) -> pa.Table:
            empty = pa.table({"query": q["query"].slice(0, 0), "doc": pa.array([], p.schema.field("docs").type.value_type), "score": pa.array([], pa.float64())})
            if not q.num_rows or not p.num_rows:
                return empty
            head = p.filter(pc.is_valid(p["docs"]))
            docs, length = head["docs"].combine_chunks().flatten(), head["lengths"].combine_chunks().flatten().to_numpy()
            base = K1 * (1 - B + B * length / mean)
            names, at = np.unique(_ids(q, "query"), return_inverse=True)
            q = q.append_column("at", pa.array(at)).sort_by([("term", "ascending"), ("at", "ascending")])
            term, at = q["term"].combine_chunks().dictionary_encode(), q["at"].to_numpy()
            idf, code = q["idf"].to_numpy(), term.indices.to_numpy()
            first = np.searchsorted(code, np.arange(len(term.dictionary) + 1))
            p = p.filter(pc.is_valid(p["term"])).sort_by("term")
            place = pc.index_in(p["term"].combine_chunks(), term.dictionary).to_numpy(zero_copy_only=False)
            slots, counts = p["slots"].combine_chunks(), p["counts"].combine_chunks()
            ends, slot, count = slots.offsets.to_numpy(), slots.values.to_numpy(), counts.values.to_numpy()
            out = np.zeros((len(names), len(docs)))
            for r, t in enumerate(place.tolist()):
                s, c = slot[ends[r] : ends[r + 1]], count[ends[r] : ends[r + 1]]
                who = slice(first[t], first[t + 1])
                out[at[who][:, None], s[None, :]] += idf[who][:, None] * (c * (K1 + 1) / (c + base[s]))
            out = _round6(out)
            out[out <= 0] = np.nan
            who, where = _candidates(out, k)
            who, score, where = _best(who, out[who, where], where, k)  # slots are in the order of ids
            return pa.table({"query": pa.array(names[who], q.schema.field("query").type), "doc": docs.take(pa.array(where)), "score": score})

        return left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(meet, schema)


def _grams(token: Column, size: int) -> Column:
    """All sequences of ``size`` characters, each once; a look ahead from every character, so linear in the length."""
    parts = F.regexp_extract_all(token, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1))
    return F.when(F.length(token) >= size, F.array_distinct(parts))


@dataclass
class SubstringIndex:
    spark: SparkSession
    path: str
    depth: int

    @classmethod
    def build(
        cls, corpus: DataFrame, path: str, doc_id: str = "doc_id", fields: tuple[str, ...] = FIELDS, depth: int = 50
    ) -> SubstringIndex:
        """Write the index of ``corpus`` for searches of up to ``depth`` documents."""
        texts = corpus.select(F.col(doc_id).alias("doc"), searchable(list(fields)).alias("t"))
        tokens = texts.select("doc", F.explode(F.array_distinct(F.split("t", r"(?U)\s+"))).alias("token")).where("token <> ''")
        # a rank with a literal bound: each task gives at most ``depth`` rows of a word
        first = top_rows(tokens, "token", ["doc"], depth, depth)
        first.groupBy("token").agg(F.array_sort(F.collect_list("doc")).alias("docs")).write.mode("overwrite").parquet(f"{path}/tokens")
        token = corpus.sparkSession.read.parquet(f"{path}/tokens").select("token", F.get("docs", F.lit(0)).alias("first"))
        grams = F.flatten(F.filter(F.array(*(_grams(F.col("token"), n) for n in (1, 2, 3))), lambda x: x.isNotNull()))
        token.select(F.explode(grams).alias("gram"), "token", "first").write.mode("overwrite").parquet(f"{path}/grams")
        made = cls(corpus.sparkSession, path, depth)
        made.read("grams").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/counts")
        return made

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}")

    def candidates(self, asked: DataFrame) -> DataFrame:
        """(word, token): the indexed words that hold each asked ``word``."""
        return self._begun(asked).select("word", "token")

    def _begun(self, asked: DataFrame) -> DataFrame:
        """(word, token, first): the same, each with the first document of the indexed word."""
        size = F.least(F.lit(3), F.length("word"))
        parts = F.coalesce(*(F.when(size == n, _grams(F.col("word"), n)) for n in (1, 2, 3)))
        cut = asked.select("word", F.size(parts).alias("parts"), F.explode(parts).alias("gram"))
        # a word with a sequence that no text has is in no text
        rarest = cut.join(self.read("counts"), "gram").groupBy("word", "parts").agg(
            F.count(F.lit(1)).alias("known"), F.min_by("gram", F.struct("n", "gram")).alias("gram")
        )
        rarest = materialize(rarest.where("known = parts").select("word", "gram"), "rarest")
        return self.read("grams").join(_sent(rarest), "gram").where(F.contains("token", F.col("word"))).select("word", "token", "first")

    def search(
        self, queries: DataFrame, k: int, query_id: str = "query_id", doc_id: str = "doc_id", text: str = "query", min_chars: int = 1
    ) -> DataFrame:
        """(query, document, score, rank) as ``retrieve.keyword_match`` gives them."""
        if k > self.depth:
            raise ValueError(f"the index holds {self.depth} documents a word; build it with depth={k}")
        split = F.array_distinct(F.split(X.canonical_query(F.col(text)), " "))
        asked = queries.select(F.col(query_id).alias("query"), F.explode(split).alias("word")).where(
            (F.length("word") >= min_chars) & (F.col("word") != "")
        )
        asked = materialize(asked, "asked")
        # ``k`` different first documents are hits: an indexed word whose first one is later adds none to the first ``k``
        nearest = F.dense_rank().over(W.partitionBy("word").orderBy("first"))
        near = self._begun(asked.select("word").distinct()).withColumn("_rank", nearest).where(F.col("_rank") <= k)
        hits = near.select("word", "token").join(self.read("tokens"), "token")
        docs = hits.select("word", F.explode(F.slice("docs", F.lit(1), F.lit(k))).alias("doc"))
        first = docs.groupBy("word", "doc").agg(F.lit(1).alias("_one")).drop("_one")
        first = materialize(top_rows(first, "word", ["doc"], k, k).select("word", "doc"), "first")
        merged = asked.join(first, "word").select("query", "doc").distinct()
        return top_rows(merged, "query", ["doc"], k, k).select(
            F.col("query").alias(query_id), F.col("doc").alias(doc_id), F.lit(1.0).alias("score"), F.col("rank").cast("bigint").alias("rank")
        )
