"""Evidence retrieval for tables of queries: vector, full-text, keyword, tiered, composed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quizmill import constants as C
from quizmill.functions import text as X
from quizmill.operators.evidence import first_wins, is_eligible, top_rows
from quizmill.operators.ordering import PART, spread
from quizmill.operators.topk import AnyWord, Bm25, Cosine, Packed, WordOverlap, best_matches
from quizmill.storage import materialize, new_path, scratch

#: Takes queries, a corpus (as a table, or ``Texts`` for ``text_topk``) and a depth.
Search = Callable[[DataFrame, "DataFrame | Texts", int], DataFrame]


def usable_vector(col: str) -> Column:
    """Not null, not empty, no null element and not all zero."""
    return F.coalesce(
        (F.size(col) > 0)
        & F.forall(col, lambda x: x.isNotNull())
        & F.exists(col, lambda x: x != 0),
        F.lit(False),
    )


def _grouped(df: DataFrame, group: str | None) -> Column:
    size = F.size("embedding").cast("string")
    return size if group is None else F.concat_ws("|", size, F.col(group).cast("string"))


def vector_topk(
    queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id",
    doc_id: str = "doc_id", group: str | None = None, force: str | None = None,
) -> DataFrame:
    """Exact cosine neighbours; vectors of another length or without a norm never match."""
    q = queries.where(usable_vector("embedding")).select(
        F.col(query_id).alias("query"), "embedding", _grouped(queries, group).alias("group")
    )
    c = corpus.where(usable_vector("embedding")).select(
        F.col(doc_id).alias("doc"), "embedding", _grouped(corpus, group).alias("group")
    )
    return _named(best_matches(q, c, Cosine(), k, force=force), query_id, doc_id)


def _named(df: DataFrame, query_id: str, doc_id: str) -> DataFrame:
    return df.select(
        F.col("query").alias(query_id), F.col("doc").alias(doc_id), "score",
        F.col("rank").cast("bigint").alias("rank"),
    )


def searchable(fields: list[str]) -> Column:
    """Text fields joined by line breaks; list fields joined first."""
    return F.lower(F.concat_ws("\n", *[F.col(f) for f in fields]))


def words(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit(X.WORD), F.lit(0))


FIELDS = ("content", "title", "summary", "keywords")


@dataclass
class Texts:
    """Texts split into words and coded once, for any number of searches: blocks with the idf of their
    terms, number of documents and their mean length."""

    packed: Packed
    n: int
    mean: float

    @classmethod
    def of(cls, corpus: DataFrame, doc_id: str = "doc_id", fields: tuple[str, ...] = FIELDS) -> Texts:
        spark, path = corpus.sparkSession, new_path(corpus.sparkSession, "texts")
        docs = corpus.select(F.col(doc_id).alias("doc"), words(searchable(list(fields))).alias("tokens"))
        with scratch(spark, "texts"):
            packed = Packed.of(docs, Bm25(1.0))
            n, total = packed.blocks.agg(F.sum("rows"), F.sum("elements")).first()

            def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for block, body in zip(batch["block"], batch["body"]):
                        vocabulary, rows, *_ = Packed.opened(body.as_py())[1]
                        at, size = pa.array(np.arange(len(rows), dtype=np.int32)), len(rows)
                        out = [pa.array([block.as_py()] * size, pa.string()), vocabulary.cast(pa.string()), at, pa.array(rows, pa.int64())]
                        yield pa.RecordBatch.from_arrays(out, ["block", "term", "at", "held"])

            def with_idf(b: pa.Table, terms: pa.Table) -> pa.Table:
                bodies = []
                if b.num_rows:  # one block
                    ids, coded = Packed.opened(b["body"][0].as_py())
                    idf = terms.sort_by("at")["idf"].to_numpy()
                    bodies = [Packed.closed((ids, (*coded, idf)))]
                return b.set_column(b.column_names.index("body"), "body", pa.array(bodies, pa.binary()))

            # a row for each term and block, not for each term and document
            terms = packed.blocks.select("block", "body").mapInArrow(held, "block string, term string, at int, held bigint")
            df = F.sum("held").over(W.partitionBy("term"))
            idf = F.log(1 + (F.lit(n or 0) - F.col("df") + 0.5) / (F.col("df") + 0.5))
            terms = terms.withColumn("df", df).select("block", "at", idf.alias("idf"))
            blocks = packed.blocks.groupBy("block").cogroup(terms.groupBy("block")).applyInArrow(with_idf, packed.blocks.schema)
            blocks = materialize(blocks, "texts", path)
        return cls(Packed(blocks, packed.doc), n or 0, (total or 0) / n if n else 1.0)


def text_topk(
    queries: DataFrame, corpus: DataFrame | Texts, k: int, query_id: str = "query_id",
    doc_id: str = "doc_id", text: str = "query", fields: tuple[str, ...] = FIELDS, force: str | None = None,
) -> DataFrame:
    """BM25 ranking over all text fields; a corpus that is searched again is given as ``Texts``.

    Texts are read and split once, and documents scored in blocks; a term that is in every document
    costs no more than its postings.
    """
    texts = corpus if isinstance(corpus, Texts) else Texts.of(corpus, doc_id, fields)
    asked = queries.select(F.col(query_id).alias("query"), F.array_distinct(words(F.col(text))).alias("terms"))
    asked = materialize(asked.where(F.size("terms") > 0), "query-terms")
    return _named(best_matches(asked, texts.packed, Bm25(texts.mean or 1.0), k, force=force), query_id, doc_id)


def keyword_match(
    queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id",
    doc_id: str = "doc_id", text: str = "query",
    fields: tuple[str, ...] = ("content", "title", "summary", "keywords"), min_chars: int = 1,
    force: str | None = None,
) -> DataFrame:
    """First ``k`` documents by id that hold any word of the query, in any field and case."""
    split = F.filter(
        F.split(X.canonical_query(F.col(text)), " "), lambda w: F.length(w) >= min_chars
    )
    q = queries.select(F.col(query_id).alias("query"), split.alias("words"))
    c = corpus.select(F.col(doc_id).alias("doc"), searchable(list(fields)).alias("haystack"))
    found = best_matches(q.where(F.size("words") > 0), c, AnyWord(), k, force=force)
    return _named(found, query_id, doc_id)


def retrieve_with_fallback(
    queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", doc_id: str = "doc_id"
) -> DataFrame:
    """Vector search where it works; text search where that failed; else keywords.

    ``vector_ok`` and ``text_ok`` say per query which index answers: a fallback follows an
    error, not an empty result. Each query runs one strategy only.
    """
    vector = F.coalesce("vector_ok", F.lit(False))
    text = ~vector & F.coalesce("text_ok", F.lit(False))
    parts = [
        ("vector", vector_topk(queries.where(vector), corpus, k, query_id, doc_id)),
        ("text", text_topk(queries.where(text), corpus, k, query_id, doc_id)),
        ("keyword", keyword_match(queries.where(~vector & ~text), corpus, k, query_id, doc_id)),
    ]
    out = None
    for name, part in parts:
        tagged = part.withColumn("strategy", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def tiered_retrieval(
    queries: DataFrame, tier1: DataFrame | Texts, tier2: DataFrame | Texts, first: Search, second: Search,
    max_k: int, max_tier1_k: int, query_id: str = "query_id", doc_id: str = "doc_id",
    expansion_chars: int = C.EXPANSION_CHARS, passages: DataFrame | None = None,
) -> DataFrame:
    """Textbook passages first, then related material searched with the expanded query.

    ``queries`` carry ``k`` and ``tier1_k`` per row. The tier is set by the stage, not by the
    stored value. ``passages`` (id, content) has the texts of ``tier1``, if that is a join which texts
    need not go through.
    """
    passages = tier1 if passages is None else passages
    depth = queries.select(
        query_id, "query", "k", F.least("k", F.greatest(F.lit(1), "tier1_k")).alias("first_k")
    )
    found = first(queries, tier1, max_tier1_k).join(depth, query_id).where("rank <= first_k")
    # Used for the expansion and for the result: computed once.
    found = materialize(found.select(query_id, doc_id, "score", "rank"), "first-stage")
    per_chunk = max(C.EXPANSION_MIN_CHARS, expansion_chars)
    shown = found.join(
        passages.select(doc_id, F.substring("content", 1, per_chunk).alias("passage")), doc_id
    )
    context = shown.groupBy(query_id).agg(  # at most max_tier1_k passages per query
        F.array_sort(F.collect_list(F.struct("rank", "passage"))).alias("p"),
        F.count(F.lit(1)).alias("n_first"),
    )
    expanded = depth.join(context, query_id, "left").select(
        query_id, "k", F.coalesce("n_first", F.lit(0)).alias("n_first"),
        F.when(
            F.col("p").isNotNull(),
            F.concat(
                "query", F.lit("\n\n" + C.LABEL_RELATED),
                F.array_join(F.transform("p", lambda x: x["passage"]), "\n"),
            ),
        ).otherwise(F.col("query")).alias("query"),
    )
    expanded = materialize(expanded, "expanded")
    related = second(expanded, tier2, max_k).join(
        expanded.select(query_id, (F.col("k") - F.col("n_first")).alias("left")), query_id
    ).where("rank <= left").drop("left")
    both = found.withColumns({"stage": F.lit(1), "tier": F.lit("tier_1")}).unionByName(
        related.withColumns({"stage": F.lit(2), "tier": F.lit("tier_2")})
    )
    once = first_wins(both, [query_id, doc_id], ["stage", "rank"]).withColumnRenamed("rank", "r")
    ranked = top_rows(once, query_id, ["stage", "r", doc_id], max_k, max_k).drop("r")
    return ranked.select(
        query_id, doc_id, "score", "stage", "tier",
        F.when(F.col("stage") == 1, "textbook").otherwise("psychology").alias("source_kind"),
        F.col("rank").cast("bigint").alias("rank"),
    )


def compose_evidence(
    items: DataFrame, reserved: DataFrame, candidates: DataFrame, item: str = "query_id",
    allow_legacy: bool = True, pages: DataFrame | None = None,
) -> DataFrame:
    """Evidence per item: reserved sources first for clinical items, then the candidates.

    ``items`` carry ``level`` and ``evidence_limit``. Both candidate tables carry ``chunk_id,
    page_content, tier, source_tier, source_kind, score, rank``; with ``pages`` (chunk_id, page_content and
    more, one row a chunk) the texts stay there, and only those chosen are joined at the end.
    """
    limit = items.select(item, "level", "evidence_limit")
    share = F.greatest(F.lit(1), F.floor(F.col("evidence_limit") / 2))
    first = (
        reserved.join(limit.where(F.col("level") == C.CLINICAL), item)
        .where(F.col("rank") <= share)
        .drop("level", "evidence_limit")
        .withColumn("stage", F.lit(0))
    )
    both = first.unionByName(candidates.withColumn("stage", F.lit(1)), allowMissingColumns=True)
    if pages is None:
        shown = both.where(~X.blank(F.col("page_content")))
    else:
        shown = both.join(pages.where(~X.blank(F.col("page_content"))).select("chunk_id"), "chunk_id")
    usable = shown.where(F.coalesce("chunk_id", F.lit("")) != "")
    once = first_wins(usable, [item, "chunk_id"], ["stage", "rank"])
    kept = once.where(is_eligible(F.col("tier"), F.col("source_tier"), allow_legacy))
    most = max(r[3] for r in C.RETRIEVAL_POLICY)
    ranked = top_rows(
        kept.withColumnRenamed("rank", "r").join(limit.select(item, "evidence_limit"), item),
        item, ["stage", "r", "chunk_id"], F.col("evidence_limit"), most,
    )
    chosen = ranked.drop("r", "stage", "evidence_limit")
    return chosen if pages is None else chosen.join(pages, "chunk_id")


def safety_query(topic: Column, case: Column, question: Column, options: Column) -> Column:
    """One text per clinical item for the supplementary search."""
    parts = F.array(
        F.coalesce(topic, F.lit("")), X.flatten_json(F.to_json(F.struct(case.alias("c")))),
        X.flatten_json(F.to_json(F.struct(question.alias("q")))),
        X.flatten_json(F.to_json(F.struct(options.alias("o")))),
    )
    return F.array_join(F.filter(parts, lambda x: x != ""), " ")


def safety_context(
    items: DataFrame, reserved: DataFrame | Texts, item: str, doc_id: str, search: Search, k: int = 3
) -> DataFrame:
    """Up to three reserved chunks per clinical item; a miss or another level gives none."""
    asked = items.where(F.col("level") == C.CLINICAL)
    found = search(asked, reserved, k)
    lists = found.groupBy(item).agg(  # at most k per item
        F.array_sort(F.collect_list(F.struct("rank", doc_id))).alias("f")
    )
    return items.select(item, "level").join(lists, item, "left").select(
        item, "level",
        F.coalesce(
            F.transform("f", lambda x: x[doc_id]), F.array().cast("array<string>")
        ).alias("safety_docs"),
    )


def similar_failures(
    items: DataFrame, memory: DataFrame, k: int = 3, force: str | None = None
) -> DataFrame:
    """Most similar earlier failures of the same judge; the older one wins a tie.

    ``items``: ``item_id, judge, level, question``; ``memory``: ``seq, judge, level, question``. With a
    list ``judges`` in place of ``judge`` a question is split into words once for all of them, and the
    result has a column ``judge``. The memory side is normally bounded and broadcast; a larger one is
    met in blocks.
    """
    many = "judges" in items.columns
    q = items.select(
        "item_id", *(["judges"] if many else [F.col("judge").alias("group")]), "level",
        X.memory_words(F.coalesce("question", F.lit(""))).alias("words"),
    )
    if many:
        q = q.select("item_id", F.explode("judges").alias("group"), "level", "words")
    q = q.select((F.concat_ws("|", "group", "item_id") if many else F.col("item_id")).alias("query"), "group", "level", "words")
    c = memory.select(
        F.col("seq").alias("doc"), F.col("judge").alias("group"), "level",
        X.memory_words(F.coalesce("question", F.lit(""))).alias("words"),
    )
    found = _named(best_matches(q, c, WordOverlap(), k, prefer="corpus", force=force), "item_id", "seq")
    if not many:
        return found
    at = F.locate("|", "item_id")
    return found.select(
        F.substr("item_id", at + 1).cast(items.schema["item_id"].dataType).alias("item_id"),
        F.substr("item_id", F.lit(1), at - 1).alias("judge"), "seq", "score", "rank",
    )


def nearest_rule(
    candidates: DataFrame, rules: DataFrame, threshold: float = C.UPDATE_SIMILARITY,
    section: str = "section",
) -> DataFrame:
    """The closest rule of the same section for each candidate, if it is close enough."""
    best = vector_topk(candidates, rules, 1, "query_id", "rule_id", group=section)
    return best.where(F.col("score") >= threshold).drop("rank")


# --- anchors and embeddings ------------------------------------------------------------


def used_ids(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out.where(F.col(out.columns[0]).isNotNull()).distinct()


def sample_unused(
    chunks: DataFrame, used: DataFrame, n: int, key: str = "chunk_id", order: Column | None = None
) -> DataFrame:
    """Unused chunks in a fixed pseudo-random order, the first ``n`` of them, whatever ``n``.

    Keys (distinct) are dealt out by range of the order and counted in each part; parts before the bound
    are taken whole, only the part on it is cut. No task sees more than its part.
    """
    order = order if order is not None else F.xxhash64(F.col(key), F.lit(13))
    free = chunks.select(key).join(used.select(key), key, "left_anti").withColumn("_order", order)
    parts = spread(free, ["_order", key], "free")
    upto = W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)  # one row a part
    room = parts.groupBy(PART).agg(F.count(F.lit(1)).alias("_own")).withColumn("_before", F.coalesce(F.sum("_own").over(upto), F.lit(0)))
    room = room.where(F.col("_before") < n)
    here = W.partitionBy(PART).orderBy("_order", key)
    taken = parts.join(F.broadcast(room), PART).withColumn("_rank", F.row_number().over(here))
    taken = taken.where(F.col("_before") + F.col("_rank") <= n)
    return chunks.join(taken.select(key), key, "left_semi")


def check_dimension(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Stop the job on a vector of another length."""
    right = F.assert_true(F.size(column) == dim, F.lit(f"Expected {dim}-dimensional vectors"))
    return vectors.where(right.isNull())


def embedding_candidates(
    chunks: DataFrame, vectors: DataFrame | None, key: str, overwrite: bool = False
) -> DataFrame:
    """(key, text) of chunks still to be embedded; blank ones never are."""
    todo = chunks
    if vectors is not None and not overwrite:
        todo = chunks.join(vectors.select(key), key, "left_anti")
    text = X.first_text(F.col("content"), F.col("summary"))
    return todo.select(key, text.alias("text")).where(~X.blank(F.col("text")))
