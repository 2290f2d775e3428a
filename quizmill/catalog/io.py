"""Sources, sinks and user-function hooks: S01 to S12, F05, G01, G02, U02."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quizmill.catalog import views as V
from quizmill.catalog.shape import finished, items_with_reports
from quizmill.functions import models
from quizmill.functions import text as X
from quizmill.operators import retrieve as RT
from quizmill.operators import shape as S
from quizmill.sources import chunks as K
from quizmill.sources import jsonl, playbook, sidecars, sinks
from quizmill.storage import new_path

QUERIES, ORACLE = {}, {}


def query(name, views="", sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = V.with_views(views, sql.strip()) if views else sql
        return fn
    return register


def chunk_files(spark, d):
    """All chunks as array files of 50, one object file and one unreadable file."""
    fields = F.struct("uuid", "headers", "content", "summary", "keywords", "type", "source_tier")
    docs = V.chunks(spark, d)
    arrays = docs.where("doc_id > 0").groupBy(F.floor(F.col("doc_id") / 50).alias("part")).agg(
        F.to_json(F.collect_list(fields)).alias("value")
    )
    single = docs.where("doc_id = 0").select(F.lit(-1).cast("bigint").alias("part"), F.to_json(fields).alias("value"))
    broken = docs.where("doc_id = 0").select(F.lit(-2).cast("bigint").alias("part"), F.lit('[{"uuid": "x", ').alias("value"))
    path = new_path(spark, "chunk-json")
    arrays.unionByName(single).unionByName(broken).write.partitionBy("part").text(path)
    return path


_STORED = """SELECT uuid, header, md5(content) AS content_md5, summary, lang || ',' || source AS keywords, type,
 coalesce(source_tier, 'tier_2') AS source_tier FROM chunks"""


def stored(df):
    return df.select(
        "uuid", F.array_join("headers", "/").alias("header"), F.md5("content").alias("content_md5"),
        "summary", F.array_join("keywords", ",").alias("keywords"), "type", "source_tier",
    )


@query("S01_read_chunk_json", "chunks", _STORED)
def s01(spark, d):
    return stored(K.read_chunk_json(spark, chunk_files(spark, d), source_tier="tier_2", pattern="*.txt"))


@query("S12_append_with_stats", "chunks", """
, n AS (SELECT count(*) AS rows, count(DISTINCT doc_id // 50) FILTER (doc_id > 0) AS arrays, sum(length(content))::BIGINT AS characters FROM chunks)
SELECT arrays + 2 AS files, arrays + 1 AS files_with_rows, 1 AS bad_files, rows, characters, 2 * rows AS stored, rows AS reported FROM n""")
def s12(spark, d):
    scanned = K.scan_chunk_json(spark, chunk_files(spark, d), pattern="*.txt")
    path = new_path(spark, "appended")
    K.append_with_stats(scanned, path)
    report = K.append_with_stats(scanned, path)
    stored_rows = spark.read.parquet(path).count()
    return K.import_stats(scanned).withColumns({
        "stored": F.lit(stored_rows), "reported": F.lit(report["rows"]),
    })


LINE = "id string, question string, n bigint, anchor_id string"


def jsonl_files(spark, d, bad: bool):
    lines = V.recs(spark, d).select(
        F.to_json(F.struct("id", "question", F.col("doc_id").alias("n"),
                           F.concat(F.lit("doc-"), "doc_id").alias("anchor_id"))).alias("value")
    )
    extra = V.table(spark, d, "nation").select(F.explode(F.array(F.lit(""), F.lit("  "), F.lit("[1]"), F.lit("7"))).alias("value"))
    if bad:
        extra = V.table(spark, d, "nation").select(F.explode(F.array(F.lit('{"id": "PSY-9'), F.lit("not json"))).alias("value"))
    path = new_path(spark, "jsonl")
    lines.unionByName(extra).repartition("value").write.text(path)
    return path


@query("S02_read_jsonl_strict", "recs", "SELECT id, md5(question) AS question_md5, doc_id AS n FROM recs")
def s02(spark, d):
    rows = jsonl.read_strict(spark, jsonl_files(spark, d, bad=False), LINE)
    return rows.select("id", F.md5("question").alias("question_md5"), "n")


@query("S02_bad_lines", "", """
SELECT 'not json' AS value, count(*) AS lines, true AS numbered FROM nation UNION ALL SELECT '{"id": "PSY-9', count(*), true FROM nation""")
def s02_bad(spark, d):
    path = jsonl_files(spark, d, bad=True)
    bad = jsonl.bad_lines(spark, path)
    return bad.groupBy("value").agg(
        F.count("*").alias("lines"), (F.countDistinct("file", "line") == F.count("*")).alias("numbered")
    )


@query("S03_read_jsonl_lenient", "recs", "SELECT id, 'doc-' || doc_id AS anchor_id, doc_id AS n FROM recs")
def s03(spark, d):
    return jsonl.read_lenient(spark, jsonl_files(spark, d, bad=True), LINE).select("id", "anchor_id", "n")


@query("S05_read_collection", "", "SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents")
def s05(spark, d):
    path = new_path(spark, "collection")
    V.table(spark, d, "documents").withColumn("_id", F.md5("text")).write.parquet(path)
    return K.read_collection(spark, path).withColumn("text_md5", F.md5("text")).drop("text")


def books(spark, d):
    """Rulebooks of up to 30 rules, written as text files."""
    rules = V.bullets(spark, d).withColumn("book", F.floor(F.col("pos") / 30).cast("string")).withColumn(
        "content", F.translate("content", "\n", " ")
    )
    path = new_path(spark, "rulebook")
    text = playbook.render_playbook(rules).withColumn("text", F.concat(F.lit("<!-- v0.2 -->\n\n"), "text"))
    text.write.partitionBy("book").text(path)
    return path


@query("S06_parse_playbook", "bullets", """
SELECT CAST(pos // 30 AS VARCHAR) AS book, section, bullet_id, helpful::INT AS helpful, harmful::INT AS harmful,
 md5(replace(content, chr(10), ' ')) AS content_md5 FROM bullets""")
def s06(spark, d):
    read = playbook.read_playbooks(spark, books(spark, d)).withColumn(
        "book", F.regexp_extract("book", "book=([0-9]+)", 1)
    )
    return playbook.parse_playbook(read).select(
        "book", "section", "bullet_id", "helpful", "harmful", F.md5("content").alias("content_md5")
    )


@query("S07_read_sidecars", "", """
SELECT doc_id, 'usage' AS kind, 'evi-' || (doc_id % 40) AS name, doc_id % 7 AS n FROM documents
UNION ALL SELECT doc_id, 'id', 'doc-' || doc_id, 1 FROM documents
UNION ALL SELECT doc_id, 'issue', 'evidence:' || source, n_chars FROM documents
UNION ALL SELECT doc_id, 'issue', 'late', 0 FROM documents""")
def s07(spark, d):
    docs = V.table(spark, d, "documents")
    usage = docs.selectExpr("doc_id", "concat('{\"evi-', doc_id % 40, '\": ', doc_id % 7, ', \"a\": -1, \"b\": \"x\", \"c\": 1.5, \"d\": null}') AS value")
    ids = docs.selectExpr("doc_id", "concat('[\"doc-', doc_id, '\", \"\", null]') AS value")
    lists = docs.selectExpr("doc_id", "to_json(array(named_struct('issue', concat('evidence:', source), 'n', n_chars), named_struct('issue', 'late', 'n', 0L))) AS value")
    other = docs.selectExpr("doc_id", "'{\"issue\": \"no list\"}' AS value")
    schema = "issue: string, n: bigint"
    return (
        sidecars.counters(usage, ["doc_id"]).selectExpr("doc_id", "'usage' AS kind", "name", "n")
        .unionByName(sidecars.id_list(ids, ["doc_id"]).selectExpr("doc_id", "'id' AS kind", "id AS name", "1L AS n"))
        .unionByName(sidecars.object_list(lists.unionByName(other), schema, ["doc_id"]).selectExpr(
            "doc_id", "'issue' AS kind", "issue AS name", "n"))
    )


@query("S08_write_outputs", "recs", """
, c AS (SELECT count(*) FILTER (origin = 'verified') AS v, count(*) FILTER (origin <> 'verified') AS q FROM recs)
SELECT id, origin AS sink, origin <> 'verified' AS has_audit, CASE WHEN origin = 'verified' THEN v ELSE q END AS written
FROM recs, c""")
def s08(spark, d):
    records = S.assemble_records(finished(items_with_reports(spark, d)))
    base = new_path(spark, "outputs")
    counts = sinks.write_outputs(records, f"{base}/verified", f"{base}/quarantine")
    schema = "id string, _audit struct<verdict: string>"

    def read(name):
        return jsonl.read_strict(spark, f"{base}/{name}", schema).select(
            "id", F.lit(name).alias("sink"), F.col("_audit").isNotNull().alias("has_audit"),
            F.lit(counts[name]).alias("written"),
        )

    return read("verified").unionByName(read("quarantine"))


@query("S09_snapshot_state", "bullets", "SELECT bullet_id, helpful + 1 AS helpful, 2 AS version FROM bullets")
def s09(spark, d):
    base = new_path(spark, "state")
    rules = V.bullets(spark, d)
    sinks.save_state(rules.select("bullet_id", "helpful"), base)
    old = sinks.load_state(spark, base)
    version = sinks.save_state(old.withColumn("helpful", F.col("helpful") + 1), base)
    return sinks.load_state(spark, base).withColumn("version", F.lit(version))


@query("S11_upsert_columns", "chunks vecs", """
SELECT c.chunk_id, CASE WHEN v.chunk_id IS NOT NULL THEN 'section ' || section ELSE summary END AS summary,
 CASE WHEN v.chunk_id IS NOT NULL THEN len(embedding) END AS dim, CASE WHEN v.chunk_id IS NOT NULL THEN 'test' END AS embedding_model
FROM chunks c LEFT JOIN vecs v USING (chunk_id)""")
def s11(spark, d):
    new = V.vecs(spark, d).select(
        "chunk_id", "embedding", F.lit("test").alias("embedding_model"),
        F.concat(F.lit("section "), "section").alias("summary"),
    )
    out = K.upsert_columns(V.chunks(spark, d).select("chunk_id", "summary"), new, "chunk_id")
    return out.select(
        "chunk_id", "summary",
        F.when(F.col("embedding").isNotNull(), F.size("embedding").cast("bigint")).alias("dim"), "embedding_model",
    )


@query("F05_embedding_candidates", "chunks vecs", """
SELECT chunk_id, md5(CASE WHEN content = '' THEN summary ELSE content END) AS text_md5 FROM chunks
WHERE chunk_id NOT IN (SELECT chunk_id FROM vecs) AND regexp_matches(CASE WHEN content = '' THEN summary ELSE content END, '\\S')""")
def f05(spark, d):
    done = RT.check_dimension(V.vecs(spark, d).select("chunk_id", "embedding"), 64)
    todo = RT.embedding_candidates(V.chunks(spark, d), done, "chunk_id")
    return todo.select("chunk_id", F.md5("text").alias("text_md5"))


def word_length_vectors(texts: list[str]) -> list[list[float]]:
    """A stand-in embedder: words counted by length, normalised."""
    out = []
    for text in texts:
        counts = [0.0] * 8
        for word in text.split(" "):
            counts[len(word) % 8] += 1
        norm = math.sqrt(sum(c * c for c in counts))
        out.append([c / norm for c in counts])
    return out


_LEN8 = "[" + ", ".join(f"len([1 FOR w IN string_split(text, ' ') IF length(w) % 8 = {i}])::DOUBLE" for i in range(8)) + "]"


@query("G01_embed_texts", "", f"""
WITH v AS (SELECT doc_id, {_LEN8} AS v FROM documents)
SELECT doc_id, {", ".join(f"round((v[{i + 1}] / sqrt(list_sum([x * x FOR x IN v])))::FLOAT::DOUBLE, 5) AS e{i}" for i in range(8))}, 'words' AS model FROM v""")
def g01(spark, d):
    out = models.embed_texts(V.table(spark, d, "documents"), "doc_id", "text", word_length_vectors, "words")
    return out.select(
        "doc_id", *[F.round(F.col("embedding")[i].cast("double"), 5).alias(f"e{i}") for i in range(8)],
        F.col("embedding_model").alias("model"),
    )


def _number(request: str) -> int:
    at = request.index('"n":') + 4
    return int(request[at:].split("}")[0].split(",")[0])


def stub_primary(role: str, request: str) -> str:
    n = _number(request)
    if n % 11 == 0:
        raise ConnectionError("down")
    return f'{{"role": "{role}", "n": {n}, "by": "primary"}}'


def stub_judge(role: str, request: str) -> str:
    n = _number(request)
    if n % 5 == 0:
        raise TimeoutError("slow")
    if n % 7 == 0:
        raise models.OutputError("llm_output_truncated")
    return f'{{"role": "{role}", "n": {n}, "by": "judge"}}'


@query("G02_respond", "recs", """
, r AS (SELECT doc_id AS n, id AS item_id, role FROM recs CROSS JOIN (VALUES ('generator'), ('evidence')) v(role))
SELECT item_id, role, CASE WHEN role = 'generator' OR n % 5 = 0 THEN 'primary' ELSE 'judge' END AS answered_by,
 CASE WHEN role = 'evidence' AND n % 5 <> 0 THEN CASE WHEN n % 7 = 0 THEN 'llm_output_truncated' END
   WHEN n % 11 = 0 THEN 'ConnectionError' END AS error,
 CASE WHEN role = 'evidence' AND n % 5 <> 0 THEN CASE WHEN n % 7 <> 0 THEN n END WHEN n % 11 <> 0 THEN n END AS n FROM r""")
def g02(spark, d):
    items = V.recs(spark, d).select(F.col("id").alias("item_id"), "level", F.col("doc_id").alias("n"))
    asked = S.build_requests(items, ["generator", "evidence"], ["n"])
    out = X.with_json_object(models.respond(asked, ["item_id"], stub_primary, stub_judge), "reply", "o")
    return out.select(
        "item_id", "role", "answered_by", "error",
        F.try_variant_get("o", "$.n", "bigint").alias("n"),
    )


@query("U02_used_ids", "chunks", """
SELECT DISTINCT chunk_id FROM chunks JOIN labels USING (doc_id)
UNION SELECT chunk_id FROM chunks WHERE source_tier = 'tier_3'""")
def u02(spark, d):
    docs = V.chunks(spark, d)
    used = docs.join(V.table(spark, d, "labels").select("doc_id"), "doc_id")
    return RT.used_ids(used.select("chunk_id"), docs.where("source_tier = 'tier_3'").select("chunk_id"))
