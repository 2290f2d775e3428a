"""The driver tables reshaped as chunks, items, reports and memories.

Every view covers its whole tables and whole texts. ``SQL`` states the same views for the
oracle; ids only decide which defect or label a row carries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).selectExpr(
        "doc_id",
        "concat('doc-', doc_id) AS chunk_id",
        "CASE WHEN doc_id % 10 <> 9 THEN concat('doc-', doc_id) END AS uuid",
        "array(source) AS headers",
        "CASE WHEN doc_id % 6 = 5 THEN '' ELSE concat(lang, '/', source) END AS title",
        "text AS content",
        "concat(lang, ' passage from ', source, ' with ', n_chars, ' characters') AS summary",
        "array(lang, source) AS keywords",
        "lang AS type",
        "source",
        "CASE doc_id % 5 WHEN 0 THEN 'tier_1' WHEN 1 THEN 'tier_1' WHEN 2 THEN 'Tier 2' "
        "WHEN 3 THEN 'tier_3' END AS source_tier",
        "CASE WHEN doc_id % 14 = 4 THEN 'Draft' END AS tier",
        "CASE WHEN doc_id % 10 = 0 THEN concat('Condition ', source) END AS disease_name",
        "CASE WHEN doc_id % 20 = 0 THEN concat('F', doc_id) END AS code",
        "CASE WHEN doc_id % 10 = 0 THEN CASE WHEN doc_id % 30 = 0 THEN concat('\"', lang, '\"') "
        "ELSE concat('[\"', lang, '\",\"', 'other', '\"]') END END AS differential_json",
        "doc_id % 7 AS chunk_index",
    )


def vecs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").selectExpr(
        "vec_id", "concat('doc-', vec_id) AS chunk_id", "embedding", "label AS section"
    )


def bench(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").selectExpr("item_id AS query_id", "text AS query")


def bench_vecs(spark: SparkSession, d: str) -> DataFrame:
    return bench(spark, d).join(
        vecs(spark, d).selectExpr("vec_id AS query_id", "embedding", "section"), "query_id"
    )


def _option(k: int) -> str:
    """The words whose place, modulo 4 to 6, is ``k`` (from the third on: all further ones); each is looked at once."""
    step = "CAST(4 + doc_id % 3 AS INT)"
    pick = "get(words, i)" if k < 3 else f"array_join(slice(words, i + 1, {step} - 3), ' ')"
    return (
        f"CASE WHEN size(words) > {k} AND {step} > {k} THEN array_join(transform("
        f"sequence({k}, size(words) - 1, {step}), i -> {pick}), ' ') WHEN words IS NOT NULL THEN '' END"
    )


BASE = "substr('ABCD', CAST((doc_id + CASE WHEN doc_id % 61 = 0 THEN 1 ELSE 0 END) % 4 AS INT) + 1, 1)"
LIMIT = "CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 6 END"


def recs(spark: SparkSession, d: str) -> DataFrame:
    df = documents(spark, d).selectExpr("*", "split(text, ' ') AS words").selectExpr(
        "doc_id",
        "source",
        "lang",
        "format_string('PSY-%06d', doc_id + 1) AS id",
        "element_at(array('direct','rag_only','rag_judges','full'), CAST(doc_id % 4 AS INT) + 1) AS method",
        "element_at(array('theory','emotion','educational_scenario','clinical_scenario'), "
        "CAST(doc_id div 4 % 4 AS INT) + 1) AS level",
        "element_at(array('easy','medium','hard'), CAST(doc_id % 3 AS INT) + 1) AS difficulty",
        "CASE WHEN doc_id % 73 = 0 THEN ' ' WHEN doc_id % 19 = 0 THEN concat(text, ' 心理') "
        "ELSE text END AS question",
        f"{_option(0)} AS oa",
        f"concat({_option(1)}, CASE WHEN doc_id % 23 = 0 THEN ' LUÔN  LUÔN' ELSE '' END) AS ob",
        f"concat({_option(2)}, CASE WHEN doc_id % 71 = 0 THEN ' A và B đều đúng' ELSE '' END) AS oc",
        f"concat({_option(3)}, CASE WHEN doc_id % 67 = 0 THEN ' ngay lập tức' ELSE '' END) AS od",
        f"{BASE} AS base",
        f"CASE WHEN doc_id % 43 = 0 THEN 0 WHEN doc_id % 47 = 0 THEN 1 + {LIMIT} ELSE {LIMIT} END AS n_refs",
        "CASE WHEN doc_id % 31 <> 0 THEN concat('Because of ', source) END AS rationale_short",
        "CASE WHEN doc_id % 37 = 0 THEN CAST(array() AS array<string>) "
        "ELSE array(concat('check ', lang), concat('check ', source)) END AS audit_steps",
        "CASE WHEN doc_id div 4 % 4 = 3 THEN concat('Hypothetical Case: ', source) END AS clinical_case",
        "CASE WHEN doc_id % 29 = 0 THEN '  ' ELSE concat('Case in ', lang) END AS case_summary",
        "CASE WHEN doc_id % 5 < 4 THEN 'verified' ELSE 'quarantine' END AS origin",
    )
    df = df.selectExpr(
        "*",
        "map_filter(map('A', oa, 'B', ob, 'C', oc, 'D', CASE WHEN doc_id % 17 <> 0 THEN od END), "
        "(k, v) -> v IS NOT NULL) AS options",
        "CASE WHEN doc_id % 11 <> 0 THEN base END AS answer",
        "map_from_entries(transform(filter(array('A','B','C','D'), k -> k <> base AND NOT "
        "(doc_id % 53 = 0 AND k = substr('BCDA', instr('ABCD', base), 1))), "
        "k -> struct(k, CASE WHEN doc_id % 59 = 0 THEN ' ' ELSE concat('Option ', k, "
        "' lacks support in ', source) END))) AS distractor_analysis",
        "transform(filter(array(1,2,3,4,5,6,7), j -> j <= n_refs), j -> named_struct("
        "'chunk_id', concat('doc-', doc_id + j), 'source_kind', "
        "element_at(array('dsm5','textbook','psychology'), CAST((doc_id + j) % 3 AS INT) + 1), "
        "'score', round(1D / (j + 1), 4))) AS refs",
    )
    return df.selectExpr(
        "doc_id", "id", "method", "level", "difficulty", "source", "lang", "question", "options",
        "answer", "distractor_analysis", "refs",
        "concat(slice(transform(refs, r -> r.chunk_id), 1, CAST(least(1 + doc_id % 4, n_refs) AS INT)), "
        "CASE WHEN doc_id % 13 = 0 THEN array('doc-unknown') ELSE CAST(array() AS array<string>) END) AS cited",
        "rationale_short", "audit_steps", "clinical_case", "case_summary", "origin",
    )


def reports(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "labels").selectExpr(
        "doc_id", "quality", "toxic", f"{BASE} AS base",
        "stack(4, 1, 'evidence', 2, 'single_answer', 3, 'ei_safety_bias', 4, 'adversarial_solver') "
        "AS (ord, judge)",
    )
    return base.selectExpr(
        "doc_id", "ord", "judge", "base",
        "CASE ord WHEN 1 THEN quality = 1 WHEN 2 THEN quality = 1 OR doc_id % 3 <> 0 "
        "WHEN 3 THEN toxic = 0 ELSE doc_id % 7 <> 0 END AS passed",
        "element_at(array('evidence_mismatch','blueprint_mismatch','irrelevant_citation','surface_cue'), "
        "CAST(doc_id % 4 AS INT) + 1) AS issue",
    ).selectExpr(
        "doc_id", "ord", "judge", "passed",
        "CASE WHEN passed THEN CAST(array() AS array<string>) WHEN doc_id % 9 <> 0 THEN array(issue) END AS issues",
        "CASE WHEN passed THEN '' ELSE concat('Fix ', issue, ' for ', judge) END AS feedback",
        "judge = 'adversarial_solver' AND doc_id % 2 = 0 AS blocking",
        "CASE WHEN judge = 'single_answer' THEN map_from_entries(transform(filter(array('A','B','C','D'), "
        "k -> NOT (doc_id % 8 = 0 AND k = 'D')), k -> struct(k, CASE WHEN k = base THEN 'correct' "
        "WHEN doc_id % 5 = 0 AND k = 'B' THEN 'ambiguous' ELSE 'incorrect' END))) END AS assessment",
        "CASE WHEN judge = 'adversarial_solver' THEN CASE WHEN doc_id % 4 = 3 THEN 'A' ELSE base END END AS selected",
        "CASE WHEN doc_id % 5 = 1 THEN 'low' ELSE 'high' END AS confidence",
        "element_at(array('length','absolute_wording','unique_qualification','grammar','none','other'), "
        "CAST(doc_id div 3 % 6 AS INT) + 1) AS cue_type",
        "CASE WHEN doc_id % 10 = 3 THEN ' ' ELSE concat('option ', base, ' stands out') END AS cue_text",
    )


def expert(spark: SparkSession, d: str) -> DataFrame:
    """Label texts as they stand in an audit file, one row per (method, id)."""
    return recs(spark, d).join(table(spark, d, "labels"), "doc_id").selectExpr(
        "doc_id", "method", "id", "quality", "toxic",
        *[
            f"element_at(array('pass','FAIL',' true ','0','','maybe'), "
            f"CAST((doc_id + {i}) % 6 AS INT) + 1) AS {name}"
            for i, name in enumerate(
                ["overall_publishable", "key_correct", "single_best_answer", "evidence_supported",
                 "distractors_plausible", "vi_language_quality", "ei_safety_bias"]
            )
        ],
    )


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """All attempts of an item in order; the event type gives the outcome."""
    return table(spark, d, "events").selectExpr(
        "user_id AS item",
        "ts", "event_id",
        "CASE event_type WHEN 'error' THEN 'evidence:evidence_mismatch' WHEN 'click' THEN "
        "'evidence:blueprint_mismatch' WHEN 'signup' THEN 'evidence:irrelevant_citation' "
        "WHEN 'view' THEN 'surface_cue:absolute_wording' END AS issue",
        "event_type = 'purchase' AS verified",
        "format_string('%s-%05d', element_at(array('evi','err','suc'), CAST(user_id % 40 % 3 AS INT) + 1), "
        "user_id % 40) AS rule_id",
    )


def fails(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "events")
        .where("event_type IN ('error', 'click')")
        .selectExpr(
            "concat(CASE WHEN event_id % 3 = 0 THEN 'evidence:' ELSE '' END, event_type, ':', "
            "user_id, ':', event_id % 5) AS issue",
            "event_id AS seq", "props AS feedback", "user_id",
        )
    )


def judge_memory(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "conversations")
        .where("role = 'user'")
        .selectExpr(
            "conv_id * 1000 + turn AS seq",
            "element_at(array('evidence','single_answer','ei_safety_bias'), CAST(conv_id % 3 AS INT) + 1) AS judge",
            "element_at(array('theory','emotion','educational_scenario','clinical_scenario'), "
            "CAST(turn % 4 AS INT) + 1) AS level",
            "text AS question",
        )
    )


def bullets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").selectExpr(
        "element_at(array('EVIDENCE & GROUNDING','COMMON MISTAKES TO AVOID',"
        "'SUCCESSFUL STRATEGIES TO REPLICATE'), CAST(item_id % 3 AS INT) + 1) AS section",
        "format_string('%s-%05d', element_at(array('evi','err','suc'), CAST(item_id % 3 AS INT) + 1), item_id) AS bullet_id",
        "item_id % 4 AS helpful", "item_id % 3 AS harmful", "text AS content", "item_id AS pos",
    )


def qa(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    ask = turns.where("role = 'user'").selectExpr("conv_id", "turn", "text AS question")
    reply = turns.where("role = 'assistant'").selectExpr(
        "conv_id", "turn - 1 AS turn", "text AS reply"
    )
    return ask.join(reply, ["conv_id", "turn"]).selectExpr(
        "format_string('PSY-%06d', conv_id % 50) AS id",
        "format_string('part-%d.jsonl', conv_id % 4) AS file",
        "conv_id * 1000 + turn AS line",
        "question",
        "CASE WHEN conv_id % 9 <> 0 THEN concat('About ', question) END AS thinking",
        "CASE WHEN conv_id % 12 = 0 THEN concat('Error parsing answer - Model failed to output "
        "<answer> tag ', reply) ELSE reply END AS answer",
    )


def raw(spark: SparkSession, d: str) -> DataFrame:
    """Replies in the four forms a model sends; the reply text is kept whole."""
    quoted = "concat('{\"answer\":', to_json(named_struct('t', text)), ',\"n\":', turn, '}')"
    return (
        table(spark, d, "conversations")
        .where("role = 'assistant'")
        .selectExpr(
            "conv_id", "turn", "text",
            f"CASE conv_id % 4 WHEN 0 THEN {quoted} "
            f"WHEN 1 THEN concat('Here it is: ```json\\n', {quoted}, '\\n``` done {{x}}') "
            "WHEN 2 THEN concat('<step>x</step> (answer)', text, '</answer>') "
            "ELSE concat('{\"answer\": \"', 'cut off') END AS reply",
        )
    )


# --- the same views for the oracle -----------------------------------------------------


def _sql_option(k: int) -> str:
    return (
        "array_to_string(list_filter(string_split(text, ' '), "
        f"lambda x, i: least((i - 1) % (4 + doc_id % 3), 3) = {k}), ' ')"
    )


_SQL_BASE = BASE
_LETTER = "['A','B','C','D']"

SQL = {
    "chunks": """
SELECT doc_id, 'doc-' || doc_id AS chunk_id,
  CASE WHEN doc_id % 10 <> 9 THEN 'doc-' || doc_id END AS uuid, source AS header,
  CASE WHEN doc_id % 6 = 5 THEN '' ELSE lang || '/' || source END AS title, text AS content,
  lang || ' passage from ' || source || ' with ' || n_chars || ' characters' AS summary,
  lang, lang AS type, source,
  CASE doc_id % 5 WHEN 0 THEN 'tier_1' WHEN 1 THEN 'tier_1' WHEN 2 THEN 'Tier 2' WHEN 3 THEN 'tier_3' END AS source_tier,
  CASE WHEN doc_id % 14 = 4 THEN 'Draft' END AS tier,
  CASE WHEN doc_id % 10 = 0 THEN 'Condition ' || source END AS disease_name,
  CASE WHEN doc_id % 20 = 0 THEN 'F' || doc_id END AS code,
  CASE WHEN doc_id % 10 = 0 THEN CASE WHEN doc_id % 30 = 0 THEN lang ELSE lang || ', other' END END AS differential,
  doc_id % 7 AS chunk_index
FROM documents""",
    "vecs": "SELECT vec_id, 'doc-' || vec_id AS chunk_id, embedding, label AS section FROM embeddings",
    "bench": "SELECT item_id AS query_id, text AS query FROM benchmark",
    "bench_vecs": """
SELECT item_id AS query_id, text AS query, embedding, label AS section
FROM benchmark JOIN embeddings ON item_id = vec_id""",
    "recs": f"""
SELECT *, printf('PSY-%06d', doc_id + 1) AS id,
  CASE WHEN doc_id % 17 <> 0 THEN od0 END AS od,
  CASE WHEN doc_id % 11 <> 0 THEN base END AS answer,
  CASE WHEN base <> 'A' AND NOT (doc_id % 53 = 0 AND base = 'D') THEN CASE WHEN doc_id % 59 = 0 THEN ' ' ELSE 'Option A lacks support in ' || source END END AS da,
  CASE WHEN base <> 'B' AND NOT (doc_id % 53 = 0 AND base = 'A') THEN CASE WHEN doc_id % 59 = 0 THEN ' ' ELSE 'Option B lacks support in ' || source END END AS db,
  CASE WHEN base <> 'C' AND NOT (doc_id % 53 = 0 AND base = 'B') THEN CASE WHEN doc_id % 59 = 0 THEN ' ' ELSE 'Option C lacks support in ' || source END END AS dc,
  CASE WHEN base <> 'D' AND NOT (doc_id % 53 = 0 AND base = 'C') THEN CASE WHEN doc_id % 59 = 0 THEN ' ' ELSE 'Option D lacks support in ' || source END END AS dd,
  [{{'chunk_id': 'doc-' || (doc_id + j), 'source_kind': (['dsm5','textbook','psychology'])[(doc_id + j) % 3 + 1],
     'score': round(1.0::DOUBLE / (j + 1), 4)}} FOR j IN range(1, n_refs + 1)] AS refs,
  list_concat(['doc-' || (doc_id + j) FOR j IN range(1, least(1 + doc_id % 4, n_refs) + 1)],
     CASE WHEN doc_id % 13 = 0 THEN ['doc-unknown'] ELSE [] END) AS cited
FROM (
  SELECT doc_id, source, lang,
    (['direct','rag_only','rag_judges','full'])[doc_id % 4 + 1] AS method,
    (['theory','emotion','educational_scenario','clinical_scenario'])[(doc_id // 4) % 4 + 1] AS level,
    (['easy','medium','hard'])[doc_id % 3 + 1] AS difficulty,
    CASE WHEN doc_id % 73 = 0 THEN ' ' WHEN doc_id % 19 = 0 THEN text || ' 心理' ELSE text END AS question,
    {_sql_option(0)} AS oa,
    {_sql_option(1)} || CASE WHEN doc_id % 23 = 0 THEN ' LUÔN  LUÔN' ELSE '' END AS ob,
    {_sql_option(2)} || CASE WHEN doc_id % 71 = 0 THEN ' A và B đều đúng' ELSE '' END AS oc,
    {_sql_option(3)} || CASE WHEN doc_id % 67 = 0 THEN ' ngay lập tức' ELSE '' END AS od0,
    {_SQL_BASE} AS base,
    CASE WHEN doc_id % 43 = 0 THEN 0 WHEN doc_id % 47 = 0 THEN 1 + {LIMIT} ELSE {LIMIT} END AS n_refs,
    CASE WHEN doc_id % 31 <> 0 THEN 'Because of ' || source END AS rationale_short,
    CASE WHEN doc_id % 37 = 0 THEN [] ELSE ['check ' || lang, 'check ' || source] END AS audit_steps,
    CASE WHEN (doc_id // 4) % 4 = 3 THEN 'Hypothetical Case: ' || source END AS clinical_case,
    CASE WHEN doc_id % 29 = 0 THEN '  ' ELSE 'Case in ' || lang END AS case_summary,
    CASE WHEN doc_id % 5 < 4 THEN 'verified' ELSE 'quarantine' END AS origin
  FROM documents)""",
    "reports": f"""
SELECT *, CASE WHEN passed THEN [] WHEN doc_id % 9 <> 0 THEN [issue] END AS issues,
  CASE WHEN passed THEN '' ELSE 'Fix ' || issue || ' for ' || judge END AS feedback,
  judge = 'adversarial_solver' AND doc_id % 2 = 0 AS blocking,
  CASE WHEN doc_id % 4 = 3 THEN 'A' ELSE base END AS selected,
  CASE WHEN doc_id % 5 = 1 THEN 'low' ELSE 'high' END AS confidence,
  (['length','absolute_wording','unique_qualification','grammar','none','other'])[(doc_id // 3) % 6 + 1] AS cue_type,
  CASE WHEN doc_id % 10 = 3 THEN ' ' ELSE 'option ' || base || ' stands out' END AS cue_text
FROM (SELECT doc_id, ord, judge, {_SQL_BASE} AS base,
    CASE ord WHEN 1 THEN quality = 1 WHEN 2 THEN quality = 1 OR doc_id % 3 <> 0
      WHEN 3 THEN toxic = 0 ELSE doc_id % 7 <> 0 END AS passed,
    (['evidence_mismatch','blueprint_mismatch','irrelevant_citation','surface_cue'])[doc_id % 4 + 1] AS issue
  FROM labels CROSS JOIN (VALUES (1,'evidence'),(2,'single_answer'),(3,'ei_safety_bias'),(4,'adversarial_solver')) j(ord, judge))""",
    "attempts": """
SELECT user_id AS item, ts, event_id,
  CASE event_type WHEN 'error' THEN 'evidence:evidence_mismatch' WHEN 'click' THEN 'evidence:blueprint_mismatch'
    WHEN 'signup' THEN 'evidence:irrelevant_citation' WHEN 'view' THEN 'surface_cue:absolute_wording' END AS issue,
  event_type = 'purchase' AS verified, printf('%s-%05d', (['evi','err','suc'])[user_id % 40 % 3 + 1], user_id % 40) AS rule_id
FROM events""",
    "fails": """
SELECT CASE WHEN event_id % 3 = 0 THEN 'evidence:' ELSE '' END || event_type || ':' || user_id || ':' || (event_id % 5) AS issue,
  event_id AS seq, props AS feedback, user_id
FROM events WHERE event_type IN ('error', 'click')""",
    "judge_memory": """
SELECT conv_id * 1000 + turn AS seq, (['evidence','single_answer','ei_safety_bias'])[conv_id % 3 + 1] AS judge,
  (['theory','emotion','educational_scenario','clinical_scenario'])[turn % 4 + 1] AS level, text AS question
FROM conversations WHERE role = 'user'""",
    "bullets": """
SELECT (['EVIDENCE & GROUNDING','COMMON MISTAKES TO AVOID','SUCCESSFUL STRATEGIES TO REPLICATE'])[item_id % 3 + 1] AS section,
  printf('%s-%05d', (['evi','err','suc'])[item_id % 3 + 1], item_id) AS bullet_id,
  item_id % 4 AS helpful, item_id % 3 AS harmful, text AS content, item_id AS pos
FROM benchmark""",
    "qa": """
SELECT printf('PSY-%06d', conv_id % 50) AS id, 'part-' || (conv_id % 4) || '.jsonl' AS file,
  conv_id * 1000 + u.turn AS line, u.text AS question,
  CASE WHEN conv_id % 9 <> 0 THEN 'About ' || u.text END AS thinking,
  CASE WHEN conv_id % 12 = 0 THEN 'Error parsing answer - Model failed to output <answer> tag ' || a.text ELSE a.text END AS answer
FROM conversations u JOIN (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant') a
  USING (conv_id, turn) WHERE u.role = 'user'""",
}
SQL["expert"] = (
    "SELECT doc_id, method, id, quality, toxic, "
    + ", ".join(
        f"(['pass','FAIL',' true ','0','','maybe'])[(doc_id + {i}) % 6 + 1] AS x_{name}"
        for i, name in enumerate(
            ["overall_publishable", "key_correct", "single_best_answer", "evidence_supported",
             "distractors_plausible", "vi_language_quality", "ei_safety_bias"]
        )
    )
    + " FROM recs JOIN labels USING (doc_id)"
)


def with_views(names: str, body: str) -> str:
    return (
        "WITH " + ", ".join(f"{n} AS ({SQL[n].strip()})" for n in names.split()) + "\n" + body
    )
