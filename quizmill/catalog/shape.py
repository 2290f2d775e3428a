"""Projections P01 to P20."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizmill import constants as C
from quizmill.catalog import views as V
from quizmill.functions import records as R
from quizmill.functions import text as X
from quizmill.operators import shape as S

QUERIES, ORACLE = {}, {}


def query(name, views="", sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = V.with_views(views, sql) if views else sql
        return fn
    return register


@query("P01_normalize_chunks", "chunks", """
SELECT md5(content) AS content_md5, uuid, header AS headers, summary, lang || ',' || source AS keywords, type
FROM chunks WHERE content <> ''""")
def p01(spark, d):
    m = F.col("metadata")
    return S.normalize_chunks(V.chunks(spark, d)).select(
        F.md5("page_content").alias("content_md5"), m["uuid"].alias("uuid"),
        F.array_join(m["headers"], "/").alias("headers"), m["summary"].alias("summary"),
        F.array_join(m["keywords"], ",").alias("keywords"), m["type"].alias("type"),
    )


_TITLE = "coalesce(nullif(title, ''), disease_name, nullif(header, ''), source)"
_PAGE = f"""CASE WHEN disease_name IS NOT NULL THEN '{C.LABEL_CONDITION}' || disease_name
  || coalesce(chr(10) || '{C.LABEL_CODE}' || code, '') || coalesce(chr(10) || '{C.LABEL_DIFFERENTIAL}' || differential, '')
  || chr(10) || chr(10) || 'Nội dung:' || chr(10) || content
 ELSE '{C.LABEL_TITLE}' || {_TITLE} || chr(10) || '{C.LABEL_SUMMARY}' || summary || chr(10) || 'Nội dung:' || chr(10) || content END"""


@query("P02_format_document", "chunks", f"""
SELECT chunk_id, md5({_PAGE}) AS page_md5, {_TITLE} AS title,
 coalesce(tier, source_tier, '') AS tier, coalesce(source_tier, tier, '') AS source_tier,
 'psychology' AS source_kind, 'tier_1' AS forced_tier, 'textbook' AS forced_kind,
 coalesce(code, '') AS code, coalesce(uuid, '') AS uuid
FROM chunks""")
def p02(spark, d):
    docs = V.chunks(spark, d)
    plain = S.format_documents(docs).select(
        "doc_id", F.md5("page_content").alias("page_md5"), "metadata"
    )
    m = F.col("metadata")
    forced = S.format_documents(docs.select("doc_id", "source_tier"), force_tier="tier_1").select(
        "doc_id", m["tier"].alias("forced_tier"), m["source_kind"].alias("forced_kind")
    )
    return plain.join(forced, "doc_id").select(
        m["chunk_id"].alias("chunk_id"), "page_md5", m["title"].alias("title"),
        m["tier"].alias("tier"), m["source_tier"].alias("source_tier"),
        m["source_kind"].alias("source_kind"), "forced_tier", "forced_kind",
        m["code"].alias("code"), m["uuid"].alias("uuid"),
    )


TIER_SQL = """CASE WHEN lower(coalesce(nullif(tier,''), nullif(source_tier,''), '')) IN ('1','tier 1','tier_1','tier1') THEN 'Tier 1'
 WHEN lower(coalesce(nullif(tier,''), nullif(source_tier,''), '')) IN ('2','tier 2','tier_2','tier2') THEN 'Tier 2'
 WHEN lower(coalesce(nullif(tier,''), nullif(source_tier,''), '')) IN ('3','tier 3','tier_3','tier3') THEN 'Tier 3'
 WHEN coalesce(nullif(tier,''), nullif(source_tier,''), '') = '' THEN 'Tier 2 (legacy-unclassified)'
 ELSE 'Unapproved tier (' || lower(coalesce(nullif(tier,''), source_tier)) || ')' END"""


@query("P03_document_tier", "chunks", f"SELECT chunk_id, {TIER_SQL} AS tier FROM chunks")
def p03(spark, d):
    return V.chunks(spark, d).select(
        "chunk_id", X.document_tier(F.col("tier"), F.col("source_tier")).alias("tier")
    )


@query("P04_evidence_refs", "chunks", f"""
SELECT chunk_id, {TIER_SQL} AS tier, 'psychology' AS source_kind, {_TITLE} AS title, 0.0::DOUBLE AS score,
 md5(substr({_PAGE}, 1, 1200)) AS excerpt_md5,
 'chunk_index=' || chunk_index || ';source=' || source || ';source_sha256=' AS provenance
FROM chunks""")
def p04(spark, d):
    ref = S.evidence_ref(F.col("page_content"), F.col("metadata"))
    entries = F.array_sort(F.transform(
        F.map_entries("r.provenance"), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    ))
    return S.format_documents(V.chunks(spark, d)).select(ref.alias("r")).select(
        "r.chunk_id", "r.tier", "r.source_kind", "r.title", "r.score",
        F.md5("r.excerpt").alias("excerpt_md5"), F.array_join(entries, ";").alias("provenance"),
    )


@query("P05_anchor_view", "chunks", """
SELECT chunk_id, coalesce(nullif(title, ''), header) AS title, summary, md5(content) AS content_md5,
 lang || ',' || source AS keywords, type, coalesce(tier, source_tier) AS tier FROM chunks""")
def p05(spark, d):
    return S.anchor_view(V.chunks(spark, d)).select(
        "chunk_id", "title", "summary", F.md5("content").alias("content_md5"),
        F.array_join("keywords", ",").alias("keywords"), "type", "tier",
    )


@query("P06_canonical_query", "qa", """
, k AS (SELECT id, line, answer, trim(regexp_replace(lower(question), '\\s+', ' ', 'g')) AS q FROM qa)
SELECT id, line, md5(q) AS query_md5, count(*) OVER (PARTITION BY q) AS askers, length(q) AS chars FROM k
""".strip())
def p06(spark, d):
    def compute(q):
        c = X.canonical_query(F.col("question"))
        return q.select("key", "question", F.md5(c).alias("query_md5"), F.length(c).cast("bigint").alias("chars"))

    asked = V.qa(spark, d).select("id", "line", "question")
    done = S.once_per_query(asked, compute, text="question")
    askers = done.groupBy("query_md5").agg(F.count("*").alias("askers"))
    return done.join(askers, "query_md5").select("id", "line", "query_md5", "askers", "chars")


@query("P07_flatten_text", "recs", """
SELECT id, md5(array_to_string(list_filter([clinical_case, question, oa, ob, oc, od, audit_steps[1], audit_steps[2]],
  lambda x: x IS NOT NULL AND x <> ''), ' ')) AS text_md5 FROM recs""")
def p07(spark, d):
    nested = F.to_json(F.struct("clinical_case", "question", F.struct("options", "audit_steps").alias("x")))
    return V.recs(spark, d).select("id", F.md5(X.flatten_json(nested)).alias("text_md5"))


def plan_replies(spark, d):
    """Planner replies in the wrapped, bare, incomplete and unreadable forms."""
    recs = V.recs(spark, d).selectExpr("doc_id", "id", "level", "difficulty", "source", "lang", "question")
    anchors = V.chunks(spark, d).selectExpr("doc_id", "title", "summary")
    inner = """to_json(named_struct(
      'topic', CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE source END, 'subtopic', lang,
      'skill', CASE WHEN doc_id % 5 <> 0 THEN 'recall' END,
      'retrieval_query', CASE WHEN doc_id % 3 <> 0 THEN question END,
      'playbook_bullet_ids', CASE WHEN doc_id % 6 <> 0 THEN array('evi-00002', 'qad-00004') END,
      'requires_emobench', doc_id % 2 = 1,
      'emobench', named_struct('task', CASE doc_id % 3 WHEN 0 THEN 'EA' WHEN 1 THEN 'EU' ELSE 'XX' END,
        'eu_category', CASE WHEN doc_id % 4 = 1 THEN 'emotional_cues' ELSE 'other' END,
        'relationship_type', 'social', 'problem_owner', 'nobody')))"""
    return recs.join(anchors, "doc_id").selectExpr("*", f"{inner} AS inner").selectExpr(
        "doc_id", "id", "level", "difficulty", "title", "summary",
        "CASE doc_id % 5 WHEN 0 THEN concat('{\"blueprint\":', inner, '}') "
        "WHEN 1 THEN concat('{\"planning_blueprint\":', inner, ',\"x\":1}') "
        "WHEN 2 THEN inner WHEN 3 THEN concat('{\"curriculum_planning_blueprint\":', inner, '} ok') "
        "ELSE 'no plan' END AS reply",
    )


@query("P08_normalize_blueprint", "recs chunks", """
, p AS (SELECT r.doc_id, r.id, level, difficulty, c.title, c.summary, doc_id % 5 <> 4 AS ok, r.question, r.source, r.lang
  FROM recs r JOIN chunks c USING (doc_id)),
q AS (SELECT *, CASE WHEN title = '' THEN 'tâm lý học' ELSE title END AS t,
  CASE WHEN ok AND doc_id % 7 <> 0 THEN source END AS topic0,
  CASE WHEN ok THEN lang END AS sub0, CASE WHEN ok AND doc_id % 5 <> 0 THEN 'recall' END AS skill0,
  CASE WHEN ok AND doc_id % 3 <> 0 AND trim(question) <> '' THEN question END AS query0,
  ok AND doc_id % 6 <> 0 AS has_rules FROM p)
SELECT id, coalesce(topic0, substr(t, 1, 180)) AS topic, coalesce(sub0, 'khái niệm và ứng dụng tâm lý học') AS subtopic,
  coalesce(skill0, 'evidence_grounded_reasoning') AS skill,
  md5(coalesce(query0, substr(t || ' ' || summary, 1, 1000))) AS query_md5,
  array_to_string(list_filter([CASE WHEN topic0 IS NULL THEN 'topic' END, CASE WHEN sub0 IS NULL THEN 'subtopic' END,
    CASE WHEN skill0 IS NULL THEN 'skill' END, CASE WHEN query0 IS NULL THEN 'retrieval_query' END, 'clinical_guardrail',
    CASE WHEN NOT has_rules THEN 'playbook_bullet_ids' END], lambda x: x IS NOT NULL), '|') AS missing,
  CASE WHEN has_rules THEN 2 ELSE 0 END AS n_rules,
  CASE difficulty WHEN 'easy' THEN 2 WHEN 'medium' THEN 4 ELSE 6 END AS evidence_limit,
  CASE WHEN level = 'clinical_scenario' OR difficulty = 'hard' THEN 2 ELSE 1 END AS min_refs,
  ok AND level = 'emotion' AND doc_id % 2 = 1 AS rubric,
  CASE WHEN ok AND level = 'emotion' AND doc_id % 2 = 1 THEN CASE WHEN doc_id % 3 = 0 THEN 'EA' ELSE 'EU' END END AS task
FROM q""".strip())
def p08(spark, d):
    return S.normalize_blueprint(plan_replies(spark, d)).select(
        "id", "plan.topic", "plan.subtopic", "plan.skill", F.md5("plan.retrieval_query").alias("query_md5"),
        F.array_join("missing", "|").alias("missing"), F.size("plan.playbook_bullet_ids").alias("n_rules"),
        "plan.evidence_limit", F.col("plan.min_evidence_refs").alias("min_refs"),
        F.col("plan.requires_emobench").alias("rubric"), F.col("plan.emobench.task").alias("task"),
    )


@query("P09_assign_curriculum", "chunks", """
, n AS (SELECT chunk_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM chunks)
SELECT chunk_id, i + 1 AS number,
 (['theory','emotion','educational_scenario','clinical_scenario'])[i % 4 + 1] AS level,
 (['easy','medium','hard'])[(i // 4) % 3 + 1] AS difficulty,
 (['theory','emotion','educational_scenario','clinical_scenario'])[i % 4 + 1] AS direct_level,
 (['easy','medium','hard'])[i % 3 + 1] AS direct_difficulty FROM n""".strip())
def p09(spark, d):
    docs = V.chunks(spark, d).select("chunk_id", "doc_id")
    planned = S.assign_curriculum(docs, ["doc_id"])
    direct = S.assign_curriculum(docs, ["doc_id"], direct=True).select(
        "chunk_id", F.col("level").alias("direct_level"), F.col("difficulty").alias("direct_difficulty")
    )
    return planned.join(direct, "chunk_id").select(
        "chunk_id", "number", "level", "difficulty", "direct_level", "direct_difficulty"
    )


@query("P10_retrieval_policy", "chunks", """
, c AS (SELECT chunk_id, (['easy','medium','hard','extreme'])[doc_id % 4 + 1] AS difficulty FROM chunks)
SELECT chunk_id, CASE difficulty WHEN 'easy' THEN 8 WHEN 'hard' THEN 24 ELSE 16 END AS candidate_k,
 CASE difficulty WHEN 'easy' THEN 2 WHEN 'hard' THEN 10 ELSE 4 END AS tier1_k,
 CASE difficulty WHEN 'easy' THEN 2 WHEN 'hard' THEN 6 ELSE 4 END AS evidence_limit,
 CASE difficulty WHEN 'hard' THEN 2 ELSE 1 END AS min_refs FROM c""".strip())
def p10(spark, d):
    docs = V.chunks(spark, d).selectExpr(
        "chunk_id",
        "element_at(array('easy','medium','hard','extreme'), CAST(doc_id % 4 AS INT) + 1) AS difficulty",
    )
    return S.with_policy(docs).drop("difficulty")


@query("P11_answer_position", "recs", """
SELECT id, substr('ABCD', CAST((greatest(doc_id - 3, 1) - 1) % 4 AS INT) + 1, 1) AS position FROM recs""")
def p11(spark, d):
    return V.recs(spark, d).select("id", R.answer_position(F.col("doc_id") - 3).alias("position"))


@query("P12_normalize_citations", "recs", """
SELECT id, array_to_string(CASE WHEN doc_id % 4 = 3 OR len(cited) = 0
  THEN [r.chunk_id FOR r IN refs] ELSE cited END, '|') AS cited FROM recs""")
def p12(spark, d):
    df = V.recs(spark, d).selectExpr(
        "id", "doc_id", "refs",
        "CASE doc_id % 4 WHEN 0 THEN to_json(named_struct('evidence_refs', cited)) "
        "WHEN 1 THEN to_json(named_struct('evidence_refs', transform(cited, c -> named_struct('chunk_id', c, 'why', 1)))) "
        "WHEN 2 THEN to_json(named_struct('evidence_refs', concat(cited, cited, array('')))) "
        "ELSE to_json(named_struct('evidence_refs', array_join(cited, ','))) END AS reply",
    )
    return R.with_typed_draft(df, "reply", "refs").select(
        "id", F.array_join("draft.cited", "|").alias("cited")
    )


@query("P13_emobench_plan", "recs", """
, r AS (SELECT id, doc_id, level = 'emotion' AS on_, CASE doc_id % 3 WHEN 0 THEN 'EA' WHEN 1 THEN 'EU' END AS task FROM recs),
t AS (SELECT *, CASE WHEN on_ THEN CASE WHEN task = 'EA' THEN 'EA' ELSE 'EU' END END AS tk FROM r)
SELECT id, on_ AS enabled, tk AS task,
 CASE WHEN tk = 'EU' THEN CASE WHEN doc_id % 5 = 0 THEN 'emotional_cues' ELSE 'complex_emotions' END END AS eu_category,
 CASE WHEN tk = 'EA' THEN CASE WHEN doc_id % 2 = 0 THEN 'social' ELSE 'personal' END END AS relationship_type,
 CASE WHEN tk = 'EA' THEN 'self' END AS problem_owner, CASE WHEN tk = 'EA' THEN 'action' END AS question_type,
 CASE tk WHEN 'EU' THEN 'emotion_recognition|emotion_cause_separation|category_fit|perspective_taking'
  WHEN 'EA' THEN 'perspective_taking|context_sensitive_response|relationship_fit|problem_owner_fit|response_action_fit'
  ELSE '' END AS criteria FROM t""".strip())
def p13(spark, d):
    plan = S.rubric_plan(
        F.col("level") == "emotion",
        F.expr("CASE doc_id % 3 WHEN 0 THEN 'EA' WHEN 1 THEN 'EU' END"),
        F.expr("CASE WHEN doc_id % 5 = 0 THEN 'emotional_cues' ELSE 'zeal' END"),
        F.expr("CASE WHEN doc_id % 2 = 0 THEN 'social' END"),
        F.lit("nobody"), F.lit("action"),
    )
    return V.recs(spark, d).select("id", plan.alias("p")).select(
        "id", "p.enabled", "p.task", "p.eu_category", "p.relationship_type", "p.problem_owner",
        "p.question_type", F.array_join("p.criteria", "|").alias("criteria"),
    )


@query("P14_extract_json_object", "", """
SELECT conv_id, turn, CASE WHEN conv_id % 4 < 2 THEN '' ELSE 'no_json_object' END AS issue,
 CASE WHEN conv_id % 4 < 2 THEN md5(text) END AS text_md5, CASE WHEN conv_id % 4 < 2 THEN turn END AS n
FROM conversations WHERE role = 'assistant'""")
def p14(spark, d):
    o = F.col("o")
    return X.with_json_object(V.raw(spark, d), "reply", "o").select(
        "conv_id", "turn", F.when(o.isNull(), "no_json_object").otherwise("").alias("issue"),
        F.md5(F.try_variant_get(o, "$.answer.t", "string")).alias("text_md5"),
        F.try_variant_get(o, "$.n", "bigint").alias("n"),
    )


@query("P15_extract_answer_tag", "", r"""
WITH r AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 2 THEN '<step>x</step> (answer)' || text || '</answer>'
  WHEN 0 THEN 'Answer: ' || text WHEN 1 THEN '(ANSWER>' || text || '</answer> tail' ELSE text END AS t
  FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CASE WHEN regexp_matches(t, '(?is)(?:<answer>|\(answer\)|Answer:|\(answer>)\s*(.*?)(?:</answer>|$)')
 THEN md5(trim(regexp_extract(t, '(?is)(?:<answer>|\(answer\)|Answer:|\(answer>)\s*(.*?)(?:</answer>|$)', 1), chr(10) || chr(9) || chr(13) || ' '))
 ELSE md5('Error parsing answer') END AS answer_md5 FROM r""")
def p15(spark, d):
    df = V.table(spark, d, "conversations").where("role = 'assistant'").selectExpr(
        "conv_id", "turn",
        "CASE conv_id % 4 WHEN 2 THEN concat('<step>x</step> (answer)', text, '</answer>') "
        "WHEN 0 THEN concat('Answer: ', text) WHEN 1 THEN concat('(ANSWER>', text, '</answer> tail') ELSE text END AS t",
    )
    return df.select("conv_id", "turn", F.md5(X.answer_tag(F.col("t"))).alias("answer_md5"))


@query("P16_build_requests", "recs", """
, r AS (SELECT id AS item_id, level = 'clinical_scenario' AS c, doc_id % 4 = 1 AS cut FROM recs)
SELECT item_id, role, CASE role WHEN 'planner' THEN 1000 WHEN 'evidence_plan' THEN CASE WHEN c THEN 1800 ELSE 700 END
  WHEN 'generator' THEN CASE WHEN c THEN 2600 ELSE 1800 END * CASE WHEN cut THEN 3 ELSE 2 END // 2
  WHEN 'preflight' THEN 450 WHEN 'adversarial_solver' THEN 500 ELSE 700 END AS max_tokens,
  role <> 'adversarial_solver' AS sees_sources
FROM r CROSS JOIN (VALUES ('planner'),('evidence_plan'),('generator'),('preflight'),('evidence'),('single_answer'),
  ('ei_safety_bias'),('adversarial_solver')) v(role)""".strip())
def p16(spark, d):
    df = V.recs(spark, d).withColumnRenamed("id", "item_id").withColumn(
        "feedback_issues",
        F.expr("CASE WHEN doc_id % 4 = 1 THEN array('llm_output_truncated') ELSE array('x') END"),
    )
    out = S.build_requests(
        df, list(S.TASKS), ["level", "difficulty", "question", "options", "answer", "refs", "source"]
    )
    return out.select(
        "item_id", "role", "max_tokens", F.contains("request", F.lit('"refs":[')).alias("sees_sources")
    )


def items_with_reports(spark, d):
    """Items with the merged reports of their judges (null where no judge ran)."""
    from quizmill.operators.reports import fan_in
    merged = fan_in(V.reports(spark, d), "doc_id", "ord")
    return V.recs(spark, d).join(merged, "doc_id", "left")


_REPORTS = """
, p AS (SELECT doc_id, bool_or(ord = 1 AND passed) AS e, bool_or(ord = 2 AND passed) AS s,
  bool_or(ord = 3 AND passed) AS b FROM reports GROUP BY doc_id),
j AS (SELECT r.*, method IN ('rag_judges','full') AS judged, coalesce(e, false) AS e, coalesce(s, false) AS s,
  coalesce(b, false) AS b, p.doc_id IS NOT NULL AS has FROM recs r LEFT JOIN p USING (doc_id))"""


@query("P17_assemble_record", "recs reports", _REPORTS.strip() + """
SELECT id, md5(question) AS question_md5, coalesce(answer, '') AS answer,
 array_to_string([x.chunk_id || ':' || x.source_kind FOR x IN refs IF list_contains(cited, x.chunk_id)], '|') AS refs,
 array_to_string(list_filter(['A=' || oa, 'B=' || ob, 'C=' || oc, 'D=' || od], lambda x: x IS NOT NULL), '|') AS options,
 CASE WHEN level = 'clinical_scenario' THEN 'B' ELSE 'A' END AS risk_tier,
 CASE WHEN method = 'direct' THEN 'synthetic_direct' ELSE 'synthetic_grounded' END AS generation_type,
 level AS question_type, coalesce(rationale_short, '') AS rationale, len(audit_steps) AS n_steps,
 CASE WHEN e THEN 'pass' WHEN judged THEN 'fail' ELSE 'not_run' END AS evidence_status,
 CASE WHEN level = 'clinical_scenario' THEN clinical_case END AS clinical_case,
 CASE WHEN level = 'clinical_scenario' THEN case_summary END AS case_summary,
 array_to_string([x.chunk_id FOR x IN refs], '|') AS retrieved
FROM j""")
def p17(spark, d):
    df = items_with_reports(spark, d)
    records = S.assemble_records(finished(df))
    return records.select(
        "id", F.md5("question").alias("question_md5"), "answer",
        F.array_join(F.transform("evidence_refs", lambda r: F.concat(r["chunk_id"], F.lit(":"), r["source_kind"])), "|").alias("refs"),
        F.array_join(F.transform(F.map_entries("options"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("options"),
        "metadata.risk_tier", "metadata.generation_type", "metadata.question_type",
        F.col("reasoning.rationale_short").alias("rationale"), F.size("reasoning.steps").cast("bigint").alias("n_steps"),
        "validation.evidence_status", "clinical_case", "case_summary",
        F.array_join("_audit.retrieved_chunk_ids", "|").alias("retrieved"),
    )


def finished(df):
    """Items in the column form that the record builder takes."""
    refs = F.transform("refs", lambda r: F.struct(
        r["chunk_id"].alias("chunk_id"), r["source_kind"].alias("source_kind"),
        r["score"].alias("score"), F.create_map(F.lit("source"), F.col("source")).alias("provenance"),
    ))
    return df.select(
        "doc_id", "id", "method", "level", "difficulty", "origin", R.draft_of().alias("draft"), refs.alias("refs"),
        F.col("source").alias("topic"), F.col("lang").alias("subtopic"),
        F.lit(C.DEFAULT_SKILL).alias("skill"),
        F.struct((F.col("level") == "emotion").alias("enabled")).alias("rubric"),
        "reports", F.col("origin").alias("verdict"), R.empty().alias("reasons"),
        F.concat(F.lit("doc-"), "doc_id").alias("anchor_id"), F.lit(1).alias("attempts"),
    )


@query("P18_assign_record_ids", "recs", """
, top AS (SELECT max(CAST(nullif(regexp_extract(id, '^PSY-([0-9]+)$', 1), '') AS BIGINT)) AS m FROM recs)
SELECT 'doc-' || doc_id AS anchor_id, m + row_number() OVER (ORDER BY doc_id) AS number,
 printf('PSY-%06d', m + row_number() OVER (ORDER BY doc_id)) AS id FROM documents, top""".strip())
def p18(spark, d):
    start = S.next_record_id(V.recs(spark, d))
    new = V.table(spark, d, "documents").selectExpr("doc_id", "concat('doc-', doc_id) AS anchor_id")
    return S.assign_record_ids(new, ["doc_id"], start).select("anchor_id", "number", "id")


@query("P19_rewrite_query", "recs", """
SELECT id, md5(substr(array_to_string(list_filter([source, lang, question,
  CASE answer WHEN 'A' THEN oa WHEN 'B' THEN ob WHEN 'C' THEN oc WHEN 'D' THEN od END],
  lambda x: x IS NOT NULL AND regexp_matches(x, '\\S')), ' '), 1, 600)) AS query_md5 FROM recs""")
def p19(spark, d):
    keyed = F.try_element_at("options", F.coalesce("answer", F.lit("")))
    return V.recs(spark, d).select(
        "id", F.md5(S.rewrite_query(F.col("source"), F.col("lang"), F.col("question"), keyed)).alias("query_md5")
    )


@query("P20_flag_rubric_level", "recs", """
SELECT id, level = 'emotion' AND doc_id % 2 = 1 AND doc_id % 5 <> 4 AS requires_rubric FROM recs""")
def p20(spark, d):
    return S.normalize_blueprint(plan_replies(spark, d)).select(
        "id", F.col("plan.requires_emobench").alias("requires_rubric")
    )
