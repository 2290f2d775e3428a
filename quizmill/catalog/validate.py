"""Filters, validators and the gate: F01 to F18, with J09, J13 and U03."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizmill import constants as C
from quizmill.catalog import views as V
from quizmill.catalog.shape import TIER_SQL, finished, items_with_reports
from quizmill.functions import records as R
from quizmill.functions import text as X
from quizmill.operators import clean, evidence
from quizmill.operators.reports import fan_in
from quizmill.operators.shape import validation_status

QUERIES, ORACLE = {}, {}


def query(name, views="", sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = V.with_views(views, sql.strip()) if views else sql
        return fn
    return register


@query("F01_eligible_evidence", "chunks", f"""
, t AS (SELECT source, doc_id, chunk_id, {TIER_SQL} AS label FROM chunks),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM t
  WHERE label IN ('Tier 1', 'Tier 2', 'Tier 2 (legacy-unclassified)'))
SELECT source, chunk_id, rank FROM r WHERE rank <= 6""")
def f01(spark, d):
    return evidence.eligible_evidence(V.chunks(spark, d), "source", ["doc_id"], 6).select(
        "source", "chunk_id", F.col("rank").cast("bigint").alias("rank")
    )


@query("F02_backfill_tier", "chunks", """
SELECT chunk_id, CASE WHEN coalesce(source_tier, '') = '' AND coalesce(tier, '') = '' THEN 'tier_2' ELSE source_tier END AS source_tier FROM chunks""")
def f02(spark, d):
    return evidence.backfill_tier(V.chunks(spark, d), "tier_2").select("chunk_id", "source_tier")


@query("F02_backfill_dry_run", "chunks", """
SELECT count(*) FILTER (coalesce(source_tier, '') = '' AND coalesce(tier, '') = '') AS would_set, count(*) AS rows FROM chunks""")
def f02_dry(spark, d):
    return evidence.backfill_count(V.chunks(spark, d))


@query("F03_drop_missing_fields", "qa", """
SELECT file, count(*) FILTER (thinking IS NOT NULL AND thinking <> '' AND question <> '' AND answer <> '') AS kept,
 count(*) FILTER (NOT (thinking IS NOT NULL AND thinking <> '' AND question <> '' AND answer <> '')) AS removed
FROM qa GROUP BY file""")
def f03(spark, d):
    return clean.split_counts(V.qa(spark, d), clean.has_all_fields(), ["file"])


@query("F04_drop_error_answers", "qa", """
SELECT id, file, line, md5(answer) AS answer_md5 FROM qa
WHERE NOT contains(answer, 'Error parsing answer - Model failed to output <answer> tag')""")
def f04(spark, d):
    return V.qa(spark, d).where(clean.has_no_error()).select(
        "id", "file", "line", F.md5("answer").alias("answer_md5")
    )


SCHEMA_OK = """(regexp_matches(question, '\\S') AND od IS NOT NULL AND regexp_matches(oa, '\\S') AND regexp_matches(ob, '\\S')
 AND regexp_matches(oc, '\\S') AND regexp_matches(od, '\\S') AND answer IS NOT NULL)"""


@query("F06_schema_valid", "recs", f"SELECT id, {SCHEMA_OK} IS TRUE AS valid FROM recs")
def f06(spark, d):
    return V.recs(spark, d).select("id", R.schema_valid(R.draft_of()).alias("valid"))


_KINDS = """len([1 FOR x IN refs IF x.source_kind = 'dsm5']) AS n_dsm5, len([1 FOR x IN refs IF x.source_kind = 'textbook']) AS n_text,
 len([1 FOR x IN refs IF x.source_kind = 'dsm5' AND list_contains(ucited, x.chunk_id)]) AS c_dsm5,
 len([1 FOR x IN refs IF x.source_kind = 'textbook' AND list_contains(ucited, x.chunk_id)]) AS c_text"""
_ANALYSIS = """(CASE WHEN da IS NOT NULL THEN 'A' ELSE '' END || CASE WHEN db IS NOT NULL THEN 'B' ELSE '' END
 || CASE WHEN dc IS NOT NULL THEN 'C' ELSE '' END || CASE WHEN dd IS NOT NULL THEN 'D' ELSE '' END)"""


@query("F07_validate_contract", "recs", f"""
, s AS (SELECT *, doc_id % 24 AS k, substr('ABCD', CAST(doc_id % 4 AS INT) + 1, 1) AS req, level = 'clinical_scenario' AS cl,
  CASE WHEN len(cited) = 0 OR doc_id % 24 = 5 THEN [x.chunk_id FOR x IN refs] ELSE cited END AS ucited, {_ANALYSIS} AS an FROM recs),
t AS (SELECT *, {_KINDS}, (od IS NOT NULL AND k <> 7) AS four,
  (regexp_matches(oa, '\\S') AND regexp_matches(ob, '\\S') AND regexp_matches(oc, '\\S') AND regexp_matches(od, '\\S') AND k <> 9) AS texts FROM s)
SELECT id, CASE WHEN k = 11 THEN 'schema:not_json_object' ELSE array_to_string(list_filter([
 CASE WHEN cl AND NOT regexp_matches(coalesce(clinical_case, ''), '\\S') THEN 'schema:missing_clinical_case' END,
 CASE WHEN cl AND NOT regexp_matches(case_summary, '\\S') THEN 'schema:missing_case_summary' END,
 CASE WHEN cl AND n_dsm5 > 0 AND c_dsm5 = 0 THEN 'schema:missing_dsm5_citation' END,
 CASE WHEN cl AND n_text > 0 AND c_text = 0 THEN 'schema:missing_textbook_citation' END,
 CASE WHEN NOT regexp_matches(question, '\\S') THEN 'schema:missing_question' END,
 CASE WHEN NOT four THEN 'schema:options_must_be_mapping_A_to_D' WHEN NOT texts THEN 'schema:options_must_be_nonempty_strings' END,
 CASE WHEN answer IS NULL THEN 'schema:answer_must_be_A_to_D' WHEN answer <> req THEN 'schema:answer_position_must_be_' || req
   WHEN k = 7 THEN NULL
   WHEN an <> replace('ABCD', answer, '') THEN 'schema:distractor_analysis_must_cover_exactly_three_wrong_options'
   WHEN doc_id % 59 = 0 THEN 'schema:distractor_analysis_must_be_nonempty_strings' END,
 CASE WHEN rationale_short IS NULL THEN 'schema:missing_rationale_short' END,
 CASE WHEN len(audit_steps) = 0 THEN 'schema:missing_audit_steps' END], lambda x: x IS NOT NULL), '|') END AS issues,
 CASE WHEN k = 11 OR clinical_case IS NULL THEN NULL ELSE replace(clinical_case, 'Hypothetical Case:', 'Tình huống giả định:') END AS clinical_case
FROM t""")
def f07(spark, d):
    """Drafts arrive as JSON text; by id some have a list for options, a list inside an
    option, citations as one text, or are no object at all."""
    names = ["question", "options", "answer", "rationale_short", "audit_steps",
             "distractor_analysis", "clinical_case", "case_summary"]
    broken = F.to_json(F.struct(*names, F.array_join("cited", ",").alias("evidence_refs")))
    listed = F.to_json(F.struct(*[n for n in names if n != "options"],
                                F.map_values("options").alias("options"), F.col("cited").alias("evidence_refs")))
    inside = F.to_json(F.struct(*[n for n in names if n != "options"],
                                F.col("cited").alias("evidence_refs"),
                                F.struct(F.array(F.col("options")["A"]).alias("A"), F.col("options")["B"].alias("B"),
                                         F.col("options")["C"].alias("C"),
                                         F.try_element_at("options", F.lit("D")).alias("D")).alias("options")))
    plain = F.to_json(F.struct(*names, F.col("cited").alias("evidence_refs")))
    k = F.col("doc_id") % 24
    df = V.recs(spark, d).withColumn(
        "reply", F.when(k == 5, broken).when(k == 7, listed).when(k == 9, inside)
        .when(k == 11, F.lit("[1]")).otherwise(plain),
    )
    df = R.with_typed_draft(df.select("id", "doc_id", "refs", "level", "reply"), "reply", "refs")
    issues = R.contract_issues(
        F.col("draft"), F.col("refs"), R.answer_position(F.col("doc_id") + 1), F.col("level")
    )
    return df.select("id", F.array_join(issues, "|").alias("issues"), "draft.clinical_case")


@query("F08_contains_script", "recs", """
SELECT id, regexp_matches(question || array_to_string(list_filter([clinical_case, case_summary, oa, ob, oc, od, rationale_short, da, db, dc, dd],
  lambda x: x IS NOT NULL), ' '), '[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]') AS has_han FROM recs""")
def f08(spark, d):
    return V.recs(spark, d).select("id", R.han_text(R.draft_of()).alias("has_han"))


_ABS = "(^|[^\\p{L}\\p{N}_])(hoàn\\s+toàn|tuyệt\\s+đối|luôn\\s+luôn|không\\s+bao\\s+giờ|duy\\s+nhất|chắc\\s+chắn|triệt\\s+để|tất\\s+cả)($|[^\\p{L}\\p{N}_])"
_META = "(^|[^\\p{L}\\p{N}_])(tất\\s+cả\\s+(?:các\\s+)?đáp\\s+án\\s+(?:trên|đúng)|cả\\s+[abcd]\\s+(?:và|lẫn)\\s+[abcd]|[abcd]\\s+(?:và|lẫn)\\s+[abcd]\\s+(?:đều\\s+)?đúng)($|[^\\p{L}\\p{N}_])"
_WORDS = "[" + ", ".join(f"len(regexp_extract_all(o{x}, '[\\p{{L}}\\p{{N}}_]+'))" for x in "abcd") + "]"


def _any(pattern: str) -> str:
    return "(" + " OR ".join(f"coalesce(regexp_matches(o{x}, '(?i){pattern}'), false)" for x in "abcd") + ")"


SURFACE = f"""
u AS (SELECT *, list_filter({_WORDS}, lambda x: x IS NOT NULL) AS wc, {_any(_ABS)} AS abs_, {_any(_META)} AS meta_,
  CASE WHEN difficulty = 'hard' THEN 5 ELSE 8 END AS gap, {SCHEMA_OK.replace("AND answer IS NOT NULL", "").replace("regexp_matches(question, '" + chr(92) + "S') AND", "")} IS TRUE AS shape FROM recs),
v AS (SELECT *, list_max(wc) - list_min(wc) > gap AS imb FROM u)"""


@query("F09_option_surface_report", "recs", f""", {SURFACE.strip()}
SELECT id, array_to_string(wc, ',') AS counts, array_to_string(list_filter([CASE WHEN meta_ THEN 'surface_cue:meta_option' END,
 CASE WHEN abs_ THEN 'surface_cue:absolute_wording' END, CASE WHEN imb THEN 'surface_cue:option_length_imbalance' END],
 lambda x: x IS NOT NULL), '|') AS issues FROM v""")
def f09(spark, d):
    options, gap = F.col("options"), R.max_gap(F.col("difficulty"))
    counts = R.word_counts(options)
    return V.recs(spark, d).select(
        "id", F.array_join(counts.cast("array<string>"), ",").alias("counts"),
        F.array_join(R.surface_issues(options, gap), "|").alias("issues"),
    )


_EMPH = _ABS.replace("triệt\\s+để|", "triệt\\s+để|ngay\\s+lập\\s+tức|tự\\s+ý|")


@query("F10_hard_guard", "recs reports", f""", {SURFACE.strip()},
w AS (SELECT *, CASE WHEN difficulty = 'hard' THEN 'hard_guard:' ELSE 'surface_cue:' END AS pre, {_any(_EMPH)} AS emph FROM v),
g AS (SELECT doc_id, id, CASE WHEN NOT shape THEN ['hard_guard:invalid_option_shape'] ELSE list_filter([
  CASE WHEN meta_ THEN pre || 'meta_option' END, CASE WHEN abs_ THEN pre || 'absolute_wording' END,
  CASE WHEN imb THEN pre || 'option_length_imbalance' END,
  CASE WHEN difficulty = 'hard' AND emph THEN 'hard_guard:emphatic_wording' END], lambda x: x IS NOT NULL) END AS guard FROM w)
SELECT id, array_to_string(guard, '|') AS guard, array_to_string(CASE WHEN r.doc_id IS NULL THEN guard
  WHEN len(guard) = 0 AND passed THEN [] WHEN len(guard) = 0 AND len(coalesce(issues, [])) = 0 THEN ['preflight_failed']
  ELSE list_concat(guard, coalesce(issues, [])) END, '|') AS preflight
FROM g LEFT JOIN (SELECT * FROM reports WHERE judge = 'evidence') r USING (doc_id)""")
def f10(spark, d):
    review = V.reports(spark, d).where("judge = 'evidence'").select("doc_id", "passed", "issues")
    df = V.recs(spark, d).select(
        "doc_id", "id", R.guard_issues(F.col("options"), F.col("difficulty")).alias("guard")
    ).join(review, "doc_id", "left")
    merged = R.preflight_issues(
        F.col("guard"), F.col("passed"), F.col("issues"), F.col("passed").isNotNull()
    )
    return df.select("id", F.array_join("guard", "|").alias("guard"), F.array_join(merged, "|").alias("preflight"))


def tri_sql(col: str) -> str:
    return (
        f"CASE WHEN lower(trim({col})) IN ('1','true','yes','pass','passed') THEN true "
        f"WHEN lower(trim({col})) IN ('0','false','no','fail','failed') THEN false END"
    )


@query("F11_tristate", "recs expert", "SELECT method, id, quality <> 0 AS quality, "
       + ", ".join(f"{tri_sql('x_' + f)} AS {f}" for f in C.AUDIT_FIELDS) + " FROM expert")
def f11(spark, d):
    return V.expert(spark, d).select(
        "method", "id", X.tristate_number(F.col("quality")).alias("quality"),
        *[X.tristate(F.col(f)).alias(f) for f in C.AUDIT_FIELDS],
    )


_PAIR = """, m AS (SELECT r.id, r.method, r.level, r.difficulty, r.answer, r.oa, r.ob, r.oc, r.od, p.* FROM reports p JOIN recs r USING (doc_id))"""


@query("F12_single_answer_audit", "recs reports", _PAIR + """,
a AS (SELECT *, od IS NOT NULL AND doc_id % 8 <> 0 OR od IS NULL AND doc_id % 8 = 0 AS complete,
  answer IS NOT NULL AND answer = base AND (answer <> 'D' OR od IS NOT NULL) AS key_ok,
  doc_id % 5 = 0 AND base <> 'B' AND answer <> 'B' AS unclear FROM m WHERE judge = 'single_answer'),
b AS (SELECT *, list_concat(coalesce(issues, []), list_filter([CASE WHEN NOT complete THEN 'option_assessment_incomplete'
  WHEN NOT key_ok THEN 'declared_answer_not_judged_correct' WHEN unclear THEN 'distractor_not_judged_incorrect' END],
  lambda x: x IS NOT NULL)) AS found FROM a)
SELECT id, array_to_string(found, '|') AS issues, passed AND len(found) = 0 AS passed FROM b""")
def f12(spark, d):
    df = V.reports(spark, d).where("judge = 'single_answer'").join(
        V.recs(spark, d).select("doc_id", "id", "options", "answer"), "doc_id"
    )
    issues = R.single_answer_issues(
        F.col("issues"), F.col("assessment"), F.col("options"), F.col("answer")
    )
    return df.select(
        "id", F.array_join(issues, "|").alias("issues"),
        (F.col("passed") & (F.size(issues) == 0)).alias("passed"),
    )


@query("F13_rubric_audit", "recs reports", _PAIR + """,
a AS (SELECT *, level = 'emotion' AS on_, CASE WHEN doc_id % 3 = 0 THEN 'EA' ELSE 'EU' END AS task,
  doc_id % 7 <> 1 AS named FROM m WHERE judge = 'ei_safety_bias'),
c AS (SELECT *, CASE WHEN task = 'EA' THEN ['perspective_taking','context_sensitive_response','relationship_fit','problem_owner_fit','response_action_fit']
  ELSE ['emotion_recognition','emotion_cause_separation','category_fit','perspective_taking'] END AS crit FROM a),
e AS (SELECT *, CASE WHEN NOT on_ THEN coalesce(issues, []) ELSE list_concat(coalesce(issues, []),
  CASE WHEN NOT named THEN ['emobench_incomplete_report'] ELSE
   [CASE WHEN x = 'perspective_taking' AND doc_id % 4 = 1 THEN 'emobench:' || x ELSE 'emobench_missing_criterion:' || x END
    FOR x IN crit IF (x = 'perspective_taking' AND doc_id % 4 = 1) OR (x IN ('category_fit','relationship_fit') AND doc_id % 5 = 0)] END) END AS found FROM c)
SELECT id, array_to_string(found, '|') AS issues, CASE WHEN on_ THEN passed AND len(found) = 0 ELSE passed END AS passed FROM e""")
def f13(spark, d):
    df = V.reports(spark, d).where("judge = 'ei_safety_bias'").join(
        V.recs(spark, d).select("doc_id", "id", "level"), "doc_id"
    )
    task = F.expr("CASE WHEN level = 'emotion' THEN CASE WHEN doc_id % 3 = 0 THEN 'EA' ELSE 'EU' END END")
    named = F.expr("CASE WHEN doc_id % 7 <> 1 THEN CASE WHEN doc_id % 3 = 0 THEN 'EA' ELSE 'EU' END ELSE 'none' END")
    criteria = F.map_from_entries(F.transform(
        F.filter(R.required_criteria(named),
                 lambda x: ~(x.isin("category_fit", "relationship_fit") & (F.col("doc_id") % 5 == 0))),
        lambda x: F.struct(x, F.when((x == "perspective_taking") & (F.col("doc_id") % 4 == 1), "fail").otherwise("pass")),
    ))
    issues = R.rubric_issues(F.col("issues"), task, named, criteria)
    return df.select(
        "id", F.array_join(issues, "|").alias("issues"),
        F.when(task.isNull(), F.col("passed")).otherwise(F.col("passed") & (F.size(issues) == 0)).alias("passed"),
    )


@query("F14_cue_audit", "recs reports", _PAIR + """,
a AS (SELECT *, coalesce(selected = answer, false) AND confidence = 'high' AND difficulty = 'hard'
  AND cue_type <> 'none' AND trim(cue_text) <> '' AS found, doc_id % 31 = 3 AS broken FROM m WHERE judge = 'adversarial_solver')
SELECT id, CASE WHEN broken THEN false ELSE NOT found END AS passed,
 CASE WHEN broken THEN 'solver_error:TimeoutError' WHEN found THEN 'adversarial:spurious_cues_found' ELSE '' END AS issues,
 NOT broken AND found AND cue_type IN ('length','absolute_wording','grammar') AS blocking FROM a""")
def f14(spark, d):
    df = V.reports(spark, d).where("judge = 'adversarial_solver'").join(
        V.recs(spark, d).select("doc_id", "id", "answer", "difficulty"), "doc_id"
    ).withColumn("error", F.expr("CASE WHEN doc_id % 31 = 3 THEN 'TimeoutError' END"))
    from quizmill.operators.reports import cue_report
    r = cue_report(
        F.col("selected"), F.col("answer"), F.col("confidence"), F.col("difficulty"),
        F.col("cue_type"), F.col("cue_text"), F.col("error"),
    )
    return df.select("id", r.alias("r")).select(
        "id", "r.passed", F.array_join("r.issues", "|").alias("issues"), "r.blocking"
    )


GATE = f""", {SURFACE.strip()},
g0 AS (SELECT *, CASE difficulty WHEN 'easy' THEN 2 WHEN 'medium' THEN 4 ELSE 6 END AS lim, CASE WHEN difficulty = 'hard' THEN 2 ELSE 1 END AS least,
  cited AS ucited, level = 'clinical_scenario' AS cl, {_ANALYSIS} AS an, od IS NOT NULL AS four,
  (regexp_matches(question || array_to_string(list_filter([clinical_case, case_summary, oa, ob, oc, od, rationale_short, da, db, dc, dd],
  lambda x: x IS NOT NULL), ' '), '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}\\x{{f900}}-\\x{{faff}}]')) AS han FROM v),
g1 AS (SELECT *, {_KINDS} FROM g0),
jr AS (SELECT doc_id, list(judge || ':' || i ORDER BY ord, pos) AS named FROM (
  SELECT doc_id, judge, ord, unnest(coalesce(issues, ['failed'])) AS i, 1 AS pos FROM reports
  WHERE NOT passed AND (judge <> 'adversarial_solver' OR blocking)) GROUP BY doc_id),
gate AS (SELECT g1.*, list_concat(list_filter([
 CASE WHEN NOT four THEN 'invalid_options' WHEN NOT shape THEN 'invalid_option_text' END,
 CASE WHEN four AND answer IS NULL THEN 'invalid_answer' END,
 CASE WHEN four AND answer IS NOT NULL AND an <> replace('ABCD', answer, '') THEN 'incomplete_distractor_analysis' END,
 CASE WHEN shape AND meta_ THEN 'surface_cue:meta_option' END,
 CASE WHEN shape AND abs_ THEN 'surface_cue:absolute_wording' END,
 CASE WHEN shape AND imb THEN 'surface_cue:option_length_imbalance' END,
 CASE WHEN han THEN 'contains_han_script' END,
 CASE WHEN len(refs) < 1 OR len(refs) > lim THEN 'evidence_count_not_1_to_' || lim END,
 CASE WHEN len(cited) < least OR len(cited) > lim OR list_contains(cited, 'doc-unknown') THEN 'invalid_evidence_refs' END,
 CASE WHEN cl AND NOT regexp_matches(coalesce(clinical_case, ''), '\\S') THEN 'missing_clinical_case' END,
 CASE WHEN cl AND NOT regexp_matches(case_summary, '\\S') THEN 'missing_case_summary' END,
 CASE WHEN cl THEN CASE WHEN n_dsm5 = 0 THEN 'dsm5_evidence_missing' WHEN c_dsm5 = 0 THEN 'missing_dsm5_citation' END END,
 CASE WHEN cl THEN CASE WHEN n_text = 0 THEN 'textbook_evidence_missing' WHEN c_text = 0 THEN 'missing_textbook_citation' END END],
 lambda x: x IS NOT NULL), coalesce(named, [])) AS issues FROM g1 LEFT JOIN jr USING (doc_id))"""


def gated(spark, d):
    df = items_with_reports(spark, d)
    issues = R.gate_issues(
        R.draft_of(), F.col("refs"), F.col("level"), F.col("difficulty"), F.col("report_list")
    )
    return df.withColumn("reasons", issues).withColumn("verdict", R.verdict(F.col("reasons")))


@query("F15_quality_gate", "recs reports", GATE + """
SELECT id, CASE WHEN len(issues) = 0 THEN 'verified' ELSE 'quarantine' END AS verdict, array_to_string(issues, '|') AS reasons FROM gate""")
def f15(spark, d):
    return gated(spark, d).select("id", "verdict", F.array_join("reasons", "|").alias("reasons"))


@query("F16_baseline_accept", "recs", """
SELECT id, CASE WHEN doc_id % 17 = 0 THEN 'quarantine' ELSE 'verified' END AS verdict,
 CASE WHEN doc_id % 34 = 0 THEN 'missing_mcq' WHEN doc_id % 17 = 0 THEN 'generator_refusal' ELSE '' END AS reasons FROM recs""")
def f16(spark, d):
    from quizmill.operators.reports import baseline_accept
    df = V.recs(spark, d).select(
        "id", F.when(F.size("options") == 4, R.draft_of()).alias("draft"),
        F.expr("CASE WHEN doc_id % 34 <> 0 THEN array('generator_refusal') END").alias("generation_issues"),
    )
    return baseline_accept(df).select("id", "verdict", F.array_join("reasons", "|").alias("reasons"))


@query("F17_validation_status", "recs reports", """
, p AS (SELECT doc_id, bool_or(ord = 1 AND passed) AS e, bool_or(ord = 2 AND passed) AS s,
  bool_or(ord = 3 AND passed) AS b FROM reports GROUP BY doc_id),
j AS (SELECT r.*, method IN ('rag_judges','full') AS judged, coalesce(e, false) AS e, coalesce(s, false) AS s,
  coalesce(b, false) AS b, p.doc_id IS NOT NULL AS has FROM recs r LEFT JOIN p USING (doc_id))
SELECT id, CASE WHEN e THEN 'pass' WHEN judged THEN 'fail' ELSE 'not_run' END AS evidence_status,
 CASE WHEN s THEN 'pass' WHEN judged THEN 'fail' ELSE 'not_run' END AS single_best_answer,
 CASE WHEN s THEN 'pass' WHEN judged THEN 'fail' ELSE 'not_run' END AS distractor_quality,
 judged AND has AS consistency_checked, judged AND b AS bias_checked, judged AND b AS safety_checked,
 CASE WHEN NOT judged THEN 'not_run' WHEN level <> 'emotion' THEN 'not_applicable' WHEN b THEN 'pass' ELSE 'fail' END AS emobench_status,
 CASE WHEN origin = 'verified' THEN 'rule_verified' ELSE 'failed' END AS reasoning_verified FROM j""")
def f17(spark, d):
    df = finished(items_with_reports(spark, d))
    status = validation_status(
        F.col("method"), F.col("reports"), F.col("verdict"), F.col("rubric")["enabled"]
    )
    return df.select("id", status.alias("v")).select(
        "id", "v.evidence_status", "v.single_best_answer", "v.distractor_quality", "v.consistency_checked",
        "v.bias_checked", "v.safety_checked", "v.emobench_status", "v.reasoning_verified",
    )


@query("F18_classify_failure", "recs", """
, e AS (SELECT *, (['llm_output_truncated'])[CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 2 END] AS code,
 (['A03 schema repair failed: x','A03 preflight repair broke schema: y','no: dsm5_evidence_missing','textbook_evidence_missing',
   'missing_retrieved_evidence','I cannot fulfill this', 'timed out'])[doc_id % 7 + 1] || source AS msg,
 level = 'clinical_scenario' AND method <> 'direct' AS cl,
 len([1 FOR x IN refs IF x.source_kind = 'dsm5']) AS n_dsm5, len([1 FOR x IN refs IF x.source_kind = 'textbook']) AS n_text FROM recs)
SELECT id, CASE WHEN len(refs) = 0 THEN CASE WHEN cl THEN 'dsm5_evidence_missing' ELSE 'missing_retrieved_evidence' END
  WHEN cl AND n_dsm5 = 0 THEN 'dsm5_evidence_missing' WHEN cl AND n_text = 0 THEN 'textbook_evidence_missing' END AS precondition,
 CASE WHEN code IS NOT NULL THEN code WHEN msg LIKE 'A03 schema%' THEN 'generator_schema_repair_failed'
  WHEN msg LIKE 'A03 preflight%' THEN 'generator_preflight_repair_broke_schema' WHEN msg LIKE '%dsm5_%' THEN 'dsm5_evidence_missing'
  WHEN msg LIKE '%textbook_evidence%' THEN 'textbook_evidence_missing' WHEN msg LIKE '%missing_retrieved%' THEN 'missing_retrieved_evidence'
  WHEN msg LIKE '%cannot fulfill%' THEN 'generator_refusal' ELSE 'generator_error:TimeoutError' END AS issue FROM e""")
def f18(spark, d):
    df = V.recs(spark, d).withColumns({
        "code": F.expr("CASE WHEN doc_id % 9 = 0 THEN 'llm_output_truncated' END"),
        "message": F.expr(
            "concat(element_at(array('A03 schema repair failed: x','A03 preflight repair broke schema: y',"
            "'no: dsm5_evidence_missing','textbook_evidence_missing','missing_retrieved_evidence',"
            "'I cannot fulfill this','timed out'), CAST(doc_id % 7 AS INT) + 1), source)"
        ),
    })
    return df.select(
        "id", R.precondition(F.col("refs"), F.col("level"), F.col("method")).alias("precondition"),
        R.failure_issue(F.col("code"), F.col("message"), F.lit("TimeoutError")).alias("issue"),
    )


@query("J09_fan_in_reports", "reports", """
, u AS (SELECT doc_id, ord, judge, passed, issues FROM reports UNION ALL
  SELECT doc_id, ord - 10, judge, true, ['stale'] FROM reports),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, judge ORDER BY ord DESC) AS rn FROM u)
SELECT doc_id, string_agg(judge || '=' || CASE WHEN passed THEN 'true' ELSE 'false' END || ':' || coalesce(array_to_string(issues, ','), '-'), '|'
  ORDER BY ord) AS reports FROM l WHERE rn = 1 GROUP BY doc_id""")
def j09(spark, d):
    now = V.reports(spark, d).select("doc_id", "ord", "judge", "passed", "issues")
    old = now.selectExpr("doc_id", "ord - 10 AS ord", "judge", "true AS passed", "array('stale') AS issues")
    merged = fan_in(now.unionByName(old), "doc_id", "ord")
    line = F.transform("report_list", lambda r: F.concat(
        r["judge"], F.lit("="), r["passed"].cast("string"), F.lit(":"),
        F.coalesce(F.array_join(r["issues"], ","), F.lit("-")),
    ))
    return merged.select("doc_id", F.array_join(line, "|").alias("reports"))


@query("J13_citation_membership", "recs", """
SELECT id, array_to_string([x.chunk_id FOR x IN refs IF list_contains(cited, x.chunk_id)], '|') AS supported,
 doc_id % 13 <> 0 AS subset, len(cited) - len([1 FOR x IN refs IF list_contains(cited, x.chunk_id)]) AS unknown FROM recs""")
def j13(spark, d):
    ids = F.transform("refs", lambda r: r["chunk_id"])
    extra = F.size(F.array_except("cited", ids))
    return V.recs(spark, d).select(
        "id", F.array_join(F.array_intersect(ids, "cited"), "|").alias("supported"),
        (extra == 0).alias("subset"), extra.cast("bigint").alias("unknown"),
    )


@query("U03_unreported_issues", "recs reports", GATE + """,
rep AS (SELECT doc_id, list(judge || ':' || i) AS seen FROM (SELECT doc_id, judge, unnest(coalesce(issues, ['failed'])) AS i
  FROM reports WHERE NOT passed) GROUP BY doc_id)
SELECT id, array_to_string([x FOR x IN issues IF NOT list_contains(coalesce(seen, []), x)], '|') AS unreported
FROM gate LEFT JOIN rep USING (doc_id)""")
def u03(spark, d):
    from quizmill.operators.reports import unreported
    return gated(spark, d).select(
        "id", F.array_join(unreported(F.col("reasons"), F.col("report_list")), "|").alias("unreported")
    )
