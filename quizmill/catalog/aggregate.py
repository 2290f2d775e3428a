"""Rates, labels and the method comparison: A01 to A06, J08, U01, S04, S10, C04."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizmill import constants as C
from quizmill.catalog import views as V
from quizmill.catalog.shape import finished, items_with_reports
from quizmill.catalog.validate import SCHEMA_OK, tri_sql
from quizmill.operators import rates
from quizmill.operators.shape import assemble_records, validation_status
from quizmill.plans import evaluate as E
from quizmill.sources.audit import parse_labels, read_audit_csv
from quizmill.sources.sinks import write_outputs, write_report
from quizmill.storage import new_path

QUERIES, ORACLE = {}, {}


def query(name, views="", sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = V.with_views(views, sql.strip()) if views else sql
        return fn
    return register


def records(spark, d):
    df = finished(items_with_reports(spark, d))
    status = validation_status(
        F.col("method"), F.col("reports"), F.col("verdict"), F.col("rubric")["enabled"]
    )
    return df.withColumn("validation", status)


def labels(spark, d):
    rows = V.expert(spark, d)
    return parse_labels(rows, ["doc_id"])


LONG = f""",
p AS (SELECT doc_id, bool_or(ord = 1 AND passed) AS e, bool_or(ord = 2 AND passed) AS s,
  bool_or(ord = 3 AND passed) AS b FROM reports GROUP BY doc_id),
j AS (SELECT r.*, method IN ('rag_judges','full') AS judged, coalesce(e, false) AS e, coalesce(s, false) AS s,
  coalesce(b, false) AS b FROM recs r LEFT JOIN p USING (doc_id)),
lab AS (SELECT * FROM (SELECT method, id, {", ".join(f"{tri_sql('x_' + f)} AS {f}" for f in C.AUDIT_FIELDS)} FROM expert)
  WHERE coalesce({", ".join(C.AUDIT_FIELDS)}) IS NOT NULL),
long AS (
 SELECT method, 'internal' AS section, 'record_yield' AS metric, origin = 'verified' AS v FROM j
 UNION ALL SELECT method, 'internal', 'schema_valid_rate', {SCHEMA_OK} IS TRUE FROM j
 UNION ALL SELECT method, 'internal', 'evidence_reference_rate', len(refs) > 0 FROM j
 UNION ALL SELECT method, 'internal', 'evidence_status', CASE WHEN e OR judged THEN e END FROM j
 UNION ALL SELECT method, 'internal', 'single_best_answer', CASE WHEN s OR judged THEN s END FROM j
 UNION ALL SELECT method, 'internal', 'distractor_quality', CASE WHEN s OR judged THEN s END FROM j
 UNION ALL SELECT method, 'internal', 'emobench_status', CASE WHEN judged THEN level = 'emotion' AND b END FROM j
 {" ".join(f"UNION ALL SELECT method, 'expert', '{f}', {f} FROM j JOIN lab USING (method, id)" for f in C.AUDIT_FIELDS)}),
rates AS (SELECT method, section, metric, round(avg(v::INT)::DOUBLE, 6) AS value, count(v) AS n FROM long GROUP BY ALL)"""


def evaluation(spark, d):
    return E.evaluate(records(spark, d), labels(spark, d))


def rounded(metrics):
    return metrics.select("method", "section", "metric", F.round("value", 6).alias("value"), "n")


@query("A01_rate_with_ci", "recs reports expert", LONG + """
SELECT method, metric, value, n, true AS ordered, true AS near_normal, value IS NULL AS empty FROM rates WHERE section = 'internal'""")
def a01(spark, d):
    """The interval itself depends on the generator: checked for order and against the normal one."""
    m = evaluation(spark, d).metrics.where("section = 'internal'")
    half = 1.96 * F.sqrt(F.try_divide(F.col("value") * (1 - F.col("value")), "n"))
    slack = 0.02 + F.try_divide(F.lit(1.0), "n")
    ordered = (F.col("ci95_low") <= F.col("value")) & (F.col("value") <= F.col("ci95_high"))
    near = (F.abs(F.col("value") - half - F.col("ci95_low")) < slack) & (
        F.abs(F.col("value") + half - F.col("ci95_high")) < slack
    )
    return m.select(
        "method", "metric", F.round("value", 6).alias("value"), "n",
        F.coalesce(ordered, F.col("ci95_low").isNull()).alias("ordered"),
        F.coalesce(near, F.col("ci95_high").isNull()).alias("near_normal"), F.isnull("value").alias("empty"),
    )


@query("A02_internal_metrics", "recs reports expert", LONG + """
SELECT method, metric, value, n FROM rates WHERE metric IN ('record_yield','schema_valid_rate','evidence_reference_rate')""")
def a02(spark, d):
    df = records(spark, d)
    values = rates.internal_values(F.col("draft"), F.col("refs"), F.col("origin"), F.col("validation"))
    first = {k: values[k] for k in C.INTERNAL_FIELDS}
    out = rates.rates_by_method(df, first, "internal", [0, 1, 2])
    return out.select("method", "metric", F.round(F.try_divide("k", "n"), 6).alias("value"), "n")


@query("A03_judge_rates", "recs reports expert", LONG + """
SELECT method, metric, value, n FROM rates WHERE section = 'internal' AND metric IN
 ('evidence_status','single_best_answer','distractor_quality','emobench_status')""")
def a03(spark, d):
    df = records(spark, d)
    values = {f: rates.judge_status(F.col("validation")[f]) for f in C.JUDGE_FIELDS}
    out = rates.rates_by_method(df, values, "internal", [3, 4, 5, 6])
    return out.select("method", "metric", F.round(F.try_divide("k", "n"), 6).alias("value"), "n")


@query("A04_expert_rates", "recs reports expert", LONG + "\nSELECT method, metric, value, n FROM rates WHERE section = 'expert'")
def a04(spark, d):
    df = E.with_labels(V.recs(spark, d).select("method", "id"), labels(spark, d)).where("audited")
    values = {f: F.col("labels")[f] for f in C.AUDIT_FIELDS}
    out = rates.rates_by_method(df, values, "expert", list(range(20, 27)))
    return out.select("method", "metric", F.round(F.try_divide("k", "n"), 6).alias("value"), "n")


@query("A05_distribution", "recs", """
, r AS (SELECT method, CASE WHEN doc_id % 12 <> 5 THEN difficulty END AS difficulty FROM recs)
SELECT method, 'difficulty' AS key, coalesce(difficulty, 'unknown') AS value, count(*) AS records FROM r GROUP BY ALL""")
def a05(spark, d):
    df = V.recs(spark, d).withColumn("difficulty", F.expr("CASE WHEN doc_id % 12 <> 5 THEN difficulty END"))
    return rates.distribution(df, "difficulty")


@query("A06_compare_methods", "recs reports expert", LONG + """,
c AS (SELECT method, count(*) FILTER (origin = 'verified') AS n_verified, count(*) FILTER (origin <> 'verified') AS n_quarantine,
 count(*) AS n_completed, count(lab.id) AS n_expert_audited FROM recs LEFT JOIN lab USING (method, id) GROUP BY method)
SELECT rates.*, n_verified, n_quarantine, n_completed, n_expert_audited FROM rates JOIN c USING (method)""")
def a06(spark, d):
    e = evaluation(spark, d)
    return rounded(e.metrics).join(e.counts, "method")


@query("J08_join_expert_labels", "recs expert", f"""
, lab AS (SELECT method, id, {", ".join(f"{tri_sql('x_' + f)} AS {f}" for f in C.AUDIT_FIELDS)} FROM expert)
SELECT r.method, r.id, r.origin, {", ".join("lab." + f for f in C.AUDIT_FIELDS)} FROM recs r JOIN lab USING (method, id)
WHERE coalesce({", ".join(C.AUDIT_FIELDS)}) IS NOT NULL""")
def j08(spark, d):
    df = V.recs(spark, d).select("method", "id", "origin")
    return E.with_labels(df, labels(spark, d)).where("audited").select("method", "id", "origin", "labels.*")


@query("U01_completed", "recs", "SELECT id, method, origin, CASE WHEN origin <> 'verified' THEN source END AS reason FROM recs")
def u01(spark, d):
    df = V.recs(spark, d).select("id", "method", "origin", F.col("source").alias("reason"))
    verified = df.where("origin = 'verified'").drop("origin", "reason")
    return E.completed(verified, df.where("origin <> 'verified'").drop("origin"))


@query("S04_read_audit_csv", "recs expert", f"""
, lab AS (SELECT method, id, {", ".join(f"{tri_sql('x_' + f)} AS {f}" for f in C.AUDIT_FIELDS)} FROM expert)
SELECT * FROM lab WHERE coalesce({", ".join(C.AUDIT_FIELDS)}) IS NOT NULL""")
def s04(spark, d):
    """Each key stands twice in the file, the first time with failing labels; the last wins."""
    rows = V.expert(spark, d).drop("quality", "toxic")
    first = rows.withColumns({f: F.lit("fail") for f in C.AUDIT_FIELDS}).withColumn("turn", F.lit(0))
    both = first.unionByName(rows.withColumn("turn", F.lit(1)))
    path = new_path(spark, "audit")
    padded = both.withColumn("id", F.concat(F.lit(" "), "id", F.lit(" ")))
    (padded.repartitionByRange("turn", "doc_id").sortWithinPartitions("turn", "doc_id")
     .drop("turn", "doc_id").write.option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return read_audit_csv(spark, path)


@query("S10_report_sink", "recs reports expert", LONG + """,
f AS (SELECT method, metric, CASE WHEN value IS NULL THEN '—' ELSE printf('%.1f%% [%.1f, %.1f]', v * 100, v / 2 * 100, (1 + v) / 2 * 100) END AS t
  FROM (SELECT *, k / n::DOUBLE AS v FROM rates JOIN (SELECT method, metric AS m2, section AS s2, count(*) FILTER (v) AS k FROM long GROUP BY ALL) q
   USING (method) WHERE q.m2 = metric AND q.s2 = section)),
c AS (SELECT method, count(*) AS n FROM recs GROUP BY method),
w AS (SELECT method, n, max(t) FILTER (metric = 'record_yield') AS a, max(t) FILTER (metric = 'schema_valid_rate') AS b,
  max(t) FILTER (metric = 'evidence_reference_rate') AS c, max(t) FILTER (metric = 'overall_publishable') AS d FROM f JOIN c USING (method) GROUP BY ALL)
SELECT (row_number() OVER (ORDER BY method) + 2)::INT AS line, '| ' || method || ' | ' || n || ' | ' || a || ' | ' || b || ' | ' || c || ' | ' || coalesce(d, '—') || ' |' AS text FROM w
UNION ALL SELECT 1, '| Method | Completed | Record yield (95% CI) | Schema valid | Evidence refs | Expert pass |'
UNION ALL SELECT 2, '|---|---:|---:|---:|---:|---:|'""")
def s10(spark, d):
    """Written as text and JSON and read back; intervals are set from the value to be checkable."""
    e = evaluation(spark, d)
    fixed = e.metrics.withColumn("ci95_low", F.col("value") / 2).withColumn("ci95_high", (1 + F.col("value")) / 2)
    path = new_path(spark, "report")
    write_report(fixed, rates.markdown_table(fixed, e.counts), path)
    lines = spark.read.text(f"{path}/markdown", wholetext=True)
    return lines.select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("line", "text")).select(
        (F.col("line") + 1).alias("line"), "text"
    )


@query("C04_evaluate", "recs reports expert", LONG + """,
c AS (SELECT method, count(*) FILTER (origin = 'verified') AS n_verified, count(*) FILTER (origin <> 'verified') AS n_quarantine FROM recs GROUP BY method)
SELECT rates.*, n_verified, n_quarantine FROM rates JOIN c USING (method)""")
def c04(spark, d):
    """End to end: finished records and labels are written to their file forms, then compared."""
    base = new_path(spark, "evaluate")
    paths = (f"{base}/verified", f"{base}/quarantine", f"{base}/audit")
    # Every retrieved source counts as cited, so that the records keep what the SQL looks at.
    items = records(spark, d).withColumn(
        "draft", F.col("draft").withField("cited", F.transform("refs", lambda r: r["chunk_id"]))
    )
    write_outputs(assemble_records(items), *paths[:2])
    V.expert(spark, d).select("method", "id", *C.AUDIT_FIELDS).write.option("header", True).csv(paths[2])
    e = E.evaluate_files(spark, *paths)
    return rounded(e.metrics).join(e.counts.select("method", "n_verified", "n_quarantine"), "method")
