"""Projections: chunks, evidence, plans, requests and finished records."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmill import constants as C
from quizmill.functions import records as R
from quizmill.functions import text as X
from quizmill.operators.attempts import ENTRIES
from quizmill.operators.ordering import number_rows


def optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def normalize_chunks(df: DataFrame) -> DataFrame:
    return df.where(F.length("content") > 0).select(
        F.col("content").alias("page_content"),
        F.struct("uuid", "headers", "summary", "keywords", "type").alias("metadata"),
    )


def chunk_key(df: DataFrame) -> Column:
    return X.first_text(optional(df, "chunk_id"), optional(df, "uuid"), optional(df, "_id"))


def differential_text(col: Column) -> Column:
    """A JSON list joined by commas, or a JSON text as it is; null when empty."""
    value = F.try_parse_json(col)
    joined = F.when(
        F.schema_of_variant(value).startswith("ARRAY"),
        F.array_join(F.try_variant_get(value, "$", "array<string>"), ", "),
    ).otherwise(F.try_variant_get(value, "$", "string"))
    return F.nullif(joined, F.lit(""))


def format_documents(
    df: DataFrame, force_tier: str | None = None, source_kind: str | None = None
) -> DataFrame:
    """Stored chunks as retrieved documents: one text plus flat metadata."""
    text = lambda n: optional(df, n)
    content = X.first_text(text("content"), text("text"), text("page_content"), text("body"))
    headers = F.array_join(optional(df, "headers", "array<string>"), " / ")
    title = X.first_text(text("title"), text("disease_name"), headers, text("source"))
    summary = F.coalesce(text("summary"), F.lit(""))
    disease = F.nullif(text("disease_name"), F.lit(""))
    differential = differential_text(text("differential_json"))
    clinical = F.concat(
        F.lit(C.LABEL_CONDITION), disease,
        F.coalesce(
            F.concat(F.lit("\n" + C.LABEL_CODE), F.nullif(text("code"), F.lit(""))), F.lit("")
        ),
        F.coalesce(F.concat(F.lit("\n" + C.LABEL_DIFFERENTIAL), differential), F.lit("")),
        F.lit("\n\n" + C.LABEL_CONTENT), content,
    )
    regular = F.concat(
        F.lit(C.LABEL_TITLE), title, F.lit("\n" + C.LABEL_SUMMARY), summary,
        F.lit("\n" + C.LABEL_CONTENT), content,
    )
    tier = F.lit(force_tier) if force_tier else F.coalesce(text("tier"), text("source_tier"), F.lit(""))
    source_tier = (
        F.lit(force_tier) if force_tier else F.coalesce(text("source_tier"), text("tier"), F.lit(""))
    )
    kind = source_kind or ("textbook" if force_tier == "tier_1" else "psychology")
    identity = F.coalesce(text("uuid"), text("_id"), F.lit(""))
    metadata = F.struct(
        identity.alias("uuid"),
        F.coalesce(text("chunk_id"), identity).alias("chunk_id"),
        tier.alias("tier"),
        source_tier.alias("source_tier"),
        F.lit(kind).alias("source_kind"),
        title.alias("title"),
        summary.alias("summary"),
        optional(df, "tags", "array<string>").alias("tags"),
        optional(df, "keywords", "array<string>").alias("keywords"),
        F.coalesce(text("type"), F.when(disease.isNotNull(), F.lit("DSM-5")), F.lit("")).alias("type"),
        F.coalesce(optional(df, "score", "double"), F.lit(0.0)).alias("score"),
        F.coalesce(text("code"), F.lit("")).alias("code"),
        F.coalesce(text("disease_name"), F.lit("")).alias("disease_name"),
        F.coalesce(text("source"), F.lit("")).alias("source"),
        F.coalesce(text("source_sha256"), F.lit("")).alias("source_sha256"),
        optional(df, "chunk_index", "bigint").alias("chunk_index"),
        optional(df, "start_char", "bigint").alias("start_char"),
        optional(df, "end_char", "bigint").alias("end_char"),
        optional(df, "source_char_count", "bigint").alias("source_char_count"),
        optional(df, "structure_path", "array<string>").alias("structure_path"),
    )
    keep = [c for c in ("query_id", "rank", "doc_id") if c in df.columns]
    return df.select(
        *keep, F.when(disease.isNotNull(), clinical).otherwise(regular).alias("page_content"),
        metadata.alias("metadata"),
    )


PROVENANCE = [
    "source", "source_sha256", "chunk_index", "start_char", "end_char", "source_char_count",
]


def evidence_ref(page: Column, meta: Column) -> Column:
    """Compact citation of one retrieved document."""
    pairs = [x for k in PROVENANCE for x in (F.lit(k), meta[k].cast("string"))]
    pairs += [F.lit("structure_path"), F.array_join(meta["structure_path"], "/")]
    return F.struct(
        X.first_text(meta["chunk_id"], meta["uuid"]).alias("chunk_id"),
        X.document_tier(meta["tier"], meta["source_tier"]).alias("tier"),
        meta["source_kind"].alias("source_kind"),
        meta["title"].alias("title"),
        meta["score"].alias("score"),
        F.substring(page, 1, C.EXCERPT_CHARS).alias("excerpt"),
        F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("provenance"),
    )


def collect_refs(df: DataFrame, item: str = "query_id", rank: str = "rank") -> DataFrame:
    """Citations per item in rank order. The caller has cut each item to its evidence limit."""
    return (
        df.groupBy(item)
        .agg(F.map_from_entries(F.collect_list(F.struct(rank, "ref"))).alias("by_rank"))
        .select(
            item,
            F.transform(
                F.array_sort(F.map_keys("by_rank")), lambda r: F.element_at("by_rank", r)
            ).alias("refs"),
        )
    )


def anchor_view(df: DataFrame) -> DataFrame:
    return df.select(
        chunk_key(df).alias("chunk_id"),
        X.first_text(
            optional(df, "title"), F.array_join(optional(df, "headers", "array<string>"), " / ")
        ).alias("title"),
        F.coalesce(optional(df, "summary"), F.lit("")).alias("summary"),
        F.coalesce(optional(df, "content"), F.lit("")).alias("content"),
        F.coalesce(optional(df, "keywords", "array<string>"), R.empty()).alias("keywords"),
        F.coalesce(optional(df, "type"), F.lit("")).alias("type"),
        F.coalesce(
            F.nullif(optional(df, "tier"), F.lit("")), optional(df, "source_tier")
        ).alias("tier"),
    )


def once_per_query(
    queries: DataFrame, compute: Callable[[DataFrame], DataFrame],
    text: str = "query", key_columns: list[str] | None = None,
) -> DataFrame:
    """Run ``compute`` on each distinct query only, then give its result to every asker.

    ``compute`` gets (key, ``text``, key_columns) and returns rows that carry ``key``.
    Other result-changing options belong in ``key_columns``.
    """
    extra = key_columns or []
    keyed = queries.withColumn(
        "key",
        F.sha2(F.concat_ws("\u0001", X.canonical_query(F.col(text)), *[F.col(c).cast("string") for c in extra]), 256),
    )
    distinct = keyed.groupBy("key").agg(
        F.min(text).alias(text), *[F.first(c).alias(c) for c in extra]
    )
    return keyed.join(compute(distinct).drop(text, *extra), "key").drop("key")


# --- plans -----------------------------------------------------------------------------


def assign_curriculum(
    df: DataFrame, order: list[str], levels: list[str] = C.LEVELS,
    difficulties: list[str] = C.DIFFICULTIES, direct: bool = False,
) -> DataFrame:
    """Level and difficulty by item number; the direct control turns both on one counter."""
    numbered = number_rows(df, order, "number")
    i = F.col("number") - 1
    turn = i if direct else F.floor(i / len(levels))

    def pick(values: list[str], at: Column) -> Column:
        return F.element_at(X.array_of(values), (F.pmod(at, F.lit(len(values))) + 1).cast("int"))

    return numbered.withColumn("level", pick(levels, i)).withColumn(
        "difficulty", pick(difficulties, turn)
    )


def with_policy(df: DataFrame) -> DataFrame:
    """Depths by difficulty; an unknown difficulty counts as medium."""
    d = F.col("difficulty")
    names = ["candidate_k", "tier1_k", "evidence_limit", "min_refs"]
    return df.withColumns({n: R.evidence_limit(d, i + 1) for i, n in enumerate(names)})


def with_plan_object(df: DataFrame, reply: str, name: str) -> DataFrame:
    """Add the plan in a reply, taken out of a known wrapper if there is one."""
    df = X.with_json_object(df, reply, "_whole")
    inner = [
        F.when(
            F.schema_of_variant(R._field(F.col("_whole"), w)).startswith("OBJECT"),
            R._field(F.col("_whole"), w),
        )
        for w in C.PLAN_WRAPPERS
    ]
    return df.withColumn(name, F.coalesce(*inner, F.col("_whole"))).drop("_whole")


def normalize_blueprint(df: DataFrame) -> DataFrame:
    """Fill a planner reply from its anchor.

    Needs columns ``reply, level, difficulty, title, summary``; adds ``missing`` and ``plan``.
    """
    base = df.columns
    df = with_plan_object(df, "reply", "_plan")
    plan, rubric = F.col("_plan"), F.col("_rubric")
    df = df.withColumn("_rubric", R._field(plan, "emobench"))
    rules = F.transform(
        R.list_field(plan, "playbook_bullet_ids"), lambda v: F.try_variant_get(v, "$", "string")
    )
    rubric_fields = ["task", "eu_category", "relationship_type", "problem_owner", "question_type"]
    df = df.select(
        *base,
        F.struct(*[R.text_field(plan, n).alias(n) for n in C.PLAN_TEXT_FIELDS]).alias("_text"),
        rules.alias("_rules"),
        F.coalesce(F.try_variant_get(plan, "$.requires_emobench", "string") == "true", F.lit(False)).alias("_asked"),
        F.struct(*[R.text_field(rubric, n).alias(n) for n in rubric_fields]).alias("_rubric"),
    )
    title = X.first_text(F.col("title"), F.lit(C.DEFAULT_TITLE))
    fallback = {
        "topic": F.substring(title, 1, C.TOPIC_CHARS),
        "subtopic": F.lit(C.DEFAULT_SUBTOPIC),
        "skill": F.lit(C.DEFAULT_SKILL),
        "retrieval_query": F.substring(
            X.strip(F.concat_ws(" ", title, F.coalesce(F.col("summary"), F.lit("")))),
            1, C.QUERY_CHARS,
        ),
        "clinical_guardrail": F.lit(C.DEFAULT_GUARDRAIL),
    }
    fields = {n: F.col("_text")[n] for n in C.PLAN_TEXT_FIELDS}
    missing = X.codes(
        *[(X.blank(fields[n]), n) for n in C.PLAN_TEXT_FIELDS],
        (F.col("_rules").isNull(), "playbook_bullet_ids"),
    )
    clinical = F.col("level") == C.CLINICAL
    least = R.evidence_limit(F.col("difficulty"), 4)
    wants_rubric = (F.col("level") == "emotion") & F.col("_asked")
    return df.select(
        *base,
        missing.alias("missing"),
        F.struct(
            *[
                F.when(X.blank(fields[n]), fallback[n]).otherwise(fields[n]).alias(n)
                for n in C.PLAN_TEXT_FIELDS
            ],
            F.coalesce("_rules", R.empty()).alias("playbook_bullet_ids"),
            F.col("level"),
            F.col("difficulty"),
            R.evidence_limit(F.col("difficulty")).alias("evidence_limit"),
            F.when(clinical, F.greatest(F.lit(2), least)).otherwise(least).alias("min_evidence_refs"),
            F.lit(4).alias("num_options"),
            wants_rubric.alias("requires_emobench"),
            rubric_plan(wants_rubric, *[F.col("_rubric")[n] for n in rubric_fields]).alias("emobench"),
        ).alias("plan"),
    )


def rubric_plan(
    enabled: Column, task: Column, category: Column, relation: Column, owner: Column, kind: Column
) -> Column:
    """Rubric choice kept inside its allowed values; unused dimensions are null."""
    enabled = F.coalesce(enabled, F.lit(False))
    task = F.when(enabled, F.when(task == "EA", F.lit("EA")).otherwise(F.lit("EU")))

    def allowed(value: Column, values: list[str], when: str) -> Column:
        return F.when(
            task == when, F.when(value.isin(values), value).otherwise(F.lit(values[0]))
        )

    return F.struct(
        enabled.alias("enabled"),
        task.alias("task"),
        allowed(category, C.EU_CATEGORIES, "EU").alias("eu_category"),
        allowed(relation, C.EA_RELATIONSHIPS, "EA").alias("relationship_type"),
        allowed(owner, C.EA_OWNERS, "EA").alias("problem_owner"),
        allowed(kind, C.EA_QUESTION_TYPES, "EA").alias("question_type"),
        F.when(enabled, R.required_criteria(task)).otherwise(R.empty()).alias("criteria"),
    )


def rewrite_query(topic: Column, subtopic: Column, question: Column, keyed: Column) -> Column:
    parts = F.filter(F.array(topic, subtopic, question, keyed), lambda x: ~X.blank(x))
    return F.substring(F.array_join(parts, " "), 1, C.REWRITE_CHARS)


# --- requests --------------------------------------------------------------------------

TASKS = {
    "planner": "Plan one question on the passage below. Return a JSON object.",
    "evidence_plan": "List the claims the sources support and the inferences they do not allow.",
    "generator": "Write one question with options A to D that only the sources decide.",
    "preflight": "Check the cited sources and the balance of the options before the review.",
    "evidence": "Judge whether the cited sources support the key and nothing else.",
    "single_answer": "Judge each option as correct, incorrect or ambiguous.",
    "ei_safety_bias": "Judge safety, bias and, where asked, every rubric criterion.",
    "adversarial_solver": "Answer without the sources and name any cue that gave the key away.",
}


def token_budget(role: Column, level: Column, truncated: Column) -> Column:
    clinical = level == C.CLINICAL
    generator = F.when(clinical, 2600).otherwise(1800)
    return (
        F.when(role == "planner", 1000)
        .when(role == "evidence_plan", F.when(clinical, 1800).otherwise(700))
        .when(role == "generator", F.when(truncated, F.floor(generator * 3 / 2)).otherwise(generator))
        .when(role == "preflight", 450)
        .when(role == "adversarial_solver", 500)
        .when(role == "insight", 900)
        .otherwise(700)
        .cast("int")
    )


def build_requests(
    df: DataFrame, roles: list[str], context: list[str], tail: Callable[[str], Column] | None = None
) -> DataFrame:
    """One request row per item and role: task line, token budget and the item as JSON.

    ``context`` names the columns a role may see; the solver sees question and options only,
    the evidence judge only the cited sources. ``tail`` gives what a role is told after that.
    """
    truncated = (
        F.coalesce(F.array_contains("feedback_issues", "llm_output_truncated"), F.lit(False))
        if "feedback_issues" in df.columns
        else F.lit(False)
    )

    def body(role: str) -> Column:
        names = [c for c in context if c in df.columns]
        if role == "adversarial_solver":
            names = [c for c in ("question", "options", "difficulty") if c in df.columns]
        columns = [F.col(c) for c in names]
        if role in ("evidence", "preflight") and "refs" in names and "cited" in df.columns:
            columns = [
                F.filter("refs", lambda r: F.array_contains("cited", r["chunk_id"])).alias("refs")
                if c == "refs" else F.col(c)
                for c in names
            ]
        told = [tail(role)] if tail else []
        return F.concat(F.lit(TASKS[role] + "\n"), F.to_json(F.struct(*columns)), *told)

    entry = F.explode(
        F.array(*[F.struct(F.lit(r).alias("role"), body(r).alias("request")) for r in roles])
    )
    keep = [c for c in ("item_id", "attempt", "level") if c in df.columns]
    return (
        df.withColumn("_t", truncated)
        .select(*keep, "_t", entry.alias("e"))
        .select(
            *[k for k in keep if k != "level"], "e.role", "e.request",
            token_budget(F.col("e.role"), F.col("level"), F.col("_t")).alias("max_tokens"),
        )
    )


# --- records ---------------------------------------------------------------------------


def validation_status(method: Column, reports: Column, verdict: Column, rubric: Column) -> Column:
    """Status per check. ``reports`` maps a judge to a struct with ``passed``."""
    judged = method.isin(C.JUDGED_METHODS)

    def passed(judge: str) -> Column:
        return F.coalesce(F.try_element_at(reports, F.lit(judge))["passed"], F.lit(False))

    def status(judge: str) -> Column:
        return (
            F.when(passed(judge), F.lit("pass"))
            .when(judged, F.lit("fail"))
            .otherwise(F.lit("not_run"))
        )

    safe = judged & passed("ei_safety_bias")
    return F.struct(
        status("evidence").alias("evidence_status"),
        status("single_answer").alias("single_best_answer"),
        status("single_answer").alias("distractor_quality"),
        (judged & (F.coalesce(F.size(reports), F.lit(0)) > 0)).alias("consistency_checked"),
        safe.alias("bias_checked"),
        safe.alias("safety_checked"),
        F.when(~judged, F.lit("not_run"))
        .when(~F.coalesce(rubric, F.lit(False)), F.lit("not_applicable"))
        .when(passed("ei_safety_bias"), F.lit("pass"))
        .otherwise(F.lit("fail"))
        .alias("emobench_status"),
        F.lit(False).alias("expert_verified"),
        F.when(verdict == "verified", F.lit("rule_verified"))
        .otherwise(F.lit("failed"))
        .alias("reasoning_verified"),
    )


def assemble_records(df: DataFrame, split: str = "train", playbook_version: str = "v0.2") -> DataFrame:
    """The nested output record.

    Needs ``id, draft, refs, level, difficulty, method, topic, subtopic, skill, rubric,
    reports, verdict, reasons, anchor_id, attempts``; takes ``playbook_delta, max_retries, history,
    feedback, failed_draft`` where they are there. Clinical fields stay null elsewhere, so that JSON
    sinks leave them out.
    """
    changes = "array<struct<op:string,section:string,bullet_id:string,content:string>>"
    past = f"array<struct<attempt:int,route:string,feedback:{ENTRIES}>>"

    def given(name: str, kind: str, default: Column) -> Column:
        return F.coalesce(F.col(name).cast(kind), default.cast(kind)) if name in df.columns else default.cast(kind)

    d, method = F.col("draft"), F.col("method")
    text = lambda n: F.coalesce(d[n], F.lit(""))
    none = F.create_map().cast("map<string,string>")
    clinical = F.col("level") == C.CLINICAL
    cited = F.filter(
        "refs", lambda r: F.coalesce(F.array_contains(d["cited"], r["chunk_id"]), F.lit(False))
    )
    references = F.transform(
        cited,
        lambda r: F.struct(
            r["chunk_id"].alias("chunk_id"),
            F.lit("supports_answer").alias("relation"),
            r["score"].alias("support_strength"),
            r["source_kind"].alias("source_kind"),
            r["provenance"].alias("provenance"),
        ),
    )
    return df.select(
        "id",
        text("question").alias("question"),
        F.coalesce(d["options"], none).alias("options"),
        text("answer").alias("answer"),
        references.alias("evidence_refs"),
        F.coalesce(d["distractor_analysis"], none).alias("distractor_analysis"),
        F.struct(
            F.coalesce(d["audit_steps"], R.empty()).alias("steps"),
            text("rationale_short").alias("rationale_short"),
            F.lit("internal_audit").alias("visibility"),
        ).alias("reasoning"),
        F.struct(
            F.coalesce("topic", F.lit("")).alias("topic"),
            F.coalesce("subtopic", F.lit("")).alias("subtopic"),
            F.coalesce("level", F.lit("")).alias("question_type"),
            F.coalesce("skill", F.lit("")).alias("cognitive_skill"),
            F.coalesce("difficulty", F.lit("medium")).alias("difficulty"),
            F.lit("vi").alias("language"),
            F.when(clinical, F.lit("B")).otherwise(F.lit("A")).alias("risk_tier"),
            F.when(method == "direct", F.lit("synthetic_direct"))
            .otherwise(F.lit("synthetic_grounded"))
            .alias("generation_type"),
            method.alias("experiment_method"),
            F.lit(playbook_version).alias("playbook_version"),
            F.col("rubric").alias("emobench"),
        ).alias("metadata"),
        F.lit(split).alias("split"),
        validation_status(
            method, F.col("reports"), F.col("verdict"), F.col("rubric")["enabled"]
        ).alias("validation"),
        F.struct(
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("created_at"),
            F.col("anchor_id"),
            method.alias("experiment_method"),
            F.col("reports").alias("judge_reports"),
            F.col("verdict"),
            F.col("reasons").alias("quarantine_reason"),
            given("playbook_delta", changes, F.array()).alias("playbook_delta"),
            F.col("attempts").alias("generation_attempts"),
            given("max_retries", "int", F.lit(C.MAX_RETRIES)).alias("max_generation_retries"),
            given("history", past, F.array()).alias("repair_history"),
            given("feedback", ENTRIES, F.array()).alias("generation_feedback"),
            given("failed_draft", "string", F.lit("{}")).alias("failed_generation_draft"),
            F.transform("refs", lambda r: r["chunk_id"]).alias("retrieved_chunk_ids"),
        ).alias("_audit"),
        F.when(clinical, text("clinical_case")).alias("clinical_case"),
        F.when(clinical, text("case_summary")).alias("case_summary"),
    )


def next_record_id(outputs: DataFrame) -> int:
    """One more than the highest numbered id, of up to 38 digits; 1 when there is none."""
    number = F.nullif(F.regexp_extract("id", r"^PSY-0*(\d+)$", 1), F.lit(""))
    longest = F.when(F.length(number) > 38, F.raise_error(F.lit("record ids have up to 38 digits"))).otherwise(number)
    top = outputs.agg(F.max(longest.cast("decimal(38,0)"))).first()[0]
    return 1 + int(top or 0)


def assign_record_ids(df: DataFrame, order: list[str], start: int) -> DataFrame:
    """Numbers from ``start`` in order and ids with them; numbers past 62 bits are decimals."""
    numbered = number_rows(df, order, "_n")
    if start < 1 << 62:
        number = F.col("_n") + (start - 1)
        name = F.format_string("PSY-%06d", number)
    else:
        number = (F.col("_n").cast("decimal(38,0)") + F.lit(Decimal(start - 1))).cast("decimal(38,0)")
        name = F.concat(F.lit("PSY-"), number.cast("string"))
    return numbered.withColumn("number", number).withColumn("id", name).drop("_n")
