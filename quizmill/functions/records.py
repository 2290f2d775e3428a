"""Column rules for one item: the draft a model wrote, its citations and its reports.

A typed draft is a struct. A null map means "not a mapping", a null map value means
"not a text", so that wrong shapes stay visible as data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmill import constants as C
from quizmill.functions import text as X


def letters() -> Column:
    return X.array_of(C.ANSWER_LABELS)


def empty() -> Column:
    return F.array().cast("array<string>")


# --- reading a draft -------------------------------------------------------------------


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _field(draft: Column, name: str) -> Column:
    return F.try_variant_get(draft, f"$.{name}", "variant")


def text_field(draft: Column, name: str) -> Column:
    value = _field(draft, name)
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def map_field(draft: Column, name: str) -> Column:
    value = _field(draft, name)
    return F.when(
        _kind(value).startswith("OBJECT"),
        F.transform_values(
            F.try_variant_get(value, "$", "map<string,variant>"),
            lambda _, v: F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")),
        ),
    )


def list_field(draft: Column, name: str) -> Column:
    value = _field(draft, name)
    return F.when(
        _kind(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>")
    )


def citation_ids(values: Column) -> Column:
    """Ids from texts or from objects that carry ``chunk_id``; ordered, distinct."""
    ids = F.transform(
        values,
        lambda v: F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")).when(
            _kind(v).startswith("OBJECT"), text_field(v, "chunk_id")
        ),
    )
    return F.coalesce(
        F.array_distinct(F.filter(ids, lambda x: F.coalesce(x != "", F.lit(False)))), empty()
    )


def typed_draft(draft: Column) -> Column:
    refs = list_field(draft, "evidence_refs")
    return F.when(
        _kind(draft).startswith("OBJECT"),
        F.struct(
            text_field(draft, "question").alias("question"),
            map_field(draft, "options").alias("options"),
            text_field(draft, "answer").alias("answer"),
            citation_ids(refs).alias("cited"),
            text_field(draft, "rationale_short").alias("rationale_short"),
            F.transform(
                list_field(draft, "audit_steps"), lambda v: F.try_variant_get(v, "$", "string")
            ).alias("audit_steps"),
            map_field(draft, "distractor_analysis").alias("distractor_analysis"),
            text_field(draft, "clinical_case").alias("clinical_case"),
            text_field(draft, "case_summary").alias("case_summary"),
        ),
    )


def with_typed_draft(df: DataFrame, reply: str, refs: str, name: str = "draft") -> DataFrame:
    """Add the typed draft in a reply, with default citations, parsing the reply once."""
    df = X.with_json_object(df, reply, "_object").withColumn(name, typed_draft(F.col("_object")))
    return df.withColumn(name, with_default_citations(F.col(name), F.col(refs))).drop("_object")


def draft_of(prefix: dict[str, str] | None = None) -> Column:
    """Typed draft struct from columns of the same names."""
    names = [
        "question", "options", "answer", "cited", "rationale_short", "audit_steps",
        "distractor_analysis", "clinical_case", "case_summary",
    ]
    prefix = prefix or {}
    return F.struct(*[F.col(prefix.get(n, n)).alias(n) for n in names])


# --- shape tests -----------------------------------------------------------------------


def four_options(options: Column) -> Column:
    return F.coalesce(F.array_sort(F.map_keys(options)) == letters(), F.lit(False))


def all_texts(mapping: Column) -> Column:
    return F.coalesce(F.forall(F.map_values(mapping), lambda x: ~X.blank(x)), F.lit(False))


def wrong_letters(answer: Column) -> Column:
    return F.array_except(letters(), F.array(answer))


def covers_wrong_letters(analysis: Column, answer: Column) -> Column:
    return F.coalesce(
        F.array_sort(F.map_keys(analysis)) == wrong_letters(answer), F.lit(False)
    )


def is_letter(answer: Column) -> Column:
    return F.coalesce(answer.isin(C.ANSWER_LABELS), F.lit(False))


def schema_valid(d: Column) -> Column:
    return (
        ~X.blank(d["question"])
        & four_options(d["options"])
        & all_texts(d["options"])
        & is_letter(d["answer"])
    )


def answer_position(number: Column) -> Column:
    return F.element_at(
        letters(), (F.pmod(F.greatest(F.coalesce(number, F.lit(1)), F.lit(1)) - 1, 4) + 1).cast("int")
    )


def ids_of_kind(refs: Column, kind: str) -> Column:
    return F.transform(
        F.filter(refs, lambda r: r["source_kind"] == kind), lambda r: r["chunk_id"]
    )


# --- contract --------------------------------------------------------------------------


def with_default_citations(d: Column, refs: Column) -> Column:
    """Heading put into the local language; every retrieved id cited when none is."""
    case = d["clinical_case"]
    case = F.when(
        case.startswith(C.CASE_HEADING),
        F.concat(F.lit(C.CASE_HEADING_LOCAL), F.substr(case, F.lit(len(C.CASE_HEADING) + 1))),
    ).otherwise(case)
    cited = F.when(F.size(d["cited"]) > 0, d["cited"]).otherwise(
        F.transform(refs, lambda r: r["chunk_id"])
    )
    return F.when(
        d.isNotNull(), d.withField("clinical_case", case).withField("cited", cited)
    )


def contract_issues(d: Column, refs: Column, required: Column, level: Column) -> Column:
    """Issue codes of a draft, in their fixed order."""
    clinical = level == C.CLINICAL
    four, letter = four_options(d["options"]), is_letter(d["answer"])
    placed = letter & (d["answer"] == required)
    analysis = placed & d["options"].isNotNull()
    covered = covers_wrong_letters(d["distractor_analysis"], d["answer"])

    def uncited(kind: str) -> Column:
        ids = ids_of_kind(refs, kind)
        return clinical & (F.size(ids) > 0) & ~F.arrays_overlap(ids, d["cited"])

    issues = X.codes(
        (clinical & X.blank(d["clinical_case"]), "schema:missing_clinical_case"),
        (clinical & X.blank(d["case_summary"]), "schema:missing_case_summary"),
        (uncited("dsm5"), "schema:missing_dsm5_citation"),
        (uncited("textbook"), "schema:missing_textbook_citation"),
        (X.blank(d["question"]), "schema:missing_question"),
        (~four, "schema:options_must_be_mapping_A_to_D"),
        (four & ~all_texts(d["options"]), "schema:options_must_be_nonempty_strings"),
        (~letter, "schema:answer_must_be_A_to_D"),
        (letter & ~placed, F.concat(F.lit("schema:answer_position_must_be_"), required)),
        (analysis & ~covered, "schema:distractor_analysis_must_cover_exactly_three_wrong_options"),
        (
            analysis & covered & ~all_texts(d["distractor_analysis"]),
            "schema:distractor_analysis_must_be_nonempty_strings",
        ),
        (X.blank(d["rationale_short"]), "schema:missing_rationale_short"),
        (F.coalesce(F.size(d["audit_steps"]), F.lit(0)) <= 0, "schema:missing_audit_steps"),
    )
    return F.when(d.isNull(), F.array(F.lit("schema:not_json_object"))).otherwise(issues)


def contract_feedback(issues: Column, required: Column, level: Column) -> Column:
    base = F.concat(
        F.lit("Repair the draft so that it holds a question, options A to D, the answer "),
        required,
        F.lit(" and an analysis of the other three letters."),
    )
    clinical = F.lit(
        " Add clinical_case and case_summary and cite one source of each retrieved kind."
    )
    return (
        F.when(F.size(issues) == 0, F.lit(""))
        .when(
            F.array_contains(issues, "schema:not_json_object"),
            F.lit("Return a single JSON object without a wrapper."),
        )
        .when(level == C.CLINICAL, F.concat(base, clinical))
        .otherwise(base)
    )


# --- surface cues ----------------------------------------------------------------------


def _counts(options: Column) -> list[Column]:
    return [X.word_count(F.try_element_at(options, F.lit(k))) for k in C.ANSWER_LABELS]


def word_counts(options: Column) -> Column:
    """Words per letter, null where an option is missing."""
    return F.array(*_counts(options))


def word_gap(options: Column) -> Column:
    """Longest less shortest option. No lambda and no array: compiled code counts each once."""
    counts = _counts(options)
    return F.greatest(*counts) - F.least(*counts)


def max_gap(difficulty: Column) -> Column:
    return F.when(difficulty == "hard", C.WORD_GAP_HARD).otherwise(C.WORD_GAP)


def surface_issues(options: Column, gap: Column) -> Column:
    # One text with a separator that is neither letter nor space: no phrase spans two options.
    joined = F.array_join(F.map_values(options), "\u0001")

    def any_option(phrases: list[str]) -> Column:
        return joined.rlike(X.phrase_pattern(phrases))

    return X.codes(
        (any_option(C.META_PHRASES), "surface_cue:meta_option"),
        (any_option(C.ABSOLUTE_PHRASES), "surface_cue:absolute_wording"),
        (word_gap(options) > gap, "surface_cue:option_length_imbalance"),
    )


def surface_feedback(issues: Column, options: Column, gap: Column) -> Column:
    counts = F.concat_ws(
        ", ",
        *[
            F.concat(
                F.lit(f"'{k}': "), X.word_count(F.try_element_at(options, F.lit(k))).cast("string")
            )
            for k in C.ANSWER_LABELS
        ],
    )
    length = F.format_string(C.CUE_FEEDBACK_LENGTH, counts, gap)
    text = lambda code: F.when(F.array_contains(issues, code), F.lit(C.CUE_FEEDBACK[code]))
    return F.array_join(
        F.array(
            text("surface_cue:meta_option"),
            text("surface_cue:absolute_wording"),
            F.when(F.array_contains(issues, "surface_cue:option_length_imbalance"), length),
        ),
        "; ",
    )


def emphatic_words(options: Column) -> Column:
    """Per option, its emphatic phrases: lower case, distinct, sorted; empty ones left out."""
    pattern = F.lit(X.phrase_pattern(C.EMPHATIC_PHRASES))
    found = F.transform_values(
        options,
        lambda _, v: F.array_sort(
            F.array_distinct(F.transform(F.regexp_extract_all(v, pattern, F.lit(0)), F.lower))
        ),
    )
    return F.map_filter(found, lambda _, v: F.size(v) > 0)


def guard_issues(options: Column, difficulty: Column, guard: bool = True) -> Column:
    """Surface codes; for hard items under their own prefix and with emphatic wording."""
    usable = four_options(options) & all_texts(options)
    surface = surface_issues(options, max_gap(difficulty))
    hard = F.concat(
        F.transform(surface, lambda c: F.replace(c, F.lit("surface_cue:"), F.lit("hard_guard:"))),
        X.codes((F.size(emphatic_words(options)) > 0, "hard_guard:emphatic_wording")),
    )
    ranked = F.when(F.lit(guard) & (difficulty == "hard"), hard).otherwise(surface)
    return F.when(~usable, F.array(F.lit("hard_guard:invalid_option_shape"))).otherwise(ranked)


def guard_feedback(options: Column, difficulty: Column) -> Column:
    usable = four_options(options) & all_texts(options)
    gap = max_gap(difficulty)
    surface = surface_feedback(surface_issues(options, gap), options, gap)
    found = emphatic_words(options)
    emphatic = F.when(
        F.size(found) > 0, F.concat(F.lit("remove emphatic wording: "), F.to_json(found))
    )
    details = F.array_join(F.array(F.nullif(surface, F.lit("")), emphatic), "; ")
    hard = F.when(details == "", F.lit("")).otherwise(
        F.concat(F.lit("Hard item needs a rewrite: "), details)
    )
    return (
        F.when(~usable, F.lit("Give four non-empty options A to D in one grammatical frame."))
        .when(difficulty == "hard", hard)
        .otherwise(surface)
    )


def preflight_issues(
    guard: Column, report_passed: Column, report_issues: Column, available: Column
) -> Column:
    """Guard codes, then those of the early review; a passing guard leaves the review as is."""
    review = F.coalesce(report_issues, empty())
    default = F.when(
        (F.size(review) == 0) & ~F.coalesce(report_passed, F.lit(False)),
        F.array(F.lit("preflight_failed")),
    ).otherwise(review)
    return (
        F.when(~available, guard)
        .when(F.size(guard) == 0, F.when(report_passed, empty()).otherwise(default))
        .otherwise(F.concat(guard, review))
    )


# --- judge reports ---------------------------------------------------------------------


def single_answer_issues(
    issues: Column, assessment: Column, options: Column, answer: Column
) -> Column:
    complete = F.coalesce(
        F.array_sort(F.map_keys(assessment)) == F.array_sort(F.map_keys(options)), F.lit(False)
    )
    key_ok = F.coalesce(
        F.map_contains_key(options, F.coalesce(answer, F.lit("")))
        & (F.try_element_at(assessment, F.coalesce(answer, F.lit(""))) == "correct"),
        F.lit(False),
    )
    others_ok = F.forall(
        F.map_keys(options),
        lambda k: (k == answer)
        | F.coalesce(F.try_element_at(assessment, k) == "incorrect", F.lit(False)),
    )
    found = X.codes(
        (~complete, "option_assessment_incomplete"),
        (complete & ~key_ok, "declared_answer_not_judged_correct"),
        (complete & key_ok & ~others_ok, "distractor_not_judged_incorrect"),
    )
    return F.array_distinct(F.concat(F.coalesce(issues, empty()), found))


def required_criteria(task: Column) -> Column:
    return F.when(task == "EA", X.array_of(C.EA_CRITERIA)).otherwise(X.array_of(C.EU_CRITERIA))


def rubric_issues(
    issues: Column, planned_task: Column, report_task: Column, criteria: Column
) -> Column:
    """Codes of a rubric report; ``planned_task`` is null for items without a rubric."""
    complete = (report_task == planned_task) & criteria.isNotNull()
    per = F.array_compact(
        F.transform(
            required_criteria(planned_task),
            lambda c: F.when(
                ~F.coalesce(F.try_element_at(criteria, c).isin("pass", "fail"), F.lit(False)),
                F.concat(F.lit("emobench_missing_criterion:"), c),
            ).when(
                F.try_element_at(criteria, c) == "fail", F.concat(F.lit("emobench:"), c)
            ),
        )
    )
    found = F.when(F.coalesce(complete, F.lit(False)), per).otherwise(
        F.array(F.lit("emobench_incomplete_report"))
    )
    given = F.coalesce(issues, empty())
    return F.when(planned_task.isNull(), given).otherwise(
        F.array_distinct(F.concat(given, found))
    )


def cue_found(
    selected: Column, answer: Column, confidence: Column, difficulty: Column,
    cue_type: Column, cue_text: Column,
) -> Column:
    return F.coalesce(
        (selected == answer)
        & (confidence == "high")
        & (difficulty == "hard")
        & cue_type.isin(C.CONCRETE_CUES)
        & ~X.blank(cue_text),
        F.lit(False),
    )


def named_issues(reports: Column, skip_warnings: bool) -> Column:
    """``judge:issue`` of the failed reports, in report order."""

    def one(r: Column) -> Column:
        failed = ~F.coalesce(r["passed"], F.lit(False))
        counts = failed
        if skip_warnings:
            counts = failed & (
                (r["judge"] != "adversarial_solver") | F.coalesce(r["blocking"], F.lit(False))
            )
        return F.when(
            counts,
            F.transform(
                F.coalesce(r["issues"], F.array(F.lit("failed"))),
                lambda i: F.concat(r["judge"], F.lit(":"), i),
            ),
        ).otherwise(empty())

    return F.flatten(F.transform(reports, one))


# --- gate ------------------------------------------------------------------------------


def evidence_limit(difficulty: Column, field: int = 3) -> Column:
    out = reduce(
        lambda acc, row: (acc.when if acc is not None else F.when)(
            difficulty == row[0], row[field]
        ),
        C.RETRIEVAL_POLICY,
        None,
    )
    medium = next(row for row in C.RETRIEVAL_POLICY if row[0] == "medium")
    return out.otherwise(medium[field])


def han_text(d: Column) -> Column:
    return X.contains_han(
        d["clinical_case"], d["case_summary"], d["question"], d["rationale_short"],
        F.array_join(F.map_values(d["options"]), " "),
        F.array_join(F.map_values(d["distractor_analysis"]), " "),
        F.array_join(d["audit_steps"], " "),
    )


def gate_issues(
    d: Column, refs: Column, level: Column, difficulty: Column, reports: Column,
    solver_blocks: bool = False,
) -> Column:
    """All reasons that keep an item out of the verified set, in their fixed order."""
    clinical = level == C.CLINICAL
    limit, least = evidence_limit(difficulty), evidence_limit(difficulty, 4)
    four, texts = four_options(d["options"]), all_texts(d["options"])
    available = F.transform(refs, lambda r: r["chunk_id"])
    cited = F.array_distinct(F.coalesce(d["cited"], empty()))
    has_answer = F.coalesce(d["answer"] != "", F.lit(False))
    surface = F.when(
        four & texts, surface_issues(d["options"], max_gap(difficulty))
    ).otherwise(empty())

    def kind(name: str, missing: str, uncited: str) -> tuple:
        ids = ids_of_kind(refs, name)
        return (
            (clinical & (F.size(ids) == 0), missing),
            (clinical & (F.size(ids) > 0) & ~F.arrays_overlap(ids, cited), uncited),
        )

    own = F.concat(
        X.codes(
            (~four, "invalid_options"),
            (four & ~texts, "invalid_option_text"),
            (four & ~is_letter(d["answer"]), "invalid_answer"),
            (
                four & has_answer & ~covers_wrong_letters(d["distractor_analysis"], d["answer"]),
                "incomplete_distractor_analysis",
            ),
        ),
        surface,
        X.codes(
            (han_text(d), "contains_han_script"),
            (
                ~F.coalesce(F.size(refs).between(1, limit), F.lit(False)),
                F.concat(F.lit("evidence_count_not_1_to_"), limit.cast("string")),
            ),
            (
                ~F.coalesce(
                    F.size(cited).between(least, limit)
                    & (F.size(F.array_except(cited, available)) == 0),
                    F.lit(False),
                ),
                "invalid_evidence_refs",
            ),
            (clinical & X.blank(d["clinical_case"]), "missing_clinical_case"),
            (clinical & X.blank(d["case_summary"]), "missing_case_summary"),
            *kind("dsm5", "dsm5_evidence_missing", "missing_dsm5_citation"),
            *kind("textbook", "textbook_evidence_missing", "missing_textbook_citation"),
        ),
    )
    return F.concat(
        own, F.coalesce(named_issues(reports, skip_warnings=not solver_blocks), empty())
    )


def verdict(issues: Column) -> Column:
    return F.when(F.size(issues) == 0, F.lit("verified")).otherwise(F.lit("quarantine"))


# --- failures --------------------------------------------------------------------------


def precondition(refs: Column, level: Column, method: Column) -> Column:
    """Why a draft must not be asked for yet; null when nothing is missing."""
    clinical = (level == C.CLINICAL) & (method != "direct")
    return (
        F.when(
            F.coalesce(F.size(refs), F.lit(0)) <= 0,
            F.when(clinical, F.lit("dsm5_evidence_missing")).otherwise(
                F.lit("missing_retrieved_evidence")
            ),
        )
        .when(clinical & (F.size(ids_of_kind(refs, "dsm5")) == 0), F.lit("dsm5_evidence_missing"))
        .when(
            clinical & (F.size(ids_of_kind(refs, "textbook")) == 0),
            F.lit("textbook_evidence_missing"),
        )
    )


def failure_issue(output_code: Column, message: Column, error_type: Column) -> Column:
    low = F.lower(message)
    out = F.when(output_code.isNotNull(), output_code)
    out = out.when(
        low.startswith("a03 schema repair failed"), F.lit("generator_schema_repair_failed")
    ).when(
        low.startswith("a03 preflight repair broke schema"),
        F.lit("generator_preflight_repair_broke_schema"),
    )
    for marker in C.MISSING_SOURCE_MARKERS:
        out = out.when(F.contains(low, F.lit(marker)), F.lit(marker))
    return out.when(F.contains(low, F.lit("cannot fulfill")), F.lit("generator_refusal")).otherwise(
        F.concat(F.lit("generator_error:"), error_type)
    )


def failure_feedback(issue: Column) -> Column:
    return (
        F.when(
            issue.isin("dsm5_evidence_missing", "textbook_evidence_missing"),
            F.lit("Retrieve both source kinds before a clinical case is written."),
        )
        .when(
            issue == "missing_retrieved_evidence",
            F.lit("Retrieve evidence before the item is written."),
        )
        .when(
            issue == "llm_output_truncated",
            F.lit("The reply was cut off: write a shorter item; the next budget is larger."),
        )
        .when(
            issue.isin("generator_schema_repair_failed", "generator_preflight_repair_broke_schema"),
            F.lit("Repair the listed shape findings and keep the rest of the item."),
        )
        .otherwise(F.lit("Return the item as JSON only, based on the evidence."))
    )
