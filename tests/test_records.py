"""Draft contract, surface cues, gate details and routing on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from quizmill.functions import records as R
from quizmill.functions import text as X
from quizmill.operators import attempts as AT
from quizmill.operators import shape as S

REFS = "array<struct<chunk_id:string,source_kind:string>>"


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def words(n):
    return " ".join(f"từ{i}" for i in range(n))


@pytest.mark.parametrize("counts, difficulty, flagged", [
    ((32, 32, 42, 32), "medium", True), ((29, 26, 25, 36), "hard", True), ((45, 32, 32, 37), "easy", True),
    ((30, 30, 36, 30), "medium", False), ((30, 30, 36, 30), "hard", True), ((10, 10, 15, 10), "hard", False),
])
def test_length_gap(spark, counts, difficulty, flagged):
    options = F.create_map(*[x for k, n in zip("ABCD", counts) for x in (F.lit(k), F.lit(words(n)))])
    issues = one(spark, R.surface_issues(options, R.max_gap(F.lit(difficulty))))
    assert ("surface_cue:option_length_imbalance" in issues) is flagged


def test_wording_is_found_per_option_only(spark):
    def issues(*texts):
        options = F.create_map(*[x for k, t in zip("ABCD", texts) for x in (F.lit(k), F.lit(t))])
        return one(spark, R.surface_issues(options, F.lit(8)))

    assert issues("hoàn", "toàn", "x", "y") == []
    assert issues("a", "b", "Điều này HOÀN  TOÀN đúng", "d") == ["surface_cue:absolute_wording"]
    assert "surface_cue:meta_option" in issues("a", "b", "c", "Cả A và B")
    assert issues("a", "b", "bất tất cảm", "d") == []


def draft(**changes):
    d = {
        "question": "Q?", "options": {k: f"option {k}" for k in "ABCD"}, "answer": "A",
        "evidence_refs": ["c1"], "rationale_short": "r", "audit_steps": ["s"],
        "distractor_analysis": {k: "no" for k in "BCD"},
        "clinical_case": "Hypothetical Case: x", "case_summary": "s",
    }
    d.update(changes)
    return json.dumps({k: v for k, v in d.items() if v is not ...})


CONTRACT = [
    (draft(), "theory", []),
    ("[1, 2]", "theory", ["schema:not_json_object"]),
    (draft(options=["a", "b"]), "theory", ["schema:options_must_be_mapping_A_to_D"]),
    (draft(options={"A": ["x"], "B": "b", "C": "c", "D": "d"}), "theory", ["schema:options_must_be_nonempty_strings"]),
    (draft(answer="B"), "theory", ["schema:answer_position_must_be_A"]),
    (draft(answer=2), "theory", ["schema:answer_must_be_A_to_D"]),
    (draft(distractor_analysis={"B": "x"}), "theory", ["schema:distractor_analysis_must_cover_exactly_three_wrong_options"]),
    (draft(distractor_analysis={"B": "x", "C": " ", "D": "y"}), "theory", ["schema:distractor_analysis_must_be_nonempty_strings"]),
    (draft(question=" ", rationale_short=..., audit_steps=[]), "theory",
     ["schema:missing_question", "schema:missing_rationale_short", "schema:missing_audit_steps"]),
    (draft(clinical_case=..., case_summary=""), "clinical_scenario",
     ["schema:missing_clinical_case", "schema:missing_case_summary", "schema:missing_textbook_citation"]),
    (draft(evidence_refs=[{"chunk_id": "c2"}, {"other": 1}]), "clinical_scenario", ["schema:missing_dsm5_citation"]),
    (draft(evidence_refs="c1"), "clinical_scenario", []),
]


def test_contract(spark):
    rows = [(i, r, level) for i, (r, level, _) in enumerate(CONTRACT)]
    df = spark.createDataFrame(rows, "i int, reply string, level string").withColumn(
        "refs", F.expr(f"cast(array(named_struct('chunk_id','c1','source_kind','dsm5'), named_struct('chunk_id','c2','source_kind','textbook')) as {REFS})")
    )
    df = df.withColumn("object", F.try_parse_json("reply")).withColumn("d", R.typed_draft(F.col("object")))
    df = df.withColumn("d", R.with_default_citations(F.col("d"), F.col("refs")))
    out = df.select("i", R.contract_issues(F.col("d"), F.col("refs"), F.lit("A"), F.col("level")).alias("x"), "d").collect()
    for r in out:
        assert r["x"] == CONTRACT[r["i"]][2], r["i"]
    whole = {r["i"]: r["d"] for r in out}
    assert whole[0]["clinical_case"] == "Tình huống giả định: x"
    assert whole[11]["cited"] == ["c1", "c2"]


def test_reply_parsing(spark):
    rows = [("pre ```json\n{\"a\": {\"b\": 1}}\n``` tail",), ("{\"a\": 1} {\"b\"",), ("[{\"a\": 1}]",), ("none",), ("{\"a\": ",)]
    df = X.with_json_object(spark.createDataFrame(rows, "reply string"), "reply", "o")
    assert [r[0] for r in df.select(F.to_json("o")).collect()] == ['{"a":{"b":1}}', '{"a":1}', '{"a":1}', None, None]


@pytest.mark.parametrize("text, want", [
    ("<step>..</step>\n(answer)Câu trả lời\n</answer>", "Câu trả lời"), ("<answer>\nNormal.\n</answer> x", "Normal."),
    ("(answer>\nMới.\n</answer>", "Mới."), ("Answer: \nFinal.\n", "Final."), ("no tag", "Error parsing answer"),
])
def test_answer_tag(spark, text, want):
    assert one(spark, X.answer_tag(F.lit(text))) == want


def test_flatten_json(spark):
    value = {"a": ["x", {"b": "say \"hi\": \\ done", "n": 3}], "c": {"d": {"e": {"f": "é\nz"}}}, "g": "", "h": None}
    assert one(spark, X.flatten_json(F.lit(json.dumps(value)))) == "x say \"hi\": \\ done é\nz"


@pytest.mark.parametrize("tier, source, want", [
    ("TIER_1", None, "Tier 1"), ("", "2", "Tier 2"), (None, "tier3", "Tier 3"), ("Draft", "tier_1", "Unapproved tier (draft)"),
    (None, "", "Tier 2 (legacy-unclassified)"),
])
def test_document_tier(spark, tier, source, want):
    assert one(spark, X.document_tier(F.lit(tier).cast("string"), F.lit(source).cast("string"))) == want


ROUTES = [
    (["evidence:evidence_mismatch"], [], "generate", 1, True, "retrieve"),
    (["evidence:evidence_mismatch"], [], "generate", 1, False, "generate"),
    (["x:blueprint_mismatch"], [], "generate", 1, True, "generate"),
    (["x:blueprint_mismatch"], ["y:blueprint_mismatch"], "generate", 2, True, "replan"),
    (["x:subtopic_mismatch"], ["y:blueprint_mismatch"], "generate", 2, True, "generate"),
    (["e:irrelevant_citation"], ["e:evidence_mismatch"], "retrieve", 2, True, "replan"),
    (["surface"], ["e:evidence_mismatch"], "retrieve", 2, True, "generate"),
    (["dsm5_evidence_missing"], [], "generate", 1, False, "replan"),
]


@pytest.mark.parametrize("issues, earlier, previous, attempt, has_draft, want", ROUTES)
def test_repair_route(spark, issues, earlier, previous, attempt, has_draft, want):
    def arr(values):
        return X.array_of(values) if values else R.empty()

    got = one(spark, AT.repair_route(arr(issues), arr(earlier), F.lit(previous), F.lit(attempt), F.lit(has_draft)))
    assert got == want


@pytest.mark.parametrize("attempt, verified, want", [
    (1, False, "prepare_regeneration"), (2, False, "prepare_regeneration"), (3, False, "collect"), (1, True, "collect"),
])
def test_retry_route(spark, attempt, verified, want):
    assert one(spark, AT.retry_route(F.lit(verified), F.lit(attempt), "collect")) == want


def test_solver_findings_warn_unless_blocking(spark):
    kind = "array<struct<judge:string,passed:boolean,issues:array<string>,feedback:string,blocking:boolean>>"

    def named(blocking, strict=False):
        reports = F.expr(
            "cast(array(named_struct('judge','adversarial_solver','passed',false,'issues',array('adversarial:spurious_cues_found'),"
            f"'feedback','','blocking',{str(blocking).lower()}), named_struct('judge','evidence','passed',cast(null as boolean),"
            f"'issues',cast(null as array<string>),'feedback','','blocking',false)) as {kind})"
        )
        return one(spark, R.named_issues(reports, skip_warnings=not strict))

    cue = "adversarial_solver:adversarial:spurious_cues_found"
    assert named(False) == ["evidence:failed"]
    assert named(True) == [cue, "evidence:failed"]
    assert named(False, strict=True) == [cue, "evidence:failed"]


def test_record_ids_continue(spark):
    out = spark.createDataFrame([("PSY-000007",), ("PSY-000021",), ("other",), (None,)], "id string")
    start = S.next_record_id(out)
    assert start == 22
    new = S.assign_record_ids(spark.createDataFrame([(2,), (1,)], "k int"), ["k"], start).orderBy("k").collect()
    assert [(r["k"], r["id"]) for r in new] == [(1, "PSY-000022"), (2, "PSY-000023")]
    assert S.next_record_id(out.limit(0)) == 1


def test_audit_part_stays_out_of_verified(spark, tmp_path):
    from quizmill.catalog.shape import finished, items_with_reports
    from quizmill.sources.sinks import write_outputs

    records = S.assemble_records(finished(items_with_reports(spark, "/root/testdata/sf0.001")))
    counts = write_outputs(records, str(tmp_path / "v"), str(tmp_path / "q"))
    verified, quarantine = spark.read.json(str(tmp_path / "v")), spark.read.json(str(tmp_path / "q"))
    assert counts == {"verified": verified.count(), "quarantine": quarantine.count()}
    assert "_audit" not in verified.columns and "_audit" in quarantine.columns


def test_flatten_json_keeps_private_use_letters(spark):
    from pyspark.sql import functions as F

    from quizmill.functions.text import flatten_json

    rows = [(r'{"a": "x\ue000y", "b": ["say \"hi\"", "back\\slash", ""], "c\"d": "end"}'.replace("\\ue000", "\ue000"),)]
    got = spark.createDataFrame(rows, "j string").select(flatten_json(F.col("j")).alias("t")).first()["t"]
    assert got == 'x\ue000y say "hi" back\\slash end'


def test_record_ids_of_many_digits(spark):
    from quizmill.operators import shape as S

    def start(*ids):
        return S.next_record_id(spark.createDataFrame([(i,) for i in ids], "id string"))

    assert start() == 1 and start("PSY-000007", "x", None, "PSY-", "PSY-12x") == 8
    long = 10**24 + 5
    assert start("PSY-000009", f"PSY-{long}", "PSY-" + "0" * 40 + "3") == long + 1
    rows = spark.createDataFrame([(k,) for k in range(5)], "k bigint")
    for first in (3, 2**62 - 1, 2**62, long + 1):
        got = S.assign_record_ids(rows, ["k"], first).orderBy("k").collect()
        assert [r["id"] for r in got] == [f"PSY-{first + k:06d}" for k in range(5)]
        assert [int(r["number"]) for r in got] == [first + k for k in range(5)]
