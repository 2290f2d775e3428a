"""A job stopped between and within batches ends as an unbroken one, and asks nothing twice."""

import json
import sys
from collections import Counter
from functools import partial

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quizmill import constants as C
from quizmill.catalog.jobs import stub_model
from quizmill.plans.build import Builder
from quizmill.plans.job import BuildJob, ReplyLog

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors cannot import tests

RULES = "section string, bullet_id string, helpful bigint, harmful bigint, content string, pos bigint"
REF = (
    "transform(array('c1','c2'), c -> named_struct('chunk_id', c, 'tier', 'Tier 1', 'source_kind', 'textbook', "
    "'title', 't', 'score', 1D, 'excerpt', 'x', 'provenance', cast(map() as map<string,string>)))"
)


def noted(log, role, request, budget):
    """The stand-in model; keeps what it was asked. Numbers from 100 on give plans without a field first."""
    body = json.loads(request.split("\n")[1])
    with open(log, "a") as f:
        f.write(json.dumps([role, body.get("number"), body.get("attempt"), request, budget]) + "\n")
    if role == "planner" and body["number"] >= 100 and "missing" not in body:
        return json.dumps({"topic": "half a plan"})
    return stub_model(role, request)


def retrieve(items):
    return items.select("item_id", F.expr(REF).alias("refs"))


def job(spark, base, log, n=14, size=7, first=7):
    anchors = spark.createDataFrame(
        [(i, f"c{i}", "t", f"s{i}", "content", "tier_1") for i in range(n)],
        "doc_id bigint, chunk_id string, title string, summary string, content string, tier string",
    )
    model = partial(noted, str(log))
    builder = Builder("full", model, retrieve, levels=["theory"], max_retries=1, preflight=False)
    rules = spark.createDataFrame([("COMMON MISTAKES TO AVOID", f"err-{i:05d}", i % 2, 0, f"rule {i} of the book", i) for i in range(1, 9)], RULES)
    made = BuildJob(str(base), builder, size, threshold=2)
    return partial(made.run, anchors, ["doc_id"], rules, first), made


def result(spark, made):
    records = made.records(spark).select("id", "answer", "question", "metadata", "evidence_refs", F.col("_audit").dropFields("created_at").alias("a"))
    return sorted(r["j"] for r in records.select(F.to_json(F.struct("*")).alias("j")).collect()), sorted(
        tuple(r) for r in made.rules(spark).select("section", "bullet_id", "helpful", "harmful", "content").collect()
    )


def asked(log):
    return [json.loads(x) for x in open(log)]


@pytest.fixture(scope="module")
def unbroken(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("job")
    run, made = job(spark, folder / "base", folder / "log")
    assert run() == 2
    return result(spark, made), asked(folder / "log")


def test_what_is_learned_is_used(unbroken):
    (records, rules), calls = unbroken
    records = [json.loads(r) for r in records]
    assert len(records) == 14 and [r["id"][-2:] for r in records if r["a"]["verdict"] == "quarantine"] == ["07", "14", "19"]
    assert max(Counter(map(json.dumps, calls)).values()) == 1
    used = {r[1]: r[2] + r[3] - int(r[1][-1]) % 2 for r in rules if r[4].startswith("rule")}
    assert used == {f"err-{i:05d}": sum(n % 7 == i % 7 for n in range(7, 21)) for i in range(1, 9)}
    added = {r[1]: r[4] for r in rules if not r[4].startswith("rule")}
    assert added == {
        "err-00009": C.RULE_FAILURE % (2, "single_answer:declared_answer_not_judged_correct"),
        "suc-00001": C.RULE_SUCCESS % (2, C.SUCCESS_OTHER),
    }
    # in the prompts of the batches after the one that added them
    book = {n: json.loads(q.split("\n")[1])["playbook"] for role, n, _, q, _ in calls if role == "planner"}
    assert {n for n, text in book.items() if "suc-00001" in text} == set(range(14, 21))
    (note,) = [r for r in records if r["id"] == "PSY-000014"]
    assert [c["bullet_id"] for c in note["a"]["playbook_delta"]] == ["err-00009"]


def test_retries_carry_draft_and_findings(unbroken):
    (records, _), calls = unbroken
    (again,) = [json.loads(q.split("\n")[1]) for role, n, attempt, q, _ in calls if role == "generator" and (n, attempt) == (7, 2)]
    assert json.loads(again["previous"])["question"] == "Which reading fits case 7?"
    assert [(f["judge"], f["issues"]) for f in again["feedback"]] == [("single_answer", ["declared_answer_not_judged_correct"])]
    (truncated,) = {b for role, n, attempt, _, b in calls if role == "generator" and (n, attempt) == (19, 2)}
    assert truncated == max(b for role, *_, b in calls if role == "generator") > 1800
    audit = {json.loads(r)["id"]: json.loads(r)["a"] for r in records}
    assert audit["PSY-000007"]["repair_history"] == [{
        "attempt": 1, "route": "generate",
        "feedback": [{"judge": "single_answer", "issues": ["declared_answer_not_judged_correct"], "feedback": ""}],
    }]
    assert audit["PSY-000008"]["repair_history"] == [] and audit["PSY-000008"]["max_generation_retries"] == 1
    shape = [f["judge"] for f in audit["PSY-000017"]["generation_feedback"]]
    assert shape == ["a03_schema"] and audit["PSY-000017"]["verdict"] == "verified"


def test_stopped_between_and_within_batches(spark, tmp_path, unbroken, monkeypatch):
    run, made = job(spark, tmp_path / "base", tmp_path / "log")
    assert run(batches=1) == 1

    def killed(self, df):
        gated(self, df).count()
        raise KeyboardInterrupt

    def killed_before_commit(self, spark, batch, tables):
        tables["records"].write.parquet(f"{self.folder(batch)}/records")
        raise KeyboardInterrupt

    gated = Builder.gated
    for cls, name, broken in ((Builder, "gated", killed), (BuildJob, "commit", killed_before_commit)):
        with monkeypatch.context() as m:
            m.setattr(cls, name, broken)
            with pytest.raises(KeyboardInterrupt):
                job(spark, tmp_path / "base", tmp_path / "log")[0]()
        assert made.committed(spark) == 1
    run, made = job(spark, tmp_path / "base", tmp_path / "log")
    assert run() == 2 and run() == 2
    assert result(spark, made) == unbroken[0]
    assert sorted(asked(tmp_path / "log")) == sorted(unbroken[1])


def test_half_a_plan_is_asked_for_once_more(spark, tmp_path):
    run, made = job(spark, tmp_path / "base", tmp_path / "log", n=2, size=5, first=100)
    run()
    plans = [json.loads(q.split("\n")[1]) for role, *_, q, _ in asked(tmp_path / "log") if role == "planner"]
    assert sorted((p["number"], len(p.get("missing", []))) for p in plans) == [(100, 0), (100, 5), (101, 0), (101, 5)]
    assert {r["metadata"]["cognitive_skill"] for r in made.records(spark).collect()} == {"recall"}


def test_replies_by_item_and_request(spark, tmp_path):
    log = ReplyLog(spark, str(tmp_path / "replies"))
    rows = [("a", "planner", "q1"), ("b", "planner", "q1"), ("a", "planner", "q2")]

    def ask(todo):
        return todo.select("item_id", "key", "role", F.concat(F.lit("r:"), "request").alias("reply"))

    def table(some):
        return spark.createDataFrame(some, "item_id string, role string, request string")

    assert sorted(r["reply"] for r in log(table(rows[:2]), ask).collect()) == ["r:q1", "r:q1"]
    assert sorted(r["reply"] for r in log(table(rows), lambda t: ask(t).withColumn("reply", F.lit("new"))).collect()) == ["new", "r:q1", "r:q1"]
    assert log(table(rows), lambda t: pytest.fail("asked again")).count() == 3
