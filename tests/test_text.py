"""White space, fences and dealt words on odd texts."""

import time

import pytest
from pyspark.sql import functions as F

from quizmill.catalog import views as V
from quizmill.functions import text as X

ODD = [None, "", " ", "\n", "a", " a", "a\n", " a ", "\u0085a b\u2028", "\x1fa\x1f", "\u3000", "a \n b", " \t", "`a`", "\u1ea5\u2003"]
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def test_blank_and_strip(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "i int, t string").select("i", X.blank(F.col("t")).alias("b"), X.strip(F.col("t")).alias("s"))
    got = {r["i"]: (r["b"], r["s"]) for r in rows.collect()}
    assert got == {i: (t is None or not t.strip(SPACE), None if t is None else t.strip(SPACE)) for i, t in enumerate(ODD)}


@pytest.mark.parametrize("reply, n", [
    ('```json\n{"n": 1}\n```', 1), ('``` {"n": 1}', 1), (' {"n": 1}```\n', 1), ('so: {"n": 1} ', 1), ('{"n": 1}', 1), ("``````", None),
    ('```json```{"n": 1}``` ', 1), ("[1]", None), (" ", None), (None, None),
])
def test_reply_without_its_fences(spark, reply, n):
    df = spark.createDataFrame([(reply,)], "reply string")
    row = X.with_json_object(df, "reply", "o").select(F.try_variant_get("o", "$.n", "int").alias("n")).first()
    assert row["n"] == n


def test_long_run_of_spaces_inside_a_reply(spark):
    began = time.time()
    got = spark.range(1).select(F.length(X.strip(F.concat(F.lit("{"), F.repeat(F.lit(" "), F.lit(400_000)), F.lit("} ")))).alias("n"))
    assert got.first()["n"] == 400_002
    assert time.time() - began < 20


def test_words_dealt_to_options(spark):
    texts = [None, "", "a", "a  b", " ".join(str(i) for i in range(41)), "a b c d e f g", "a b c "]
    df = spark.createDataFrame([(i, t) for i in range(-4, 5) for t in texts], "doc_id bigint, text string")
    df = df.selectExpr("*", "split(text, ' ') AS words")
    for k in range(4):
        plain = f"array_join(filter(words, (x, i) -> least(i % (4 + doc_id % 3), 3) = {k}), ' ')"
        assert df.where(f"NOT ({V._option(k)} <=> {plain})").count() == 0
        assert "filter(" not in V._option(k)  # no look at every word for each option
