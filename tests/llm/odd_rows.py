"""Small tables with nulls, ties, repeated rows, long texts and clashing column names."""

import random

from pyspark.sql import types as T

BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
LONG = " ".join(f"w{k % 977}x{k % 13}" for k in range(6000))
PASSAGE = "a passage of more than fifty bytes that stands in several of the texts, word for word"

TEXTS = [
    (0, BASE), (1, BASE), (2, BASE.upper()), (3, BASE + " more"), (4, None), (5, ""), (6, " \n\t "),
    (7, LONG), (8, LONG + " end"), (9, "x"), (10, "x"), (11, "two words"),
    (12, f"before {PASSAGE} after"), (13, f"{PASSAGE}\nand then"), (14, f"quite other é ü ß {PASSAGE}"),
    (15, "Ünïcödé   text’s  “quoted”\n\nlines\nlines"), (16, "a" * 3000), (17, "ab" * 400), (18, "ab" * 400),
    (None, "a row without an id"), (19, "repeated row"), (19, "repeated row"), (19, "repeated id, other text"),
]

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ("id", "score", "block", "label", "part", "rank", "sid", "kept", "votes")]
)


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, *[7] * 9) for i, t in rows], SCHEMA)


def words(n: int, seed: int) -> list[str]:
    pick = random.Random(seed)
    return ["".join(pick.choice(["an", "er", "the", "ou", "st", "é"]) for _ in range(pick.randint(1, 4))) for _ in range(n)]
