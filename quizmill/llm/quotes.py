"""Conversations from quotations.

A line that begins with ``>`` marks quotes; the number of marks is its level. What a message says itself
is its lines without marks. Its quoted passages are the runs of level-one lines; deeper levels were
quoted by the quoted message already. Passages and single quoted lines are normalised (small letters,
single spaces, no empty lines), hashed, and joined to the messages that say the same themselves, as a
whole or in a line. A whole passage decides before lines, more matching lines before fewer, the earliest
message before later ones. A message can only reply to one with a smaller id, so replies form trees;
their roots are found by doubling steps, and a conversation's messages are ordered by their distance
from the root, then by id.

Votes count all messages that say a key, without a row for each: messages that say the same keys count as
their earliest. A passage is met by whole messages, which differ in nothing but their lines' ends. A line
that more than ``COMMON`` kinds of messages say is a common one: a message's candidates come from its other
lines, with all their votes; those that it shares common lines only with are told from the distinct sets of
common lines that are said and that are quoted, of which each number of votes keeps its earliest message.
Positions are running sums over ranges, so a conversation may be of any size. DataFrame functions only.

Defined results: a null or empty text is empty and replies to nothing; a message that quotes only what
nobody said begins a conversation. Ids are unique and not null; of rows that repeat an id the least text
stands. An empty table gives an empty result. Columns besides id and text pass through, but for those
named as results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quizmill.operators import ordering
from quizmill.storage import materialize

#: Kinds of messages up to which a line is joined to all of them.
COMMON = 100
MARKS = r"^\s*((?:>\s?)+)"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _own(line: Column) -> Column:
    return F.regexp_replace(line, MARKS, "")


def _level(line: Column) -> Column:
    return F.char_length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), r"[^>]", ""))


def parse(messages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text without quotes, keys said, keys quoted): a key is a hash and whether it is a line's."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    levelled = messages.select(
        F.col(id_col).alias("id"),
        F.transform(lines, lambda x: F.struct(_level(x).alias("level"), _own(x).alias("line"))).alias("lines"),
    )
    # runs of level-one lines, parted by the lines of other levels
    passages = F.filter(
        F.split(
            F.array_join(
                F.transform("lines", lambda x: F.when(x["level"] == 1, F.concat(F.lit("\n"), x["line"])).otherwise(F.lit("\0"))), ""
            ),
            "\0",
        ),
        lambda p: normalised(p) != "",
    )
    said = F.filter("lines", lambda x: x["level"] == 0)
    parsed = levelled.select(
        "id",
        F.trim(F.array_join(F.transform(said, lambda x: x["line"]), "\n")).alias("text"),
        passages.alias("passages"),
    )

    def keys(whole: Column, parts: Column) -> Column:
        hashed = lambda a, line: F.transform(
            F.filter(F.transform(a, normalised), lambda t: t != ""),
            lambda t: F.struct(F.xxhash64(t).alias("hash"), F.sha2(t, 256).alias("exact"), F.lit(line).alias("line")),
        )
        return F.array_distinct(F.concat(hashed(whole, False), hashed(parts, True)))

    return parsed.select(
        "id", "text",
        keys(F.array("text"), F.split("text", "\n")).alias("said"),
        keys(F.col("passages"), F.flatten(F.transform("passages", lambda p: F.split(p, "\n")))).alias("quoted"),
    )


def replies(parsed: DataFrame) -> DataFrame:
    """(id, reply_to) of every message whose quotes are found."""
    exact = lambda c, line: F.array_sort(
        F.transform(F.filter(c, lambda k: k["line"] == line), lambda k: k["exact"])
    )
    # kinds of messages: the earliest of those that say the same passage and lines
    kinds = parsed.where(F.size("said") > 0).select("id", exact("said", False)[0].alias("whole"), exact("said", True).alias("lines"))
    kinds = materialize(kinds.groupBy("whole", "lines").agg(F.min("id").alias("original")), "kinds")
    asked = parsed.where(F.size("quoted") > 0).select("id", exact("quoted", False).alias("passages"), exact("quoted", True).alias("asked"))
    asked = materialize(asked, "asked")

    def best(candidates: DataFrame) -> DataFrame:
        """Of (id, original, votes), the most votes, then the earliest."""
        return candidates.groupBy("id").agg(F.min(F.struct((-F.col("votes")).alias("n"), "original")).alias("best"))

    votes = F.size(F.array_intersect("asked", "lines"))
    by_whole = (
        asked.select("id", "passages", "asked", F.explode("passages").alias("whole"))
        .join(kinds, "whole").where("original < id")
        .select("id", "original", (votes + 1).alias("votes"))
    )
    found = materialize(best(by_whole), "by_passage")
    # what no whole message answers: by lines
    open_ = materialize(asked.join(found.select("id"), "id", "left_anti").select("id", "asked"), "open")
    wanted = open_.select(F.explode("asked").alias("key")).distinct()
    spoken = materialize(
        kinds.select("original", F.explode("lines").alias("key")).join(wanted, "key", "left_semi"), "spoken"
    )
    common = spoken.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > COMMON).select("key")
    common = materialize(common, "common")
    lines = open_.select("id", F.explode("asked").alias("key"))
    rare = (
        lines.join(common, "key", "left_anti").join(spoken.join(common, "key", "left_anti"), "key")
        .where("original < id").select("id", "original").distinct()
    )
    sets = kinds.groupBy("original").agg(F.flatten(F.collect_list("lines")).alias("lines"))
    by_rare = rare.join(open_, "id").join(sets, "original").select("id", "original", votes.alias("votes"))

    def common_sets(keys: DataFrame, name: str) -> DataFrame:
        held = keys.join(common, "key", "left_semi")
        return held.groupBy(name).agg(F.array_sort(F.collect_set("key")).alias("held"))

    heard = materialize(common_sets(lines, "id"), "heard")
    told = common_sets(spoken, "original").groupBy("held").agg(F.min("original").alias("original"))
    told = told.select("original", F.col("held").alias("lines"), F.explode("held").alias("key"))
    pairs = (
        heard.select("held").distinct().select(F.col("held").alias("asked"), F.explode("held").alias("key"))
        .join(told, "key").select("asked", "lines", "original").distinct()
    )
    # of as many votes only the earliest can be earlier than a message
    least = pairs.groupBy("asked", votes.alias("votes")).agg(F.min("original").alias("original"))
    by_common = (
        heard.join(least.withColumnRenamed("asked", "held"), "held").where("original < id").select("id", "original", "votes")
    )
    by_line = best(by_rare.unionByName(by_common))
    return found.unionByName(by_line).select("id", F.col("best.original").alias("reply_to"))


def trees(links: DataFrame) -> DataFrame:
    """(id, root, depth) of every message that replies, in steps that double their length."""
    now = links.select("id", F.col("reply_to").alias("root"), F.lit(1).alias("depth"), F.lit(True).alias("open"))
    now = materialize(now, "trees")
    while now.where("open").head(1):
        up = now.select(F.col("id").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        far = now.where("open").join(up, "root", "left").select(
            "id", F.coalesce("above", "root").alias("root"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("open"),
        )
        # what has met its root is done
        now = materialize(far.unionByName(now.where("NOT open")), "trees")
    return now.select("id", "root", "depth")


def conversations(messages: DataFrame, id_col: str = "message_id", text_col: str = "text") -> DataFrame:
    """Per message: ``conversation`` (its root's id), ``position`` (from 0), ``reply_to`` and the text
    without quotes."""
    results = ("conversation", "position", "reply_to", text_col)
    least = messages.groupBy(id_col).agg(
        F.min(F.struct(*(F.col(c) for c in [text_col, *(c for c in messages.columns if c not in (id_col, *results))]))).alias("row")
    )
    once = least.select(id_col, "row.*")
    parsed = materialize(parse(once, id_col, text_col), "messages")
    links = materialize(replies(parsed), "replies")
    placed = (
        parsed.select("id", "text")
        .join(links, "id", "left")
        .join(trees(links), "id", "left")
        .select(
            "id", F.col("text").alias("said"), "reply_to", F.coalesce("root", "id").alias("conversation"),
            F.coalesce("depth", F.lit(0)).alias("depth"),
        )
    )
    order = ["conversation", "depth", "id"]
    parts = ordering.spread(placed, order, "ordered")
    ranked = ordering.running(parts, ["conversation"], order, F.lit(1), "sum", "position")
    others = once.select(F.col(id_col).alias("id"), *(c for c in once.columns if c not in (id_col, *results)))
    return ranked.join(others, "id").select(
        F.col("id").alias(id_col), "conversation", (F.col("position") - 1).cast("bigint").alias("position"), "reply_to",
        *(c for c in others.columns if c != "id"), F.col("said").alias(text_col),
    )


def quoting(turns: DataFrame) -> DataFrame:
    """The turns as messages that quote: each has the turn before it at level one and the one before
    that at level two; which conversation it is from is left out."""
    step = lambda k: turns.select(
        "conv_id", (F.col("turn") + k).alias("turn"),
        F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("> " * k), x)).alias(f"quote{k}"),
    )
    joined = turns.join(step(1), ["conv_id", "turn"], "left").join(step(2), ["conv_id", "turn"], "left")
    lines = F.concat(
        *(F.coalesce(f"quote{k}", F.array().cast("array<string>")) for k in (2, 1)), F.split(F.coalesce("text", F.lit("")), "\n")
    )
    return joined.select(
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("message_id"), "role", F.array_join(lines, "\n").alias("text")
    )


def op4_quotes(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("conv_id is not null and turn is not null")
    return conversations(quoting(turns))


#: A message replies to the earliest that says what the turn before it says.
SQL = r"""
WITH RECURSIVE m AS (
    SELECT conv_id * 1000000 + turn AS message_id, conv_id, turn, role, trim(coalesce(text, '')) AS text,
        trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS said
    FROM conversations),
f AS (SELECT said, message_id, row_number() OVER (PARTITION BY said ORDER BY message_id) AS k FROM m WHERE said <> ''),
r AS (
    SELECT a.message_id, min(f.message_id) AS reply_to
    FROM m a JOIN m b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1
    JOIN f ON f.said = b.said AND f.k <= 2 AND f.message_id < a.message_id GROUP BY 1),
t AS (
    SELECT message_id, message_id AS conversation, 0 AS depth FROM m WHERE message_id NOT IN (SELECT message_id FROM r)
    UNION ALL
    SELECT r.message_id, t.conversation, t.depth + 1 FROM r JOIN t ON r.reply_to = t.message_id)
SELECT m.message_id, t.conversation,
    row_number() OVER (PARTITION BY t.conversation ORDER BY t.depth, m.message_id) - 1 AS position,
    r.reply_to, m.role, m.text
FROM m JOIN t USING (message_id) LEFT JOIN r USING (message_id)
"""
