"""Prefix trie of conversations by collapsing whole sequences.

Every turn is a digest of its role and text, mixed with its place. The exclusive-or over a conversation's
turns names its whole sequence, so identical conversations become one weighted sequence by aggregation
alone, with the list of those that end there. Only one conversation of each sequence then gives its
prefixes, each named by the running exclusive-or. Sequences whose end is an inner prefix of another are
dropped by anti-join; the rest are the leaves. Nodes are the prefixes with their weights summed.

Sums over subtrees need no walk. A node's bytes over all members are the weighted rests of the sequences
through it. Its bytes over distinct nodes are summed over the owners of the nodes: a node belongs to its
least sequence, so a sequence owns the lower end of its path, from one depth on.

Conversations of any length and groups of any size spread over tasks: turns are numbered and prefixes run
by range, joins are plain ones that Spark may split, and lists of ends are hashed as a stream.

Defined results: rows without a conv_id belong to no conversation. Turns are ordered by ``turn``, null
first, equal ones by the MD5 of role and text. A null role or text is an empty one. A conversation that is
rebuilt without turns is a member of the root alone. An empty table has no nodes. Other columns are not
read. ``conv_id % 5`` has the sign of ``conv_id``, as in SQL.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizmill.llm.chains import run_along
from quizmill.storage import materialize

#: Prefix turns are taken from the conversation whose id is the next lower multiple of ``FAMILY``; there
#: are crc32(id) % ``HEADS`` of them.
FAMILY, HEADS = 5, 9
#: Bytes of ids in one row of a list of ends.
PIECE = 1 << 16
KEY = ["depth", "x", "y"]


def turns(talks: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, a, b, size): numbered turns, each as 120 bits of its digest and its text's bytes."""
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = talks.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv"), F.col(turn).alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.octet_length(text).cast("bigint").alias("size"),
    ).select(
        "conv", "turn", *(F.conv(F.substring("digest", at, 15), 16, 10).cast("bigint").alias(c) for at, c in ((1, "a"), (16, "b"))),
        "size", F.lit(1).cast("bigint").alias("pos"), F.monotonically_increasing_id().alias("tie"),
    )
    numbered = run_along(rows, "conv", [F.col("turn").asc_nulls_first(), "a", "b", "tie"], {"pos": "sum"}, "turns")
    return numbered.select("conv", "pos", "a", "b", "size")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations with their number of turns, their turns) after taking the first turns of each
    family's first conversation."""
    own = turns.groupBy("conv").agg(F.max("pos").alias("n")).select(
        "conv", "n", (F.col("conv") - F.col("conv") % FAMILY).alias("first"),
        (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).alias("h"),
    )
    own = materialize(own, "conversations")
    firsts = own.select(F.col("conv").alias("first"), F.col("n").alias("has"))
    taken = F.least("h", F.coalesce("has", F.lit(0)))
    convs = materialize(
        own.join(firsts, "first", "left").select(
            "conv", "first", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")
        ),
        "rebuilt",
    )
    rest = turns.join(convs, "conv").where("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    heads = turns.where((F.col("pos") < HEADS) & (F.col("conv") % FAMILY == 0)).withColumnRenamed("conv", "first")
    heads = heads.join(convs, "first").where("pos <= h")
    return convs, heads.select("conv", "pos", "a", "b", "size").union(rest.select("conv", "pos", "a", "b", "size"))


def _ends_in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, x, y, conv) to (depth, x, y, at, ids): ids of one key, comma after each."""
    names = [*KEY, "at", "ids"]
    key, at, held, size = None, 0, [], 0
    rows: list[tuple] = []
    for batch in batches:
        for *now, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != key or size >= PIECE:
                if held:
                    rows.append((*key, at, ",".join(held) + ","))
                key, at, held, size = now, conv, [], 0
            held.append(str(conv))
            size += len(held[-1]) + 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
            rows = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, at, ",".join(held) + ",")], names=names)


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [*KEY, "ends"]
    key, state, comma = None, hashlib.sha256(), b""
    for batch in batches:
        rows: list[tuple] = []
        for *now, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != key:
                if key is not None:
                    rows.append((*key, state.hexdigest()))
                key, state, comma = now, hashlib.sha256(), b""
            state.update(comma + ids[:-1].encode())
            comma = b","
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, state.hexdigest())], names=names)


def hashed_ends(whole: DataFrame) -> DataFrame:
    """(depth, x, y, ends): SHA-256 of the ascending ids that end at each key. Ids are sorted by range
    and joined in pieces of bounded size, which one task reads in order."""
    keys = T.StructType([T.StructField(c, T.LongType()) for c in KEY])
    rows = whole.select(*KEY, "conv").repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv")
    pieces = rows.mapInArrow(
        _ends_in_pieces, T.StructType([*keys, T.StructField("at", T.LongType()), T.StructField("ids", T.StringType())])
    )
    ordered = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "at")
    return ordered.mapInArrow(_hash_pieces, T.StructType([*keys, T.StructField("ends", T.StringType())]))


def nodes(convs: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """The trie's nodes of ``convs`` (conv, length) with the turns ``rebuilt`` (conv, pos, a, b, size)."""
    long = F.lit(0).cast("bigint")
    placed = materialize(
        rebuilt.select(
            "conv", "pos", "size",
            *(F.xxhash64(F.lit(k), "pos", "a", "b").alias(c) for k, c in ((1, "x"), (2, "y"))),
        ),
        "placed",
    )
    whole = materialize(
        placed.groupBy("conv")
        .agg(F.count(F.lit(1)).alias("depth"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("size").alias("total"))
        .union(convs.where("length = 0").select("conv", *(long.alias(c) for c in (*KEY, "total")))),
        "whole",
    )
    sequences = materialize(
        whole.groupBy(*KEY).agg(F.count(F.lit(1)).alias("weight"), F.min("conv").alias("conv"), F.max("total").alias("total")),
        "sequences",
    )
    one = placed.join(sequences.select("conv", "weight", "total", F.col("depth").alias("length")), "conv")
    running = run_along(
        one.select("*", F.col("x").alias("own_x"), F.col("y").alias("own_y"), F.col("size").alias("upto")),
        "conv", ["pos"], {"x": "xor", "y": "xor", "upto": "sum"}, "prefixes",
    )
    root = sequences.select(
        "conv", long.alias("depth"), long.alias("x"), long.alias("y"), F.lit(None).cast("bigint").alias("px"),
        F.lit(None).cast("bigint").alias("py"), long.alias("before"), "weight", "total", F.col("depth").alias("length"),
    )
    prefixes = running.select(
        "conv", F.col("pos").alias("depth"), "x", "y", F.col("x").bitwiseXOR(F.col("own_x")).alias("px"),
        F.col("y").bitwiseXOR(F.col("own_y")).alias("py"), (F.col("upto") - F.col("size")).alias("before"), "weight", "total", "length",
    ).union(root)

    first = materialize(
        prefixes.groupBy(*KEY).agg(
            F.min("conv").alias("conv"), F.max("before").alias("before"), F.max(F.col("length") > F.col("depth")).alias("inner")
        ),
        "first_nodes",
    )
    owned = first.groupBy("conv").agg(F.min("depth").alias("owns"), F.min("before").alias("owned_before"))
    leaves = sequences.join(first.where("inner"), KEY, "left_anti").select("conv", F.lit(1).alias("leaf"))
    scores = sequences.select("conv").join(owned, "conv", "left").join(leaves, "conv", "left")
    scored = prefixes.join(materialize(scores, "scores"), "conv")
    distinct = F.when(F.col("owns").isNull(), 0).otherwise(
        F.col("total") - F.when(F.col("depth") >= F.col("owns"), F.col("before")).otherwise(F.col("owned_before"))
    )
    found = materialize(
        scored.groupBy(*KEY).agg(
            F.min("conv").alias("conv_id"), F.max("px").alias("px"), F.max("py").alias("py"), F.sum("weight").alias("n_convs"),
            F.coalesce(F.sum("leaf"), F.lit(0)).alias("n_leaves"),
            F.sum(F.col("weight") * (F.col("total") - F.col("before")) - distinct).alias("saved_tokens"),
        ),
        "nodes",
    )
    above = [(F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")]
    children = found.where("depth > 0").select(*above).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    parents = found.select(
        (F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id")
    )
    full = found.join(children, KEY, "left").join(hashed_ends(whole), KEY, "left")
    return materialize(full, "full_nodes").join(parents, ["depth", "px", "py"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
        "saved_tokens", F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op12_trie(spark, sf_dir: str) -> DataFrame:
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return nodes(*rebuild(turns(talks)))


#: Nodes as joined digests of their turns; subtrees by cutting every node's key at every depth.
SQL = f"""
WITH o AS (SELECT conv_id, d, b, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS pos
    FROM (SELECT conv_id, turn, strlen(coalesce(text, '')) AS b, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS d
        FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % {FAMILY} AS f, xor(4294967295::BIGINT, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
        lambda v, s: list_reduce(list_prepend(xor(v, s), range(8)), lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::BIGINT) ELSE r // 2 END)
    )) % {HEADS} AS h FROM o GROUP BY conv_id),
r AS (SELECT c.conv_id, o.pos, d, b FROM c JOIN o ON o.conv_id = c.f AND o.pos <= c.h
    UNION ALL SELECT c.conv_id, o.pos - c.h + least(c.h, coalesce(e.n, 0)), d, b
    FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h LEFT JOIN c AS e ON e.conv_id = c.f),
p AS (SELECT conv_id, pos AS depth, string_agg(d, '') OVER w AS key, b FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
    UNION ALL SELECT conv_id, 0, '', 0 FROM c),
n AS (SELECT depth, key, left(key, 32 * depth - 32) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, max(b) AS b FROM p GROUP BY depth, key),
k AS (SELECT depth - 1 AS depth, up AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
s AS (SELECT cut AS depth, left(key, 32 * cut) AS key, sum((n_convs - 1) * b) AS saved, count(*) FILTER (n_children IS NULL) AS n_leaves
    FROM (SELECT n.*, n_children, unnest(range(0, n.depth + 1)) AS cut FROM n LEFT JOIN k USING (depth, key)) GROUP BY ALL),
e AS (SELECT depth, key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends
    FROM p WHERE depth = (SELECT max(q.depth) FROM p AS q WHERE q.conv_id = p.conv_id) GROUP BY depth, key)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
    n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM n JOIN s USING (depth, key) LEFT JOIN k USING (depth, key) LEFT JOIN e USING (depth, key) LEFT JOIN n AS u ON u.depth = n.depth - 1 AND u.key = n.up
"""
