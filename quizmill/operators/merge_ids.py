"""Unique record ids over merged files: the first holder keeps its id, a later one gets the
next free number.

Which numbers end up taken does not depend on the order of arrival: sorted by wanted number,
record i gets ``max over j <= i of (wanted_j - j) + i``. Only who gets which number does, and
only inside a run of adjacent numbers wanted by different ids. Small mixed runs are replayed
each in one task. Large ones are halved by arrival again and again: the earlier half's numbers
have the same closed form, the later half gets the rest, until each part is small.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.operators.ordering import PART, running, spread
from quizmill.storage import materialize

GROUP_ROWS = 200_000
MAX_DIGITS = 18

ARRIVAL = ["file", "line"]
CHAIN = ["prefix", "chain"]
RUN = [*CHAIN, "run"]


def _first_fit(rows: pd.DataFrame) -> pd.DataFrame:
    """Arrival order within one bounded group: at each free place the earliest waiting row wins."""
    rows = rows.sort_values(["want", *ARRIVAL], kind="stable").reset_index(drop=True)
    want = rows["want"].tolist()
    arrived = rows[ARRIVAL].apply(tuple, axis=1).tolist()
    place, waiting, i, at = [0] * len(rows), [], 0, 0
    while i < len(rows) or waiting:
        if not waiting:
            at = max(at, want[i])
        while i < len(rows) and want[i] <= at:
            heapq.heappush(waiting, (arrived[i], i))
            i += 1
        place[heapq.heappop(waiting)[1]] = at
        at += 1
    return rows.assign(place=place)


def _replay(items: DataFrame, keys: list[str]) -> DataFrame:
    """``place`` for items with ``want``, group by group."""
    cols = [*keys, *ARRIVAL, "want"]
    types = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in cols) + ", place bigint"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _first_fit(rows)[[*cols, "place"]]

    return items.select(*cols).groupBy(*keys).applyInPandas(run, schema)


def _closed_form(items: DataFrame, chain: list[str], name: str) -> DataFrame:
    """``place`` by the closed form, exact as a set of places per chain."""
    parts = spread(items, [*chain, "want", *ARRIVAL], name)
    order = ["want", *ARRIVAL]
    counted = materialize(running(parts, chain, order, F.lit(1), "sum", "r"), name)
    based = running(counted, chain, order, F.col("want") - F.col("r"), "max", "base")
    return based.withColumn("place", F.col("base") + F.col("r")).drop("base", "r")


def _split_large(items: DataFrame, rows: int) -> DataFrame:
    """Places for runs too large for one group. ``items``: RUN, ARRIVAL, want, place."""
    ranked = running(
        spread(items, [*RUN, *ARRIVAL], "large"), RUN, ARRIVAL, F.lit(1), "sum", "at"
    ).drop(PART)
    ranked = materialize(
        ranked.withColumn("part", F.floor((F.col("at") - 1) / rows).cast("bigint")), "large"
    )
    bits = int(ranked.agg(F.max("part")).first()[0]).bit_length()
    seg = [*RUN, "seg"]
    slots = ranked.select(
        *RUN, F.lit(0).cast("bigint").alias("seg"), (F.col("place") - F.col("run")).alias("pos"), "place"
    )
    left = ranked.select(
        *RUN, *ARRIVAL, "part", F.lit(0).cast("bigint").alias("seg"), (F.col("want") - F.col("run")).alias("want")
    )
    for bit in reversed(range(bits)):
        half = F.shiftright("part", bit).bitwiseAND(F.lit(1))
        early = _closed_form(left.where(half == 0), seg, "early")
        taken = early.select(*seg, F.col("place").alias("pos"), F.lit(1).alias("mark"))
        marked = slots.join(taken, [*seg, "pos"], "left").withColumn("mark", F.coalesce("mark", F.lit(0)))
        counted = running(spread(marked, [*seg, "pos"], "slots"), seg, ["pos"], F.col("mark"), "sum", "c").drop(PART)
        counted = materialize(counted.withColumn("c", F.col("c") - F.col("mark")), "slots")
        left = materialize(
            left.join(
                counted.select(*seg, F.col("pos").alias("want"), "c"), [*seg, "want"]
            ).select(
                *RUN, *ARRIVAL, "part", (F.col("seg") * 2 + half).alias("seg"),
                F.when(half == 0, F.col("c")).otherwise(F.col("want") - F.col("c")).alias("want"),
            ),
            "left",
        )
        slots = counted.select(
            *RUN, (F.col("seg") * 2 + 1 - F.col("mark")).alias("seg"),
            F.when(F.col("mark") == 1, F.col("c")).otherwise(F.col("pos") - F.col("c")).alias("pos"), "place",
        )
    placed = _replay(left, seg).withColumnRenamed("place", "pos")
    return placed.join(slots, [*seg, "pos"]).select(*RUN, *ARRIVAL, "place")


def _solve(items: DataFrame, rows: int) -> DataFrame:
    """(prefix, chain, file, line, place) for chains of plain consecutive numbers."""
    placed = materialize(_closed_form(items, CHAIN, "places"), "places")
    # A run starts where a record gets just the number it wants.
    start = F.when(F.col("place") == F.col("want"), F.col("want"))
    runs = materialize(running(placed, CHAIN, ["want", *ARRIVAL], start, "max", "run").drop(PART), "runs")
    sizes = runs.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("n"), F.min("want").alias("low"), F.max("want").alias("high")
    ).where("low < high").select(*RUN, (F.col("n") > rows).alias("large"))
    out = [*CHAIN, *ARRIVAL, "place"]
    mixed = materialize(runs.join(sizes, RUN), "mixed")
    done = runs.join(sizes, RUN, "left_anti").select(*out)
    done = done.unionByName(_replay(mixed.where("NOT large"), RUN).select(*out))
    large = mixed.where("large").drop("large")
    if not large.isEmpty():
        done = done.unionByName(_split_large(large, rows).select(*out))
    return materialize(done, "solved")


def merge_unique_ids(df: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``df`` (id, file, line, ...) with unique ids and ``old_id``.

    Numbers with leading zeros keep their width; past the last number of a width they go on
    without zeros, where they meet the ids that are written without.
    """
    pattern = r"(?s)^(.*?)(\d+)$"
    digits = F.regexp_extract("id", pattern, 2)
    bad = ~F.coalesce(F.col("id").rlike(pattern), F.lit(False)) | (F.length(digits) > MAX_DIGITS)
    number = F.when(
        bad, F.raise_error(F.concat(F.lit("Record id must end in 1 to 18 digits: "), F.coalesce("id", F.lit("null")))).cast("bigint")
    ).otherwise(digits.try_cast("bigint"))
    padded = digits.startswith("0") & (F.length(digits) > 1)
    items = materialize(
        df.select(
            F.regexp_extract("id", pattern, 1).alias("prefix"),
            F.when(padded, F.length(digits)).otherwise(0).alias("chain"),
            number.alias("want"), *ARRIVAL,
        ),
        "ids",
    )
    plain = items.where("chain = 0")
    zeros = items.where("chain > 0")
    solved = None
    if not zeros.isEmpty():
        first = _solve(zeros, group_rows)
        limit = F.pow(F.lit(10.0), F.col("chain") - 1).cast("bigint")
        solved = first.where(F.col("place") < limit)
        plain = plain.unionByName(
            first.where(F.col("place") >= limit).select(
                "prefix", F.lit(0).alias("chain"), limit.alias("want"), *ARRIVAL
            )
        )
    rest = _solve(plain, group_rows)
    solved = rest if solved is None else solved.unionByName(rest)
    text = F.col("place").cast("string")
    new_id = F.concat(
        "prefix", F.when(F.col("chain") > 0, F.lpad(text, F.col("chain"), F.lit("0"))).otherwise(text)
    )
    return df.withColumnRenamed("id", "old_id").join(
        solved.select(*ARRIVAL, new_id.alias("id")), ARRIVAL
    )
