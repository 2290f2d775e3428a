"""Unique ids against the plain sequential replay."""

import random
import re

import pytest

from quizmill.operators.merge_ids import merge_unique_ids


def replay(rows):
    """(file, line) -> id, one record after the other."""
    used, out = set(), {}
    for file, line, rid in sorted(rows):
        prefix, digits = re.fullmatch(r"(?s)(.*?)(\d+)", rid).groups()
        n = int(digits)
        while f"{prefix}{n:0{len(digits)}d}" in used:
            n += 1
        out[file, line] = f"{prefix}{n:0{len(digits)}d}"
        used.add(out[file, line])
    return out


def run(spark, rows, group_rows):
    df = spark.createDataFrame(rows, "file string, line bigint, id string")
    got = merge_unique_ids(df, group_rows=group_rows).collect()
    assert len(got) == len(rows)
    assert len({r["id"] for r in got}) == len(rows)
    assert {(r["file"], r["line"]): r["id"] for r in got} == replay(rows)


def cases(seed, n_cases, size, numbers, widths=(6,)):
    rng, rows, line = random.Random(seed), [], 0
    for case in range(n_cases):
        for _ in range(rng.randint(1, size)):
            line += 1
            n, w = rng.randint(0, numbers), rng.choice(widths)
            rows.append((f"f{rng.randint(0, 3)}", line, f"C{case}x-{n:0{w}d}"))
    return rows


def test_random_prefixes(spark):
    run(spark, cases(1, 60, 40, 25), 1000)


def test_large_runs_are_halved(spark):
    """Groups of three rows at most, so every mixed run takes the path for large ones."""
    run(spark, cases(2, 12, 60, 20), 3)


def test_hot_id(spark):
    rng = random.Random(3)
    rows = [("a", i, "P-000010" if rng.random() < 0.5 else f"P-{rng.randint(0, 60):06d}") for i in range(150)]
    run(spark, rows, 8)


def test_widths_meet(spark):
    """Short widths run over into the ids without leading zeros."""
    run(spark, cases(4, 15, 40, 12, widths=(1, 2, 3)), 1000)
    rows = [("a", i, rid) for i, rid in enumerate(["X-09", "X-09", "X-10", "X-9", "X-9", "X-10", "X-09"])]
    run(spark, rows, 1000)


def test_id_without_number_stops(spark):
    df = spark.createDataFrame([("a", 1, "PSY-x")], "file string, line bigint, id string")
    with pytest.raises(Exception, match="must end in"):
        merge_unique_ids(df).collect()
