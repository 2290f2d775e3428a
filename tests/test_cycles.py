"""Cycles of the usage log next to their SQL."""

import duckdb

import __spark_entry__ as entry


def test_an_event_half_a_second_before_a_boundary(spark, tmp_path):
    """Seconds are rounded to the nearest one, halves to the even one, before they make a cycle."""
    duckdb.sql(f"COPY (SELECT i::BIGINT AS item_id, 'rule ' || i AS text FROM range(41) t(i)) TO '{tmp_path}/benchmark.parquet'")
    duckdb.sql(f"""COPY (SELECT i::BIGINT AS event_id, (TIMESTAMP '2024-01-01' + to_microseconds(
        (21600000000 * (1 + 6 * (i // 40) + i % 3) - [400000, 500000, 600000, 1500000][i % 4 + 1])::BIGINT)) AS ts,
      (i % 40)::BIGINT AS user_id, 'view' AS event_type, 1.0 AS value, '' AS props FROM range(240) t(i)) TO '{tmp_path}/events.parquet'""")
    found = entry.queries()["W06_prune_unused"](spark, str(tmp_path))
    got = sorted(tuple(r) for r in found.select("bullet_id", "dropped_at", "unused_cycles").collect())
    con = duckdb.connect()
    for name in ("benchmark", "events"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = con.sql(f"SELECT bullet_id, dropped_at, unused_cycles FROM ({entry.oracle_sql()['W06_prune_unused']})").fetchall()
    assert len(got) > 3 and got == sorted(want)
