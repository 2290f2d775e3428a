"""Near-duplicate vectors by lattice hashing.

Every table projects unit vectors at random onto ``BLOCKS`` eight-dimensional spaces and takes the
nearest point of the E8 lattice in each. The points together are a vector's cell; taking in some blocks
the best point of the lattice's other coset gives the neighbouring cells that it probes as well.
Vectors that meet in a cell, one of them at home there, are compared by cosine in double precision.

A pair can meet in several cells; it is counted in one: the first table in which either probes the
other's cell, the cell of the smaller id first. So links are counted without a table of pairs: a cell
returns each vector's number of links and one vector that it is connected to. Equal vectors are one from
the start. Cells with more than ``CELL`` rows are cut into parts, and each pair of parts is one group.

Defined results: vectors that are null, empty, zero or hold null or non-finite components have no links
and are their own component. Vectors of different lengths don't link. Repeated ids are rows of their
own with the counts of their vector. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.llm.components import components
from quizmill.llm.shingles import U, mix
from quizmill.storage import materialize

TABLES = 8
BLOCKS = 2
#: Width of the lattice in units of the projected unit vectors.
SCALE = 0.36
CELL = 2_000
SEED = 7


def _half(x: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray]:
    """Nearest point of D8 + ``shift`` and its squared distance."""
    y = x - shift
    near = np.rint(y)
    off = y - near
    odd = near.sum(1).astype(np.int64) & 1 == 1
    worst = np.abs(off).argmax(1)
    rows = np.flatnonzero(odd)
    near[rows, worst[rows]] += np.where(off[rows, worst[rows]] >= 0, 1.0, -1.0)
    return near + shift, ((y - near) ** 2).sum(1)


def e8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest point of the E8 lattice to each row, and the best point of the other coset."""
    (a, da), (b, db) = _half(x, 0.0), _half(x, 0.5)
    first = (da <= db)[:, None]
    return np.where(first, a, b), np.where(first, b, a)


def _name(points: np.ndarray, salt: int) -> np.ndarray:
    out = np.full(len(points), mix(np.array([salt], U))[0], U)
    for c in np.rint(points * 2).astype(np.int64).T:
        out = mix(out + c.astype(U))
    return out


def cells(units: np.ndarray) -> np.ndarray:
    """Of each vector, per table, its own cell and the cells it probes (its own first)."""
    n, d = units.shape
    out = np.zeros((n, TABLES, 2**BLOCKS), U)
    for t in range(TABLES):
        turn = np.random.default_rng([SEED, t, d]).standard_normal((d, 8 * BLOCKS))
        if d >= 8 * BLOCKS:
            turn, _ = np.linalg.qr(turn)
        shift = np.random.default_rng([SEED, t]).uniform(0, 1, 8 * BLOCKS)
        flat = units @ turn / SCALE + shift
        names = []
        for k in range(BLOCKS):
            both = e8(flat[:, 8 * k : 8 * k + 8])
            names.append([_name(p, 1000 * t + k) for p in both])
        for v, pick in enumerate(product((0, 1), repeat=BLOCKS)):
            total = np.full(n, U(d))
            for k, c in enumerate(pick):
                total = mix(total * U(31) + names[k][c])
            out[:, t, v] = total
    return out


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"".join(column.to_pylist()), np.float64)
    x = flat.reshape(len(column), -1)
    return x, x / np.linalg.norm(x, axis=1, keepdims=True)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per table and cell: (cell, table, home, id, copies, vector, cells)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([len(v) for v in batch.column(2).to_pylist()])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            own = batch.take(pa.array(at))
            # the largest component sets the scale, so that no square overflows or vanishes
            x = np.array(own.column(2).to_pylist(), np.float64)
            x = x / np.abs(x).max(1, keepdims=True)
            units = x / np.linalg.norm(x, axis=1, keepdims=True)
            names = cells(units)
            n, per = len(at), TABLES * 2**BLOCKS
            row = np.repeat(np.arange(n), per)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names.reshape(-1).view(np.int64)),
                    pa.array(np.tile(np.repeat(np.arange(TABLES), 2**BLOCKS), n)),
                    pa.array(np.tile(np.arange(2**BLOCKS), TABLES * n) == 0),
                    own.column(0).take(pa.array(row)), own.column(1).take(pa.array(row)),
                    pa.array([v.tobytes() for v in units]).take(pa.array(row)),
                    pa.array([c.tobytes() for c in names]).take(pa.array(row)),
                ],
                names=["cell", "tab", "home", "id", "copies", "unit", "names"],
            )


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index connected to each of ``n`` by the pairs (a, b)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label


def _compare(least: float):
    def run(table: pa.Table) -> pa.Table:
        found_id, found_links, found_root = [], [], []
        cell, sub = table.column("cell").to_numpy(), table.column("sub").to_numpy()
        order = np.lexsort((table.column("id").to_numpy(), sub, cell))
        table = table.take(pa.array(order))
        cell, sub = cell[order], sub[order]
        edge = np.flatnonzero((np.diff(cell, prepend=cell[0] - 1) != 0) | (np.diff(sub, prepend=sub[0] - 1) != 0))
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(cell)], strict=True):
            if b - a < 2:
                continue
            part = table.slice(a, b - a).combine_chunks()
            home = part.column("home").to_numpy()
            if not home.any():
                continue
            ids, copies, tab = part.column("id").to_numpy(), part.column("copies").to_numpy(), int(part.column("tab")[0].as_py())
            side = part.column("side").to_numpy()
            units = np.frombuffer(b"".join(part.column("unit").to_pylist()), np.float64).reshape(b - a, -1)
            names = np.frombuffer(b"".join(part.column("names").to_pylist()), U).reshape(b - a, TABLES, -1)
            mixed = side.any()
            one, two = [], []
            step = max(1, 4_000_000 // (b - a))
            for k in range(0, b - a, step):
                near = units[k : k + step] @ units.T >= least
                near &= home[k : k + step, None] | home[None, :]
                near &= np.arange(b - a)[None, :] > np.arange(k, min(k + step, b - a))[:, None]
                if mixed:
                    near &= side[k : k + step, None] != side[None, :]
                i, j = np.nonzero(near)
                one.append(i + k)
                two.append(j)
            one, two = np.concatenate(one), np.concatenate(two)
            kept = []
            for k in range(0, len(one), 200_000):
                i, j = one[k : k + 200_000], two[k : k + 200_000]
                # i has the smaller id: rows are in the order of ids
                his = (names[i, :, :1] == names[j]).any(2)
                hers = (names[j, :, :1] == names[i]).any(2)
                first = (his | hers).argmax(1) == tab
                here = np.where(his[:, tab], names[i, tab, 0], names[j, tab, 0]) == U(int(cell[a]) & (1 << 64) - 1)
                kept.append(first & here)
            kept = np.concatenate(kept) if kept else np.zeros(0, bool)
            one, two = one[kept], two[kept]
            if not len(one):
                continue
            links = np.bincount(one, copies[two], b - a) + np.bincount(two, copies[one], b - a)
            root = _roots(one, two, b - a)
            at = np.flatnonzero(links)
            found_id.append(ids[at])
            found_links.append(links[at].astype(np.int64))
            found_root.append(ids[root[at]])
        join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
        return pa.table({"id": join(found_id), "links": join(found_links), "root": join(found_root)})

    return run


def near_duplicates(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95
) -> DataFrame:
    """Per row: id, ``n_links``, ``component_id`` and ``kept``."""
    vector = F.col(vector_col).cast("array<double>")
    usable = (
        F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)
        & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(vector, lambda x: x != 0) & F.col(id_col).isNotNull()
    )
    rows = table.select(
        F.col(id_col).cast("bigint").alias("id"), F.when(F.coalesce(usable, F.lit(False)), vector).alias("vector")
    )
    named = rows.withColumn("key", F.when(F.col("vector").isNotNull(), F.sha2(F.to_json(F.struct("vector")), 256)))
    named = materialize(named.select("id", "key", "vector"), "vectors")
    same = materialize(
        named.where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")),
        "distinct_vectors",
    )
    # an id with two different vectors stands for both
    hashed = same.select("rep", "copies", "vector").mapInArrow(
        _hash, "cell long, tab long, home boolean, id long, copies long, unit binary, names binary"
    )
    hashed = materialize(hashed, "cells")
    sizes = hashed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("used"))
    sizes = sizes.where("used and n > 1").select("cell", F.ceil(F.col("n") / CELL).cast("int").alias("parts"))
    cut = hashed.join(sizes, "cell").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # a part meets itself, and every other part once
    spread = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "cell", "tab", "home", "id", "copies", "unit", "names",
        (F.least("own", "with") * F.lit(1 << 20) + F.greatest("own", "with")).alias("sub"),
        F.when(F.col("own") > F.col("with"), 1).otherwise(0).alias("side"),
    )
    parts = max(64, hashed.count() // 20_000)
    found = materialize(
        spread.withColumn("part", F.pmod(F.xxhash64("cell", "sub"), F.lit(parts)))
        .groupBy("part")
        .applyInArrow(_compare(least), "id long, links long, root long"),
        "cell_links",
    )
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    reps = (
        same.select("key", "rep", "copies")
        .join(links.withColumnRenamed("id", "rep"), "rep", "left")
        .join(joined.select(F.col("node").alias("rep"), F.col("component")), "rep", "left")
        .select(
            "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    out = named.select("id", "key").join(reps, "key", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op7_lattice(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


#: All pairs of vectors; what is reached by links.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
u AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS n FROM v
    WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
    WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.95),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
