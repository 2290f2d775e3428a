"""Similarity join of texts on word shingles by parity sketches.

Two sets with a Jaccard similarity of at least ``NUM`` / 100 differ in at most D elements, D following
from their sizes. In a band of sizes every set is cut into G > D groups by a hash of its elements, and a
group's elements are XOR-ed to one number. An element in only one of two sets changes one group, so the
number of unequal groups bounds the symmetric difference from below: by the pigeonhole at least G - D
groups of a linking pair are equal. Texts that share a group's number in a band are candidates. A text
with so many empty groups that only empty ones might be equal also gives its shingle prefix as keys;
of a pair of that kind both texts do, so no pair is lost.

Candidates are compared by a sketch of single parities, whose Hamming distance is a lower bound too, and
then by the sets themselves. Texts with equal sets are one class from the start. Of the texts that share
a key, each is compared with the first. Where that doesn't join them all, of any two parts of a group the
nearest pairs by sketch are compared, and at last all pairs of different parts that the sketches allow.

Keys travel packed, as runs of numbers per task and bucket; no pair of one group is written twice and
pairs of texts that are already joined are never made. A bucket's runs (about ``BUCKET`` bytes, plus
what one key's texts have) are read by one task.

Defined results: a null text and one without words have no shingle and link with nothing; equal texts
link; repeated ids give one row per input row with the id's common class; null ids are joined to
nothing. Empty tables give empty results. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.llm.components import components
from quizmill.llm.shingles import U, mix, numbers, shingle_sets
from quizmill.storage import materialize

NUM = 80
BITS = 1024
BUCKET = 12_000_000
FLUSH = 4_000_000


def bands(most: int) -> list[tuple[int, int, int, int]]:
    """(least size, greatest size, greatest difference, groups) of every band up to size ``most``."""
    out, low = [], 1
    while low <= most:
        top = max(low, low * 3 // 2)
        above = top * 100 // NUM
        differ = (top + above) * (100 - NUM) // (100 + NUM)
        out.append((low, above, differ, differ + 1 if differ < 1 else differ + 2 + differ // 6))
        low = top + 1
    return out


BANDS = bands(1 << 40)


def keys(items: np.ndarray) -> np.ndarray:
    """The candidate keys of one set."""
    n, out, risky = len(items), [], False
    spread = mix(items + U(7)) >> U(32)
    for k, (low, high, differ, groups) in enumerate(BANDS):
        if low > n:
            break
        if n > high:
            continue
        group = spread % U(groups)
        order = np.argsort(group)
        group = group[order]
        first = np.flatnonzero(np.diff(group, prepend=U(groups + 1)))
        parity = np.bitwise_xor.reduceat(items[order], first)
        out.append(mix(parity + mix(group[first] + U(k << 40) + U(1))))
        own = min(differ, (n + min(high, n * 100 // NUM)) * (100 - NUM) // (100 + NUM))
        risky |= groups - len(first) >= groups - own
    if risky:
        out.append(mix(items[: n - -(-NUM * n // 100) + 1] + U(3 << 60)))
    return np.concatenate(out) if out else np.zeros(0, U)


def identity(items: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    one, two = mix(items + U(11)).sum(dtype=U), np.bitwise_xor.reduce(mix(items + U(13)), initial=U(0))
    return tuple(mix(np.array([one + U(len(items)), two], U)).view(np.int64).tolist())


def sketch(items: np.ndarray) -> bytes:
    """The parities of a set's elements in a power of two of bits, at least as many as elements."""
    bits = max(BITS, 1 << (2 * len(items) + 1).bit_length() - 1)
    places = (items & U(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=bits) & 1 == 1, bitorder="little").tobytes()


class _Sketches:
    """Distances of sketches: the longer of two is folded, which keeps its parities."""

    def __init__(self, column: pa.ChunkedArray | pa.Array):
        raw = column.to_pylist()
        self.size = np.array([len(x) for x in raw], np.int64)
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in np.unique(self.size).tolist():
            own = [np.flatnonzero(self.size == size), np.flatnonzero(self.size == 2 * size)]
            half = size // 8
            same, double = (
                np.frombuffer(b"".join(raw[k] for k in at.tolist()), U).reshape(-1, width)
                for at, width in zip(own, (half, 2 * half), strict=True)
            )
            place = np.full(len(raw), -1)
            place[np.concatenate(own)] = np.arange(len(own[0]) + len(own[1]))
            folded = double[:, :half] ^ double[:, half:] if len(own[1]) else same[:0]
            self.rows[size] = place, np.concatenate([same, folded])

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lower bounds of the symmetric differences of the rows ``i`` and ``j``."""
        out, least = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        for size, (place, rows) in self.rows.items():
            at = np.flatnonzero(least == size)
            # sizes more than a fold apart can't link
            far = np.maximum(self.size[i[at]], self.size[j[at]]) > 2 * size
            out[at[far]] = np.iinfo(np.int32).max
            at = at[~far]
            step = max(1, 16_000_000 // size)
            for k in range(0, len(at), step):
                own = at[k : k + step]
                out[own] = np.bitwise_count(rows[place[i[own]]] ^ rows[place[j[own]]]).sum(1, dtype=np.int64)
        return out


def _texts(column: pa.Array, most: int = 8_000_000) -> Iterator[list[bytes]]:
    """Values (null: empty) in lists of bounded size."""
    held, size = [], 0
    for value in column:
        text = value.as_py() or b""
        held.append(text)
        size += len(text)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    for texts in _texts(column):
        yield from shingle_sets(texts)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(len(s), *(identity(s) if len(s) else (None, None)), sketch(s)) for s in _sets(batch.column(1))]
        if rows:
            n, one, two, bits = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(bits, pa.binary())],
                names=["id", "n_shingles", "sid", "sid2", "sketch"],
            )


def _key_runs(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            every = np.concatenate([k for _, k in held])
            owner = np.repeat(np.arange(len(held)), [len(k) for _, k in held])
            sids = np.array([s for s, _ in held], np.int64)
            bucket = (every % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            every, owner, bucket = every[order], owner[order], bucket[order]
            edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
            runs, names = [], []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own, counts = np.unique(owner[a:b], return_counts=True)
                raw = every[a:b].view(np.uint8).reshape(-1, 8)[:, :6]
                head = np.array([len(own)], np.int64)
                runs.append(b"".join(x.tobytes() for x in (head, sids[own], counts, raw)))
                names.append(int(bucket[a]))
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(runs, pa.binary())], names=["bucket", "run"])

        for batch in batches:
            for items in _sets(batch.column(1)):
                if not len(items):
                    continue
                held.append((identity(items)[0], keys(items)))
                size += len(held[-1][1])
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _share(table: pa.Table) -> pa.Table:
    """Of one bucket: texts that share a key, as pairs with the first, and the groups of three or more."""
    key, sid = [], []
    for value in table.column("run"):
        raw = value.as_buffer()
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        names, counts = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n)
        low = np.frombuffer(raw, np.uint8, -1, 8 + 16 * n).reshape(-1, 6)
        full = np.zeros((len(low), 8), np.uint8)
        full[:, :6] = low
        key.append(full.view(np.int64)[:, 0])
        sid.append(np.repeat(names, counts))
    key, sid = np.concatenate(key), np.concatenate(sid)
    order = np.lexsort((sid, key))
    key, sid = key[order], sid[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
    key, sid = key[fresh], sid[fresh]
    first = np.flatnonzero(np.diff(key, prepend=key[0] - 1)) if len(key) else np.zeros(0, np.int64)
    size = np.diff(first, append=len(key))
    lead = np.repeat(sid[first], size)
    other = np.ones(len(sid), bool)
    other[first] = False
    pairs = np.unique(np.stack([lead[other], sid[other]], 1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    groups, names = [], []
    if len(key):
        name = mix(np.add.reduceat(mix(sid.view(U)), first)).view(np.int64)
        many = np.flatnonzero(size > 2)
        names, at = np.unique(name[many], return_index=True)
        groups = [sid[first[k] : first[k] + size[k]].tobytes() for k in many[at].tolist()]
    none = pa.nulls(len(pairs), pa.binary())
    return pa.table({
        "a": pa.concat_arrays([pa.array(pairs[:, 0]), pa.array(names, pa.int64())]),
        "b": pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(len(groups), pa.int64())]),
        "members": pa.concat_arrays([none, pa.array(groups, pa.binary())]),
    })


def _near(na: np.ndarray, nb: np.ndarray, apart: np.ndarray) -> np.ndarray:
    low, high = np.minimum(na, nb), np.maximum(na, nb)
    return (100 * low >= NUM * high) & (apart * (100 + NUM) <= (na + nb) * (100 - NUM))


def _by_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        na, nb = (batch.column(k).to_numpy() for k in (2, 3))
        rows = _Sketches(pa.concat_arrays([batch.column(4), batch.column(5)]))
        at = np.arange(batch.num_rows)
        near = _near(na, nb, rows.apart(at, at + batch.num_rows))
        yield pa.RecordBatch.from_arrays(
            [c.filter(pa.array(near)) for c in batch.columns[:2]], names=["a", "b"]
        )


def _by_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            one, two = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
            common = len(np.intersect1d(one, two, assume_unique=True))
            near.append(100 * common >= NUM * (len(one) + len(two) - common))
        yield pa.RecordBatch.from_arrays(
            [c.filter(pa.array(near, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"]
        )


def _meetings(table: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    """Of many groups: (sid, sid, part, part, distance) of the texts of a group, in different parts, that
    the sketches don't rule out. Members are compared with those so many places after them, all groups
    at once."""
    name, n = table.column("name").to_numpy(), table.column("n").to_numpy()
    order = np.lexsort((n, name))
    table = table.take(pa.array(order))
    name, n = name[order], n[order]
    sid, part = table.column("sid").to_numpy(), table.column("part").to_numpy()
    sketches = _Sketches(table.column("sketch"))
    at, ends = np.arange(len(name)), np.searchsorted(name, name, side="right")
    step = 1
    while len(at := at[at + step < ends[at]]):
        # sizes rise within a group: once one is too far away, so are the rest
        at = at[100 * n[at] >= NUM * n[at + step]]
        one = at[part[at] != part[at + step]]
        apart = sketches.apart(one, one + step)
        near = _near(n[one], n[one + step], apart)
        i, j = one[near], one[near] + step
        yield sid[i], sid[j], part[i], part[j], apart[near]
        step += 1


def _across(most: int | None):
    """Of many groups: for any two parts the ``most`` pairs that are nearest by sketch (None: all)."""

    def run(table: pa.Table) -> pa.Table:
        found = list(_meetings(table))
        a, b, p, q, apart = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (zip(*found, strict=True) if found else [()] * 5))
        a, b, p, q = np.minimum(a, b), np.maximum(a, b), np.minimum(p, q), np.maximum(p, q)
        _, once = np.unique(np.stack([a, b], 1), axis=0, return_index=True)
        if most is not None and len(once):
            once = once[np.lexsort((apart[once], q[once], p[once]))]
            fresh = np.append(True, (np.diff(p[once]) != 0) | (np.diff(q[once]) != 0))
            first = np.flatnonzero(fresh)
            once = once[np.arange(len(once)) - first[np.cumsum(fresh) - 1] < most]
        return pa.table({"a": a[once], "b": b[once]})

    return run


def _meet(table: pa.Table) -> pa.Table:
    """Of many groups: the texts that some other of their group is near to by sketch."""
    found = [x for pair in _meetings(table) for x in pair[:2]]
    return pa.table({"sid": np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)})


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, n_shingles, the set's identity and its sketch."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(
        _describe, f"id {kind}, n_shingles long, sid long, sid2 long, sketch binary"
    )


def links(docs: DataFrame, seen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) between sets' identities that suffice to join all that are similar enough."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(12, int(size * 0.6) // BUCKET)
    texts = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("text"))
    shared = materialize(
        texts.mapInArrow(_key_runs(buckets), "bucket long, run binary")
        .groupBy("bucket")
        .applyInArrow(_share, "a long, b long, members binary"),
        "shared",
    )
    classes = materialize(
        seen.where(F.col("sid").isNotNull())
        .groupBy("sid")
        .agg(F.min("id").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")),
        "classes",
    )

    def promising(pairs: DataFrame) -> DataFrame:
        one, two = (
            classes.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab"
        )
        found = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb")
        return found.mapInArrow(_by_sketch, "a long, b long")

    pairs = materialize(shared.where(F.col("b").isNotNull()).select("a", "b").distinct(), "pairs")
    groups = shared.where(F.col("members").isNotNull()).groupBy(F.col("a").alias("name")).agg(F.first("members").alias("members"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0), batch.column(1), strict=True):
                own = np.frombuffer(raw.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(own)), pa.array(own)], names=["name", "sid"])

    near = materialize(promising(pairs), "pairs")
    listed = materialize(groups.mapInArrow(members, "name long, sid long"), "members")
    sketches = classes.select("sid", "n", "sketch")
    lots = max(64, listed.count() // 20_000)
    lot = F.pmod(F.xxhash64("name"), F.lit(lots)).alias("lot")  # some groups for one call
    meeting = (
        listed.withColumn("part", F.col("sid")).join(sketches, "sid").groupBy(lot).applyInArrow(_meet, "sid long")
    )
    # every text that may be compared
    wanted = near.select(F.explode(F.array("a", "b")).alias("sid")).union(meeting).distinct()
    wanted = wanted.join(classes, "sid").select("sid", F.col("id").alias(id_col))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # an id may stand for several texts
            names = batch.column(0).to_pylist()
            sets = [(n, s.tobytes()) for n, s in zip(names, _sets(batch.column(1)), strict=True) if identity(s)[0] == n]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in sets], pa.int64()), pa.array([s for _, s in sets], pa.binary())], names=["sid", "items"]
            )

    sets = materialize(
        # as many rows as there are near copies: never broadcast
        texts.join(wanted.hint("shuffle_merge"), id_col).select("sid", "text").mapInArrow(collect, "sid long, items binary"), "sets"
    )

    def verified(candidates: DataFrame) -> DataFrame:
        placed = sets.repartition("sid")  # one exchange for both joins
        one, two = (placed.select(F.col("sid").alias(c), F.col("items").alias(f"s{c}")) for c in "ab")
        both = candidates.join(one, "a").join(two, "b").select("a", "b", "sa", "sb")
        return materialize(both.mapInArrow(_by_sets, "a long, b long"), "links")

    found, compared = verified(near), near
    # first the nearest of any two parts of a group, then all that are still in different parts
    for most in (4, None):
        parts = components(found)
        placed = listed.join(parts.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn(
            "part", F.coalesce("component", "sid")
        )
        placed = materialize(placed.select("name", "sid", "part"), "members")
        still = placed.groupBy("name").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y")
        rest = (
            placed.join(still.select("name"), "name", "left_semi")
            .join(sketches, "sid")
            .groupBy(lot)
            .applyInArrow(_across(most), "a long, b long")
            .distinct()
        )
        rest = materialize(rest.join(compared, ["a", "b"], "left_anti"), "more")
        found = materialize(found.union(verified(rest)), "links")
        compared = compared.union(rest)
    return found


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_shingles`` and ``component_id``, the smallest id of the row's class."""
    seen = materialize(describe(docs, id_col, text_col), "seen")
    linked = components(links(docs, seen, id_col, text_col))
    labels = seen.join(linked.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn(
        "label", F.coalesce("component", "sid")
    )
    labels = materialize(labels.select("id", "n_shingles", "label", "sid2", F.col("component").isNotNull().alias("linked")), "labels")
    # an unlinked set's class is told by all 128 bits
    key = ["label", F.when(~F.col("linked"), F.col("sid2")).alias("also")]
    least = labels.where(F.col("label").isNotNull()).groupBy(*key).agg(F.min("id").alias("component_id"))
    joined = labels.withColumn("also", F.when(~F.col("linked"), F.col("sid2"))).join(
        least.withColumnRenamed("label", "l").withColumnRenamed("also", "o"),
        (F.col("label") == F.col("l")) & F.col("also").eqNullSafe(F.col("o")),
        "left",
    )
    return joined.select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id")
    )


def op10_jaccard(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: All pairs that share a shingle; what is reached by links.
SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS x FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(x) >= 5 THEN list_transform(range(1, len(x) - 3), lambda i: array_to_string(x[i:i + 4], ' '))
    WHEN len(x) > 0 THEN [array_to_string(x, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
"""
