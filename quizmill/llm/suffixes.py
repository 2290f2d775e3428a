"""Removal of repeated passages by a distributed merge sort of suffixes that knows common prefixes.

A byte is removed if some string of ``LENGTH`` bytes over it also starts in a text with a smaller id.

Which suffixes are sorted: every string of ``LENGTH`` bytes holds the same least-hashed string of
``ANCHOR`` bytes wherever it stands, so repeats meet at these anchors, about one in thirteen positions.
A first exchange of 48-bit hashes drops the anchors that stand in one text only; a wrong match of
hashes only lets an anchor through.

What is left is sorted: for each anchor, the ``LENGTH`` bytes from it on, followed by the bytes before it
in reverse. Each block of texts sorts its own, keeps equal ones once with their smallest id, and sends
front-coded runs (length of the prefix shared with the one before, and the rest) to the buckets of
their anchors. A bucket merges its runs with a tournament of losers in which every loser remembers how
long a prefix it shares with its winner: longer prefixes win unread, and comparisons begin where the
known prefix ends. Where a group of suffixes with one anchor holds different ones, the
strings of ``LENGTH`` bytes over the anchor are compared too. Back goes, per block, which strings over
which suffix also start in a text with a smaller id than the block's own.

All exchanges are of packed runs; texts are shuffled once, into blocks by a hash of the id, and that
exchange is used by every pass.

Defined results: ids are integers; a null id stands after all others; a null text is empty; equal ids
don't remove from each other. Empty and short texts lose nothing. Only the id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizmill.llm.shingles import LETTERS, U, mix, numbers

LENGTH = 50
ANCHOR = 24
SPAN = LENGTH - ANCHOR  # bytes that can stand before an anchor in one string
WIDTH = LENGTH + SPAN
NONE = 0xFF  # stands for bytes beyond a text's ends; never in UTF-8
BLOCK = 4_000_000
CHUNK = 150_000
BUCKET = 12_000_000
LAST = np.iinfo(np.int64).max


def _fold(x: np.ndarray, n: int, op) -> np.ndarray:
    """``op`` over every ``n`` consecutive items."""
    have, out = 1, x
    while have < n:
        step = min(have, n - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, text, place in the buffer, 48-bit hash) of every anchor of ``texts``.

    The buffer holds the texts one after the other, each between ``LENGTH`` bytes of ``NONE``.
    """
    gap = bytes([NONE]) * LENGTH
    data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    hashes = LETTERS[data]
    for step in (1, 2, 4):  # strings of 2, 4 and 8 bytes
        hashes = hashes[:-step] * FACTORS[step] + hashes[step:]
    hashes = (hashes[:-16] * FACTORS[8] + hashes[8:-8]) * FACTORS[16] + hashes[16:]
    hashes = mix(hashes)
    # 32 bits choose; equal ones of a string are all taken
    rank = (hashes >> U(32)).astype(np.uint32) | np.uint32(1)
    reach = LENGTH - ANCHOR
    window = _fold(rank, reach + 1, np.minimum)
    # strings of LENGTH bytes wholly inside a text
    outside = np.flatnonzero(data == NONE)
    least = window[: len(data) - LENGTH + 1].copy()
    cover = np.zeros(len(data) + 1, np.int32)
    np.add.at(cover, np.maximum(outside - LENGTH + 1, 0), 1)
    np.add.at(cover, outside + 1, -1)
    least[np.cumsum(cover)[: len(least)] > 0] = 0
    padded = np.concatenate([np.zeros(reach, np.uint32), least, np.zeros(reach, np.uint32)])
    most = _fold(padded, reach + 1, np.maximum)[: len(rank)]
    at = np.flatnonzero(rank[: len(most)] == most)
    starts = np.cumsum([LENGTH + len(t) for t in texts])
    return data, np.searchsorted(starts, at, side="right"), at, mix(hashes[at] + U(5)) & U((1 << 48) - 1)


FACTORS = numbers(32, 21)


def _ordered(table: pa.Table) -> pa.Table:
    keys = [("id", "ascending"), ("text", "ascending")]
    return table.take(pc.sort_indices(table, sort_keys=keys)) if table.num_rows else table


def _chunks(table: pa.Table):
    """(ids, texts) of bounded size, in an order that doesn't depend on the exchange."""
    table = _ordered(table)
    ids, texts, size = [], [], 0
    for name, text in zip(table.column("id"), table.column("text"), strict=True):
        raw = text.as_py() or b""
        ids.append(LAST if name.as_py() is None else name.as_py())
        texts.append(raw)
        size += len(raw)
        if size >= CHUNK:
            yield np.array(ids, np.int64), texts
            ids, texts, size = [], [], 0
    if ids:
        yield np.array(ids, np.int64), texts


def _pack6(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack6(raw) -> np.ndarray:
    low = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    full = np.zeros((len(low), 8), np.uint8)
    full[:, :6] = low
    return full.view(np.int64)[:, 0]


def _rows(block: int, buckets: list[int], runs: list[bytes], kind: int = 0) -> pa.Table:
    n = len(buckets)
    return pa.table({
        "block": pa.array([block] * n, pa.int64()), "bucket": pa.array(buckets, pa.int64()),
        "kind": pa.array([kind] * n, pa.int64()), "run": pa.array(runs, pa.binary()),
    })


ROWS = "block long, bucket long, kind long, run binary"


def _announce(buckets: int):
    """Of a block of texts: the hashes of its anchors, those of several texts after the others."""

    def run(table: pa.Table) -> pa.Table:
        names, hashes, before = [], [], 0
        for ids, texts in _chunks(table):
            _, owner, _, mark = anchors(texts)
            names.append(owner + before)
            hashes.append(mark.astype(np.int64))
            before += len(ids)
        owner, mark = np.concatenate(names), np.concatenate(hashes)
        order = np.lexsort((owner, mark))
        owner, mark = owner[order], mark[order]
        first = np.flatnonzero(np.diff(mark, prepend=-1))
        several = np.maximum.reduceat(owner, first) != owner[first] if len(first) else np.zeros(0, bool)
        mark = mark[first]
        bucket, out, at = mark % buckets, [], []
        for b in np.unique(bucket).tolist():
            own = bucket == b
            one, more = mark[own & ~several], mark[own & several]
            out.append(np.int64(len(one)).tobytes() + _pack6(np.concatenate([one, more])))
            at.append(b)
        return _rows(table.column("block")[0].as_py(), at, out)

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Of a bucket: for every block, its hashes that stand in several texts."""
    blocks = table.column("block").to_pylist()
    marks, several = [], []
    for raw in table.column("run"):
        raw = raw.as_buffer()
        one = int(np.frombuffer(raw, np.int64, 1)[0])
        own = _unpack6(raw.slice(8))
        marks.append(own)
        several.append(np.arange(len(own)) >= one)
    every = np.concatenate(marks)
    order = np.argsort(every)
    ranked = every[order]
    again = np.zeros(len(every), bool)
    again[1:] = ranked[1:] == ranked[:-1]
    again |= np.concatenate(several)[order]
    # all of an equal run, if one of it is marked
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    again = np.repeat(np.logical_or.reduceat(again, first), np.diff(first, append=len(ranked)))
    repeated = np.empty(len(every), bool)
    repeated[order] = again
    where, out, begin = [], [], 0
    for block, own in zip(blocks, marks, strict=True):
        kept = own[repeated[begin : begin + len(own)]]
        begin += len(own)
        if len(kept):
            where.append(block)
            out.append(_pack6(kept))
    n = len(where)
    return pa.table({
        "block": pa.array(where, pa.int64()), "bucket": pa.array([0] * n, pa.int64()),
        "kind": pa.array([0] * n, pa.int64()), "run": pa.array(out, pa.binary()),
    })


class _Suffixes:
    """The suffixes at a block's shared anchors, sorted, equal ones once."""

    def __init__(self, docs: pa.Table, shared: pa.Table, buckets: int):
        runs = [_unpack6(r.as_buffer()) for r, k in zip(shared.column("run"), shared.column("kind").to_pylist(), strict=True) if k == 0]
        marks = np.sort(np.concatenate(runs)) if runs else np.zeros(0, np.int64)
        columns, names, owners, places, heads, before = [], [], [], [], [], 0
        right, left = np.arange(LENGTH), -1 - np.arange(SPAN)
        for ids, texts in _chunks(docs):
            data, owner, at, mark = anchors(texts)
            mark = mark.astype(np.int64)
            found = np.searchsorted(marks, mark)
            known = np.zeros(len(mark), bool)
            inside = found < len(marks)
            known[inside] = marks[found[inside]] == mark[inside]
            owner, at, mark = owner[known], at[known], mark[known]
            # bytes after a text's end, and before its beginning, are NONE
            ahead, behind = data[at[:, None] + right], data[at[:, None] + left]
            for side in (ahead, behind):
                beyond = np.logical_or.accumulate(side == NONE, axis=1)
                side[beyond] = NONE
            columns.append(np.concatenate([ahead, behind], 1))
            starts = np.cumsum([0] + [LENGTH + len(t) for t in texts[:-1]]) + LENGTH
            names.append(ids[owner])
            owners.append(owner + before)
            places.append(at - starts[owner])
            heads.append(mark % buckets)
            before += len(ids)
        self.n_texts = before
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        names, self.owner, self.place = join(names, np.int64), join(owners, np.int64), join(places, np.int64)
        matrix = np.concatenate(columns) if columns else np.zeros((0, WIDTH), np.uint8)
        bucket = join(heads, np.int64)
        # bucket first, then the bytes, in one key
        keyed = np.concatenate([bucket.astype(">u4").view(np.uint8).reshape(-1, 4), matrix], 1)
        order = np.argsort(np.ascontiguousarray(keyed).view(f"V{WIDTH + 4}")[:, 0].view(f"S{WIDTH + 4}"), kind="stable")
        keyed, names = keyed[order], names[order]
        self.owner, self.place = self.owner[order], self.place[order]
        n = len(keyed)
        differ = np.ones(n, bool)
        differ[1:] = (keyed[1:] != keyed[:-1]).any(1)
        first = np.flatnonzero(differ)
        self.entry = np.cumsum(differ) - 1
        self.least = np.minimum.reduceat(names, first) if n else names
        self.name = names
        self.matrix, self.bucket = keyed[first, 4:], bucket[order][first]

    def spans(self):
        """(bucket, first entry, end) of each run."""
        first = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        return zip(self.bucket[first].tolist(), first.tolist(), [*first[1:].tolist(), len(self.bucket)], strict=True) if len(first) else ()


def front_code(matrix: np.ndarray, least: np.ndarray) -> bytes:
    """A sorted run: its length, per suffix the prefix shared with the one before, the smallest ids, and
    the rests of the suffixes."""
    shared = np.zeros(len(matrix), np.uint8)
    shared[1:] = (matrix[1:] != matrix[:-1]).argmax(1)
    rest = matrix[np.arange(WIDTH) >= shared[:, None]]
    head = np.int64(len(matrix)).tobytes() + least.astype("<i8").tobytes() + shared.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + rest.tobytes())


class Run:
    """A front-coded run, read one suffix at a time."""

    __slots__ = ("least", "shared", "rest", "at", "place", "now", "n")

    def __init__(self, raw: bytes):
        raw = zstandard.ZstdDecompressor().decompress(raw)
        self.n = n = int(np.frombuffer(raw, np.int64, 1)[0])
        self.least = np.frombuffer(raw, "<i8", n, 8)
        self.shared = raw[8 + 8 * n : 8 + 9 * n]
        self.rest, self.at, self.place, self.now = raw, -1, 8 + 9 * n, b""

    def step(self) -> int:
        """To the next suffix; the prefix it shares with the one before, or -1 at the end."""
        self.at += 1
        if self.at >= self.n:
            return -1
        shared = self.shared[self.at]
        end = self.place + WIDTH - shared
        self.now = self.now[:shared] + self.rest[self.place : end]
        self.place = end
        return shared


def merge(runs: list[Run]) -> tuple[list[int], list[int], list[int], list[bytes]]:
    """All suffixes in order: run, place in it, prefix shared with the one before, and the bytes.

    A tournament of losers: each node keeps the loser and the length of the prefix that it shares with
    the winner that passed it. A candidate that shares more with the last output than another is
    smaller, unread; only at equal lengths are bytes compared, from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    known = [r.step() for r in runs] + [-1] * (size - len(runs))
    lost = [-1] * (2 * size)
    win = list(range(size))
    texts = [r.now for r in runs] + [b""] * (size - len(runs))

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes that with the winner."""
        ha, hb = known[a], known[b]
        if ha != hb:
            return (a, b) if ha > hb else (b, a)
        if ha < 0:
            return a, b
        x, y = texts[a], texts[b]
        if x == y:
            known[b] = WIDTH
            return a, b
        while x[ha] == y[ha]:
            ha += 1
        if x[ha] < y[ha]:
            known[b] = ha
            return a, b
        known[a] = ha
        return b, a

    level = size
    while level > 1:
        half = level // 2
        nxt = []
        for k in range(half):
            w, loser = play(win[2 * k], win[2 * k + 1])
            lost[half + k] = loser
            nxt.append(w)
        win, level = nxt, half
    best = win[0]
    out_run, out_at, out_shared, out_text = [], [], [], []
    while known[best] >= 0:
        run = runs[best]
        out_run.append(best)
        out_at.append(run.at)
        out_shared.append(known[best])
        out_text.append(texts[best])
        known[best] = run.step()
        texts[best] = run.now
        node, w = (size + best) // 2, best
        while node:
            rival = lost[node]
            hw, hr = known[w], known[rival]
            if hw < hr:
                lost[node], w = w, rival
            elif hw == hr and hw >= 0:
                x, y = texts[w], texts[rival]
                if x == y:
                    known[rival] = WIDTH
                else:
                    while x[hw] == y[hw]:
                        hw += 1
                    if x[hw] < y[hw]:
                        known[rival] = hw
                    else:
                        known[w] = hw
                        lost[node], w = w, rival
            node //= 2
        best = w
    return out_run, out_at, out_shared, out_text


RIGHT, LEFT = numbers(LENGTH, 31), numbers(SPAN, 37)


def earlier(matrix: np.ndarray, shared: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each sorted suffix a mask: bit j says that the string which begins j bytes before its anchor
    also starts in a text with a smaller id than ``least``."""
    n = len(matrix)
    group = np.cumsum(shared < ANCHOR)
    same = np.cumsum(shared < WIDTH) - 1  # number of the distinct suffix
    first = np.flatnonzero(shared < WIDTH)
    lowest = np.minimum.reduceat(least, first)
    distinct, own = matrix[first], group[first]
    room = (distinct != NONE).cumprod(1, dtype=np.uint8)
    ahead = room[:, :LENGTH].sum(1, dtype=np.int64)
    behind = (distinct[:, LENGTH:] != NONE).sum(1, dtype=np.int64)
    low = np.repeat(lowest[:, None], SPAN + 1, 1)
    mixed = np.flatnonzero(np.bincount(own)[own] > 1)
    step = 200_000
    begin = 0
    while begin < len(mixed):
        # whole groups at a time
        end = min(len(mixed), begin + step)
        while end < len(mixed) and own[mixed[end]] == own[mixed[end - 1]]:
            end += 1
        rows = mixed[begin:end]
        begin = end
        right = np.cumsum(LETTERS[distinct[rows, :LENGTH]] * RIGHT, axis=1, dtype=U)
        left = np.cumsum(LETTERS[distinct[rows, LENGTH:]] * LEFT, axis=1, dtype=U)
        tag = mix(own[rows].astype(U))
        for j in range(SPAN + 1):
            fits = np.flatnonzero((behind[rows] >= j) & (ahead[rows] >= LENGTH - j))
            if not len(fits):
                continue
            name = mix(right[fits, LENGTH - j - 1] + (left[fits, j - 1] if j else U(0)) + tag[fits])
            order = np.argsort(name, kind="stable")
            head = np.flatnonzero(np.diff(name[order], prepend=name[order][0] - U(1)))
            value = np.minimum.reduceat(low[rows[fits], j][order], head)
            low[rows[fits[order]], j] = np.repeat(value, np.diff(head, append=len(order)))
    smaller = low[same] < least[:, None]
    bits = np.zeros(n, np.int64)
    for j in range(SPAN + 1):
        bits |= smaller[:, j].astype(np.int64) << j
    return bits


def _sort_runs(buckets: int):
    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        if not docs.num_rows or not shared.num_rows:
            return _rows(0, [], [])
        own = _Suffixes(docs, shared, buckets)
        at, out = [], []
        for bucket, a, b in own.spans():
            at.append(bucket)
            out.append(front_code(own.matrix[a:b], own.least[a:b]))
        return _rows(docs.column("block")[0].as_py(), at, out)

    return run


def _merge_bucket(table: pa.Table) -> pa.Table:
    bucket, blocks = table.column("bucket")[0].as_py(), table.column("block").to_pylist()
    runs = [Run(r.as_py()) for r in table.column("run")]
    order, place, shared, texts = merge(runs)
    order, place = np.array(order), np.array(place)
    matrix = np.frombuffer(b"".join(texts), np.uint8).reshape(-1, WIDTH)
    least = np.zeros(len(order), np.int64)
    for k, r in enumerate(runs):
        own = order == k
        least[own] = r.least[place[own]]
    masks = earlier(matrix, np.array(shared, np.int64), least)
    out = []
    for k, r in enumerate(runs):
        mask = np.zeros(r.n, "<u4")
        own = order == k
        mask[place[own]] = masks[own]
        out.append(zstandard.ZstdCompressor(level=1).compress(mask.tobytes()))
    return pa.table({
        "block": pa.array(blocks, pa.int64()), "bucket": pa.array([bucket] * len(blocks), pa.int64()),
        "kind": pa.array([1] * len(blocks), pa.int64()), "run": pa.array(out, pa.binary()),
    })


def _cut(buckets: int, whole: bool):
    """``whole``: with the texts and spans."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        docs = _ordered(docs)
        names, spans = [], []
        own = _Suffixes(docs, found, buckets) if found.num_rows else None
        starts: dict[int, np.ndarray] = {}
        if own is not None and len(own.entry):
            masks = np.zeros(len(own.bucket), np.int64)
            by = {b: (x, y) for b, x, y in own.spans()}
            for kind, bucket, raw in zip(*(found.column(c).to_pylist() for c in ("kind", "bucket", "run")), strict=True):
                if kind == 1:
                    x, y = by[bucket]
                    masks[x:y] = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<u4")
            every = (1 << (SPAN + 1)) - 1
            bits = np.where(own.name > own.least[own.entry], every, masks[own.entry])
            hit = np.flatnonzero(bits)
            marks, texts, place = bits[hit], own.owner[hit], own.place[hit]
            ahead = (own.matrix[own.entry[hit], :LENGTH] != NONE).sum(1)
            # strings that fit into the text begin so many bytes before the anchor
            few, many = np.maximum(0, LENGTH - ahead), np.minimum(SPAN, place)
            full = (marks == every) & (few <= many)
            names.append(texts[full])
            spans.append(np.stack([(place - many)[full], (place - few)[full] + LENGTH], 1))
            for j in range(SPAN + 1):
                got = np.flatnonzero(~full & (marks >> j & 1 == 1) & (few <= j) & (many >= j))
                names.append(texts[got])
                spans.append(np.stack([place[got] - j, place[got] - j + LENGTH], 1))
            texts, begins = np.concatenate(names), np.concatenate(spans)
            order = np.argsort(texts, kind="stable")
            texts, begins = texts[order], begins[order]
            first = np.flatnonzero(np.diff(texts, prepend=-1))
            starts = {
                int(texts[a]): begins[a:b] for a, b in zip(first.tolist(), [*first[1:].tolist(), len(texts)][: len(first)], strict=True)
            }
        rows, at = [], 0
        for ids, texts in _chunks(docs):
            for name, text in zip(ids.tolist(), texts, strict=True):
                if at in starts:
                    low, high = (np.bincount(x, minlength=len(text) + 1) for x in starts[at].T)
                    gone = np.cumsum(low - high)[:-1] > 0
                else:
                    gone = np.zeros(0, bool)
                runs = np.diff(gone.astype(np.int8), prepend=0, append=0)
                a, b = np.flatnonzero(runs == 1).tolist(), np.flatnonzero(runs == -1).tolist()
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if a else text
                rows.append((None if name == LAST else name, len(text), len(text) - len(kept), len(a),
                             hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if whole else "",
                             list(zip(a, b, strict=True)) if whole else []))
                at += 1
        cols = list(zip(*rows, strict=True)) if rows else [()] * 7
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        out = {
            "id": pa.array(cols[0], pa.int64()), "n_bytes": pa.array(cols[1], pa.int64()),
            "n_removed": pa.array(cols[2], pa.int64()), "n_spans": pa.array(cols[3], pa.int64()),
            "kept_sha256": pa.array(cols[4], pa.string()),
        }
        if whole:
            out["text"] = pa.array(cols[5], pa.string())
            out["spans"] = pa.array([[{"start": x, "end": y} for x, y in s] for s in cols[6]], span)
            out["rest"] = docs.column("rest")
        return pa.table(out)

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = True
) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, and with ``whole`` the text that is left (a
    character that was cut in two goes), the ``spans`` removed (in bytes) and ``rest``, all columns but
    the id and text as one."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(48, size // BLOCK)
    buckets = max(24, int(size * 0.5) // BUCKET)
    others = [F.col(c) for c in docs.columns if c not in (id_col, text_col)] or [F.lit(None).cast("int").alias("none")]
    texts = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"),
        F.pmod(F.xxhash64(F.col(id_col).cast("bigint")), F.lit(blocks)).alias("block"),
        *([F.struct(*others).alias("rest")] if whole else []),
    ).repartition(blocks, "block")
    shared = (
        texts.groupBy("block").applyInArrow(_announce(buckets), ROWS).groupBy("bucket").applyInArrow(_shared, ROWS)
    )
    runs = texts.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_sort_runs(buckets), ROWS)
    masks = runs.groupBy("bucket").applyInArrow(_merge_bucket, ROWS)
    found = shared.union(masks)
    schema = T.StructType(
        [T.StructField("id", T.LongType())]
        + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
        + [T.StructField("kept_sha256", T.StringType())]
    )
    if whole:
        span = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "end")])
        schema = schema.add("text", T.StringType()).add("spans", T.ArrayType(span)).add(texts.schema["rest"])
    out = texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_cut(buckets, whole), schema)
    return out.withColumnRenamed("id", id_col)


def op6_suffixes(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, whole=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Every 50-byte string of every text, as hex digits, with the smallest document that it starts in.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, (length(h) // 2)::BIGINT AS n_bytes FROM d),
w AS (SELECT doc_id, p, hash(substr(h, 2 * p + 1, 100)) AS x, substr(h, 2 * p + 1, 100) AS s
    FROM (SELECT doc_id, h, unnest(range(0, n_bytes - 49)) AS p FROM n WHERE n_bytes >= 50)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
g AS (SELECT doc_id, p FROM w JOIN f USING (s) WHERE first < doc_id),
o AS (SELECT doc_id, p, max(p + 50) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g),
r AS (SELECT doc_id, p, sum(CASE WHEN reach IS NULL OR p > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM o),
k AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM r GROUP BY doc_id, run),
c AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM k),
e AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM c JOIN n USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM n LEFT JOIN e USING (doc_id)
"""
