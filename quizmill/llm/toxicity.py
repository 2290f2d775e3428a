"""Toxic passages by maximum-scoring segments.

Every word gets a score: its log-odds in toxic against clean labelled texts, under a Dirichlet prior
whose mean is the score of the word's longest known beginning, and so on down to all words together. A
word that was never seen is judged by its beginning. Words without significant odds cost ``GAP``.

A linear scan finds all maximal scoring segments of a text (Ruzzo and Tompa). A segment of score S in n
words is expected K n exp(-lambda S) times by chance; lambda and K are estimated from clean texts. The
significant segments of a text are added up, and a logistic curve turns the sum into a probability.

The model is fitted on about ``SAMPLE`` labelled texts, picked by a hash of their id; scoring covers
every text whole. Defined results: a null, empty or wordless text has no segment and the smallest
score; equal texts get equal scores; repeated rows stay; with no labelled text of either class every
score is 0. Columns that clash with results are replaced, others pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizmill.storage import materialize

#: Labelled texts that the model is fitted on, about; fewer if there are fewer.
SAMPLE = 40_000
#: Score of a word without significant odds.
GAP = -0.5
#: Weight of the prior in words; standard errors that odds must be away from the prior; fewest counts.
MASS, SIGMAS, LEAST = 2.0, 4.0, 4
#: Lengths of word beginnings.
HEADS = (3, 4, 5, 6, 7)
#: Chance occurrences below which a segment is significant.
EXPECTED = 0.5
WORDS = re.compile(r"[^\W\d_]+").findall
PLACES = re.compile(r"[^\W\d_]+").finditer


@dataclass
class Model:
    odds: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    k: float = 1.0
    bias: float = -50.0
    slope: float = 0.0


class _Scores(dict):
    """Score of each word met so far."""

    def __init__(self, odds: dict[str, float]):
        self.odds = odds

    def __missing__(self, word: str) -> float:
        odds = self.odds
        found = odds.get(word + " ")
        for n in reversed(HEADS):
            if found is not None:
                break
            if len(word) >= n:
                found = odds.get(word[:n])
        self[word] = found = GAP if found is None else found
        return found


def segments(scores: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence that is ``GAP`` but for ``scores`` (place, score).

    (first place, last place, score), in linear time: runs of gaps are added in one step.
    """
    found: list[list[float]] = []  # first, last, sum before, sum after
    links: list[int] = []  # for each, the nearest earlier one with a smaller sum before
    total, at = 0.0, 0
    for place, score in scores:
        total += GAP * (place - at)
        at = place + 1
        if score <= 0:
            total += score
            continue
        new = [place, place, total, total + score]
        total += score
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = links[j]
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                links.append(j)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:], links[j:]
    return [(int(a), int(b), high - low) for a, b, low, high in found]


class Scanner:
    def __init__(self, model: Model, limit: int = 400_000):
        self.model, self.limit, self.scores = model, limit, _Scores(model.odds)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words and all maximal segments."""
        if len(self.scores) > self.limit:
            self.scores.clear()
        words = WORDS((text or "").lower())
        scored = np.fromiter(map(self.scores.__getitem__, words), float, len(words))
        places = np.flatnonzero(scored != GAP)
        return len(words), segments(list(zip(places.tolist(), scored[places].tolist(), strict=True)))

    def weigh(self, n: int, found: list[tuple[int, int, float]]) -> tuple[float, list]:
        """Sum of the significant segments' scores above chance, and those segments."""
        m = self.model
        kept = []
        for first, last, score in found:
            expected = m.k * n * math.exp(-min(700.0, m.rate * score))
            if expected < EXPECTED:
                kept.append((first, last, score, expected))
        return sum(-math.log(e + 1e-300) for *_, e in kept), kept

    def probability(self, weight: float) -> float:
        x = self.model.bias + self.model.slope * math.log1p(weight)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, sample: int) -> DataFrame:
    """(text, toxic) of about ``sample`` labelled texts, equal texts once."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull())
    n = usable.count()
    share = min(1.0, sample / max(1, n))
    picked = usable.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(share * (1 << 30)))
    picked = picked.groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    # about ``sample`` rows of an id and a label, whatever the size of the corpus
    found = docs.select(id_col, "text").join(F.broadcast(picked), id_col)
    return found.groupBy("text").agg(F.max("toxic").alias("toxic"))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many clean and toxic texts each word is."""
    sums = (Counter(), Counter())

    def take() -> pa.RecordBatch:
        names = list(sums[0].keys() | sums[1].keys())
        out = [pa.array(names, pa.string()), *(pa.array([s[x] for x in names], pa.int64()) for s in sums)]
        for s in sums:
            s.clear()
        return pa.RecordBatch.from_arrays(out, names=["word", "clean", "toxic"])

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
            sums[1 if toxic.as_py() == 1 else 0].update(set(WORDS((text.as_py() or "").lower())))
        if len(sums[0]) + len(sums[1]) > 500_000:
            yield take()
    yield take()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """The model of ``labels`` (id, toxic); ids, languages and sources are never looked at."""
    texts = materialize(labelled(docs, labels, id_col, sample), "toxic_sample")
    sizes = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sum(n for k, n in sizes.items() if k != 1)
    if not toxic or not clean:
        return Model()
    words = materialize(
        texts.mapInArrow(_words, "word string, clean long, toxic long")
        .groupBy("word")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")),
        "toxic_words",
    )
    # a beginning is judged by how many words share it, so no frequent word decides for it
    heads = (
        words.select(F.explode(F.array(*map(F.lit, HEADS))).alias("h"), "word", "clean", "toxic")
        .where(F.char_length("word") >= F.col("h"))
        .groupBy(F.substring("word", F.lit(1), F.col("h")).alias("word"))
        .agg(*(F.sum(F.least(F.col(c), F.lit(2))).alias(c) for c in ("clean", "toxic")))
    )
    # of the words of the bounded sample, those often enough to matter
    often = (F.col("toxic") >= LEAST) | (F.col("clean") >= 20 * LEAST)
    found = {r.word + " ": (r.toxic, r.clean) for r in words.where(often).collect()}
    found |= {r.word: (r.toxic, r.clean) for r in heads.where(F.col("toxic") >= LEAST).collect()}
    caps = words.agg(*(F.sum(F.least(F.col(c), F.lit(2))) for c in ("clean", "toxic"))).first()
    model = Model(odds=_odds(found, toxic / (toxic + clean), caps[1] / (caps[0] + caps[1])))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model)
        for batch in batches:
            out = [scanner.scan(t.as_py()) for t in batch.column(0)]
            tops = [[s for *_, s in found] for _, found in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).cast(pa.int64()), pa.array([n for n, _ in out], pa.int64()),
                 pa.array(tops, pa.list_(pa.float64()))], names=["toxic", "n", "scores"],
            )

    # three numbers or a few more per text of the bounded sample
    seen = texts.mapInArrow(scan, "toxic long, n long, scores array<double>").collect()
    clean = [r for r in seen if r.toxic != 1 and r.n]
    # exponential tail of chance segments: rate and K of the extreme-value law
    chance = np.array([s for r in clean for s in r.scores])
    model.rate = min(1.0, 1 / max(0.5, float(chance.mean()))) if len(chance) else 1.0
    most = np.array([max(r.scores, default=0.0) for r in clean])
    size = np.array([r.n for r in clean], float)
    if len(clean):
        model.k = len(clean) / float((size * np.exp(-model.rate * most)).sum())
    scanner = Scanner(model)
    x = np.array([scanner.weigh(r.n, [(0, 0, s) for s in r.scores])[0] for r in seen])
    model.bias, model.slope = _logistic(np.log1p(x), np.array([float(r.toxic == 1) for r in seen]))
    return model


def _odds(counts: dict[str, tuple[int, int]], base: float, heads: float) -> dict[str, float]:
    """Log-odds of the words (with a space at the end) and beginnings that differ from what their
    longest kept beginning says. ``base`` and ``heads``: the toxic share over all words and over all
    beginnings."""
    out: dict[str, float] = {}
    longest: dict[str, int] = {}  # most toxic words of a beginning that share a longer one
    for feature, (t, _) in counts.items():
        if not feature.endswith(" "):
            for h in HEADS:
                if h < len(feature):
                    longest[feature[:h]] = max(longest.get(feature[:h], 0), t)

    def parent(feature: str) -> str | None:
        word = feature.rstrip(" ")
        top = len(word) if feature.endswith(" ") else len(word) - 1
        return next((word[:h] for h in reversed(HEADS) if h <= top and word[:h] in out), None)

    for feature in sorted(counts, key=lambda f: (f.endswith(" "), len(f), f)):
        t, c = counts[feature]
        if longest.get(feature, 0) > 0.8 * t:
            continue  # its longer beginning says it better
        above = out.get(parent(feature), 0.0)
        own = base if feature.endswith(" ") else heads
        prior = 1 / (1 + math.exp(-above) * (1 - own) / own)
        share = (t + MASS * prior) / (t + c + MASS)
        shift = math.log(share / (1 - share)) - math.log(prior / (1 - prior))
        error = math.sqrt(1 / (t + MASS * prior) + 1 / (c + MASS * (1 - prior)))
        sure = abs(shift) > SIGMAS * error
        if above > 0:
            # under a toxic beginning, a word that is often enough speaks for itself
            sure = sure or (feature.endswith(" ") and t + c >= 2 * LEAST)
        elif above + shift < 1:
            sure = False
        if sure:
            out[feature] = above + shift
    return {f: v if v > 1 else GAP for f, v in out.items()}


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (not below 0), by Newton's method with a little ridge."""
    data, w = np.stack([np.ones(len(x)), x], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(data @ w, -30, 30)))
        hess = (data * (p * (1 - p))[:, None]).T @ data + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, data.T @ (y - p) - 1e-2 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), max(0.0, float(w[1]))


def score(docs: DataFrame, model: Model, text_col: str = "text", passages: bool = True) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and, unless left out, ``passages``: significant segments as
    (start, end) in code points of the lower-cased text, their score and chance occurrences."""
    names = ("score", "passages")
    kept = [f for f in docs.schema.fields if f.name not in names]
    spans = T.ArrayType(
        T.StructType([T.StructField(c, T.LongType()) for c in ("start", "end")]
                     + [T.StructField(c, T.DoubleType()) for c in ("score", "expected")])
    )
    schema = T.StructType(
        [*kept, T.StructField("score", T.DoubleType())] + [T.StructField("passages", spans)] * passages
    )
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])
    inputs = docs.select(*(f.name for f in kept), F.col(text_col).alias("_scanned_"))
    last = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model)
        for batch in batches:
            scores, found = [], []
            for value in batch.column(last):
                text = value.as_py()
                weight, own = scanner.weigh(*scanner.scan(text))
                scores.append(scanner.probability(weight) if model.slope else 0.0)
                if passages:
                    at = [m.span() for m in PLACES((text or "").lower())] if own else []
                    found.append([
                        {"start": at[a][0], "end": at[b][1], "score": s, "expected": e} for a, b, s, e in own
                    ])
            columns = [*batch.columns[:last], pa.array(scores, pa.float64())]
            if passages:
                columns.append(pa.array(found, pa.list_(span)))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return inputs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0


def fit_folds(spark, docs: DataFrame, sf_dir: str) -> Model:
    """The model of the labels outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return fit(docs, labels.where(~held_out()))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_folds(spark, docs, sf_dir)
    scored = score(docs.select("doc_id", "text"), model, passages=False)
    return scored.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
