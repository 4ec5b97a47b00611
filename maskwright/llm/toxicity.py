"""Toxic passages by maximum-scoring segments over token log-odds.

Training compares the words of toxic and other labelled documents (distinct texts, a word once in each) by log-odds with an informative Dirichlet
prior (the words' shares of the sample) and keeps those whose odds differ clearly. A text's tokens get their log-odds less a drift, so
that ordinary text scores below zero; one linear scan finds every maximal scoring segment. Segment scores are calibrated
by extreme-value theory: lambda solves the moment equation of the scores of untoxic text, K follows from the best segments
of untoxic documents; a segment counts where its expected number in a text of that length is small. The evidence of a
text's significant segments, through a logistic curve fitted on the same sample, is its score.

Training reads a bounded sample: about SAMPLE_ROWS labelled rows by hash of doc_id; it collects at most VOCABULARY words
and two numbers for each sampled row. Prediction reads nothing but the text.

Defined results: null and empty texts, and texts without words, have the score of a text without evidence. A document with
several labels counts as toxic if any is. Without both labels in the sample every score is the share of toxic rows (0 if
there are none). Repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_rows, table
from .langid import part_of

#: Labelled rows that fitting reads, about.
SAMPLE_ROWS = 20_000
#: Words kept, least occurrences, and least standard errors between the classes.
VOCABULARY, LEAST_COUNT, LEAST_Z = 20_000, 5, 3.0
#: Share of the sample's words that the prior is worth, and what each token loses.
PRIOR, DRIFT = 0.0025, 0.5
#: Expected number of segments as good in a text as long, below which a segment is significant.
SIGNIFICANT = 0.05
#: Score from which a document is predicted toxic.
TOXIC_FROM = 0.7

WORD = re.compile(r"[^\W\d_]+")
EULER = 0.5772156649015329


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of scores, end exclusive, in linear time."""
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum left of it, sum at its end
    below: list[int] = []  # for each, the nearest segment to the left whose left sum is smaller, or -1
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, left, right = i, i + 1, float(sums[i]), float(sums[i + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = below[j]
            if j < 0 or stack[j][3] >= right:
                stack.append((start, end, left, right))
                below.append(j)
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:], below[j:]
    return [(a, b, r - x) for a, b, x, r in stack]


@dataclass
class Model:
    odds: dict[str, float]
    rate: float = 1.0  #: lambda
    log_k: float = 0.0
    curve: tuple[float, float, float] = (-30.0, 0.0, 0.0)

    def scores(self, text: str) -> np.ndarray:
        get = self.odds.get
        return np.array([get(w, 0.0) for w in words(text)]) - DRIFT

    def passages(self, text: str) -> list[tuple[int, int, float]]:
        """Significant segments (first word, end, normalised score)."""
        s = self.scores(text)
        if not len(s):
            return []
        floor = -math.log(SIGNIFICANT)
        shift = self.log_k + math.log(len(s))
        return [(a, b, x) for a, b, v in segments(s) if (x := self.rate * v - shift) >= floor]

    def evidence(self, text: str | None) -> tuple[float, float]:
        found = [x for *_, x in self.passages(text or "")]
        return math.log1p(max(found, default=0.0)), math.log1p(sum(found))

    def score(self, text: str | None) -> float:
        a, b, c = self.curve
        x, y = self.evidence(text)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * x + c * y))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Weights of a logistic curve, constant first, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        penalty = ridge * np.eye(len(w))
        penalty[0, 0] = 1e-6
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def rate_of(values: np.ndarray, weight: np.ndarray) -> float:
    """lambda > 0 with sum of weight * exp(lambda * value) = 1, for values of negative mean."""
    weight = weight / weight.sum()
    if values.max(initial=-1) <= 0 or (values * weight).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    f = lambda t: float((weight * np.exp(np.minimum(t * values, 700))).sum())
    while f(high) < 1:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 1 else (low, mid)
    return high


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Model from docs(doc_id, text) and labels(doc_id, toxic)."""
    docs = docs.select("doc_id", "text")
    labelled = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    fraction = min(1.0, sample_rows / max(1, labelled.count()))
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < int(fraction * (1 << 20))).limit(2 * sample_rows)
    rows = cut(docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic"))  # the sample bounds what is sent and written
    distinct = rows.groupBy("text").agg(F.max("toxic").alias("toxic"))  # else a copied text's words count as its copies

    def count(batches):
        sums: Counter = Counter()
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums.update((w, toxic == 1) for w in set(words(text or "")))
        items = list(sums.items())
        for at in range(0, len(items), 10_000):
            part = items[at : at + 10_000]
            yield pa.RecordBatch.from_pydict({"word": [w for (w, _), _ in part], "toxic": [t for (_, t), _ in part], "n": [n for _, n in part]}, schema=pa.schema([("word", pa.string()), ("toxic", pa.bool_()), ("n", pa.int64())]))

    counts = distinct.mapInArrow(count, "word string, toxic boolean, n long").groupBy("word").agg(F.coalesce(F.sum(F.when(F.col("toxic"), F.col("n"))), F.lit(0)).alias("y"), F.coalesce(F.sum(F.when(~F.col("toxic"), F.col("n"))), F.lit(0)).alias("x"))
    counts = counts.persist()
    totals = counts.agg(F.sum("y").alias("y"), F.sum("x").alias("x")).collect()[0]
    n_y, n_x = float(totals["y"] or 0), float(totals["x"] or 0)
    model = Model({})
    if n_y and n_x:
        weight = PRIOR * (n_x + n_y)
        prior = F.lit(PRIOR) * (F.col("x") + F.col("y"))
        a, b = F.col("y") + prior, F.col("x") + prior
        odds = F.log(a / (n_y + weight - a)) - F.log(b / (n_x + weight - b))
        clear = counts.where(F.col("x") + F.col("y") >= LEAST_COUNT).withColumn("odds", odds).withColumn("z", F.col("odds") / F.sqrt(1 / a + 1 / b)).where(F.abs("z") >= LEAST_Z)
        kept = clear.orderBy(F.desc(F.abs("z")), "word").limit(VOCABULARY).collect()
        model.odds = {r["word"]: r["odds"] for r in kept}
        common = n_x - sum(r["x"] for r in kept)
        model.rate = rate_of(np.array([r["odds"] - DRIFT for r in kept] + [-DRIFT]), np.array([r["x"] + 0.5 for r in kept] + [max(common, 1.0)], dtype=float))  # half an occurrence more, as a word may be in no untoxic text
    counts.unpersist()

    def best(batches):
        for b in batches:
            found = []
            for text in b.column(0).to_pylist():
                s = model.scores(text or "")
                found.append((len(s), max((v for *_, v in segments(s)), default=0.0)))
            yield pa.RecordBatch.from_pydict({"n": [n for n, _ in found], "best": [x for _, x in found]}, schema=pa.schema([("n", pa.int64()), ("best", pa.float64())]))

    ys = rows.where("toxic = 1").count()
    clean = rows.where("toxic <> 1").select("text").mapInArrow(best, "n long, best double").where("best > 0").select(F.avg(F.col("best") * model.rate - F.log("n"))).collect()[0][0]
    model.log_k = (clean or 0.0) - EULER

    def evidence(batches):
        for b in batches:
            found = [model.evidence(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"top": [x for x, _ in found], "sum": [y for _, y in found], "toxic": b.column(1)}, schema=pa.schema([("top", pa.float64()), ("sum", pa.float64()), ("toxic", pa.int32())]))

    seen = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(evidence, "top double, sum double, toxic int").toPandas()
    if 0 < ys < len(seen):
        model.curve = logistic(seen[["top", "sum"]].to_numpy(), (seen["toxic"] == 1).to_numpy(dtype=float))
    elif len(seen):
        model.curve = (30.0 if ys else -30.0, 0.0, 0.0)
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passages array<struct<first, end, score>>): positions are words."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def setup():
        m = held.value
        return lambda key, text: [(key, m.score(text), [{"first": a, "end": b, "score": x} for a, b, x in m.passages(text or "")])]

    passage = pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("passages", pa.list_(passage))])
    return map_rows(docs, ["doc_id", "text"], schema, "doc_id bigint, score double, passages array<struct<first: int, end: int, score: double>>", setup)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(part_of(F.col("doc_id"), 3) != 1)
    out = scored(docs, train(docs, labels))
    return out.select("doc_id", (part_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))
