"""Toxicity: a character n-gram linear classifier on features scaled by naive Bayes log-count ratios.

An n-gram is 4 to 7 characters of the lower-cased text (white space is one space character; the text has a space
before and after), known by a 32-bit hash.  Training reads at most ``PER_CLASS`` labelled texts of each class, whole:

1. Tasks hash the texts; the hashes are dealt by range, and each range counts in how many texts of each class an
   n-gram occurs.  Those whose counts differ between the classes beyond chance (G statistic of at least ``MIN_G``)
   are the features; a feature's value is the log ratio of its smoothed shares in toxic and other texts.
2. Tasks look the features up in the training texts, and logistic regression with an L2 penalty gives the weights.

Scoring reads every whole text and sums the weights of the features that occur in it.  The model is as large as its
features, of which the bounded sample can only give so many.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_arrow, crc32_mod, map_rows, ship_package, texts, written

SHORTEST, LONGEST = 4, 7
PER_CLASS = 2000  # labelled texts of each class that the fit reads, chosen by a hash of their ids
MIN_G = 12.0
SMOOTHING = 1.0
PENALTY = 1e-3
STEPS = 200  # of L-BFGS, which ends when the loss falls by less than 1e-7
PART = 1 << 20  # characters whose n-grams are hashed at once
RANGES = 64  # of hashes that are counted apart
TABLE_BITS = 22


def ngram_hashes(text: str) -> Iterator[np.ndarray]:
    """Hashes of the text's n-grams, ``PART`` characters at a time; an n-gram may come more than once."""
    characters = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    characters = np.where((characters >= 9) & (characters <= 13), np.uint32(32), characters)
    for at in range(0, len(characters), PART):
        part = characters[at:at + PART + LONGEST - 1]
        total, factor, found = np.zeros(len(part), np.uint32), 1, []
        for k in range(min(LONGEST, len(part))):
            total = total[:len(part) - k] + part[k:] * np.uint32(factor)
            factor = (factor * 0x01000193 + 0x9E37) & 0xFFFFFFFF
            if k + 1 >= SHORTEST:
                h = total * np.uint32(0x9E3779B1) + np.uint32(77 * k)
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                found.append((h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35))
        if found:
            yield np.concatenate(found)


@dataclass
class Model:
    """Sorted hashes of the features, their weights (log ratio times regression weight) and the intercept."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.table = None

    def features(self, text: str) -> np.ndarray:
        """Sorted distinct numbers of the features in a text."""
        if self.table is None:  # built once per task
            self.table = np.zeros(1 << TABLE_BITS, bool)
            self.table[self.hashes >> np.uint32(32 - TABLE_BITS)] = True
        found = [np.zeros(0, np.int64)]
        for hashes in ngram_hashes(text):
            hashes = hashes[self.table[hashes >> np.uint32(32 - TABLE_BITS)]]
            if len(hashes):
                at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
                found.append(np.unique(at[self.hashes[at] == hashes]))
        return np.unique(np.concatenate(found))

    def probability(self, text: str) -> float:
        z = float(self.weights[self.features(text)].sum(dtype=np.float64)) + self.bias
        return float(1 / (1 + np.exp(-max(-700.0, min(700.0, z)))))

    def __getstate__(self):
        return self.__dict__ | {"table": None}


def counted(rows: DataFrame, read: dict[int, int]) -> DataFrame:
    """hash, other, toxic: numbers of training texts (row, toxic, text) of each class with a feature, for the n-grams
    whose counts differ beyond chance."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
                for hashes in ngram_hashes(text):
                    hashes = np.unique(hashes)
                    ends = np.searchsorted(hashes, np.arange(1, RANGES, dtype=np.uint64) * ((1 << 32) // RANGES))
                    pieces = [x.tobytes() for x in np.split(hashes, ends)]
                    yield pa.RecordBatch.from_pydict({"part": pa.array(range(RANGES), pa.int32()), "row": pa.array([row] * RANGES, pa.int64()),
                                                      "toxic": pa.array([toxic] * RANGES, pa.int32()), "hashes": pa.array(pieces, pa.binary())})


    def count(some: pd.DataFrame) -> pd.DataFrame:
        of = {k: [] for k in (0, 1)}
        for (_, toxic), pieces in some.groupby(["row", "toxic"])["hashes"]:
            found = [np.frombuffer(x, np.uint32) for x in pieces]
            of[toxic].append(found[0] if len(found) == 1 else np.unique(np.concatenate(found)))
        names = {k: np.unique(np.concatenate(v), return_counts=True) if v else (np.zeros(0, np.uint32), np.zeros(0, np.int64)) for k, v in of.items()}
        every = np.union1d(names[0][0], names[1][0])
        a = {k: np.zeros(len(every)) for k in (0, 1)}
        for k, (hashes, n) in names.items():
            a[k][np.searchsorted(every, hashes)] = n
        keep = g_statistic(a[0], a[1], read[0], read[1]) >= MIN_G
        return pd.DataFrame({"hash": every[keep].astype("int64"), "other": a[0][keep], "toxic": a[1][keep]})

    ship_package(rows.sparkSession)
    return (rows.select("row", "toxic", "text").mapInArrow(deal, "part int, row long, toxic int, hashes binary")
            .groupBy("part").applyInPandas(count, "hash long, other double, toxic double"))


def g_statistic(a: np.ndarray, b: np.ndarray, total_a: float, total_b: float) -> np.ndarray:
    """Twice the log-likelihood ratio of two shares a / total_a and b / total_b against one common share."""
    def term(x, expected):
        return x * np.log(np.maximum(x, 1e-300) / np.maximum(expected, 1e-300))

    total = total_a + total_b
    share = (a + b) / max(total, 1e-300)
    out = 0.0
    for x, n in ((a, total_a), (b, total_b)):
        out = out + term(x, share * n) + term(n - x, (1 - share) * n)
    return 2 * out


def minimise(f, w: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking for a smooth convex ``f(w) -> (value, gradient)``."""
    value, gradient = f(w)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction, parts = gradient.copy(), []
        for s, y in reversed(moves):
            a = s @ direction / (y @ s)
            parts.append(a)
            direction -= a * y
        if moves:
            s, y = moves[-1]
            direction *= s @ y / (y @ y)
        else:
            direction /= max(1e-9, float(np.linalg.norm(gradient)))
        for (s, y), a in zip(moves, reversed(parts)):
            direction += (a - y @ direction / (y @ s)) * s
        slope, step = gradient @ direction, 1.0
        while step > 1e-6:
            new = w - step * direction
            new_value, new_gradient = f(new)
            if new_value <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            return w
        if (new - w) @ (new_gradient - gradient) > 1e-12:
            moves = [*moves, (new - w, new_gradient - gradient)][-memory:]
        done = value - new_value < 1e-7
        w, value, gradient = new, new_value, new_gradient
        if done:
            break
    return w


def fit(toxic: np.ndarray, features: list[np.ndarray], ratio: np.ndarray, weight: dict[int, float]) -> tuple[np.ndarray, float]:
    """Regression weights and intercept; ``features`` are the numbers of the features in each text."""
    index, flat = np.repeat(np.arange(len(toxic)), [len(x) for x in features]), np.concatenate(features)
    of = np.where(toxic == 1, weight[1], weight[0])
    total = of.sum()

    def loss(w):
        z = np.bincount(index, (ratio * w[:-1])[flat], len(toxic)) + w[-1]
        error = of * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - toxic)
        gradient = np.append(np.bincount(flat, error[index], len(ratio)) * ratio / total + PENALTY * w[:-1], error.sum() / total)
        return float((of * (np.logaddexp(0, z) - toxic * z)).sum() / total + PENALTY / 2 * (w[:-1] @ w[:-1])), gradient

    w = minimise(loss, np.zeros(len(ratio) + 1), STEPS)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on ``labels`` (doc_id, toxic 0/1; a null label is no label, and of clashing labels of one doc_id the toxic
    one holds) and the texts of ``docs``.  At most ``per_class`` ids per class are read, chosen by a hash, and count
    for all of their class.  With one class only, or none, every text gets that class's smoothed share."""
    marked = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = marked.filter("toxic = 0").orderBy(*order).limit(per_class).union(marked.filter("toxic = 1").orderBy(*order).limit(per_class))
    chosen = chosen.select(F.col("doc_id").alias("label_id"), "toxic")
    # at most 2 * per_class ids: sent to the tasks, so the documents are not shuffled
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("toxic", "text")
    rows = written(picked.withColumn("row", F.monotonically_increasing_id()), "training")
    read, totals = dict(rows.groupBy("toxic").count().collect()), dict(marked.groupBy("toxic").count().collect())
    weight = {k: totals[k] / read[k] for k in read}
    nothing = np.zeros(0, np.uint32), np.zeros(0, np.float32)
    if len(read) < 2:
        every = sum(totals[k] for k in read)
        share = (totals[1] * (1 in read) + 0.5) / (every + 1.0) if 1 in read else 0.5 / (every + 1.0) if read else 0.0
        return Model(*nothing, float(np.log(share / (1 - share))) if share else -50.0)
    found = counted(rows, read).toPandas().sort_values("hash")  # features: as many as the bounded sample gives
    other, toxic = found["other"].to_numpy(), found["toxic"].to_numpy()
    ratio = np.log((toxic + SMOOTHING) / (read[1] + 2 * SMOOTHING)) - np.log((other + SMOOTHING) / (read[0] + 2 * SMOOTHING))
    model = Model(found["hash"].to_numpy().astype(np.uint32), np.zeros(len(found), np.float32), 0.0)

    def look_up(batch: pa.RecordBatch):
        return batch.column(0), [model.features(t).astype("<i4").tobytes() for t in texts(batch.column(1))]

    some = by_arrow(rows.select("toxic", "text"), look_up, "toxic int, features binary").toPandas()
    w, bias = fit(some["toxic"].to_numpy(), [np.frombuffer(x, "<i4") for x in some["features"]], ratio, weight)
    return Model(model.hashes, (ratio * w).astype(np.float32), bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every row of ``docs`` (doc_id, text).  A null text is scored as the empty one."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        fitted = sent.value
        scores = [fitted.probability(t) for t in texts(batch.column(1))]
        return batch.column(0), scores, [int(s >= 0.5) for s in scores]

    return by_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                    "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        fitted = sent.value
        for batch in batches:
            yield batch.filter(pa.array([fitted.probability(t) < 0.5 for t in texts(batch.column(at))], pa.bool_()))

    return map_rows(docs, run)


def held_out(doc_id: Column) -> Column:
    """Rows that the classifier must not learn from: crc32 of the id as text is a multiple of 5."""
    return crc32_mod(doc_id, 5) == 0
