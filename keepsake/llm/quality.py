"""Quality scores by positive-unlabelled learning.

Trusted good texts and unlabelled web texts are all the learner sees; labelled
bad texts are not used. A first classifier tells the two apart and gives the
class prior: the smallest ratio, over cuts of its score on rows held back, of
the share of unlabelled to the share of positive texts above the cut. The model
then minimises the non-negative unbiased risk (Kiryo et al., 2017) with that
prior, by gradient descent on the whole bounded sample.

A text is described by how often each word shape occurs (runs of upper case,
lower case and digits squeezed, marks kept) and by a few shares: repeated
neighbours, distinct words, word length, upper case, marks, lines.

Edge cases: null and empty texts have no words and get the score of the bias;
null labels are unlabelled; with no positive text everyone scores the prior of
a half; repeated rows are scored each; an empty table gives no rows. Extra
columns are ignored by ``query`` and kept by ``score``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import crc_part, raw, table, with_score

SHAPES = 512
MAX_POSITIVE, MAX_UNLABELLED = 6_000, 12_000
STEPS, RATE, DECAY = 400, 0.05, 2e-4
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0

_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_SHAPE = bytes(ord("X") if c in _UPPER else ord("0") if c in _DIGIT else ord("x") if c > 127 or chr(c).isalpha() else c for c in range(256))
_RUNS = re.compile(rb"([Xx0])\1+")
EXTRA = 9


class Shapes:
    """The features of texts given as bytes; slots of shapes are remembered up to a bound."""

    def __init__(self, slots: int = SHAPES, cache: int = 100_000):
        self.slots, self.cache = slots, cache
        self.known: dict[bytes, int] = {}

    def slot(self, shape: bytes) -> int:
        at = self.known.get(shape)
        if at is None:
            if len(self.known) > self.cache:
                self.known.clear()
            at = self.known[shape] = xxhash.xxh3_64_intdigest(shape) % self.slots
        return at

    def row(self, text: bytes) -> np.ndarray:
        out = np.zeros(self.slots + EXTRA, np.float32)
        words = text.split()
        if not words:
            return out
        n, size = len(words), len(text)
        for shape, count in Counter(_RUNS.sub(rb"\1", text.translate(_SHAPE)).split()).items():
            out[self.slot(shape)] += count / n
        out[: self.slots] = np.log1p(50 * out[: self.slots]) / np.log(51)
        distinct = len(set(words))
        same = sum(map(eq, words, words[1:])) / n
        lines = text.split(b"\n")
        share = lambda chars: 1 - len(text.translate(None, chars)) / size
        out[self.slots :] = (
            np.log1p(50 * same) / np.log(51), distinct / n, np.log1p(n) / 10, min(1.0, size / n / 40), share(_UPPER), share(_MARKS), share(_DIGIT),
            len(set(lines)) / len(lines), min(1.0, len(lines) / n),
        )
        return out


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def _descend(gradient, width: int, steps: int, rate: float) -> np.ndarray:
    """Adam from zero over a gradient of the whole sample."""
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = STEPS) -> float:
    """The share of good texts among the unlabelled, from features of both (a bias column is last)."""
    p, u, p2, u2 = positive[::2], unlabelled[::2], positive[1::2], unlabelled[1::2]
    if not len(p2) or not len(u2):
        return 0.5

    def gradient(w: np.ndarray) -> np.ndarray:
        return -p.T @ (1 - _sigmoid(p @ w)) / len(p) + u.T @ _sigmoid(u @ w) / len(u) + DECAY * w

    w = _descend(gradient, p.shape[1], steps // 2, RATE)
    cuts = np.sort(p2 @ w)
    above_p = 1 - np.arange(len(cuts)) / len(cuts)
    above_u = 1 - np.searchsorted(np.sort(u2 @ w), cuts) / len(u2)
    slack = 1 / np.sqrt(len(u2)) + 1 / np.sqrt(len(p2))
    return float(np.clip(np.min(np.where(above_p > 0.1, (above_u + slack * (1 - above_p)) / above_p, 1.0)), 0.02, 0.98))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> np.ndarray:
    """Weights of least non-negative risk: pi R_p(+) + max(0, R_u(-) - pi R_p(-)), sigmoid loss."""

    def gradient(w: np.ndarray) -> np.ndarray:
        gp, gu = _sigmoid(positive @ w), _sigmoid(unlabelled @ w)
        slope_p, slope_u = positive.T @ (gp * (1 - gp)) / len(gp), unlabelled.T @ (gu * (1 - gu)) / len(gu)
        rest = gu.mean() - prior * gp.mean()
        negative = slope_u - prior * slope_p
        # where the risk of the bad class would fall below zero, step back from it
        return (-prior * slope_p + negative if rest >= 0 else -negative) + DECAY * w

    return _descend(gradient, positive.shape[1], steps, RATE)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = Shapes()
    for got in batches:
        rows = [made.row(t.as_py()) for t in got.column("text")]
        yield pa.RecordBatch.from_arrays([got.column("key"), got.column("kind"), pa.array(rows, pa.list_(pa.float32()))], ["key", "kind", "row"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: dict[int, list] = {0: [], 1: []}
    for got in batches:
        flat, width = got.column("row").values.to_numpy(), SHAPES + EXTRA
        for k, (key, kind) in enumerate(zip(got.column("key").to_pylist(), got.column("kind").to_pylist())):
            rows[kind].append((key, flat[k * width : (k + 1) * width].copy()))
    x = {k: np.array([np.append(r, 1) for _, r in sorted(v, key=lambda r: (r[0], r[1].tobytes()))]) for k, v in rows.items()}  # not the order of arrival
    if len(x[0]) and len(x[1]):
        prior = estimate_prior(x[1], x[0])
        w = fit_pu(x[1], x[0], prior)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(w, prior))], ["w"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> np.ndarray:
    """The weights, bias and estimated prior: a vector of fixed length.

    Positives are labelled rows of value 1, the unlabelled are texts of all
    documents; both samples are picked by a hash of the id, up to their bounds.
    """
    good = labels.where(F.col(label) == 1).select("doc_id").distinct()
    key = F.xxhash64(F.lit("quality"), F.col("doc_id"))

    def thinned(rows: DataFrame, most: int) -> DataFrame:
        return rows.where(F.pmod(key, F.lit(1_000_000)) < int(most / max(most, rows.count()) * 1_000_000))

    some = docs.select("doc_id", "text")
    positive = some.join(thinned(good, max_positive), "doc_id").select(key.alias("key"), F.lit(1).alias("kind"), raw(F.col("text")).alias("text"))
    unlabelled = thinned(some, max_unlabelled).select(key.alias("key"), F.lit(0).alias("kind"), raw(F.col("text")).alias("text"))
    found = positive.union(unlabelled).mapInArrow(_features, "key long, kind int, row array<float>")
    return np.array([r[0] for r in found.repartition(1).mapInArrow(_fit, "w double").collect()])


def score(docs: DataFrame, model: np.ndarray, column: str = "quality") -> DataFrame:
    """The documents with ``column``, the chance that their text is good; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
        w, made = shared.value, Shapes()
        for got in batches:
            texts = got.column("text")
            p = np.array([made.row(t.as_py()) @ w[:-2] + w[-2] for t in texts], float) if len(w) else np.zeros(len(texts))
            yield pa.array(_sigmoid(p))

    return with_score(docs, column, scores)


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(crc_part(F.col("doc_id"), FOLDS) != HELD_OUT)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = score(docs, train(docs, training_labels(table(spark, sf_dir, "labels")))).select("doc_id", F.col("quality").alias("score"))
    held_out = crc_part(F.col("doc_id"), FOLDS) == HELD_OUT
    return got.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
