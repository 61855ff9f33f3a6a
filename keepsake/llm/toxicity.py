"""Toxicity scores by FTRL-proximal logistic regression.

A text's features are its words, pairs of neighbours and pairs with one or two
words between, hashed into a fixed number of slots; a feature counts once. The
learner keeps a rate per coordinate and drives most weights to exactly zero, so
the model that goes to the tasks is short, and its size is bounded by the slots.

It is fitted in one task on at most ``MAX_ROWS`` labelled rows, picked by a hash
of their id. From a sample without both classes nothing can be learnt: every text then scores
0, and ``reject`` keeps all documents.

Edge cases: null and empty texts have no features and get the score of the bias
alone; a document without label, or with a null one, is scored and not learnt
from; repeated rows are scored each; an empty table gives no rows. Extra columns
are kept, whatever their names; one that has the name of the score is replaced by ``score`` and kept by ``reject``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import ASCII_LOWER, SCORED, crc_part, free_name, quoted, raw, table, with_score

SLOT_BITS = 20
MAX_ROWS = 12_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.1
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
CACHE_WORDS = 400_000
# ASCII that is neither letter nor digit separates words.
_SPLIT = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in ASCII_LOWER)
_GAPS = (1, 2, 3)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


class Features:
    """Hashed features of texts given as bytes; word hashes are remembered up to a bound."""

    def __init__(self, slot_bits: int = SLOT_BITS, cache_words: int = CACHE_WORDS):
        self.shift, self.cache_words = np.uint64(64 - slot_bits), cache_words
        self.known: dict[bytes, int] = {}

    def words(self, text: bytes) -> np.ndarray:
        words = text.translate(_SPLIT).split()
        known = self.known
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > self.cache_words:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.array([known[w] for w in words], np.uint64)

    def slots(self, text: bytes) -> np.ndarray:
        """Slot of every word, pair and skip pair, with repeats."""
        h = self.words(text)
        parts = [h * _MIX[0] >> self.shift]
        parts += [((h[:-g] * _MIX[g]) ^ (h[g:] + _MIX[g])) * _MIX[0] >> self.shift for g in _GAPS if len(h) > g]
        return np.concatenate(parts).astype(np.int64)


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, slot_bits: int = SLOT_BITS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots and weights that are not zero, and the bias, of a model over rows of distinct slots."""
    size = 1 << slot_bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        zi, pull = z[i], np.where(i == size, 0.0, l1)
        return -np.sign(zi) * np.maximum(np.abs(zi) - pull, 0) / ((beta + np.sqrt(n[i])) / alpha + l2)

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            i = np.append(rows[k], size)  # the bias, without L1; no second copy of all rows is kept
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - labels[k]
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - step * w
            n[i] += g * g
    every = weights(np.arange(size + 1))
    kept = np.flatnonzero(every[:size])
    return kept, every[kept], float(every[size])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = Features()
    for batch in batches:
        for start in range(0, batch.num_rows, SCORED):
            got = batch.slice(start, SCORED)
            slots = [np.unique(made.slots(t.as_py())).astype(np.int32) for t in got.column("text")]
            yield pa.RecordBatch.from_arrays([got.column("key"), got.column("label"), pa.array(slots, pa.list_(pa.int32()))], ["key", "label", "slots"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, labels, keys = [], [], []
    for got in batches:
        keys += got.column("key").to_pylist()
        labels += got.column("label").to_pylist()
        lists = got.column("slots")
        flat, edges = lists.values.to_numpy(), lists.offsets.to_numpy()
        rows += [flat[a:b] for a, b in zip(edges[:-1], edges[1:])]  # views of the batch, which holds the slots once
    if len(set(labels)) < 2:
        return
    often = Counter(keys)
    # not the order of arrival; rows are compared themselves only where a key repeats
    order = sorted(range(len(rows)), key=lambda k: (keys[k], labels[k], rows[k].tobytes() if often[keys[k]] > 1 else b""))
    slots, weights, bias = fit_ftrl([rows[k] for k in order], np.array([labels[k] for k in order], float))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(slots, -1), pa.int64()), pa.array(np.append(weights, bias))], ["slot", "weight"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights of the model; the bias has slot -1.

    ``labels`` has doc_id and the label. Labelled rows beyond ``max_rows`` are
    thinned by a hash of their id, before texts are read for them.
    """
    wanted = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    key = F.xxhash64(F.lit("toxicity"), F.col("doc_id"))
    share = max_rows / max(max_rows, wanted.count())
    wanted = wanted.where(F.pmod(key, F.lit(1_000_000)) < int(share * 1_000_000))
    sample = docs.select("doc_id", "text").join(wanted, "doc_id").select(key.alias("key"), "label", raw(F.col("text")).alias("text"))
    found = sample.mapInArrow(_features, "key long, label int, slots array<int>")
    model = found.repartition(1).mapInArrow(_fit, "slot long, weight double").collect()  # at most one row per slot
    return np.array([r[0] for r in model], np.int64), np.array([r[1] for r in model], float)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], column: str = "toxicity") -> DataFrame:
    """The documents with ``column``, the chance that their text is toxic."""
    slots, weights = model
    known = bool((slots == -1).any())
    shared = docs.sparkSession.sparkContext.broadcast((slots[slots >= 0], weights[slots >= 0], float(weights[slots == -1].sum())))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
        kept, values, bias = shared.value
        dense = np.zeros(1 << SLOT_BITS)
        dense[kept] = values
        made = Features()
        for got in batches:
            sums = []
            for text in got.column("text"):
                slots = made.slots(text.as_py())
                w = dense[slots]
                sums.append(dense[np.unique(slots[w != 0])].sum() + bias)
            p = 1 / (1 + np.exp(-np.clip(np.array(sums, float), -30, 30))) if known else np.zeros(got.num_rows)
            yield pa.array(p)

    return with_score(docs, column, scores)


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(crc_part(F.col("doc_id"), FOLDS) != HELD_OUT)


def reject(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns kept, that score below ``threshold``."""
    own = free_name(docs, "toxicity")
    kept = score(docs, model, own).where(F.col(quoted(own)) < threshold)
    return kept.select(*[F.col(quoted(c)) for c in docs.columns])


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, training_labels(table(spark, sf_dir, "labels")))
    got = score(docs, model).select("doc_id", F.col("toxicity").alias("score"))
    held_out = crc_part(F.col("doc_id"), FOLDS) == HELD_OUT
    return got.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
