"""Plug points that turn texts into vectors.

An embedder has an ``id``, a dimension, and ``embed(texts, role)`` from
(id, text) to (id, vec); ``role`` is ``document`` or ``query``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.functions import vectors as v

ROLES = ("document", "query")
# Letters, and counts, that are worked on at once.
HASHED_BYTES = 4_000_000
_LETTERS = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789'", np.uint8))


class Embedder(Protocol):
    id: str
    dimensions: int

    def embed(self, texts: DataFrame, role: str) -> DataFrame: ...


class WordHash:
    """Counts words into hashed slots: deterministic. The words of a batch of texts are hashed together, letter by letter."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions
        self.id = f"stub:{dimensions}"

    def embed(self, texts: DataFrame, role: str = "document") -> DataFrame:
        dims, schema = self.dimensions, f"id {texts.schema['id'].dataType.simpleString()}, vec array<double>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lowered = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
                starts = np.frombuffer(lowered.buffers()[1], np.int64)[lowered.offset : lowered.offset + len(lowered) + 1]
                # so many rows at a time that neither letters nor counts fill a worker
                first = 0
                while first < len(lowered):
                    last = int(np.searchsorted(starts, starts[first] + HASHED_BYTES, "right")) - 1
                    last = min(max(last, first + 1), first + max(1, HASHED_BYTES // (8 * dims)))
                    data = np.frombuffer(lowered.buffers()[2] or b"", np.uint8)[starts[first] : starts[last]]
                    vecs = _unit_counts(data, starts[first : last + 1] - starts[first], dims)
                    sizes = pa.array(np.arange(last - first + 1, dtype=np.int32) * dims)
                    made = pa.ListArray.from_arrays(sizes, pa.array(vecs.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), made], names=["id", "vec"])
                    first = last

        return texts.select("id", F.lower("text").alias("text")).mapInArrow(run, schema)


def _unit_counts(data: np.ndarray, starts: np.ndarray, dims: int) -> np.ndarray:
    """One unit vector per text of how often each slot occurs in it; ``starts`` says where each begins in ``data``."""
    n = len(starts) - 1
    letters = _LETTERS[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[starts] = True
    before = np.concatenate(([False], letters))
    after = np.concatenate((letters, [False]))
    begins = np.flatnonzero(after & (cut | ~before))
    lengths = np.flatnonzero(before & (cut | ~after)) - begins
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[order], lengths[order]
    h = np.full(len(begins), v.FNV_OFFSET, dtype=np.uint32)
    # words with an i-th letter stand first
    having = len(begins) - np.searchsorted(lengths[::-1], np.arange(1, lengths[0] + 1 if len(lengths) else 1), "left")
    for i, m in enumerate(having.tolist()):
        h[:m] = (h[:m] ^ data[begins[:m] + i]) * np.uint32(v.FNV_PRIME)
    wide = h.astype(np.int64)
    slots = np.minimum(wide, 4294967296 - wide) % dims
    text = np.searchsorted(starts, begins, "right") - 1
    counts = np.bincount(text * dims + slots, minlength=n * dims).reshape(n, dims).astype(np.float64)
    length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return counts / np.where(length == 0, 1.0, length)


class Precomputed:
    """Vectors looked up in a table of (id, vec) made elsewhere."""

    def __init__(self, id: str, dimensions: int, table: DataFrame):
        self.id, self.dimensions, self.table = id, dimensions, table

    def embed(self, texts: DataFrame, role: str = "document") -> DataFrame:
        return texts.select("id").join(self.table.select("id", "vec"), "id")


class BatchFunction:
    """A model call over batches of texts, run where the rows are.

    ``fn(texts, role)`` gets a list of at most ``batch_size`` texts and returns
    as many vectors.
    """

    def __init__(self, id: str, fn: Callable[[list[str], str], list], dimensions: int | None = None, batch_size: int = 256):
        self.id, self.fn, self.batch_size = id, fn, batch_size
        # one call tells the width, for models no table of widths knows
        self.dimensions = dimensions or len(fn(["probe"], "document")[0])

    def embed(self, texts: DataFrame, role: str = "document") -> DataFrame:
        if role not in ROLES:
            raise ValueError(f"unknown role {role!r}")
        fn, size, dims = self.fn, self.batch_size, self.dimensions

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for start in range(0, len(frame), size):
                    part = frame.iloc[start : start + size]
                    made = fn(part["text"].tolist(), role)
                    if len(made) != len(part):
                        raise ValueError(f"{len(made)} vectors came back for {len(part)} texts")
                    rows = [np.asarray(m, dtype=np.float64) for m in made]
                    if any(r.shape != (dims,) for r in rows):
                        raise ValueError(f"expected vectors of {dims} dimensions")
                    yield pd.DataFrame({"id": part["id"].to_numpy(), "vec": rows})

        return texts.select("id", "text").mapInPandas(run, "id string, vec array<double>")
