"""Exact substring deduplication with FM-indexes.

A window is ``WINDOW`` consecutive words. Runs of windows with the same minimiser
(the least hash of the word groups in a window) are segments, so equal windows
lie in segments of one minimiser, whatever stands around them. Segments whose
minimiser occurs under one id only hold nothing repeated; all others go to shards
by minimiser. A shard writes its distinct segments one after another, builds an
FM-index of them (suffixes ordered to the window's depth, the Burrows-Wheeler
transform in a wavelet matrix), and streams the segments through backward search. That
gives, for every window, the interval of all its occurrences and the smallest
document id in it. No shard needs to see another's text.

Words are known to the index by 48 bits of their hash; positions and windows are exact.

Edge cases: a null text has no words; a document of fewer words than a window
keeps all; a null id is neither smaller nor greater than another, so its words
stay and take no others out; repeated rows have equal ids and keep what the first
has; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm.common import raw, table
from keepsake.session import stored

WINDOW, SEED_WORDS = 13, 4
SHARD_WORDS = 2_000_000
CACHE_WORDS = 400_000
ID_BYTES = 6
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_P, _M = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_P_INVERSE = pow(_P, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    return x ^ (x >> np.uint64(29))


class Segmenter:
    """Cuts texts, given as bytes, into segments."""

    def __init__(self, window: int = WINDOW, seed: int = SEED_WORDS, cache_words: int = CACHE_WORDS):
        self.window, self.seed, self.cache_words = window, seed, cache_words
        self.known: dict[bytes, int] = {}
        self.powers, self.inverses = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def words(self, text: bytes) -> np.ndarray:
        words, known = text.split(), self.known
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > self.cache_words:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.array([known[w] for w in words], np.uint64)

    def minimisers(self, h: np.ndarray) -> np.ndarray:
        """The minimiser of every window."""
        n, m = len(h) - self.window + 1, self.seed
        if n <= 0:
            return h[:0]
        groups = np.zeros(len(h) - m + 1, np.uint64)
        for j in range(m):
            groups = (groups ^ h[j : j + len(groups)]) * np.uint64(_P)
        groups, width, want = _mix(groups), 1, self.window - m + 1
        while 2 * width <= want:
            groups = np.minimum(groups[:-width], groups[width:])
            width *= 2
        return np.minimum(groups[:n], groups[want - width : want - width + n])

    def segments(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Minimiser, content hash, first window and number of windows of each segment."""
        least = self.minimisers(h)
        starts = np.flatnonzero(np.append(True, least[1:] != least[:-1])) if len(least) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(least)) if len(starts) else starts
        while len(self.powers) <= len(h):
            step = np.uint64(pow(_P, len(self.powers), 1 << 64)), np.uint64(pow(_P_INVERSE, len(self.powers), 1 << 64))
            self.powers, self.inverses = np.append(self.powers, self.powers * step[0]), np.append(self.inverses, self.inverses * step[1])
        before = np.append(np.uint64(0), np.cumsum(h * self.powers[: len(h)]))
        content = _mix((before[ends + self.window - 1] - before[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64)) if len(starts) else h[:0]
        return least[starts], content, starts, ends - starts


class WaveletMatrix:
    """Rank of a symbol before many positions at once, over a sequence of numbers below 2^bits."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (sequence >> level) & 1 == 1
            packed = np.packbits(np.append(bit, np.zeros(-len(bit) % 64 + 64, bool)), bitorder="little").view(np.uint64)
            self.levels.append((packed, np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int64))))
            self.zeros.append(int(len(bit) - bit.sum()))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])
        self.bases = self._down(np.arange(1 << bits), np.zeros(1 << bits, np.int64)) if bits < 24 else None

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        packed, before = self.levels[level]
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(packed[word] & mask)

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a position ends up when it follows the bits of its symbol."""
        for level in range(self.bits):
            ones = self._ones(level, at)
            at = np.where((symbols >> (self.bits - 1 - level)) & 1 == 1, self.zeros[level] + ones, at - ones)
        return at

    def ranks(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol occurs before ``low`` and before ``high``."""
        base = self._down(symbols, np.zeros(len(symbols), np.int64)) if self.bases is None else self.bases[symbols]
        both = self._down(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        return both[: len(symbols)] - base, both[len(symbols) :] - base


class FMIndex:
    """Backward search for patterns of up to ``depth`` symbols in a sequence of positive numbers.

    The last symbol closes the sequence and is in no pattern.
    """

    def __init__(self, sequence: np.ndarray, depth: int = WINDOW):
        rank, width = sequence.astype(np.int64), 1
        while width < depth:
            after = np.append(rank[width:], np.zeros(min(width, len(rank)), np.int64))[: len(rank)]
            _, rank = np.unique(rank * (rank.max(initial=0) + 1) + after, return_inverse=True)
            rank, width = rank + 1, 2 * width
            if rank.max() == len(rank):
                break
        self.order = np.argsort(rank, kind="stable")
        self.first = np.append(0, np.cumsum(np.bincount(sequence)))
        self.transform = WaveletMatrix(sequence[self.order - 1], int(sequence.max(initial=1)).bit_length())

    def intervals(self, sequence: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Interval of suffixes that begin like the sequence at each start; 0, 0 for what occurs there alone."""
        low, high = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        here, l, h = np.arange(len(starts)), np.zeros(len(starts), np.int64), np.full(len(starts), len(self.order))
        for j in range(length - 1, -1, -1):
            symbols = sequence[starts[here] + j]
            before, upto = self.transform.ranks(symbols, l, h)
            l, h = self.first[symbols] + before, self.first[symbols] + upto
            more = h - l > 1  # an end that occurs once makes the window occur once
            here, l, h = here[more], l[more], h[more]
        low[here], high[here] = l, h
        return low, high


def least_documents(words: np.ndarray, lengths: np.ndarray, documents: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each segment, the smallest document id among all occurrences of each of its windows.

    ``words`` are the segments' word ids one after another, ``documents`` the
    smallest id under which a segment occurs.
    """
    _, symbols = np.unique(words, return_inverse=True)
    at = np.append(0, np.cumsum(lengths))
    places = np.arange(len(words)) + np.repeat(np.arange(len(lengths)), lengths)  # one place is left after each segment
    sequence = np.ones(len(words) + len(lengths), np.int64)  # 1 parts the segments
    sequence[places] = symbols + 2
    owners = np.repeat(documents, lengths + 1)
    index = FMIndex(sequence, window)
    counts = lengths - window + 1
    first = (at[:-1] + np.arange(len(lengths))).repeat(counts)
    starts = first + np.arange(counts.sum()) - np.append(0, np.cumsum(counts)[:-1]).repeat(counts)
    low, high = index.intervals(sequence, starts, window)
    least, often = owners[starts], np.flatnonzero(high)
    if len(often):
        lows, place, back = np.unique(low[often], return_index=True, return_inverse=True)
        by_order = np.append(owners[index.order], np.iinfo(np.int64).max)
        least[often] = np.minimum.reduceat(by_order, np.stack([lows, high[often][place]], 1).reshape(-1))[::2][back]
    return np.split(least, np.cumsum(counts)[:-1])


@contextmanager
def _tidy(spark: SparkSession):
    """Shuffle files of a finished job are removed at once, where Spark offers that."""
    before = spark.conf.get(CLEANUP, None) if spark.conf.isModifiable(CLEANUP) else None
    if spark.conf.isModifiable(CLEANUP):
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(CLEANUP, before)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = Segmenter()
    for got in batches:
        found = [np.unique(made.minimisers(made.words(t.as_py()))) for t in got.column("text")]
        ids = np.repeat(got.column("doc_id").to_numpy(), [len(f) for f in found])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)), pa.array(ids, pa.int64())], ["seed", "doc_id"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = Segmenter()
    schema = pa.schema([("seed", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("words", pa.binary())])
    for got in batches:
        out: list[list] = [[] for _ in schema]
        held = 0
        for k in range(got.num_rows):
            h = made.words(got.column("text")[k].as_py())
            seeds, content, starts, windows = made.segments(h)
            keep = np.flatnonzero(np.isin(seeds, np.asarray(got.column("seeds")[k].values).view(np.uint64)))
            if not len(keep):
                continue
            seeds, content, starts, windows = seeds[keep], content[keep], starts[keep], windows[keep]
            lengths = windows + WINDOW - 1
            ends = np.cumsum(lengths)
            at = np.repeat(starts - np.append(0, ends[:-1]), lengths) + np.arange(ends[-1])
            packed = h[at].view(np.uint8).reshape(-1, 8)[:, :ID_BYTES].tobytes()
            edges = np.append(0, ends * ID_BYTES).tolist()
            for column, values in zip(out, (seeds.view(np.int64), content.view(np.int64), np.full(len(keep), got.column("doc_id")[k].as_py()), np.full(len(keep), got.column("text_key")[k].as_py()), starts, windows)):
                column.append(values)
            out[-1] += [packed[a:b] for a, b in zip(edges[:-1], edges[1:])]
            held += len(packed)
            if held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if i < 6 else c, t.type) for i, (c, t) in enumerate(zip(out, schema))], schema=schema)
                out, held = [[] for _ in schema], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if i < 6 else c, t.type) for i, (c, t) in enumerate(zip(out, schema))], schema=schema)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard: its segments are read, indexed and searched."""
    seeds, contents, documents, lengths, packed = [], [], [], [], []
    for got in batches:
        seeds.append(got.column("seed").to_numpy())
        contents.append(got.column("content").to_numpy())
        documents.append(got.column("doc_id").to_numpy())
        rows = got.column("words").to_pylist()
        lengths.append(np.array([len(r) // ID_BYTES for r in rows], np.int64))
        packed += rows
    if not packed:
        return
    flat = np.zeros((sum(map(len, packed)) // ID_BYTES, 8), np.uint8)
    flat[:, :ID_BYTES] = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, ID_BYTES)
    packed.clear()
    least = least_documents(flat.view(np.uint64).reshape(-1), np.concatenate(lengths), np.concatenate(documents))
    seeds, contents, step = np.concatenate(seeds), np.concatenate(contents), 20_000
    for a in range(0, len(least), step):
        yield pa.RecordBatch.from_arrays([pa.array(seeds[a : a + step]), pa.array(contents[a : a + step]), pa.array(least[a : a + step], pa.list_(pa.int64()))], ["seed", "content", "least"])


def repeated_windows(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, text_key and ``starts``: first words of windows that also start under a smaller id."""
    some = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_key"), raw(F.col("text")).alias("text"))
    seeds = stored(some.select("doc_id", "text").mapInArrow(_seeds, "seed long, doc_id long"), "substring-seeds")
    shared = seeds.groupBy("seed").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("seed")
    wanted = stored(seeds.join(shared, "seed", "left_semi").groupBy("doc_id").agg(F.collect_set("seed").alias("seeds")), "substring-wanted")
    segments = stored(some.join(wanted, "doc_id").mapInArrow(_segments, "seed long, content long, doc_id long, text_key long, start int, windows int, words binary"), "substring-segments")
    distinct = segments.groupBy("seed", "content").agg(F.min("doc_id").alias("doc_id"), F.first("words").alias("words"))
    words = segments.agg(F.sum(F.col("windows") + WINDOW - 1)).first()[0] or 0
    shards = max(1, -(-words // shard_words))
    least = stored(distinct.repartition(shards, "seed").mapInArrow(_index, "seed long, content long, least array<long>"), "substring-least")
    met = segments.select("seed", "content", "doc_id", "text_key", "start").join(least, ["seed", "content"])
    gone = F.filter(F.transform("least", lambda d, i: F.when(d < F.col("doc_id"), F.col("start") + i)), lambda x: x.isNotNull())
    met = met.select("doc_id", "text_key", gone.alias("starts")).where(F.size("starts") > 0)
    return met.groupBy("doc_id", "text_key").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for got in batches:
        out = []
        for text, starts in zip(got.column("text"), got.column("starts")):
            words = text.as_py().split()
            if starts.is_valid:
                gone = np.zeros(len(words) + 1, np.int64)
                at = starts.values.to_numpy()
                np.add.at(gone, at, 1)
                np.add.at(gone, at + WINDOW, -1)
                words = [w for w, covered in zip(words, np.cumsum(gone)[:-1].tolist()) if not covered] if len(at) else words
            out.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([got.column("doc_id"), pa.array([len(t.as_py().split()) for t in got.column("text")], pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n_words", "kept"])


def deduplicate(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words and ``kept``, the words left, joined by one space, as UTF-8 bytes."""
    with _tidy(docs.sparkSession):
        gone = stored(repeated_windows(docs, shard_words), "substring-gone")
        key = F.struct("doc_id", "text_key").alias("key")
        texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), raw(F.col("text")).alias("text")).select("doc_id", "text", key)
        return texts.join(gone.select(key, "starts"), "key", "left").select("doc_id", "text", "starts").mapInArrow(_cut, "doc_id long, n_words long, kept binary")


def query(spark, sf_dir):
    got = deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # spaces join words and lie in none
    left = F.when(F.octet_length("kept") == 0, F.lit(0)).otherwise(F.octet_length("kept") - F.octet_length(F.translate(F.col("kept").cast("string"), " ", "")) + 1)
    return got.select("doc_id", "n_words", (F.col("n_words") - left).cast("long").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
