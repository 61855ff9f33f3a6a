"""Near-duplicates by improved consistent weighted sampling.

A text is its shingles of five lower-cased words, weighted by term frequency and
a damped inverse document frequency. Document frequencies are counted over all
documents, in a fixed number of slots, so the table that goes to the tasks has a
fixed size. Each sample of Ioffe's scheme (2010) agrees between two texts with
the probability of their weighted Jaccard similarity; bands of samples bring
candidates together, and every link is verified on the weights themselves.

Copies are one text from the start. The texts of a bucket are compared by their samples
inside tasks, in blocks of bounded size; a pair belongs to the first band its texts share, so it
is looked at once. A pair is plausible if ``PLAUSIBLE`` of its 56 samples agree. Every text first names its
most alike plausible partners, and those pairs are verified: about n of them in a group of n near copies. Plausible
pairs whose texts are then still in different components are verified all,
in blocks that get the shingles of each text once, unless links join them before.

Edge cases: a text of fewer than five words is one shingle; a null text and one without
words is like no other and always stays; copies and repeated rows form one class with
the smallest id (nulls first); rows of one id and different texts are different
documents; an empty table gives no rows. ``deduplicate`` keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm.common import ASCII_LOWER, raw, table, whole_row
from keepsake.session import stored

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 14, 4
# Of 56 samples of two texts at a similarity of 0.8, fewer agree in 6 of a million draws, two orders below what the bands miss.
PLAUSIBLE = 31
PARTNERS = 1  # named by each text in each of its buckets
WANTED_BITS = 22
BLOCK_TEXTS = 1024  # of a bucket compared with as many others at once
STRIP = 64
# Finer bands of more samples each, which pick from the first samples and as many fresh ones. The job does without them.
FRESH = BANDS * ROWS
FINE_BANDS, FINE_ROWS = 80, 8
DF_BITS = 16
IDF_SHARE = 0.25
CACHE_WORDS = 400_000
SAID = r"[^\x20\x09-\x0D]"  # a text with words has one such character
BLOCK = 16_384  # shingles sampled at once
LEVELS = 4096
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(29))


def _gamma_levels() -> np.ndarray:
    """The middles of equally likely slices of Gamma(2, 1), by inverting its distribution on a grid."""
    x = np.linspace(0, 25, 400_001)
    return np.interp((np.arange(LEVELS) + 0.5) / LEVELS, 1 - (1 + x) * np.exp(-x), x).astype(np.float32)


class Shingles:
    """Distinct shingle hashes of texts given as bytes, with their counts."""

    def __init__(self, cache_words: int = CACHE_WORDS):
        self.known: dict[bytes, int] = {}
        self.cache_words = cache_words

    def _words(self, text: bytes) -> np.ndarray:
        words, known = text.translate(ASCII_LOWER).split(), self.known
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > self.cache_words:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.array([known[w] for w in words], np.uint64)

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        h = self._words(text)
        if not len(h):
            return h, h.astype(np.int64)
        n = max(1, len(h) - SHINGLE + 1)
        out = np.zeros(n, np.uint64)
        for j in range(min(SHINGLE, len(h))):
            out = (out ^ h[j : j + n]) * _M1
            out ^= out >> np.uint64(31)
        return np.unique(_mix(out + np.uint64(min(SHINGLE, len(h)))), return_counts=True)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - DF_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents by slot of shingle, and documents in all, over the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, counts, n = Shingles(), np.zeros((1 << DF_BITS) + 1, np.int64), 0
        held: list[np.ndarray] = []
        for got in batches:
            for text in got.column("text"):
                hashes, _ = made.of(text.as_py())
                held.append(_slot(hashes).astype(np.int32))
                n += len(hashes) > 0
                if len(held) == 1024:
                    counts[:-1] += np.bincount(np.concatenate(held), minlength=1 << DF_BITS)
                    held.clear()
        if held:
            counts[:-1] += np.bincount(np.concatenate(held), minlength=1 << DF_BITS)
        counts[-1] = n
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used])], ["slot", "n"])

    found = docs.select(raw(F.col("text")).alias("text")).mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    out = np.zeros((1 << DF_BITS) + 1, np.int64)
    for slot, n in found.collect():  # at most one row per slot
        out[slot] = n
    return out[:-1], int(out[-1])


def slot_weights(df: np.ndarray, documents: int) -> np.ndarray:
    """Damped inverse document frequency by slot, from one to 1 + ``IDF_SHARE``.

    Damped, so that what the texts of a large group share still counts next to
    what sets them apart, and near copies by plain similarity stay near copies.
    """
    idf = np.log1p(documents / np.maximum(df, 1))
    return 1 + IDF_SHARE * idf / max(idf.max(initial=0), 1e-9)


class Sampler:
    """Consistent weighted samples of many texts at once, from the one after ``skip`` on."""

    def __init__(self, samples: int = BANDS * ROWS, skip: int = 0):
        levels = _gamma_levels()
        self.r, self.log_c = levels, np.log(levels)
        self.seeds = np.random.default_rng(1).integers(1, 1 << 62, skip + samples, np.uint64)[skip:] * np.uint64(2) + np.uint64(1)

    def __call__(self, hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row of samples per text; texts are the stretches from ``starts``, none empty."""
        lengths = np.diff(np.append(starts, len(hashes)))
        owner, log_w = np.repeat(np.arange(len(starts)), lengths), np.log(weights).astype(np.float32)
        out = np.empty((len(starts), len(self.seeds)), np.uint64)
        for k, seed in enumerate(self.seeds):
            x = _mix(hashes * seed)
            r = self.r[(x >> np.uint64(52)).astype(np.intp)]
            log_c = self.log_c[((x >> np.uint64(40)) & np.uint64(LEVELS - 1)).astype(np.intp)]
            beta = ((x >> np.uint64(16)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2.0**-24)
            t = np.floor(log_w / r + beta)
            a = log_c - r * (t - beta + np.float32(1))
            best = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), lengths))
            best = best[np.append(True, np.diff(owner[best]) > 0)]
            out[:, k] = _mix(hashes[best] ^ (t[best].astype(np.int64).astype(np.uint64) * _M1))
        return out


def sketches(docs: DataFrame, df: np.ndarray, documents: int) -> DataFrame:
    """doc_id, text_key (a digest of the text), the hash of every band and short samples, of texts with words."""
    shared = docs.sparkSession.sparkContext.broadcast(slot_weights(df, documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_slot, made, sampler = shared.value, Shingles(), Sampler()
        rows: list[tuple[int, np.ndarray, np.ndarray]] = []

        def flush(got: pa.RecordBatch) -> pa.RecordBatch:
            hashes = np.concatenate([h for _, h, _ in rows])
            weights = by_slot[_slot(hashes)] * np.concatenate([c for _, _, c in rows])
            starts = np.concatenate([[0], np.cumsum([len(h) for _, h, _ in rows])[:-1]])
            samples = sampler(hashes, weights, starts)
            short = samples.astype(np.uint16)
            packed = [x.tobytes() for x in short]
            # made of the short samples, so whoever holds those knows which bands two texts share
            samples = short.astype(np.uint64).reshape(len(rows), BANDS, ROWS)
            bands = np.arange(BANDS, dtype=np.uint64) * _M1 + np.zeros((len(rows), 1), np.uint64)
            for j in range(ROWS):
                bands = _mix((bands ^ samples[:, :, j]) * _M1)
            at = pa.array([i for i, _, _ in rows])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1).view(np.int64)))
            return pa.RecordBatch.from_arrays([got.column("doc_id").take(at), got.column("text_key").take(at), lists, pa.array(packed, pa.binary())], ["doc_id", "text_key", "bands", "samples"])

        for got in batches:
            held = 0
            for i, text in enumerate(got.column("text")):
                hashes, counts = made.of(text.as_py())
                if len(hashes):
                    rows.append((i, hashes, counts))
                    held += len(hashes)
                if held >= BLOCK:
                    yield flush(got)
                    rows.clear()
                    held = 0
            if rows:
                yield flush(got)
                rows.clear()

    some = docs.select("doc_id", text_key().alias("text_key"), raw(F.col("text")).alias("text"))
    return some.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text_key binary, bands array<long>, samples binary")


def text_key():
    return F.unhex(F.md5(raw(F.col("text"))))


def _features(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """text_key, hashes and counts (packed) of the wanted texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Shingles()
        for got in batches:
            found = [made.of(t.as_py()) for t in got.column("text")]
            columns = [got.column("text_key"), pa.array([h.tobytes() for h, _ in found], pa.binary()), pa.array([c.astype("<i4").tobytes() for _, c in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["text_key", "hashes", "counts"])

    key = F.struct("doc_id", "text_key").alias("key")  # nulls equal nulls inside a struct
    texts = docs.select("doc_id", text_key().alias("text_key"), raw(F.col("text")).alias("text")).select("*", key)
    # one document stands for a text, and its repeated rows go while they are texts: shingles take more room
    wanted = wanted.groupBy("text_key").agg(F.min("doc_id").alias("doc_id")).select(key)
    texts = texts.where(_maybe(wanted)).join(wanted, "key", "left_semi").dropDuplicates(["key"]).select("text_key", "text")
    return texts.mapInArrow(run, "text_key binary, hashes binary, counts binary")


def _maybe(wanted: DataFrame) -> Column:
    """Whether a key has the hash slot of a wanted one: most other texts go where they are read, and are not shuffled.

    The slots are bits of a fixed number of words, one literal.
    """
    slot = F.xxhash64("key").bitwiseAND(F.lit((1 << WANTED_BITS) - 1))
    bits = wanted.select(F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, cast(xxhash64(key) & 63 AS INT))").alias("bit"))
    words = [0] * (1 << WANTED_BITS - 6)
    for word, some in bits.groupBy("word").agg(F.bit_or("bit").alias("some")).collect():  # at most one row per word
        words[word] = some
    held = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
    return F.expr("shiftleft(1L, cast(xxhash64(key) & 63 AS INT))").bitwiseAND(F.get(held, F.shiftright(slot, 6).cast("int"))) != 0


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sets of sorted distinct hashes with their weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    return float(shared / (a[1].sum() + b[1].sum() - shared))


def _verify(pairs: DataFrame, features: DataFrame, weights: np.ndarray, similarity: float) -> DataFrame:
    """The pairs (a, b) of text keys that are similar enough, with their similarity."""
    shared = pairs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_slot, last, one = shared.value, None, None

        def loaded(hashes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
            h = np.frombuffer(hashes, np.uint64)
            return h, by_slot[_slot(h)] * np.frombuffer(counts, "<i4")

        for got in batches:
            sims = []
            for k in range(got.num_rows):
                b = got.column("b")[k].as_py()
                if b != last:
                    last, one = b, loaded(got.column("b_hashes")[k].as_py(), got.column("b_counts")[k].as_py())
                sims.append(weighted_jaccard(loaded(got.column("a_hashes")[k].as_py(), got.column("a_counts")[k].as_py()), one))
            yield pa.RecordBatch.from_arrays([got.column("a"), got.column("b"), pa.array(sims, pa.float64())], ["a", "b", "sim"])

    def side(n: str) -> DataFrame:
        return features.select(F.col("text_key").alias(n), F.col("hashes").alias(f"{n}_hashes"), F.col("counts").alias(f"{n}_counts"))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_hashes", "a_counts", "b_hashes", "b_counts")
    return both.mapInArrow(run, "a binary, b binary, sim double").where(F.col("sim") >= similarity)


def fine_picks() -> np.ndarray:
    """The samples of each finer band, one row per band."""
    return np.array([np.random.default_rng(b).choice(BANDS * ROWS + FRESH, FINE_ROWS, replace=False) for b in range(FINE_BANDS)])


def _fine_keys(texts: DataFrame, features: DataFrame, weights: np.ndarray) -> DataFrame:
    """key and text_key of the finer bands of texts (text_key, samples), which are sampled further for them."""
    picks, shared = fine_picks(), texts.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_slot, sampler = shared.value, Sampler(FRESH, BANDS * ROWS)
        rows: list[tuple[int, np.ndarray, np.ndarray]] = []

        def flush(got: pa.RecordBatch) -> pa.RecordBatch:
            hashes = np.concatenate([h for _, h, _ in rows])
            starts = np.concatenate([[0], np.cumsum([len(h) for _, h, _ in rows])[:-1]])
            fresh = sampler(hashes, by_slot[_slot(hashes)] * np.concatenate([c for _, _, c in rows]), starts).astype(np.uint16)
            known = np.array([np.frombuffer(got.column("samples")[i].as_py(), np.uint16) for i, _, _ in rows])
            samples = np.concatenate([known, fresh], 1).astype(np.uint64)
            keys = np.arange(FINE_BANDS, dtype=np.uint64) * _M1 + np.zeros((len(rows), 1), np.uint64)
            for j in range(FINE_ROWS):
                keys = _mix((keys ^ samples[:, picks[:, j]]) * _M1)
            at = pa.array(np.repeat([i for i, _, _ in rows], FINE_BANDS))
            return pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), got.column("text_key").take(at)], ["key", "text_key"])

        for got in batches:
            held = 0
            for i in range(got.num_rows):
                hashes = np.frombuffer(got.column("hashes")[i].as_py(), np.uint64)
                rows.append((i, hashes, np.frombuffer(got.column("counts")[i].as_py(), "<i4")))
                held += len(hashes)
                if held >= BLOCK:
                    yield flush(got)
                    rows.clear()
                    held = 0
            if rows:
                yield flush(got)
                rows.clear()

    return texts.join(features, "text_key").mapInArrow(run, "key long, text_key binary")


def _buckets(texts: DataFrame) -> DataFrame:
    """key, band, text_key and n of the buckets of n texts, more than one."""
    keys = texts.select("text_key", F.posexplode("bands").alias("band", "hash"))
    keys = keys.select(F.xxhash64("band", "hash").alias("key"), "band", "text_key")
    return keys.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")


def _dealt(buckets: DataFrame) -> DataFrame:
    """The rows dealt to blocks (key, low, high): two parts of a large bucket, or one of them with itself; ``mine`` is a row's own part."""
    parts = F.ceil(F.col("n") / BLOCK_TEXTS).cast("int")
    rows = buckets.withColumn("mine", F.pmod(F.xxhash64("text_key"), parts).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rows.withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other")).drop("other", "n")


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block; they come sorted, so a block is a stretch that may run over batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for got in batches:
        names = np.stack([got.column(c).to_numpy() for c in ("key", "low", "high")], 1)
        edges = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1).tolist(), len(names)]
        for a, b in zip(edges[:-1], edges[1:]):
            if a == b:
                continue
            if held and tuple(names[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(names[a])
            held.append(got.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _plausible(block: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Agreeing samples of the pairs of a block, a strip of rows at a time with the number of its first row.

    Zero where a pair is not plausible, shares an earlier band, lies in one component, or has its place in another block.
    """
    x = np.frombuffer(b"".join(block.column("samples").to_pylist()), np.uint16).reshape(block.num_rows, BANDS * ROWS)
    band, mine = block.column("band")[0].as_py(), block.column("mine").to_numpy()
    _, part = np.unique(np.array([p.hex() for p in block.column("part").to_pylist()]), return_inverse=True)
    apart = block.column("low")[0].as_py() != block.column("high")[0].as_py()
    columns = np.ascontiguousarray(x.T)
    for s in range(0, len(x), STRIP):
        strip = slice(s, s + STRIP)
        same = np.zeros((len(x[strip]), len(x)), np.uint8)
        ok = part[strip, None] != part
        if apart:
            ok &= mine[strip, None] != mine
        for j in range(BANDS):
            whole = np.ones(same.shape, bool)
            for column in columns[j * ROWS : (j + 1) * ROWS]:
                equal = column[strip, None] == column
                same += equal
                whole &= equal
            if j < band:
                ok &= ~whole
        ok &= same >= PLAUSIBLE
        yield s, same * ok


def _partners(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of each text and the plausible partners of its bucket it is most alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            keys, pairs = block.column("text_key").to_pylist(), set()
            for s, same in _plausible(block):
                best = np.argsort(-same.astype(np.int16), 1, kind="stable")[:, :PARTNERS]
                for i, chosen in enumerate(best.tolist()):
                    pairs.update((max(keys[s + i], keys[j]), min(keys[s + i], keys[j])) for j in chosen if same[i, j])
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.binary()), pa.array([b for _, b in pairs], pa.binary())], ["a", "b"])

    return _together(rows).mapInArrow(run, "a binary, b binary").distinct()


def _unsettled(rows: DataFrame) -> DataFrame:
    """The rows of texts with a plausible partner of another component in their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            some = np.concatenate([same.any(1) for _, same in _plausible(block)])
            yield from block.filter(pa.array(some)).combine_chunks().to_batches()

    return _together(rows).mapInArrow(run, rows.schema)


def _settled(rows: DataFrame, weights: np.ndarray, similarity: float) -> DataFrame:
    """Links (a, b) between components, from all plausible pairs of rows with hashes and counts; the most alike come first."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_slot = shared.value
        for block in _blocks(batches):
            hashes = [np.frombuffer(h, np.uint64) for h in block.column("hashes").to_pylist()]
            sets = [(h, by_slot[_slot(h)] * np.frombuffer(c, "<i4")) for h, c in zip(hashes, block.column("counts").to_pylist())]
            sums = np.array([w.sum() for _, w in sets])
            joined = {p: p for p in block.column("part").to_pylist()}
            parts, keys = block.column("part").to_pylist(), block.column("text_key").to_pylist()
            ends = []
            for s, same in _plausible(block):
                i, j = np.nonzero(same)
                later = j > i + s
                ends.append(np.stack([same[i, j][later], i[later] + s, j[later]], 1).astype(np.int32))
            pairs = np.concatenate(ends)
            # no two texts are more alike than the smaller is large
            fit = np.minimum(sums[pairs[:, 1]], sums[pairs[:, 2]]) >= (similarity - 1e-9) * np.maximum(sums[pairs[:, 1]], sums[pairs[:, 2]])
            pairs = pairs[fit]
            found = []

            def root(p: bytes) -> bytes:
                while joined[p] != p:
                    joined[p] = p = joined[joined[p]]
                return p

            for i, j in pairs[np.argsort(-pairs[:, 0], kind="stable"), 1:].tolist():
                a, b = root(parts[i]), root(parts[j])
                if a != b and weighted_jaccard(sets[i], sets[j]) >= similarity:
                    joined[a] = b
                    found.append((max(keys[i], keys[j]), min(keys[i], keys[j])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["a", "b"])

    return _together(rows).mapInArrow(run, "a binary, b binary")


def links(texts: DataFrame, docs: DataFrame, weights: np.ndarray, similarity: float = SIMILARITY) -> DataFrame:
    """Verified links (a, b) between the text keys of ``texts`` (doc_id, text_key, bands, samples).

    They join what belongs together: two texts are linked here, or by way of others.
    """
    buckets = stored(_buckets(texts), "near-buckets")
    rows = stored(_dealt(buckets).join(texts.select("text_key", "samples"), "text_key"), "near-rows")
    pairs = stored(_partners(rows.withColumn("part", F.col("text_key"))), "near-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("text_key")).distinct()
    nodes = stored(texts.join(ends, "text_key", "left_semi").select("doc_id", "text_key"), "near-nodes")
    # who has a plausible partner has named one, so no other text is looked at again
    features = stored(_features(docs, nodes), "near-features")
    found = stored(_verify(pairs, features, weights, similarity).select("a", "b"), "near-links")
    part = components(nodes, found).select("text_key", F.col("label.text_key").alias("part"))
    left = stored(_unsettled(rows.join(part, "text_key")), "near-open")
    return found.union(_settled(left.join(features, "text_key"), weights, similarity)).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """text_key and ``label``, the first (doc_id, text_key) of its component.

    Every node with links goes over to the smallest label around it, and links with it, until none is left: links
    within one label go, so fewer are looked at in every round. The smallest of a component never moves.
    """
    own = F.struct("doc_id", "text_key").alias("label")
    ends = edges.select(F.col("a").alias("text_key")).union(edges.select(F.col("b").alias("text_key"))).distinct()
    labels = stored(nodes.join(ends, "text_key", "left_semi").select("text_key", own), "near-labels")
    if labels.isEmpty():
        return nodes.select("text_key", own)
    left = edges.join(labels.toDF("a", "a_label"), "a").join(labels.toDF("b", "b_label"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
    left = stored(left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
    while not left.isEmpty():
        goes = stored(left.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("label"), F.least("a", "near").alias("to")), "near-goes")
        # labels without links left are settled
        labels = stored(labels.join(goes, "label", "left").select("text_key", F.coalesce("to", "label").alias("label")), "near-labels")
        moved = left.join(goes.toDF("a", "a_to"), "a").join(goes.toDF("b", "b_to"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        left = stored(moved.where("a != b").distinct(), "near-edges")
    return nodes.select("text_key", own.alias("own")).join(labels, "text_key", "left").select("text_key", F.coalesce("label", "own").alias("label"))


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key) of all documents with words, and the class of each text as (text_key, label)."""
    df, documents = document_frequencies(docs)
    members = stored(sketches(docs, df, documents), "near-sketches")
    texts = stored(members.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("samples").alias("samples")), "near-texts")
    found = links(texts, docs, slot_weights(df, documents), similarity)
    return members.select("doc_id", "text_key"), stored(components(texts, found), "near-classes")


def find(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest id of its class) and kept.

    Texts without words are classes of their own.
    """
    members, labels = classes(docs, similarity)
    words = F.col("text").rlike(SAID)
    alone = docs.where(~F.coalesce(words, F.lit(False))).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    first = (F.col("label.text_key") == F.col("text_key")) & F.col("label.doc_id").eqNullSafe(F.col("doc_id"))
    return members.join(labels, "text_key").select("doc_id", F.col("label.doc_id").alias("class_id"), first.alias("kept")).union(alone)


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The first document of every class, all columns kept; of its repeated rows, one."""
    _, labels = classes(docs, similarity)
    first = labels.where(F.col("label.text_key") == F.col("text_key")).select(F.struct(F.col("label.doc_id").alias("doc_id"), "text_key").alias("key"))
    keyed = docs.select(whole_row(docs), F.struct("doc_id", text_key().alias("text_key")).alias("key"), F.col("text").alias("said"))
    some = F.coalesce(F.col("said").rlike(SAID), F.lit(False))
    kept = keyed.where(some).join(first, "key", "left_semi")
    repeated = keyed.where(some).groupBy("key").count().where("count > 1").select("key")
    once = kept.join(repeated, "key", "left_semi").groupBy("key").agg(F.min_by("doc", F.to_json("doc")).alias("doc")).select("doc.*")
    return kept.join(repeated, "key", "left_anti").select("doc.*").union(once).union(keyed.where(~some).select("doc.*"))


def query(spark, sf_dir):
    return find(table(spark, sf_dir, "documents").select("doc_id", "text"))
