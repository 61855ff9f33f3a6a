"""Nearest neighbours by multi-index hashing.

Codes are the signs of centred vectors under several rotations, each learned
(iterative quantisation) on a bounded sample. A code is cut into substrings of
sixteen bits; every block of rows keeps a table per substring, from value to rows. A
query within Hamming distance r of a row agrees with it in some substring up to
a distance of r / substrings, so probing the tables that far finds every code
within r; those are ranked by the cosine of the original vectors.

The radius is set where it reaches ``RECALL`` of the true neighbours of a
bounded number of rows, which are compared with every row for that. Queries
with too few rows in the radius are searched again without one. Queries meet
rows in packed blocks, and a block gives on at most ``k`` rows a query.

Edge cases: vectors that are null, of another length than most of the sample, zero, or
hold null or non-finite components take no part, nor do rows without id; rows of
the query's own id are not its candidates; repeated rows are candidates each; a repeated
query row is asked once, and queries of one id and different vectors have k ranks each; ties
go to the smaller id; an empty table has no results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keepsake.llm.common import table
from keepsake.session import stored

K = 5
EVERY = 50
SAMPLE, CALIBRATION = 4096, 96
ROTATIONS, ROUNDS = 4, 30
BITS = 16  # of a substring
RECALL = 0.97
ROW_BLOCK, QUERY_BLOCK = 8192, 512
BLOCK = "slot int, ids array<long>, vectors binary, codes binary, query_rows array<long>"
HITS = "query_row long, query_id long, vec_id long, score double"


def usable(rows: DataFrame) -> DataFrame:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col("embedding").cast("array<double>")
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, fine) & F.exists(v, lambda x: x != 0)).select("vec_id", v.alias("embedding"))


def learn(sample: np.ndarray, rotations: int = ROTATIONS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions x bits, bits a multiple of sixteen) of binary codes."""
    mean = sample.mean(0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    turned, parts = centred @ axes, []
    for seed in range(rotations):
        turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(turned @ turn > 0, 1.0, -1.0).T @ turned)
            turn = (u @ v).T
        parts.append(axes @ turn)
    both = np.concatenate(parts, 1)
    spare = -both.shape[1] % BITS
    return mean, np.concatenate([both, np.zeros((len(mean), spare))], 1)


def encode(vectors: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Codes as rows of sixteen-bit substrings; direction alone counts."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.packbits((unit - model[0]) @ model[1] > 0, axis=1).view(np.uint16)


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return rows @ query / (np.sqrt((rows * rows).sum(1)) * np.sqrt((query * query).sum()))


class Tables:
    """The substring tables of a block of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(c, kind="stable") for c in codes.T]
        self.values, self.starts = zip(*[np.unique(c[o], return_index=True) for c, o in zip(codes.T, self.order)])

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is at most ``radius`` away: by pigeonhole, then by all bits."""
        if radius >= self.codes.shape[1] * BITS:
            return np.arange(len(self.codes))
        n = self.codes.shape[1]
        near, extra = divmod(radius, n)
        seen = np.zeros(len(self.codes), bool)
        for j in range(n):
            # radius = n * near + extra: the first extra + 1 substrings need ``near``, the others one less
            most = near if j <= extra else near - 1
            hit = np.flatnonzero(np.bitwise_count(self.values[j] ^ code[j]) <= most)
            if len(hit):
                ends = np.append(self.starts[j][1:], len(self.codes))
                sizes = (ends - self.starts[j])[hit]
                at = np.repeat(self.starts[j][hit] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
                seen[self.order[j][at]] = True
        found = np.flatnonzero(seen)
        return found[np.bitwise_count(self.codes[found] ^ code).sum(1) <= radius]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def _blocks(rows: DataFrame, model, size: int) -> DataFrame:
    """Rows packed by task: ids, vectors as doubles and codes of up to ``size`` rows, of queries their numbers."""
    numbered = "query_row" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId()
        for got in batches:
            for at in range(0, got.num_rows, size):
                part = got.slice(at, size)
                vectors = np.array(part.column("embedding").to_pylist(), float)
                columns = [[slot], [part.column("vec_id").to_pylist()], [vectors.tobytes()], [encode(vectors, model).tobytes()]]
                columns.append([part.column("query_row").to_pylist() if numbered else None])
                types = (pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["slot", "ids", "vectors", "codes", "query_rows"])

    return rows.mapInArrow(run, BLOCK)


def _hits(found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*found)] or [[], [], [], []]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["query_row", "query_id", "vec_id", "score"])


def _probe(queries: DataFrame, index: DataFrame, slots: int, radius: int, dims: int, k: int) -> DataFrame:
    """The k nearest rows in the radius of every query in every block of the index."""
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), *[F.col(c).alias(f"q_{c}") for c in ("ids", "vectors", "codes")], "query_rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            for row in range(got.num_rows):
                one = {n: got.column(n)[row] for n in got.schema.names}
                ids, q_ids, q_rows = (np.asarray(one[n].values, np.int64) for n in ("ids", "q_ids", "query_rows"))
                vectors, q_vectors = (np.frombuffer(one[n].as_py()).reshape(-1, dims) for n in ("vectors", "q_vectors"))
                codes = np.frombuffer(one["codes"].as_py(), np.uint16).reshape(len(ids), -1)
                q_codes = np.frombuffer(one["q_codes"].as_py(), np.uint16).reshape(len(q_ids), -1)
                tables, found = Tables(codes), []
                for q_row, q_id, vector, code in zip(q_rows, q_ids, q_vectors, q_codes):
                    near = tables.within(code, radius)
                    near = near[ids[near] != q_id]
                    scores = cosines(vector, vectors[near])
                    top = _best(ids[near], scores, k)
                    found.append((np.full(len(top), q_row), np.full(len(top), q_id), ids[near][top], scores[top]))
                yield _hits(found)

    return asked.join(index.drop("query_rows"), "slot").mapInArrow(run, HITS)


def _top(hits: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_row", "query_id", "rank", "vec_id", "score")


def calibrate(rows: DataFrame, model, sample: list[tuple[int, np.ndarray]], k: int, recall: float = RECALL) -> int:
    """The radius that reaches ``recall`` of the true k neighbours of a few rows among all rows."""
    ids, vectors = np.array([i for i, _ in sample]), np.array([v for _, v in sample])
    codes = encode(vectors, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            theirs, x = got.column("vec_id").to_numpy(), np.array(got.column("embedding").to_pylist(), float)
            theirs_codes, found = encode(x, model), []
            for q_row, (q_id, vector, code) in enumerate(zip(ids, vectors, codes)):
                scores = np.where(theirs == q_id, -2.0, cosines(vector, x))
                top = _best(theirs, scores, k)
                top = top[scores[top] > -2]
                far = np.bitwise_count(theirs_codes[top] ^ code).sum(1)
                found.append((np.full(len(top), q_row), np.full(len(top), q_id), far, scores[top]))
            yield _hits(found)  # the distance stands in the place of the id

    far = [r["vec_id"] for r in _top(rows.mapInArrow(run, HITS), k).collect()]  # k rows for each of the few
    return int(np.ceil(np.quantile(far, recall))) if far else model[1].shape[1]


def search(rows: DataFrame, queries: DataFrame, k: int = K, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest ``rows`` of every query."""
    rows, queries = usable(rows), usable(queries)
    picked = rows.withColumn("h", F.xxhash64("vec_id", "embedding"))
    share = SAMPLE / max(SAMPLE, picked.count())
    picked = picked.where(F.pmod("h", F.lit(1_000_000)) < int(share * 1_000_000)).limit(2 * SAMPLE)
    sample = sorted((r["h"], r["vec_id"], r["embedding"]) for r in picked.collect())  # bounded by SAMPLE, and by the limit should hashes clash
    if not sample:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    lengths = [len(v) for _, _, v in sample]
    dims = max(sorted(set(lengths)), key=lengths.count)
    rows, queries = (t.where(F.size("embedding") == dims) for t in (rows, queries))
    known = [(i, np.array(v)) for _, i, v in sample if len(v) == dims]
    model = learn(np.array([v / np.linalg.norm(v) for _, v in known]))
    radius = calibrate(rows, model, known[:CALIBRATION], k, recall)
    slots = max(1, rows.rdd.getNumPartitions())
    queries = stored(queries.distinct().withColumn("query_row", F.monotonically_increasing_id()), "neighbour-asked")
    index = stored(_blocks(rows, model, ROW_BLOCK), "neighbour-index")
    asked = stored(_blocks(queries, model, QUERY_BLOCK), "neighbour-queries")
    found = stored(_top(_probe(asked, index, slots, radius, dims, k), k), "neighbours")
    full = found.groupBy("query_row").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    few = queries.join(full, "query_row", "left_anti")
    if few.isEmpty():
        return found.drop("query_row")
    wider = _top(_probe(_blocks(few, model, QUERY_BLOCK), index, slots, model[1].shape[1], dims, k), k)
    return found.join(full, "query_row", "left_semi").union(wider).drop("query_row")


def query(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % EVERY == 0))
