"""Vector code compression: product codes in whole numbers, entries found with LAESA pivots.

Components become floor(4096 * x); a vector is cut into parts side by side, and each
part is named by the nearest entry of its position's codebook. Codebooks start as the parts
of the smallest ids and move to the floored mean of their parts, round by round.

The entries are found as in LAESA. The first entries of each codebook are its pivots and never
move; every part's distances to them are worked out once and stored beside the vector. A round
works out the few distances from pivots to entries; by the triangle inequality their
differences to a part's stored distances bound the part's distance to each entry from below.
Entries are taken by ascending bound, and a part is done when the next bound exceeds
its best exact distance. Bounds carry a margin for rounding, so entries left out are farther;
distances compared are exact integers.

A round adds up a sum and a count per task, position and entry; what reaches the
driver is one row per entry.

Edge cases: rows whose vector is null, or holds null or non-finite components,
are dropped, and so are vectors of another length than the most common one
(of equally common ones the shortest), and empty vectors; where the length is no multiple
of the parts, the first parts are one longer, and positions without components have
code 00. A null id sorts last; equal ids sort by vector; repeated rows are rows each. With fewer rows
than entries the codebook has as many entries as rows. Components beyond 2**26 are worked on as
Python integers; an error beyond 64 bits is null. An empty table has no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import table
from keepsake.session import broadcast_if_small, stored

SCALE, PARTS, ENTRIES, ROUNDS, PIVOTS = 4096, 8, 16, 6, 3
# Largest size of a component for which squares and sums fit 64 bits at any usual length.
SAFE = 1 << 26
SALTS = 32


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label and the vector, of one length."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = rows.select("vec_id", "label", F.col("embedding").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", fine))
    common = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return kept.where(F.size("v") == (common["n"] if common else 1))


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(4096 * x) as 64-bit integers, or as Python integers where those are too large."""
    if np.abs(vectors).max(initial=0) <= SAFE // SCALE:
        return np.floor(vectors * float(SCALE)).astype(np.int64)
    # beyond 2**52 a double is a whole number, and scaling it might overflow
    exact = [[int(x) * SCALE if abs(x) > 2.0**52 else math.floor(x * SCALE) for x in row] for row in vectors.tolist()]
    return np.array(exact, object).reshape(vectors.shape)


def cut(width: int, parts: int = PARTS) -> list[tuple[int, int]]:
    sizes = [width // parts + (p < width % parts) for p in range(parts)]
    ends = np.cumsum(sizes).tolist()
    return [(e - s, e) for s, e in zip(sizes, ends)]


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    gap = x - y
    return (gap * gap).sum(1)


def lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances as doubles, rows of x by rows of y; none (NaN) where they may not fit."""
    if object in (x.dtype, y.dtype):
        return np.full((len(x), len(y)), np.nan)
    return np.stack([np.sqrt(squares(x, one).astype(float)) for one in y], 1)


def nearest(parts: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Per part the index of its nearest entry and its squared distance, ties to the lower index; and how many distances that took.

    Parts beyond 64 bits have no bounds: there every distance is worked out.
    """
    if object in (parts.dtype, entries.dtype, pivots.dtype):
        far = np.stack([squares(parts, e) for e in entries], 1).astype(object)
        best = np.array([min(range(len(entries)), key=row.__getitem__) for row in far.tolist()], int)
        return best, far[np.arange(len(parts)), best], far.size
    from_pivots = lengths(entries, pivots)
    bounds = np.abs(to_pivots[:, None, :] - from_pivots[None]).max(2)
    # a few units in the last place of either distance, far below a unit of the grid for usual vectors
    bounds -= 1e-9 * (1 + to_pivots.max(1)[:, None] + from_pivots.max(1)[None])
    bounds[np.isnan(bounds)] = 0.0
    order = np.argsort(bounds, axis=1, kind="stable")
    best = order[:, 0].copy()
    least = squares(parts, entries[best])
    open_, taken = np.arange(len(parts)), len(parts)
    for rank in range(1, len(entries)):
        near = bounds[open_, order[open_, rank]] <= np.sqrt(least[open_].astype(float)) * (1 + 1e-12)
        open_ = open_[near]  # later entries have larger bounds still
        if not len(open_):
            break
        entry = order[open_, rank]
        far = squares(parts[open_], entries[entry])
        taken += len(open_)
        better = (far < least[open_]) | ((far == least[open_]) & (entry < best[open_]))
        best[open_[better]], least[open_[better]] = entry[better], far[better]
    return best, least, taken


def _vectors(got: pa.RecordBatch, width: int) -> np.ndarray:
    return whole(np.asarray(got.column("v").flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width))


def _measured(rows: DataFrame, pivots: list[np.ndarray], spans: list[tuple[int, int]], width: int) -> DataFrame:
    """The rows with their parts' distances to the pivots, by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            if not got.num_rows:
                continue
            x = _vectors(got, width)
            far = np.concatenate([lengths(x[:, a:b], p) for (a, b), p in zip(spans, pivots)], 1)
            column = pa.FixedSizeListArray.from_arrays(pa.array(far.ravel()), far.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*got.columns, column], [*got.schema.names, "pivots"])

    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{own}, pivots array<double>")


def _assigned(got: pa.RecordBatch, books: list[np.ndarray], pivots: list[np.ndarray], spans: list[tuple[int, int]], width: int):
    x = _vectors(got, width)
    far = np.asarray(got.column("pivots").flatten()).reshape(len(x), -1)
    at = 0
    for (a, b), book, own in zip(spans, books, pivots):
        yield x[:, a:b], *nearest(x[:, a:b], far[:, at : at + len(own)], book, own)
        at += len(own)


def _sums(rows: DataFrame, books, pivots, spans, width: int) -> DataFrame:
    """part, entry, n, sums and taken: one row per position and entry of a task, then of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(spans), ENTRIES), np.int64)
        sums = [[[0] * (b - a) for _ in range(ENTRIES)] for a, b in spans]
        taken = [0] * len(spans)
        for got in batches:
            if not got.num_rows:
                continue
            for p, (x, best, _, some) in enumerate(_assigned(got, books, pivots, spans, width)):
                n[p] += np.bincount(best, minlength=ENTRIES)
                taken[p] += some
                for e in np.unique(best):
                    # Python integers, so that sums never wrap
                    sums[p][e] = [s + int(t) for s, t in zip(sums[p][e], x[best == e].sum(0))]
        made = [(p, e, int(n[p, e]), [str(s) for s in sums[p][e]], taken[p] if e == 0 else 0) for p in range(len(spans)) for e in range(ENTRIES) if n[p, e]]
        columns = list(zip(*made)) or [[]] * 5
        types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["part", "entry", "n", "sums", "taken"])

    per = rows.mapInArrow(run, "part int, entry int, n long, sums array<string>, taken long")

    def add(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        sums = [str(sum(map(int, column))) for column in zip(*some["sums"])]
        return pd.DataFrame([(*key, some["n"].sum(), sums, some["taken"].sum())], columns=list(some.columns))

    # a group has one row per task; Python integers again
    return per.groupBy("part", "entry").applyInPandas(add, per.schema)


def _moved(sums: DataFrame, books: list[np.ndarray], spans) -> list[np.ndarray]:
    """The books after a round: floored means, unused entries as they were."""
    out = [[list(map(int, e)) for e in book] for book in books]
    for r in sums.collect():  # one row per entry at most
        out[r["part"]][r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
    return [_array(book, b - a) for book, (a, b) in zip(out, spans)]


def _array(rows: list[list[int]], width: int) -> np.ndarray:
    large = any(abs(x) > SAFE for row in rows for x in row)
    return np.array(rows, object if large else np.int64).reshape(len(rows), width)


def fit(rows: DataFrame, rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES, pivots: int = PIVOTS):
    """The stored rows with their distances to pivots, and the model (books, pivots, spans, width); None for an empty table."""
    kept = usable(rows)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return kept, None
    start = whole(np.array([r["v"] for r in first], float))
    spans, width = cut(start.shape[1], parts), start.shape[1]
    books = [start[:, a:b] for a, b in spans]
    fixed = [book[:pivots] for book in books]
    measured = stored(_measured(kept, fixed, spans, width), "codes-measured")
    for _ in range(rounds):
        books = _moved(_sums(measured, books, fixed, spans, width), books, spans)
    return measured, (books, fixed, spans, width)


def encode(measured: DataFrame, model) -> DataFrame:
    """vec_id, label, code and error of every stored row."""
    books, fixed, spans, width = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            if not got.num_rows:
                continue
            codes, errors = [], 0
            for _, best, least, _ in _assigned(got, books, fixed, spans, width):
                codes.append(best.astype(np.uint8))
                errors = errors + least
            names = [c.tobytes().hex() for c in np.stack(codes, 1)]
            fits = [int(e) if int(e) < 1 << 63 else None for e in errors]
            yield pa.RecordBatch.from_arrays([got.column("vec_id"), got.column("label"), pa.array(names), pa.array(fits, pa.int64())], ["vec_id", "label", "code", "error"])

    return measured.mapInArrow(run, "vec_id long, label int, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for book in books for entry in book for x in entry).encode()).hexdigest()


def _with_label_error(coded: DataFrame) -> DataFrame:
    """Each row with the error of all rows of its label: sums are worked out before they meet the rows.

    More labels than fit a broadcast meet their rows in ``SALTS`` parts, so that no label's rows gather in one task.
    """
    salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")
    key = F.struct("label")  # null labels are equal as parts of a struct
    rows = coded.select("*", key.alias("key"), salt.alias("salt"))
    sums = coded.groupBy(key.alias("key")).agg(F.sum("error").alias("label_error"))
    small = broadcast_if_small(sums)
    if small is not sums:
        return rows.join(small, "key", "left")
    return rows.join(sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "salt"], "left")


def query(spark, sf_dir):
    measured, model = fit(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    if model is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = stored(encode(measured, model), "codes")
    return _with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(model[0])).alias("codebooks_sha256"))


def _sql() -> str:
    """The same rounds as common table expressions."""
    gap = "list_sum(list_transform(range(1, len(e.x) + 1), lambda i: (a.x[i] - e.x[i]) * (a.x[i] - e.x[i])))::bigint"
    pick = "select r, a.p, a.x, min(({d}) * {n}::hugeint + e.k) m from a join {book} e on e.p = a.p group by r, a.p, a.x"
    parts = [f"""with v as materialized (select row_number() over (order by vec_id nulls last, embedding) - 1 r, vec_id, label, list_transform(embedding, lambda z: floor(z::double * {SCALE})::bigint) x
  from embeddings where embedding is not null and len(list_filter(embedding, lambda z: z is null or not isfinite(z))) = 0 and len(embedding) > 0),
a as materialized (select r, p, x[p * len(x) // {PARTS} + 1 : (p + 1) * len(x) // {PARTS}] x from v, range({PARTS}) t(p)),
b0 as materialized (select p, r k, x from a where r < {ENTRIES})"""]
    for i in range(ROUNDS):
        parts.append(f"""n{i} as materialized (select r, p, x, (m % {ENTRIES})::bigint k from ({pick.format(d=gap, n=ENTRIES, book=f'b{i}')})),
s{i} as (select p, k, i, sum(x[i])::hugeint s, count(*) c from n{i}, range(1, 1 + (select max(len(x)) from a)) t(i) where i <= len(x) group by all),
m{i} as (select p, k, list(((s - ((s % c) + c) % c) // c)::bigint order by i) x from s{i} group by all),
b{i + 1} as materialized (select b.p, b.k, coalesce(m.x, b.x) x from b{i} b left join m{i} m on m.p = b.p and m.k = b.k)""")
    parts.append(f"""f as materialized (select r, p, (m % {ENTRIES})::bigint k, (m // {ENTRIES})::bigint d from ({pick.format(d=gap, n=ENTRIES, book=f'b{ROUNDS}')})),
c as materialized (select vec_id, label, string_agg(lpad(lower(to_hex(k)), 2, '0'), '' order by p) code, sum(d)::bigint error from f join v using (r) group by r, vec_id, label),
h as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, k)) codebooks_sha256 from b{ROUNDS})
select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, codebooks_sha256 from c, h""")
    return ",\n".join(parts)


SQL = _sql()
