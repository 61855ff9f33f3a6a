"""Vector codes against the same rounds in plain Python."""

import math
import random

import numpy as np

from keepsake.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, v int, key string"


def plain(rows, rounds=6, parts=8, size=16):
    """(vec_id, code, error) of every usable row, and the books."""
    kept = [(i, [math.floor(x * 4096) if abs(x) < 2**52 else int(x) * 4096 for x in v], label) for i, v, label in rows]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:size]] for p in range(parts)]

    def pick(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            named = [(pick(v, p)[1], cut(v, p)) for _, v, _ in kept]
            moved = []
            for k, entry in enumerate(books[p]):
                mine = [x for j, x in named if j == k]
                moved.append([sum(c) // len(mine) for c in zip(*mine)] if mine else entry)
            new.append(moved)
        books = new
    out = []
    for i, v, label in kept:
        found = [pick(v, p) for p in range(parts)]
        error = sum(d for d, _ in found)
        out.append((i, "".join(f"{k:02x}" for _, k in found), error if error < 2**63 else None))
    return sorted(out, key=repr), books


def run(spark, rows, n=4):
    df = spark.createDataFrame([(i, v, label, "x", 1, "y") for i, v, label in rows], SCHEMA).repartition(n)
    measured, model = codes.fit(df)
    return sorted((tuple(r) for r in codes.encode(measured, model).select("vec_id", "code", "error").collect()), key=repr), model


def numbers(n, dims=16, seed=1, scale=1.0):
    r = random.Random(seed)
    return [(i, [r.gauss(0, scale) for _ in range(dims)], r.choice([None, 1, 2])) for i in range(n)]


def test_same_as_plain_rounds(spark):
    rows = numbers(150)
    rows += [(7, rows[7][1], 1), (7, rows[8][1], 2), (None, rows[3][1], None), (500, [0.0] * 16, 3)]  # repeats, equal ids, no id
    bad = [(1000, None, 1), (1001, [None] * 16, 1), (1002, [math.nan] + [0.0] * 15, 1), (1003, [math.inf] * 16, 1), (1004, [1.0], 1), (1005, [], 1)]
    got, model = run(spark, rows + bad)
    want, books = plain(rows)
    assert got == want
    assert [b.tolist() for b in model[0]] == books


def test_ties_go_to_the_lower_entry(spark):
    rows = [(i, [float(i % 2)] * 16, 0) for i in range(20)]
    got, model = run(spark, rows)
    want, books = plain(rows)
    assert got == want
    assert {c for _, c, _ in got} == {"00" * 8, "01" * 8}
    assert [b.tolist() for b in model[0]] == books


def test_few_rows_and_very_large_components(spark):
    rows = numbers(3, seed=2) + [(9, [3e38, -3e38] * 8, 1), (10, [1e300] * 16, 1), (11, [1e308] * 16, 1)]
    got, _ = run(spark, rows)
    assert got == plain(rows)[0]
    rows = numbers(40, seed=3, scale=1e6)
    assert run(spark, rows)[0] == plain(rows)[0]


def test_bounds_leave_entries_out_and_none_that_matters():
    r = np.random.default_rng(0)
    centres = r.integers(-4000, 4000, (16, 8))
    x = centres[r.integers(0, 16, 3000)] + r.integers(-200, 200, (3000, 8))
    pivots = centres[:3]
    best, least, taken = codes.nearest(x, codes.lengths(x, pivots), centres, pivots)
    far = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert (best == far.argmin(1)).all() and (least == far.min(1)).all()
    assert taken < 0.4 * far.size


def test_lengths_that_parts_do_not_divide(spark):
    assert codes.cut(10, 8) == [(0, 2), (2, 4), (4, 5), (5, 6), (6, 7), (7, 8), (8, 9), (9, 10)]
    got, _ = run(spark, numbers(30, dims=5))
    assert all(len(c) == 16 and c.endswith("00" * 3) for _, c, _ in got)


def test_empty_and_no_usable_row(spark):
    assert codes.fit(spark.createDataFrame([], SCHEMA))[1] is None
    assert codes.fit(spark.createDataFrame([(1, None, 1, "", 1, "")], SCHEMA))[1] is None


def test_label_errors(spark, monkeypatch):
    rows = [(i, f"{i:02x}", i, None if i % 3 == 0 else i % 3) for i in range(30)]
    coded = spark.createDataFrame(rows, "vec_id long, code string, error long, label int")
    want = {}
    for _, _, e, label in rows:
        want[label] = want.get(label, 0) + e
    for small in (True, False):
        if not small:
            monkeypatch.setattr(codes, "broadcast_if_small", lambda df: df)
        got = codes._with_label_error(coded).collect()
        assert len(got) == 30 and all(r["label_error"] == want[r["label"]] for r in got)


def test_parts_without_stored_distances_are_compared_with_all():
    r = np.random.default_rng(1)
    x, centres = r.integers(-99, 99, (50, 4)), r.integers(-99, 99, (16, 4))
    unknown = np.full((50, 3), np.nan)
    best, least, taken = codes.nearest(x, unknown, centres, centres[:3])
    far = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert (best == far.argmin(1)).all() and taken == far.size
