"""Skewed inputs, and each distributed method against the plain one."""

import random

import numpy as np
import pytest
from helpers import entries, entry, notes
from pyspark.sql import functions as F

import keepsake.operators.nearest as nearest
from keepsake.operators import duplicates, hybrid, index
from keepsake.operators.embedders import BatchFunction, WordHash
from keepsake.session import broadcast_if_small, chunks_of


def grams(s):
    out = set()
    for w in "".join(c if c.isalnum() else " " for c in s.lower()).split():
        p = f"  {w} "
        out |= {p[i : i + 3] for i in range(len(p) - 2)}
    return out


def similar(a, b, t):
    ga, gb = grams(a), grams(b)
    return len(ga | gb) and float(np.float32(len(ga & gb) / len(ga | gb))) > t


@pytest.mark.parametrize("head", [64, 3])
def test_duplicates_against_brute_force(spark, monkeypatch, head):
    # short lists make the second pass do its part
    monkeypatch.setattr(duplicates, "HEAD", head)
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "alphas", "betas"]
    rows = []
    for i in range(120):
        # a third of all items share one title
        title = "The same title" if i % 3 == 0 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
        rows.append(("movie" if i % 2 else "person", f"e{i:03d}", title.upper() if i % 7 == 0 else title, i, i % 11 == 0))
    e = entries(spark, *[entry(i, kind=k, title=t, minutes=m // 2, archived_at=None if not a else __import__("helpers").T0) for k, i, t, m, a in rows])
    want = {}
    for k, i, t, m, a in rows:
        near = [(-(m2 // 2), i2) for k2, i2, t2, m2, a2 in rows if k2 == k and i2 != i and not a2 and (t2.lower() == t.lower() or similar(t, t2, 0.55))]
        for n, (_, other) in enumerate(sorted(near)[:5]):
            want[(i, n + 1)] = other
    got = {(r["id"], r["position"]): r["duplicate_id"] for r in duplicates.find_duplicates(e, e).collect()}
    assert got == want and len(got) > 300


def _vectors(spark, n, seed, copies=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 8))
    v[: copies] = v[0]
    return v, spark.createDataFrame([(f"v{i:04d}", [float(x) for x in r]) for i, r in enumerate(v)], "entry_id string, vec array<double>")


def test_nearest_both_ways_against_numpy(spark, monkeypatch):
    # a third of the corpus are copies of one vector
    v, corpus = _vectors(spark, 90, 1, copies=30)
    q, _ = _vectors(spark, 20, 2)
    q[0] = v[0]
    asked = spark.createDataFrame([(i, "p", [float(x) for x in r]) for i, r in enumerate(q)], "query_id int, provider string, vec array<double>")
    e = entries(spark, *[entry(f"v{i:04d}", archived_at=__import__("helpers").T0 if i % 9 == 8 else None) for i in range(90)])
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    dist = np.round(np.maximum(1 - unit(q) @ unit(v).T, 0), 9)
    want = set()
    for i in range(20):
        near = sorted((dist[i, j], f"v{j:04d}") for j in range(90) if j % 9 != 8 and dist[i, j] < 0.8)[:7]
        want |= {(i, n + 1, x) for n, (_, x) in enumerate(near)}
    run = lambda: {(r["query_id"], r["rank"], r["entry_id"]) for r in nearest.nearest(asked, corpus, e, "p", k=7, ceiling=0.8).collect()}
    assert run() == want
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 6)
    monkeypatch.setattr(nearest, "CORPUS_BLOCK", 16)
    assert run() == want
    assert nearest.nearest(asked, corpus, e, "other").count() == 0


def test_cutoffs(spark):
    rows = [(1, "a", 0.30, 1), (1, "b", 0.305, 2), (1, "c", 0.309, 3), (2, "a", 0.30, 1), (2, "b", 0.37, 2), (2, "c", 0.39, 3), (3, "a", 0.5, 1), (3, "b", 0.501, 2)]
    df = spark.createDataFrame(rows, "query_id int, entry_id string, dist double, rank int")
    assert {(r[0], r[1]) for r in nearest.cutoff(df).select("query_id", "entry_id").collect()} == {(2, "a"), (2, "b"), (3, "a"), (3, "b")}


def test_fusion_is_symmetric_and_post_filters(spark):
    e = entries(spark, entry("a"), entry("b"), entry("c", archived_at=__import__("helpers").T0))
    t = spark.createDataFrame([(1, "a", 5.0, 1), (1, "b", 3.0, 2), (2, "a", 2.0, 1)], "query_id int, id string, score double, position int")
    v = spark.createDataFrame([(1, "c", 1), (1, "b", 2), (1, "a", 3)], "query_id int, entry_id string, rank int")
    got = {(r["query_id"], r["id"]): (r["score"], r["via"]) for r in hybrid.fuse(t, v, e).collect()}
    assert got == {
        (1, "a"): (round(1 / 61 + 1 / 63, 9), "both"), (1, "b"): (round(1 / 62 + 1 / 62, 9), "both"), (2, "a"): (2.0, "text")}


def test_long_threads_are_cut_the_same_way(spark):
    rng = random.Random(9)
    e = entries(spark, entry("hot", title="T"), entry("cold", title="C", body="b" * 9000))
    many = [(f"n{i:04d}", "hot", "x" * rng.randint(1, 40), i // 3, "me") for i in range(1500)] + [("z", "cold", "never seen", 0, "me")]
    got = {r["id"]: r["text"] for r in index.embedding_text(e, notes(spark, *many)).collect()}
    whole = "\n".join(["T", "thought"] + [b for _, en, b, _, _ in sorted(many, key=lambda r: (r[3], r[0])) if en == "hot"])
    assert got["hot"] == whole[:8000] and got["cold"] == "\n".join(["C", "thought", "b" * 9000])[:8000]


def test_embedders(spark):
    texts = spark.createDataFrame([("a", "x"), ("b", "yy"), ("c", "zzz")], "id string, text string")
    fine = BatchFunction("len", lambda ts, role: [[float(len(t)), 1.0] for t in ts], batch_size=2)
    assert {r["id"]: r["vec"] for r in fine.embed(texts, "query").collect()} == {"a": [1.0, 1.0], "b": [2.0, 1.0], "c": [3.0, 1.0]}
    short = BatchFunction("bad", lambda ts, role: [[1.0]] * (len(ts) - 1), dimensions=1)
    with pytest.raises(Exception, match="vectors came back"):
        short.embed(texts, "document").collect()
    held = spark.createDataFrame([("a", "stub:8", [0.0] * 8)], "entry_id string, provider string, vec array<double>")
    index.check_space(held, WordHash(8))
    with pytest.raises(ValueError, match="rebuild"):
        index.check_space(held, WordHash(64))
    index.check_space(held, WordHash(64), rebuild=True)
    with pytest.raises(ValueError, match="dimensions"):
        index.check_space(held, WordHash(20000))


def test_sync_is_idempotent(spark):
    e = entries(spark, entry("a", title="one"), entry("b", title="two"), entry("c", title="gone", archived_at=__import__("helpers").T0))
    n = notes(spark, ("n", "a", "said", 1, "me"))
    none = spark.createDataFrame([], "entry_id string, provider string, vec array<float>, source_updated_at timestamp, embedded_at timestamp")
    stub = WordHash(16)
    first = index.sync(e, n, none, stub, F.lit("2024-02-01").cast("timestamp"))
    assert {r["entry_id"] for r in first.vectors.collect()} == {"a", "b"}
    again = index.sync(e, n, first.vectors, stub, F.lit("2024-02-02").cast("timestamp"))
    assert again.embedded.count() == 0 and again.vectors.count() == 2


def test_pieces_cover_a_table_once(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    parts = chunks_of(df, "k", 100)
    assert len(parts) > 5 and all(p.count() <= 100 for p in parts)
    assert sorted(r[0] for p in parts for r in p.collect()) == list(range(1000))
    assert "ResolvedHint" not in broadcast_if_small(df, 10)._jdf.queryExecution().analyzed().toString()


def test_cells_too_far_apart_are_not_compared(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    v = np.repeat(centres, 40, axis=0) + rng.normal(scale=0.05, size=(480, 16))
    rows = [(f"v{i:04d}", [float(x) for x in r]) for i, r in enumerate(v)] + [("zero", [0.0] * 16)]
    corpus = spark.createDataFrame(rows, "entry_id string, vec array<double>")
    e = entries(spark, *[entry(i) for i, _ in rows])
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 16)
    monkeypatch.setattr(nearest, "CORPUS_BLOCK", 32)
    seen = []
    keep = nearest.cells_that_may_meet
    monkeypatch.setattr(nearest, "cells_that_may_meet", lambda *a: seen.append(keep(*a)) or seen[-1])
    asked = corpus.select(F.col("entry_id").alias("query_id"), F.lit("p").alias("provider"), "vec")
    got = {(r["query_id"], r["rank"], r["entry_id"]) for r in nearest.nearest(asked, corpus, e, "p", k=5, ceiling=0.2).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    dist = np.round(np.maximum(1 - unit @ unit.T, 0), 9)
    want = {(f"v{i:04d}", n + 1, x) for i in range(480) for n, (_, x) in enumerate(sorted((dist[i, j], f"v{j:04d}") for j in range(480) if dist[i, j] < 0.2)[:5])}
    assert got == want
    assert seen[0].mean() < 0.5  # most pairs of cells are left out


def test_duplicates_never_shuffle_pairs(spark, monkeypatch):
    # 240 titles that share most of their trigrams; blocks of 40 titles on each side
    monkeypatch.setattr(duplicates, "BLOCK_TITLES", 40, raising=False)
    rng = random.Random(5)
    words = ["alpha", "alphas", "alphabet", "gamma", "gammas", "beta", "betas"]
    rows = [(f"e{i:03d}", f"{' '.join(rng.choices(words, k=rng.randint(2, 9)))} {i % 50}", i // 4) for i in range(240)]
    e = entries(spark, *[entry(i, kind="movie", title=t, minutes=m) for i, t, m in rows])
    want = {}
    for i, t, _ in rows:
        near = sorted((-m2, i2) for i2, t2, m2 in rows if i2 != i and (t2 == t or similar(t, t2, 0.55)))
        want |= {(i, n + 1): other for n, (_, other) in enumerate(near[:5])}
    found = duplicates.find_duplicates(e, e)
    assert {(r["id"], r["position"]): r["duplicate_id"] for r in found.collect()} == want and len(want) > 1000
    # titles meet in blocks: no join is made on trigrams
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "FlatMapCoGroupsInPandas" in plan


def test_nearest_blocks_piece_by_piece(spark, monkeypatch):
    # copies of one vector, a zero vector, and pieces far smaller than the ties
    v, _ = _vectors(spark, 60, 4, copies=20)
    v = v.astype(np.float32)
    v[59] = 0
    rows = [(f"v{i:04d}", [float(x) for x in r]) for i, r in enumerate(v)]
    corpus = spark.createDataFrame(rows, "entry_id string, vec array<float>")
    placed = nearest._placed(corpus, "entry_id", np.eye(8)[:2])
    # a vector travels as wide as it came
    assert placed.schema["vec"].dataType.simpleString() == "array<float>" and placed.count() == 59
    unit = v[:59].astype(float) / np.linalg.norm(v[:59].astype(float), axis=1, keepdims=True)
    dist = np.round(np.maximum(1 - unit @ unit.T, 0), 9)
    want = {(i, f"v{j:04d}") for i in range(59) for _, j in sorted((dist[i, j], j) for j in range(59) if dist[i, j] < 0.8)[:7]}
    monkeypatch.setattr(nearest, "QUERY_PIECE", 7)
    monkeypatch.setattr(nearest, "CORPUS_PIECE", 5)
    pdf = corpus.toPandas()
    got = nearest._block_top(pdf.rename(columns={"entry_id": "query_id"}), pdf.sample(frac=1, random_state=1), 7, 0.8)
    assert {(int(q[1:]), e) for q, e in zip(got["query_id"], got["entry_id"], strict=True)} == want and len(got) == len(want)
    # a piece of either side meets the other often enough to matter: blocks of both sides are alike
    assert nearest.QUERY_BLOCK == nearest.CORPUS_BLOCK
