"""What the operators compare, send and keep stays in proportion to their rows."""

from __future__ import annotations

import glob
import os
import time

import numpy as np
import pyarrow as pa

from keepsake.llm import common, line_dedup, near_dedup
from keepsake.session import stored


def near_group(texts: int, words: int, changed: int) -> list[tuple[int, str]]:
    """Texts that differ from one base, and so from each other, in a few words."""
    draws = np.random.default_rng(7)
    base = [f"w{k}" for k in range(words)]
    rows = []
    for i in range(texts):
        own = list(base)
        for at in draws.choice(words, changed, replace=False):
            own[at] = f"x{i}y{at}"
        rows.append((i, " ".join(own)))
    return rows


def brute_classes(docs, rows, similarity=near_dedup.SIMILARITY):
    df, n = near_dedup.document_frequencies(docs)
    weights, made = near_dedup.slot_weights(df, n), near_dedup.Shingles()
    sets = [(h, weights[near_dedup._slot(h)] * c) for h, c in (made.of(t.encode()) for _, t in rows)]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and near_dedup.weighted_jaccard(sets[i], sets[j]) >= similarity:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return {i: rows[x][0] for (i, _), x in zip(rows, label)}


def test_a_group_below_the_threshold_is_not_verified_pair_by_pair(spark, monkeypatch):
    rows, sent = near_group(200, 300, 5), []
    real = near_dedup._verify

    def counted(pairs, *rest):
        sent.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(near_dedup, "_verify", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.find(docs).collect()}
    assert sum(sent) < 4000 < len(rows) * (len(rows) - 1) // 2
    assert got == brute_classes(docs, rows)


def test_a_bucket_of_several_blocks_gives_the_same_classes(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", 8)
    rows = near_group(60, 120, 2) + [(i + 1000, t.replace("w", "v")) for i, t in near_group(50, 120, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.find(docs).collect()}
    assert got == brute_classes(docs, rows)


def test_scores_see_pieces_and_each_text_once(spark):
    rows = [(i, f"text {i}" if i % 7 else None) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)

    def scores(batches):
        for got in batches:
            assert got.schema.names == ["text"] and all(t.as_py() is not None for t in got.column("text"))
            yield pa.array([float(got.num_rows)] * got.num_rows)

    out = common.with_score(docs, "s", scores)
    found = out.collect()
    assert sorted((r["doc_id"], r["text"]) for r in found) == rows and max(r["s"] for r in found) <= 1024


def test_long_lines_that_meet_by_chance_are_not_verified(spark, monkeypatch):
    draws, pairs = np.random.default_rng(11), []
    lines = [[f"w{w}" for w in draws.choice(2000, 140, replace=False)] for _ in range(150)]
    lines += [x[:-2] + ["one", "two"] for x in lines[:5]]
    real = line_dedup.stored

    def seen(df, name, *rest, **more):
        table = real(df, name, *rest, **more)
        if name == "line-pairs":
            pairs.append(table.count())
        return table

    monkeypatch.setattr(line_dedup, "stored", seen)
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_links"], r["removed"]) for r in line_dedup.find(docs).collect()}
    assert got == {i: (1, i >= 150) if i < 5 or i >= 150 else (0, False) for i in range(155)}
    assert pairs[0] < 10


def test_shuffles_of_a_table_stored_alone_go(spark):
    folder = spark.conf.get("spark.local.dir", os.environ.get("SPARK_LOCAL_DIRS", "/tmp"))
    there = lambda: set(glob.glob(f"{folder}/**/shuffle_*.data", recursive=True))
    before, asked = there(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    table = stored(spark.range(5000).selectExpr("id % 999 AS k").groupBy("k").count(), "alone", alone=True)
    for _ in range(40):
        if not (left := there() - before):
            break
        time.sleep(0.25)
    assert not left and table.count() == 999
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == asked
