"""Whole-row operators on tables whose other columns have awkward names and types; classifiers without classes."""

import math
import random

import numpy as np
import pytest

from keepsake.llm import decontamination, line_dedup, mixing, near_dedup, quality, toxicity

EXTRA = ["a.b", "doc", "key", "toxicity", "quality", "label", "__text", "raw_text", "h", "text_key", "words", "gone", "row", "copies", "slot", "sp ace", "b`t"]
r = random.Random(5)
VOCABULARY = ["".join(r.choice("abdeilnorstu") for _ in range(r.randint(2, 7))) for _ in range(300)]


def prose(n, seed):
    q = random.Random(seed)
    return " ".join(q.choice(VOCABULARY) for _ in range(n))


def odd(spark, rows):
    """doc_id, text, source, a map and a column for every awkward name."""
    schema = "doc_id long, text string, source string, m map<string,int>, " + ", ".join("`" + c.replace("`", "``") + "` string" for c in EXTRA)
    return spark.createDataFrame([(i, t, "s", {"k": 1}, *[f"{c}{i}" for c in EXTRA]) for i, t in rows], schema)


ROWS = [(1, prose(50, 1)), (2, prose(50, 1)), (3, prose(40, 3) + "\n" + prose(12, 4)), (4, prose(12, 4)), (5, None), (6, ""), (7, "vile stuff " * 9), (7, "vile stuff " * 9)]


def same_rows(got, docs, ids):
    assert got.columns == docs.columns
    kept = sorted((row["doc_id"], row["text"], row["a.b"], row["toxicity"], row["m"]["k"]) for row in got.collect())
    assert [k[0] for k in kept] == ids
    assert all(k[2] == f"a.b{k[0]}" and k[3] == f"toxicity{k[0]}" and k[4] == 1 for k in kept)


def test_whole_rows_survive(spark):
    docs = odd(spark, [(i, t or "") for i, t in ROWS])
    bench = spark.createDataFrame([(1, ROWS[3][1])], "item_id long, text string")
    same_rows(near_dedup.deduplicate(docs), docs, [1, 3, 4, 5, 6, 7])
    same_rows(decontamination.remove(docs, bench), docs, [1, 2, 5, 6, 7, 7])
    assert decontamination.remove_spans(docs, bench).columns == docs.columns
    same_rows(line_dedup.remove(docs), docs, [1, 2, 3, 4, 5, 6, 7, 7])
    assert mixing.expand(docs).columns == docs.columns


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int, quality int")


def test_scores_keep_other_columns(spark):
    docs = odd(spark, ROWS)
    many = odd(spark, [(i, prose(30, i) + " vile stuff vile stuff" * (i % 2)) for i in range(300)])
    marks = labels(spark, [(i, i % 2, 1 - i % 2) for i in range(300)])
    model = toxicity.train(many, marks)
    scored = toxicity.score(docs, model)
    found = {row["doc_id"]: row["toxicity"] for row in scored.collect()}
    assert found[7] > max(found[1], found[3])
    same_rows(toxicity.reject(docs, model, found[7]), docs, [i for i, _ in ROWS if found[i] < found[7]])
    assert sorted(scored.columns) == sorted(docs.columns) and dict(scored.dtypes)["toxicity"] == "double"
    own = quality.score(docs, quality.train(many, marks), "good")
    assert own.columns == [*docs.columns, "good"] and all(0 <= row["good"] <= 1 and row["quality"].startswith("quality") for row in own.collect())


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, 1, 1), (7, 1, 1)], [(1, 0, 0), (2, 0, 0)]])
def test_without_both_classes(spark, rows):
    docs = odd(spark, ROWS)
    model = toxicity.train(docs, labels(spark, rows))
    assert {row["s"] for row in toxicity.score(docs, model, "s").collect()} == {0.0}
    assert toxicity.reject(docs, model).count() == len(ROWS)
    if not any(q == 1 for _, _, q in rows):
        assert {row["s"] for row in quality.score(docs, quality.train(docs, labels(spark, rows)), "s").collect()} == {0.5}


def test_ftrl_is_the_plain_loop():
    g = random.Random(2)
    rows = [np.array(sorted(g.sample(range(64), g.randint(0, 12))), np.int64) for _ in range(60)]
    y = np.array([float(len(set(x.tolist()) & set(range(9))) > 1) for x in rows])
    alpha, beta, l1, l2, epochs = 0.2, 1.0, 0.6, 0.1, 3
    z, n = [0.0] * 65, [0.0] * 65

    def weight(i):
        pull = 0.0 if i == 64 else l1
        if abs(z[i]) <= pull:
            return 0.0
        return -(z[i] - math.copysign(pull, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            used = [*rows[k].tolist(), 64]
            ws = {i: weight(i) for i in used}
            gradient = 1 / (1 + math.exp(-sum(ws.values()))) - y[k]
            for i in used:
                z[i] += gradient - (math.sqrt(n[i] + gradient**2) - math.sqrt(n[i])) / alpha * ws[i]
                n[i] += gradient**2
    slots, weights, bias = toxicity.fit_ftrl(rows, y, 6, epochs, alpha, beta, l1, l2)
    want = {i: weight(i) for i in range(64) if weight(i)}
    assert slots.tolist() == sorted(want) and np.allclose(weights, [want[i] for i in slots]) and math.isclose(bias, weight(64), rel_tol=1e-9)
    assert 0 < len(want) < 64


def test_pu_fit_has_least_risk_around():
    g = np.random.default_rng(3)
    good, bad = g.normal(1, 1, (150, 3)), g.normal(-1, 1, (150, 3))
    positive, unlabelled = (np.concatenate([x, np.ones((len(x), 1))], 1) for x in (good, np.concatenate([good[:60], bad])))

    def risk(w):
        s = lambda x: 1 / (1 + np.exp(-(x @ w)))
        rest = s(unlabelled).mean() - 0.3 * s(positive).mean()
        return 0.3 * (1 - s(positive)).mean() + max(0.0, rest) + quality.DECAY * (w @ w) / 2

    w = quality.fit_pu(positive, unlabelled, 0.3)
    assert risk(w) < risk(np.zeros(4)) and risk(w) < risk(-w)
    steps = [g.normal(0, 0.5, 4) for _ in range(200)]
    assert np.mean([risk(w + d) >= risk(w) - 1e-3 for d in steps]) > 0.9
    assert (bad @ w[:3] + w[3] < 0).mean() > 0.85 and (good @ w[:3] + w[3] > 0).mean() > 0.85


def test_near_dedup_links_a_group_around_the_threshold(spark):
    base = prose(220, 40).split()
    texts = []
    for k in range(36):  # from nearly equal to quite different
        q, words = random.Random(k), list(base)
        for at in q.sample(range(len(words)), k // 3):
            words[at] = f"other{k}x{at}"
        texts.append(" ".join(words))
    texts += [prose(80, 900 + k) for k in range(20)] + [texts[4], texts[4].upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df, n = near_dedup.document_frequencies(docs)
    weights, made = near_dedup.slot_weights(df, n), near_dedup.Shingles()
    sets = [(h, weights[near_dedup._slot(h)] * c) for h, c in (made.of(t.encode()) for t in texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    linked = 0
    for i in range(len(texts)):
        for j in range(i):
            if near_dedup.weighted_jaccard(sets[i], sets[j]) >= near_dedup.SIMILARITY:
                a, b = sorted((find(i), find(j)))
                root[b] = a
                linked += 1
    got = {row["doc_id"]: row["class_id"] for row in near_dedup.find(docs).collect()}
    assert got == {i: find(i) for i in range(len(texts))} and 50 < linked < 600
