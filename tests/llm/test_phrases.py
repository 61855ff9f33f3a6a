"""Collocations against plain counting, whole and in small pieces."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from keepsake.llm import phrases

SCHEMA = "doc_id long, text string, lang string, words string, state int, n int"


def plain(rows, least, longest=5, top=2000):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n, found = totals[lang], []
        fine = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = {}
        for p, a in fine.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    covered[p[i : i + k]] = max(covered.get(p[i : i + k], 0), a)
        for p, a in fine.items():
            if covered.get(p, 0) >= a:
                continue
            score, j = min((1000 * a * n // (f[p[:j]] * f[p[j:]]), j) for j in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:j]], f[p[j:]]))
        found.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(found[:top])]
    return sorted(out)


def rows_of(seed=3, n=250):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Été", "ÀÉ", "x\x85y", "#", "naïve"]
    weights = [1 / (i + 1) for i in range(len(words))]
    out = []
    for i in range(n):
        some = r.choices(words, weights, k=r.randint(0, 40))
        if i % 3 == 0:
            some[5:5] = "of the long white road".split()
        text = "".join(w + r.choice([" ", "  ", "\t", " ", ", ", ".", "\n", " "]) for w in some)
        out.append((text.upper() if i % 7 == 0 else text, [None, "en", "fr", "und"][i % 4]))
    hot = ("one hot pair " * 400, "en")  # a third of all words, one very long text
    return [*out, hot, hot, (None, "en"), ("", None), (" \t ", "xx"), ("...", "xx")]


def frame(spark, rows, n=5):
    return spark.createDataFrame([(i, t, lang, "a", 1, 2) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(n)


def run(spark, rows, **how):
    return sorted(tuple(r) for r in phrases.collocations(frame(spark, rows), **how).collect())


@pytest.mark.parametrize("least", [4, 30])
def test_same_as_plain_counts(spark, least):
    rows = rows_of()
    want = plain(rows, least)
    assert run(spark, rows, least=least) == want
    assert {len(r[2].split()) for r in want} >= {2, 5}


def test_small_pieces_give_the_same(spark, monkeypatch):
    rows = rows_of(5)
    want = plain(rows, 5)
    for name, size in (("WORD_PIECE", 40), ("TRIE_PIECE", 60), ("BLOCK", 500), ("HELD", 50)):
        monkeypatch.setattr(phrases, name, size)
    assert run(spark, rows, least=5) == want


def test_top_and_ties(spark):
    rows = [("a b. c d. e f. b a" , "en")] * 6
    want = plain(rows, 2, top=3)
    assert run(spark, rows, least=2, top=3) == want
    assert [r[2] for r in want] == ["c d", "e f", "a b"]


def test_nothing_frequent(spark):
    assert run(spark, [("a b c", "en"), (None, None)], least=2) == []
    assert run(spark, [("a b. b. a", "en")] * 2, least=3) == []
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_trie_accepts_what_it_holds_and_nothing_else():
    r = np.random.default_rng(2)
    for digits, top in ((1, 255), (2, 60_000), (3, 1_000_000)):
        pairs = np.unique(np.stack([r.integers(11, 400, 5000), r.integers(1, top, 5000)], 1), axis=0)
        states = np.arange(1, len(pairs) + 1)
        trie = phrases.Trie(10, 390, pairs[:, 0], pairs[:, 1], states, digits)
        known = {tuple(p): s for p, s in zip(pairs.tolist(), states.tolist())}
        asked = np.concatenate([pairs, np.stack([r.integers(0, 500, 20_000), r.integers(0, top, 20_000)], 1)])
        at, to = trie.advance(asked[:, 0].astype(np.int32), asked[:, 1].astype(np.int32))
        found = dict(zip(at.tolist(), to.tolist()))
        assert all(found.get(i) == known.get(tuple(p)) for i, p in enumerate(asked.tolist()))


def test_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**14, [10**15], [2 * 10**14], 10**17)], "a long, pre array<long>, suf array<long>, n long")
    got = df.select(phrases._score("n").alias("s")).first()["s"]
    assert int(got["score"]) == 1000 * 10**14 * 10**17 // (10**15 * 2 * 10**14) and got["l"] == 10**15
