"""The pipeline's rows against every stage worked out plainly on a small corpus."""

import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from keepsake.llm import decontamination, mixing, near_dedup, tokens, toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")
r = random.Random(11)
VOCABULARY = ["".join(r.choice("abdeilnorstu") for _ in range(r.randint(2, 8))) for _ in range(900)]
VILE = ["vile" + "".join(r.choice("xyz") for _ in range(3)) for _ in range(12)]


def prose(n, seed):
    q = random.Random(seed)
    return " ".join(q.choice(VOCABULARY) for _ in range(n))


def corpus():
    """(id, text, source, toxic) and benchmark items."""
    docs = [(i, prose(40 + i % 50, i), "abc"[i % 3], 0) for i in range(240)]
    docs += [(300 + i, " ".join(w + " " + r.choice(VILE) for w in prose(30, 5000 + i).split()), "abc"[i % 2], 1) for i in range(160)]
    long = prose(220, 77).split()
    near = [w if k not in (20, 150) else "changed" for k, w in enumerate(long)]
    docs += [(600, docs[3][1], "a", 0), (601, docs[3][1].upper(), "b", 0), (602, " ".join(long), "c", 0), (603, " ".join(near), "a", 0)]
    item = prose(30, 99)
    docs += [(604, prose(30, 98) + " " + " ".join(item.split()[5:17]).title() + ", " + prose(9, 97), "b", 0), (605, "", None, 0), (606, "a b", None, 0)]
    return docs, [(1, item), (2, prose(25, 96)), (3, None)]


def first_of_classes(docs):
    """Ids left when of every class of near copies the first stays, by all pairs."""
    texts = [t for _, t, _, _ in docs]
    made, sets = near_dedup.Shingles(), []
    hashes = [made.of(t.encode()) for t in texts]
    df = np.zeros(1 << near_dedup.DF_BITS, np.int64)
    for h, _ in hashes:
        np.add.at(df, near_dedup._slot(h), 1)
    weights = near_dedup.slot_weights(df, sum(len(h) > 0 for h, _ in hashes))
    sets = [(h, weights[near_dedup._slot(h)] * c) for h, c in hashes]
    root = list(range(len(docs)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i][0]) and len(sets[j][0]) and near_dedup.weighted_jaccard(sets[i], sets[j]) >= near_dedup.SIMILARITY:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [d for i, d in enumerate(docs) if find(i) == i]


def leaks(text, items):
    words = lambda t: re.findall(decontamination.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    said = words(text)
    for _, item in items:
        w = words(item)
        n = min(len(w), decontamination.WINDOW)
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        if any(tuple(said[i : i + n]) in windows for i in range(len(said) - n + 1)):
            return True
    return False


def test_pipeline_is_its_plain_stages(spark, tmp_path):
    docs, items = corpus()
    table = lambda rows, schema, name: spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    table([(i, t, "en", s, len(t)) for i, t, s, _ in docs], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    table([(i, 1 - x, x) for i, _, _, x in docs if i < 600], "doc_id long, quality int, toxic int", "labels")
    table(items, "item_id long, text string", "benchmark")
    table([(0, "u", "h")], "page_id long, url string, html string", "pages")

    clean = [d for d in docs if not d[3]]
    model = toxicity.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), toxicity.training_labels(spark.read.parquet(f"{tmp_path}/labels.parquet")))
    kept = toxicity.reject(spark.read.parquet(f"{tmp_path}/documents.parquet"), model)
    assert {x["doc_id"] for x in kept.select("doc_id").collect()} == {i for i, _, _, _ in clean}
    once = [d for d in first_of_classes(clean) if not leaks(d[1], items)]
    ids = {i for i, _, _, _ in once}
    assert {3, 602} <= ids and not ids & {600, 601, 603, 604}

    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(i, t, s) for i, t, s, _ in once])
    cur = con.execute(mixing.SQL)
    names = [c[0] for c in cur.description]
    plan = {row[names.index("doc_id")]: (row[names.index("size")], row[names.index("taken")]) for row in cur.fetchall()}

    from tokenizers import Tokenizer

    encode, want, start = Tokenizer.from_file(tokens.tokenizer_path()), [], 0
    for i, t, _, _ in sorted(once):
        size, taken = plan[i]
        for _ in range(taken // size if size else 0):
            got = [*encode.encode(t, add_special_tokens=False).ids, tokens.END_ID]
            want.append((i, start, len(got), zlib.crc32(np.array(got, "<u4").tobytes())))
            start += len(got)
    wordless = {i for i, _, _, _ in once if not plan[i][0]}
    out = sorted(tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert [x[0] for x in out if x[0] not in wordless] == [x[0] for x in want]
    assert [(x[0], x[2], x[3]) for x in out if x[0] not in wordless] == [(x[0], x[2], x[3]) for x in want]
    ends = [0, *np.cumsum([x[2] for x in out]).tolist()]
    assert [x[1] for x in out] == ends[:-1]
