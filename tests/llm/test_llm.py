"""Each operator against a brute-force version on hand rows: nulls, empty and long texts, ties, repeats, extra columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from keepsake.llm import decontamination, line_dedup, mixing, near_dedup, neighbours, quality, substrings, tokens, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, `key` string"
rng = random.Random(7)
VOCABULARY = ["".join(rng.choice("abdeilnorstu") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    base = prose(120, 1)
    near = base.replace(base.split()[60], "otherwise")
    out = [(1, base, "a"), (2, base, "a"), (3, near, "b"), (4, None, None), (5, "", "b"), (6, " \n ", "c"), (7, "one two", "c"), (7, "one two", "c")]
    out += [(8, prose(40, 2) + " " + " ".join(base.split()[20:45]) + "\n" + prose(30, 3), None), (9, prose(20_000, 4), "a"), (None, base, "a"), (10, "Éa, b c\x85d X!!\n" + base.upper(), "é")]
    return out + [(11 + k, prose(60, 100 + k), "abc"[k % 3]) for k in range(40)]


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_empty_tables(spark):
    none = frame(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert mixing.mix(none).count() == 0
    assert mixing.expand(none).count() == 0
    assert decontamination.hits(none, bench).count() == 0
    assert substrings.deduplicate(none).count() == 0
    assert near_dedup.find(none).count() == 0
    assert near_dedup.deduplicate(none).count() == 0
    assert line_dedup.find(none).count() == 0
    assert tokens.tokenise(spark, none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    assert quality.score(none, quality.train(none, labels)).count() == 0
    assert neighbours.search(*[spark.createDataFrame([], "vec_id long, embedding array<float>")] * 2).count() == 0


def test_mixing_near_targets_and_whole_copies(spark, rows):
    mixed = mixing.mix(frame(spark, rows)).toPandas()
    assert len(mixed) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").encode().split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    assert {s: w for s, w in zip(order, [1, 2, 3, 1, 2])}
    targets, open_, left = {}, {s: i % 3 + 1 for i, s in enumerate(order)}, sum(sizes.values())
    while open_:  # share by weight, settle the sources above their cap, share again
        over = {s for s, w in open_.items() if left * w / sum(open_.values()) > 3 * sizes[s]}
        settled = {s: 3.0 * sizes[s] for s in over} or {s: left * w / sum(open_.values()) for s, w in open_.items()}
        targets |= settled
        left -= sum(settled.values())
        open_ = {s: w for s, w in open_.items() if s not in settled}
    for source, part in mixed.groupby("source", dropna=False):
        name = source if isinstance(source, str) else None
        assert part["target"].iloc[0] == pytest.approx(targets[name])
        assert (part["taken"] <= 3 * part["size"]).all()
    again = mixing.mix(frame(spark, rows)).toPandas()
    assert sorted(map(repr, again.values.tolist())) == sorted(map(repr, mixed.values.tolist()))


def test_expand_keeps_columns(spark, rows):
    docs = frame(spark, rows)
    assert mixing.expand(docs).columns == docs.columns


def test_decontamination(spark, rows):
    base = rows[0][1].split()
    items = [(1, " ".join(base[20:45]).upper()), (2, "one TWO"), (3, None), (4, "!!"), (None, " ".join(base[:12])), (5, " ".join(base[20:45]))]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, extra int")
    import re

    def words(t):
        return [w.translate(str.maketrans(decontamination.UPPER, decontamination.LOWER)) for w in re.findall(decontamination.ANY_WORD, t or "")]

    want = []
    for doc_id, text, _ in rows:
        d, hit, found = words(text), set(), set()
        for item, t in items:
            w = words(t)
            n = min(10, len(w))
            for a in range(max(1, len(w) - 9)) if n else ():
                for s in range(len(d) - n + 1):
                    if d[s : s + n] == w[a : a + n]:
                        hit |= set(range(s, s + n))
                        found |= {str(item)} - {"None"}
        want.append((doc_id, len(d), len(hit), sorted(found)))
    for piece in (decontamination.PIECE_WORDS, 40):
        assert got(decontamination.hits(frame(spark, rows), bench, piece_words=piece), "doc_id", "n_words", "n_hit", "items") == sorted(want, key=repr)
    clean = decontamination.remove(frame(spark, rows), bench)
    assert clean.columns == frame(spark, rows).columns
    assert got(clean, "doc_id") == sorted([(w[0],) for w in want if not w[2]], key=repr)
    cut = decontamination.remove_spans(frame(spark, rows), bench).where("doc_id = 8").first()["text"]
    assert " ".join(base[20:45]) not in cut


def test_substrings(spark, rows):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t, _ in rows]
    for i, w in split:
        for k in range(len(w) - 12) if i is not None else ():
            at = tuple(w[k : k + 13])
            first[at] = min(first.get(at, i), i)
    want = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - 12) if i is not None else ():
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        want.append((i, len(w), b" ".join(x for k, x in enumerate(w) if k not in gone)))
    assert [(a, b, bytes(c)) for a, b, c in got(substrings.deduplicate(frame(spark, rows), shard_words=500), "doc_id", "n_words", "kept")] == sorted(want, key=repr) or sorted(
        (a or -1, b, bytes(c)) for a, b, c in got(substrings.deduplicate(frame(spark, rows), shard_words=500), "doc_id", "n_words", "kept")
    ) == sorted((a or -1, b, c) for a, b, c in want)


def test_fm_index_finds_every_occurrence():
    sequence = np.append(np.random.default_rng(3).integers(2, 6, 300), 1)
    index = substrings.FMIndex(sequence, 4)
    low, high = index.intervals(sequence, np.arange(296), 4)
    for s in range(296):
        places = sorted(k for k in range(297) if (sequence[k : k + 4] == sequence[s : s + 4]).all())
        assert (sorted(index.order[low[s] : high[s]]) == places) if len(places) > 1 else low[s] == high[s]


def test_near_copies(spark, rows):
    found = near_dedup.find(frame(spark, rows))
    by_id = {r["doc_id"]: r for r in found.collect() if r["doc_id"] is not None}
    assert len(by_id) == len({i for i, _, _ in rows if i is not None}) and found.count() == len(rows)
    assert by_id[1]["class_id"] == by_id[2]["class_id"] == by_id[3]["class_id"]
    assert by_id[8]["class_id"] == 8 and by_id[20]["class_id"] == 20 and by_id[4]["kept"] and by_id[5]["kept"]
    docs = near_dedup.deduplicate(frame(spark, rows))
    assert docs.columns == frame(spark, rows).columns
    ids = [r["doc_id"] for r in docs.collect()]
    assert ids.count(7) == 1 and 2 not in ids and 3 not in ids and {4, 5, 6, 9} <= set(ids)


def test_samples_agree_as_often_as_the_similarity():
    made, sampler = near_dedup.Shingles(), near_dedup.Sampler(400)
    text = prose(300, 5).split()
    other = text[:200] + prose(40, 6).split() + text[240:]
    (a, ca), (b, cb) = made.of(" ".join(text).encode()), made.of(" ".join(other).encode())
    samples = sampler(np.concatenate([a, b]), np.concatenate([ca, cb]).astype(float), np.array([0, len(a)]))
    assert abs((samples[0] == samples[1]).mean() - near_dedup.weighted_jaccard((a, ca), (b, cb))) < 0.08


def test_line_join(spark):
    base = prose(20, 9).split()
    lines = [" ".join(base), " ".join(base[:-1] + ["zz"]), " ".join(base[::-1]), prose(15, 10), "", "Les.", "a b c d", "a b c d e", " ".join(base[:12])]
    docs = frame(spark, [(2, "\n".join(lines), "a"), (1, "\n".join(lines[1:5]), "a"), (3, None, "b"), (4, lines[0] + "\n" + lines[5], "c")])
    places = sorted((i, k, l) for i, t in ((2, "\n".join(lines)), (1, "\n".join(lines[1:5])), (4, lines[0] + "\n" + lines[5])) for k, l in enumerate(t.split("\n")) if l.split())
    first = {}
    for i, k, l in places:
        first.setdefault(l, (i, k))
    sets = {l: set(l.lower().split()) for l in first}
    linked = {l: [m for m in first if m != l and len(sets[l] & sets[m]) >= 0.8 * len(sets[l] | sets[m])] for l in first}
    want = [(i, k, *first[l], len(linked[l]), (i, k) != first[l] or any(first[m] < first[l] for m in linked[l])) for i, k, l in places]
    assert got(line_dedup.find(docs), "doc_id", "line_no", "class_doc_id", "class_line_no", "n_links", "removed") == sorted(want, key=repr)
    assert line_dedup.remove(docs).where("doc_id = 4").first()["text"] == ""


def test_finer_bands_miss_no_more_than_coarse_ones():
    """Pairs that share a coarse bucket, by how many samples agree, and no finer one."""
    draws, size = np.random.default_rng(3), 20_000
    first, picks = near_dedup.BANDS * near_dedup.ROWS, near_dedup.fine_picks()
    assert len({tuple(sorted(p)) for p in picks}) == len(picks) and picks.max() < first + near_dedup.FRESH
    for similarity in (0.8, 0.81, 0.82, 0.85):
        left = 0
        for _ in range(5):
            same = draws.random((size, first + near_dedup.FRESH)) < similarity
            coarse = same[:, :first].reshape(size, near_dedup.BANDS, near_dedup.ROWS).all(2).any(1)
            left += (coarse & ~np.any([same[:, p].all(1) for p in picks], 0)).sum()
        assert left <= 5 * size * (1 - similarity**near_dedup.ROWS) ** near_dedup.BANDS


def test_texts_of_a_coarse_bucket_meet_in_finer_ones(spark):
    """Pairs at the threshold, by the keys themselves: nearly all share a finer bucket."""
    texts = []
    for k in range(300):
        words = [f"w{k}x{j}" for j in range(400)]
        texts += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:356] + [f"v{k}x{j}" for j in range(44)]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    df, n = near_dedup.document_frequencies(docs)
    weights, made = near_dedup.slot_weights(df, n), near_dedup.sketches(docs, df, n)
    keys = near_dedup._fine_keys(made.select("text_key", "samples"), near_dedup._features(docs, made), weights)
    of = {}
    for row in keys.join(made.select("doc_id", "text_key"), "text_key").select("doc_id", "key").collect():
        of.setdefault(row["doc_id"], set()).add(row["key"])
    assert len(of) == 600 and sum(not of[2 * k] & of[2 * k + 1] for k in range(300)) <= 1
    assert not of[0] & of[2]


def test_tokens_round_trip(spark, rows, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.tokenizer_path())
    special = rows + [(90, "a <|endoftext|> b", "a"), (91, "x\x1cy ΣΑΣ İx don't! 12,5||", "a")]
    path = tokens.write_tokens(frame(spark, special), str(tmp_path / "t"), tokens.tokenizer_path())
    start, want = 0, []
    for i, text, _ in sorted(special, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got(tokens.digests(spark, path), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    assert tokens.read_tokens(spark, path, 8, 9).count() == 2
    import glob

    import pyarrow.parquet as pq

    column = pq.ParquetFile(max(glob.glob(f"{path}/*.parquet"))).metadata.row_group(0).column(1)
    assert "DELTA_BINARY_PACKED" in column.encodings and column.has_offset_index


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "u", "<p>é</p>"), (2, None, "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u\r\nx", None), (4, "u", ""), (5, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 300), (None, "u", "z"), (6, "u", "q\r\n")]
    path = warc.write_archives(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, payload int"), str(tmp_path / "w"), chunk=64)
    chunks = warc.read_archives(spark, path)
    assert chunks.where("page_id = 5").count() > 50
    import base64

    want = []
    for i, _, html in pages:
        body = (html or "").encode()
        same = [p for p, _, h in pages if (h or "") == (html or "") and p is not None]
        again = bool(same) and i != max(same)
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", max(same) if again else None))
    assert got(chunks.where("is_last"), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    parts = sorted((r["chunk_no"], bytes(r["data"])) for r in chunks.where("page_id = 5").collect())
    assert b"".join(p for _, p in parts).decode() == pages[5][2]


def test_special_strings_of_any_case():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.tokenizer_path())
    texts = ["a <|ENDOFTEXT|> b", "<|StartOfText|>", "A<|EndOfText|>!", "x <|endoftext|> Y", "<|endoftext|><|ENDOFTEXT|>", "<| endoftext |> Plain", "<|ENDOF TEXT|>"]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = tokens.WordEncoder(tokens.tokenizer_path())
    for some in (texts, texts[::-1]):
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(some)] == [want[texts.index(t)] for t in some]
    assert want[0] != want[3] and 49407 not in want[0]


def test_neighbours(spark):
    r = np.random.default_rng(0)
    vectors = r.normal(size=(600, 16)).astype(np.float32)
    vectors[10] = vectors[20]
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(vectors)]
    rows += [(1000, None, 1), (1050, [0.0] * 16, 1), (1100, [float("nan")] * 16, 1), (1150, [1.0, None] + [0.0] * 14, 1), (1200, [1.0], 1), (None, [1.0] * 16, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = neighbours.search(table, table.where("vec_id % 50 = 0")).toPandas()
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 600, 50):
        scores = unit @ unit[q]
        scores[q] = -2
        best = np.lexsort((np.arange(600), -scores))[:5]
        mine = found[found["query_id"] == q].sort_values("rank")
        assert len(mine) == 5 and np.allclose(mine["score"], scores[mine["vec_id"]])
        hits += len(set(best) & set(mine["vec_id"]))
    assert hits >= 0.9 * 60 and found["query_id"].nunique() == 12
    assert neighbours.search(table.where("vec_id < 3"), table.where("vec_id = 0")).count() == 2


def test_neighbours_of_repeated_queries(spark):
    vectors = np.random.default_rng(2).normal(size=(300, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    other = [float(x) for x in vectors[200] + 0.01]
    asked = spark.createDataFrame([rows[0]] * 3 + [rows[50], (50, other)], "vec_id long, embedding array<double>").repartition(2)
    found = neighbours.search(table, asked, recall=1.0)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found.collect())
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)

    def best(own, vector):
        scores = unit @ vector
        scores[own] = -2
        return [(own, n + 1, int(i)) for n, i in enumerate(np.lexsort((np.arange(300), -scores))[:5])]

    mine = {q: [g for g in got if g[0] == q] for q in (0, 50)}
    assert [r for _, r, _ in mine[0]] == [1, 2, 3, 4, 5] and len({i for _, _, i in mine[0]}) == 5
    assert len(set(mine[0]) & set(best(0, vectors[0]))) >= 4
    assert [r for _, r, _ in mine[50]] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    want = set(best(50, vectors[50]) + best(50, np.array(other)))
    assert (50, 1, 200) in mine[50] and len(set(mine[50]) & want) >= len(want) - 2
    few = neighbours.search(table.where("vec_id < 4"), asked.where("vec_id = 0")).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3]


def test_probing_finds_all_codes_in_the_radius():
    codes = np.random.default_rng(1).integers(0, 1 << 16, (500, 4), np.uint16)
    codes[::3] = codes[0]
    built = neighbours.Tables(codes)
    for radius in (0, 1, 5, 13, 26, 30, 64):
        near = np.flatnonzero(np.bitwise_count(codes ^ codes[7]).sum(1) <= radius)
        assert (np.sort(built.within(codes[7], radius)) == near).all()


def learn_rows():
    out = []
    for k in range(600):
        bad = k % 3 == 0
        out.append((k, prose(40, 1000 + k) + (" idiot scum" if bad else ""), ("spam " * 60) if k % 5 == 0 else None))
    return out


def test_toxicity_held_out(spark):
    docs = frame(spark, [(k, t, "a") for k, t, _ in learn_rows()] + [(9000, None, "a"), (9001, "", "a"), (9002, prose(20_000, 8), "a")])
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(0, 600, 2)] + [(1, None)], "doc_id long, toxic int")
    scored = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert len(scored) == 603 and scored[9000] == scored[9001]
    right = sum((scored[k] >= 0.3) == (k % 3 == 0) for k in range(1, 600, 2))
    assert right >= 285
    assert toxicity.reject(docs, toxicity.train(docs, labels)).columns == docs.columns


def test_quality_held_out(spark):
    docs = frame(spark, [(k, junk or t, "a") for k, t, junk in learn_rows()] + [(9000, None, "a"), (9001, "", "a")])
    labels = spark.createDataFrame([(k, int(k % 5 != 0)) for k in range(0, 600, 2)] + [(1, None)], "doc_id long, quality int")
    scored = {r["doc_id"]: r["quality"] for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert scored[9000] == scored[9001]
    assert sum((scored[k] >= 0.3) == (k % 5 != 0) for k in range(1, 600, 2)) >= 285


def test_pipeline_stages(spark):
    import os

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name == "token_files":
            assert out.count() == docs.count()
        else:
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
            assert docs.count() > 0
