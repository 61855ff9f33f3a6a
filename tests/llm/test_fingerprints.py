"""I-Match fingerprints against a plain version, and the order of documents."""

import hashlib
import random
import re
import struct

import pytest
import xxhash

from keepsake.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, lang string, bucket int, marks string, h int"


def xx(data: bytes, seed=42) -> int:
    return xxhash.xxh64_intdigest(data, seed)


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def terms(text):
    return list(dict.fromkeys(xx(w.encode()) for w in re.split(fp.GAPS, (text or "").lower()) if w))


def plain_lexicon(texts, at_least=fp.AT_LEAST, at_most=fp.AT_MOST):
    df = {}
    for t in texts:
        for s in {x >> (64 - fp.SLOT_BITS) for x in terms(t)}:
            df[s] = df.get(s, 0) + 1
    most = max(at_least, at_most * len(texts))
    return {s for s, n in df.items() if at_least <= n <= most}


def plain_marks(text, lexicon):
    all_ = terms(text)
    kept = [t for t in all_ if t >> (64 - fp.SLOT_BITS) in lexicon]
    kept = kept if len(kept) >= fp.FEWEST else all_
    keys = sorted((t & 63) << 57 | t >> 7 for t in kept)
    out = []
    for level in range(fp.LEVELS):
        held = {}
        for k in keys:
            if k & (4**level - 1) == 0:
                held.setdefault(k >> 57, []).append(k)
        for subset, ks in sorted(held.items()):
            seed = 42
            for k in ks:
                seed = xx(struct.pack("<q", k), seed)
            out.append((level * 64 + subset) << 32 | seed & 0xFFFFFFFF)
    return out


def plain_likeness(a, b):
    found = {}
    for level in range(fp.LEVELS):
        x, y = ({m for m in marks if m >> 38 == level} for marks in (a, b))
        used = len({m >> 32 for m in x | y})
        if used:
            found[level] = (used, len(x & y) / used)
    for used, share in found.values():
        if used <= fp.SPARSE:
            return share
    return list(found.values())[-1][1] if found else 1.0


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    words = ["".join(r.choice("aeinrst") for _ in range(r.randint(3, 7))) for _ in range(3000)]
    out = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 5, 60, 400])))) for i in range(150)]
    out += [(150, None), (151, ""), (152, "... !!"), (153, "É" * 11), (154, " ".join(words) * 3), (None, "no id"), (None, None)]
    return out + [(5, out[5][1]), (5, out[5][1]), (6, "other text of six"), (10**12, "far"), (-(10**12), "far away")]


def frame(spark, rows, n=4):
    return spark.createDataFrame([(i, t, "en", 1, "x", 2) for i, t in rows], SCHEMA).repartition(n)


def test_marks_and_lexicon_are_the_plain_ones(spark, rows):
    docs = frame(spark, rows)
    lexicon = fp.lexicon_of(docs)
    want = plain_lexicon([t for _, t in rows])
    assert {64 * i + b for i, bits in enumerate(lexicon) for b in range(64) if bits >> b & 1} == want
    got = fp.fingerprint(docs, lexicon, name="found").collect()
    assert got[0].__fields__ == [*docs.columns, "found"]
    for r in got:
        assert r["found"] == plain_marks(r["text"], want), r["text"]


def test_follow_and_likeness(spark, rows, monkeypatch):
    for bucket_rows in (fp.BUCKET_ROWS, 3):
        monkeypatch.setattr(fp, "BUCKET_ROWS", bucket_rows)
        docs = frame(spark, rows)
        lexicon = fp.lexicon_of(docs)
        got = fp.follow(docs, lexicon).withColumn("likeness", fp.likeness("marks", "next_marks")).collect()
        order = sorted(((i is not None, i or 0, signed(xx((t or "").encode())), t or "", i) for i, t in rows), key=lambda x: x[:4])
        want = [(a[4], a[3], b[3]) for a, b in zip(order, order[1:] + order[:1])]
        assert sorted([(r["doc_id"], r["text"], r["next_text"]) for r in got], key=repr) == sorted(want, key=repr)
        for r in got:
            assert r["likeness"] == pytest.approx(plain_likeness(r["marks"], r["next_marks"]))


def test_likeness_of_edges(spark):
    df = spark.createDataFrame([([], []), ([1 << 32], []), ([1 << 32 | 5], [1 << 32 | 5]), ([1 << 32 | 5], [1 << 32 | 6])], "a array<long>, b array<long>")
    assert [r[0] for r in df.select(fp.likeness("a", "b")).collect()] == [1.0, 0.0, 1.0, 0.0]


def test_one_document_and_none(spark):
    docs = frame(spark, [(3, "alone here")])
    assert [tuple(r) for r in fp.follow(docs, fp.lexicon_of(docs)).select("text", "next_text").collect()] == [("alone here", "alone here")]
    none = frame(spark, [])
    assert fp.follow(none, fp.lexicon_of(none)).count() == 0


def test_query_columns(spark, rows, tmp_path):
    numbered = [(i, t) for i, t in rows if i is not None and 10 < i < 10**12]
    frame(spark, numbered).write.parquet(f"{tmp_path}/documents.parquet")
    from keepsake.llm.fingerprints import query

    got = {r["doc_id"]: r for r in query(spark, str(tmp_path)).collect()}
    order = sorted(numbered)
    lexicon = plain_lexicon([t for _, t in numbered])
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = t or "", after or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        r, marks, changed = got[i], plain_marks(text, lexicon), plain_marks(edited, lexicon)
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == ".".join(f"{m:x}" for m in marks)
        assert r["edited_fingerprint"] == ".".join(f"{m:x}" for m in changed)
        assert r["near_edited"] == pytest.approx(plain_likeness(marks, changed))
        assert r["near_next"] == pytest.approx(plain_likeness(marks, plain_marks(after, lexicon)))
