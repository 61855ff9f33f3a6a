import re

from helpers import apply
from pyspark.sql import functions as F

from keepsake.functions import text, vectors
from keepsake.operators import fulltext, pages


def test_kinds(spark):
    assert apply(spark, text.normalize_kind, None, "", " Film ", "paper", "Recipe", "   ") == [
        "thought", "thought", "movie", "reading", "recipe", ""]


def test_derived_titles(spark):
    long = "x" * 80 + "       " + "y" * 30
    assert apply(spark, text.derive_title, None, "  \n", "\n  First  \nsecond", long) == [
        None, None, "First", "x" * 80 + "…"]


def test_tags_and_hashtags(spark):
    df = spark.createDataFrame([(["#AI / Harness", "ai//harness/", " ", "/x/", "open-source"],)], "t array<string>")
    assert df.select(text.clean_tags(F.col("t"))).first()[0] == ["ai/harness", "x", "open-source"]
    typed = "see  #ai/x and https://a.b/c#frag #b-c\n\n\nend #1"
    assert apply(spark, text.hashtags, typed, None) == [["ai/x", "b-c", "1"], []]
    assert apply(spark, text.without_hashtags, typed, "#only") == ["see and https://a.b/c#frag\nend", None]


def test_urls(spark):
    assert apply(spark, text.extract_url, "go to (https://a.b/c?d=1), now", "HTTP://X.y/z!?", "none") == [
        "https://a.b/c?d=1", "HTTP://X.y/z", None]
    assert apply(spark, text.is_url_only, " https://a.b ", "https://a.b x", None) == [True, False, False]
    assert apply(
        spark, text.title_from_url, "https://h.org/a/1a%20Paper_on+growth.pdf?x", "https://h.org/", "https://h.org/deadbeefdeadbeef00",
        "https://h.org/%zz", "https://h.org/x-12-3",
    ) == ["1a Paper on growth", None, None, None, None]


def test_site_names(spark):
    df = spark.createDataFrame(
        [("Real Name", "https://a.example.com/"), ("docs.thing.io", "https://docs.thing.io/x"), (None, "https://www.blog.acme.org"), ("", "nonsense")],
        "s string, u string",
    )
    assert [r[0] for r in df.select(text.site_name(F.col("s"), F.col("u"))).collect()] == ["Real Name", "Thing", "Acme", ""]


def test_generic_titles_get_their_site(spark):
    df = spark.createDataFrame(
        [("Overview", None, "https://docs.harbour.dev"), ("Thing", None, "https://thing.io"), ("A proper title", None, "https://thing.io"), (" ", None, "https://t.io")],
        "t string, s string, u string",
    )
    got = [r[0] for r in df.select(text.qualify_title(F.col("t"), F.col("s"), F.col("u"))).collect()]
    assert got == ["Harbour — Overview", "Thing", "A proper title", None]


def test_entities_are_decoded_once(spark):
    assert apply(spark, text.decode_entities, "a &amp;lt; b", "&#8212;&#x2014; &#128512;", "&unknown; & &#xd800;", " a \n b&nbsp; ") == [
        "a &lt; b", "—— 😀", "&unknown; & &#xd800;", "a b"]


def test_trigram_similarity(spark):
    sim = lambda a, b: spark.range(1).select(text.trigram_similarity(F.lit(a), F.lit(b))).first()[0]
    assert round(sim("word", "two words"), 4) == 0.3636
    assert sim("word", "word") == 1.0
    assert sim("abc def", "def abc") == 1.0
    assert sim("", "") == 0.0
    assert sim("chris nolan", "Christopher Nolan") == sim("Christopher Nolan", "chris nolan")


def test_like_keeps_wildcards(spark):
    df = spark.createDataFrame([("100% sure", "0% S"), ("abc", "a_c"), ("abc", "B"), ("abc", "a.c"), (r"a\qb", r"A\Q"), ("a_c", r"a\_c"), ("abc", r"a\_c")], "t string, q string")
    assert [r[0] for r in df.select(text.like_contains(F.col("t"), F.col("q"))).collect()] == [True, True, True, False, False, True, False]


def test_stub_vectors_match_a_plain_fnv(spark):
    def fnv(word):
        h = 2166136261
        for ch in word:
            h = ((h ^ ord(ch)) * 16777619) % 2**32
        return abs(h - 2**32 if h >= 2**31 else h) % 64

    words = ["tram", "it's", "2024", "oslo", "a"]
    assert apply(spark, lambda c: vectors.word_slot(c, 64), *words) == [fnv(w) for w in words]
    zero = spark.sql("select array(0f, 0f) as v").select(vectors.l2_normalise(F.col("v"))).first()[0]
    assert zero == [0.0, 0.0]


def test_page_meta_branches(spark):
    rows = [
        ("https://a.com/1", """<META content='Og &amp; Title long' property="og:title"><title>no</title><meta name="author" content="Ann">"""),
        ("https://a.com/2", """<meta property="og:title" content=" "><meta name="twitter:title" content="Tweet title"><title>no</title>"""),
        ("https://docs.acme.io/3", """<title>Overview</title><meta property="og:site_name" content="acme.io"><meta name="description" content="It&#39;s &#x201c;it&#x201d;">"""),
        ("https://a.com/4", "<p>nothing</p>"),
        ("https://a.com/5", "<title>" + "t" * 301 + "</title>"),
    ]
    got = {r["url"]: r for r in pages.page_meta(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got["https://a.com/1"]["title"] == "Og & Title long" and got["https://a.com/1"]["author"] == "Ann"
    assert got["https://a.com/2"]["title"] == "Tweet title"
    r = got["https://docs.acme.io/3"]
    assert (r["title"], r["site"], r["description"]) == ("Acme — Overview", "Acme", "It's “it”")
    assert got["https://a.com/4"]["title"] is None and got["https://a.com/4"]["site"] == "A"
    assert got["https://a.com/5"]["title"] is None


def test_snippets(spark):
    words = " ".join(f"w{i}" for i in range(100))
    df = spark.createDataFrame(
        [("Title", words.replace("w50", "needle").replace("w60", "Needle,").replace("w5 ", "needle "), ["needle"]), ("T", words, ["zzz"]), (None, None, ["x"])],
        "title string, body string, terms array<string>",
    )
    got = [r[0] for r in df.select(fulltext.snippet(F.col("title"), F.col("body"), F.col("terms"))).collect()]
    assert got[0].split()[0] == "**needle**" and got[0].split()[10] == "**Needle,**" and len(got[0].split()) == 28
    assert got[1] == "T — w0 w1 w2 w3 w4 w5"
    assert got[2] == "—"


def test_word_hash_of_many_texts_together(spark, monkeypatch):
    from keepsake.operators import embedders

    def plain(t, dims):
        counts = [0.0] * dims
        for w in re.findall("[a-z0-9']+", (t or "").lower()):
            h = 2166136261
            for ch in w:
                h = ((h ^ ord(ch)) * 16777619) & 0xFFFFFFFF
            counts[min(h, 2**32 - h) % dims] += 1
        length = sum(c * c for c in counts) ** 0.5 or 1.0
        return [c / length for c in counts]

    texts = ["abc def", "", "'x'", "é a K", None, "Zz top ABC abc", "abc", "a" * 70 + " a" * 30, "日本"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    # pieces that end between texts, at a text longer than a piece, and whole batches
    for size in (8, 60, 4_000_000):
        monkeypatch.setattr(embedders, "HASHED_BYTES", size)
        got = {r["id"]: list(r["vec"]) for r in embedders.WordHash(7).embed(df).collect()}
        assert got == {i: plain(t, 7) for i, t in enumerate(texts)}
