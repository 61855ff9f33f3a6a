"""One scenario end to end, and the rules every store must keep."""

import pytest
from helpers import T0, apply, as_of, entries, entry, notes, requests  # noqa: F401
from pyspark.sql import functions as F

from keepsake.functions import text
from keepsake.operators import capture as cap
from keepsake.operators import details, mutate, prompts, recall, references, shelf_tree, stats, views
from keepsake.operators.filters import EntryFilter


@pytest.fixture(scope="module")
def store(spark):
    r = requests(
        spark,
        {"kind": "movie", "title": "Smoke Test: A Film", "data": {"year": "2026", "director": "Nobody"}, "tags": ["_smoke"]},
        {"kind": "person", "title": "Smoke Testperson", "body": "Works at Testco. Met at a conference that did not happen.",
         "data": {"company": "Testco"}, "tags": ["_smoke"], "minutes": 1},
    )
    e = cap.capture(r, entries(spark)).drop("seq").cache()
    film, person = [x["id"] for x in e.orderBy("created_at").collect()]
    patch = spark.createDataFrame([(film,)], "id string").select(
        "id",
        *[F.lit(None).cast(t).alias(c) for c, t in [
            ("kind", "string"), ("title", "struct<value:string>"), ("body", "struct<value:string>"),
            ("occurred_at", "struct<value:timestamp>"), ("remind_at", "struct<value:timestamp>"),
            ("tags", "array<string>"), ("add_tags", "array<string>"), ("data", "map<string,string>"), ("archived", "boolean")]],
        mutate.set_to(F.lit("watched")).alias("status"),
        mutate.set_to(F.lit(7)).alias("rating"),
    )
    e = mutate.apply_updates(e, patch, as_of())
    n = mutate.add_notes(notes(spark), notes(spark, ("n1", film, " A note added later. ", 9, " ")))
    return e, n, film, person


def _find(spark, store, query, **f):
    e, n, *_ = store
    q = spark.createDataFrame([(0, query)], "query_id int, query string")
    return [r["id"] for r in recall.text_search(q, e, n, EntryFilter(**f)).orderBy("position").collect()]


def test_recall_by_word_typo_and_note(spark, store):
    _, _, film, person = store
    assert person in _find(spark, store, "testco")
    assert person in _find(spark, store, "smoke testprson")
    assert film in _find(spark, store, "added later")
    assert _find(spark, store, "testco", kind="people") == [person]


def test_update_detail_and_views(spark, store):
    e, n, film, person = store
    row = e.where(F.col("id") == film).first()
    assert row["status"] == "watched" and row["rating"] == 7
    links = spark.createDataFrame([("l1", person, film, "recommended")], "id string, from_id string, to_id string, rel string")
    rows = details.entry_detail(e.where(F.col("id") == film), e, n, links).collect()
    assert {(r["part"], r["label"], r["content"]) for r in rows} == {
        ("entry", "movie", "Smoke Test: A Film"), ("note", "me", "A note added later."), ("link", "in recommended", "Smoke Testperson")}
    assert [r["id"] for r in views.watchlist(e, "watched").collect()] == [film]
    assert views.watchlist(e, "want").count() == 0
    assert [r["id"] for r in views.list_entries(e, EntryFilter(kind="movie", tags=["_smoke"])).collect()] == [film]
    assert views.due(e, as_of(), 365).count() == 0
    assert stats.totals(e).first()["total"] == 2 and views.briefing(e, as_of()).count() > 0


def test_references(spark, store):
    e, _, film, _ = store
    refs = spark.createDataFrame([(0, "smoke test: a film"), (1, film[:8]), (2, "no such thing"), (3, film.upper()), (4, "cafe")], "ref_id int, ref string")
    got = {r["ref_id"]: (r["status"], r["id"]) for r in references.resolve(refs, e).collect()}
    assert got == {0: ("ok", film), 1: ("ok", film), 2: ("none", None), 3: ("ok", film), 4: ("none", None)}


def test_capturing_twice_stores_once(spark):
    r = requests(spark, {"capture_id": " a ", "body": "one"}, {"capture_id": "a", "body": "two"}, {"body": "x"}, {"body": "x"}, {"capture_id": "", "body": " "})
    empty = entries(spark)
    once = cap.capture(r, empty)
    assert sorted(x["body"] for x in once.collect()) == ["one", "x", "x"]
    again = cap.capture(r.where("seq < 2"), cap.store(empty, once))
    assert again.count() == 0
    told = {x["seq"]: x["created"] for x in cap.outcomes(r, empty, once).collect()}
    assert told == {0: True, 1: False, 2: True, 3: True}


def test_enrichment_protects_the_callers_words(spark):
    meta = spark.createDataFrame([("https://a.b/c", "Page title", "What it is", "Site", "Ann")], "url string, title string, description string, site string, author string")
    r = requests(
        spark,
        {"title": "hardware", "body": "https://a.b/c", "tags": ["hardware"]},
        {"title": "My own name", "body": "worth it https://a.b/c.", "data": {"summary": "", "source": "mine"}},
        {"title": "My own name", "data": {"url": "https://a.b/c", "summary": "kept"}, "kind": "repo"},
        {"body": "https://x.y/Some_Paper-2.pdf"},
        {"data": {"url": "https://x.y/Some_Paper-2.pdf"}},
    )
    got = {x["seq"]: x for x in cap.normalise(r, pages=meta).collect()}
    assert (got[0]["title"], got[0]["body"], got[0]["kind"], got[0]["status"]) == ("Page title", None, "reading", "queued")
    assert got[1]["title"] == "My own name" and got[1]["data"] == {"url": "https://a.b/c", "summary": "What it is", "source": "mine", "author": "Ann"}
    assert got[2]["kind"] == "repo" and got[2]["data"] == {"url": "https://a.b/c", "summary": "kept"}
    assert got[3]["title"] == "https://x.y/Some_Paper-2.pdf" and got[4]["title"] == "Some Paper 2"


def test_tags_and_add_tags_exclude_each_other(spark):
    e = entries(spark, entry("a", tags=["z", "b"]))
    cols = [F.lit(None).cast(t).alias(c) for c, t in [("kind", "string"), ("data", "map<string,string>"), ("archived", "boolean")]]
    cols += [F.lit(None).cast("struct<value:string>").alias(c) for c in ("title", "body", "status")]
    cols += [F.lit(None).cast("struct<value:int>").alias("rating"), F.lit(None).cast("struct<value:timestamp>").alias("occurred_at"), F.lit(None).cast("struct<value:timestamp>").alias("remind_at")]
    one = spark.createDataFrame([("a",)], "id string")
    added = one.select("id", *cols, F.lit(None).cast("array<string>").alias("tags"), F.array(F.lit("A"), F.lit("b")).alias("add_tags"))
    assert mutate.apply_updates(e, added, as_of()).first()["tags"] == ["a", "b", "z"]
    both = one.select("id", *cols, F.array(F.lit("x")).alias("tags"), F.array(F.lit("y")).alias("add_tags"))
    with pytest.raises(Exception, match="both tags and add_tags"):
        mutate.apply_updates(e, both, as_of()).collect()
    with pytest.raises(Exception, match="several patches"):
        mutate.apply_updates(e, added.union(added), as_of()).collect()
    # a patch that names nothing leaves the edit time alone
    none = one.select("id", *cols, F.lit(None).cast("array<string>").alias("tags"), F.lit(None).cast("array<string>").alias("add_tags"))
    assert mutate.apply_updates(e, none, as_of()).first()["updated_at"] == T0


def test_shelves_roll_up_and_rename(spark):
    e = entries(
        spark,
        entry("a", tags=["ai/harness", "ai/harness/mcp"]), entry("b", tags=["ai"]), entry("c", tags=["aim"]),
        entry("d", tags=["ai/x"], archived_at=T0),
    )
    tree = {r["tag"]: r for r in shelf_tree.shelf_tree(e).collect()}
    assert {t: (r["count"], r["own"], r["depth"], r["parent"]) for t, r in tree.items()} == {
        "ai": (2, 1, 0, None), "ai/harness": (1, 1, 1, "ai"), "ai/harness/mcp": (1, 1, 2, "ai/harness"), "aim": (1, 1, 0, None)}
    there = shelf_tree.rename_shelf(e, "ai", "models")
    assert {r["id"]: r["tags"] for r in there.collect()} == {"a": ["models/harness", "models/harness/mcp"], "b": ["models"], "d": ["models/x"]}
    back = shelf_tree.rename_shelf(there, "models", "ai")
    assert {r["id"]: r["tags"] for r in back.collect()} == {"a": ["ai/harness", "ai/harness/mcp"], "b": ["ai"], "d": ["ai/x"]}
    assert shelf_tree.rename_shelf(e, "AI", " ai/").count() == 0


def test_habits_of_an_empty_log(spark):
    none = spark.createDataFrame([], "id string, at timestamp, surface string, action string, input string, entry_ids array<string>, ok boolean, error string")
    assert tuple(prompts.lengths(none).first()) == (0, 0, 0, 0)
    assert prompts.rates(none).first()["pct_with_url"] is None


def test_blank_recall_lists_newest(spark, store):
    e, *_ = store
    assert _find(spark, store, "  ") == [r["id"] for r in views.list_entries(e).collect()]


def test_weak_titles(spark):
    assert apply(spark, lambda c: text.is_weak_title(c, F.array(F.lit("Hardware"))), None, "ab", "hardware", "hardware shop", "https://x y") == [
        True, True, True, False, True]


def test_folded_patches_do_what_they_do_in_turn(spark):
    import random

    r = random.Random(6)
    schema = (
        "id string, seq int, kind string, title struct<value:string>, body struct<value:string>, status struct<value:string>, rating struct<value:int>, "
        "occurred_at struct<value:timestamp>, remind_at struct<value:timestamp>, tags array<string>, add_tags array<string>, data map<string,string>, archived boolean"
    )
    some = lambda x, p=0.5: x if r.random() < p else None
    rows = []
    for seq in range(5):
        for i in "abcdef":
            replaces = r.random() < 0.3
            rows.append((
                i, seq, some(r.choice(["Film", "place"])), some((some(f"t{seq}"),)), some((f"b{seq}",), 0.3), some((some("open"),), 0.3), some((seq,)), None, None,
                [f"r{seq}", "x"] if replaces else None, None if replaces else some([f"#A{seq}", "x"]), some({k: some(f"{k}{seq}") for k in r.sample("pqrs", 2)}), some(bool(seq % 2), 0.3),
            ))
    r.shuffle(rows)
    patches = spark.createDataFrame(rows, schema)
    e = entries(spark, *[entry(i, title="T", tags=["old"], data={"p": "0", "z": "1"}) for i in "abcdefg"])
    turn = e
    for seq in range(5):
        turn = mutate.apply_updates(turn, patches.where(F.col("seq") == seq).drop("seq"), as_of())
    got = mutate.apply_updates(e, mutate.fold_patches(patches), as_of())
    shown = lambda df: sorted(map(repr, (x.asDict(True) | {"data": sorted((x["data"] or {}).items())} for x in df.collect())))
    assert shown(got) == shown(turn)


def test_prompts_are_cut_before_they_travel(spark):
    calls = spark.createDataFrame([("p1", T0, "web", "jot", "x" * 9000, ["e1"], 1, None, "y" * 600)], "id string, at timestamp, surface string, action string, input string, entry_ids array<string>, ms int, ok boolean, error string")
    logged = prompts.log_prompts(calls, entries(spark, entry("e1", tags=["a"])))
    (row,) = logged.collect()
    assert (len(row["input"]), len(row["error"]), row["tags"], row["kinds"], row["ok"]) == (8000, 500, ["a"], ["thought"], True)
    plan = logged._jdf.queryExecution().analyzed().toString()
    assert plan.index("Join LeftOuter") < plan.index("substring(input")


def test_no_text_is_shuffled_with_a_call(spark, tmp_path):
    from datetime import datetime

    from keepsake.sources import bindings

    long = "é" * (prompts.INPUT_CHARS + 50)
    docs = [(0, "zero", "en", "s0", 4), (1, long, "fr", "s1", len(long)), (1, "one again", "fr", "s1", 9)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    at = datetime(2024, 1, 1)
    # numbers are taken modulo three: the last two have no document to be worded after
    calls = [(0, at, 1, "click", 2.5), (1, at, 2, "view", 1.0), (4, at, 3, "error", 1.0), (4, at, 3, "error", 1.0), (2, at, 4, "click", 1.0), (None, at, 5, "click", 1.0)]
    spark.createDataFrame(calls, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        logged = bindings.prompts(spark, str(tmp_path))
        plan = logged._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["id"][:8], r["input"], r["kinds"], r["error"]) for r in logged.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # texts travel once, cut, to the last join: nothing above it is an exchange
    assert "Exchange" not in plan[: plan.index("Join")]
    want = [("00000000", "https://example.com/p/0  #en/s0", ["thought", "movie"], None)]
    want += [("00000001", text, [], None) for text in (long[: prompts.INPUT_CHARS], "one again")]
    want += [("00000004", text, ["movie"], "timeout") for text in (long[: prompts.INPUT_CHARS], "one again #fr/s1") for _ in range(2)]
    assert got == sorted(want)
