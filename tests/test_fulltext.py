import random

from helpers import entries, entry, notes
from pyspark.sql import functions as F

import keepsake.operators.recall as recall
from keepsake.operators import fulltext
from keepsake.session import broadcast_if_small


def covers(occ, n_terms):
    """Every minimal span that holds all terms, by trying all spans."""
    occ = sorted(occ)
    spans = []
    for i in range(len(occ)):
        for j in range(i, len(occ)):
            if {k for _, k, _ in occ[i : j + 1]} >= set(range(n_terms)):
                spans.append((i, j))
                break
    minimal = [s for s in spans if not any(o != s and o[0] >= s[0] and o[1] <= s[1] for o in spans)]
    score = 0.0
    for i, j in minimal:
        part = occ[i : j + 1]
        noise = (occ[j][0] - occ[i][0]) - (len(part) - 1)
        score += len(part) / sum(1 / w for _, _, w in part) / (1 + noise)
    return score


def test_cover_density_against_all_spans(spark):
    rng = random.Random(5)
    rows, want = [], []
    for case in range(60):
        n_terms = rng.randint(1, 4)
        places = sorted(rng.sample(range(1, 40), rng.randint(n_terms, 14)))
        occ = [(p, rng.randrange(n_terms), rng.choice([1.0, 0.4, 0.2])) for p in places]
        if {k for _, k, _ in occ} != set(range(n_terms)):
            continue
        rows.append((len(rows), [{"pos": p, "k": k, "w": w} for p, k, w in occ], [{"must": list(range(n_terms)), "phrases": [], "must_not": []}]))
        want.append(covers(occ, n_terms))
    schema = (
        "i int, occ array<struct<pos:bigint,k:int,w:double>>, "
        "met array<struct<must:array<int>,phrases:array<array<int>>,must_not:array<array<int>>>>"
    )
    df = spark.createDataFrame(rows, schema)
    got = [r[0] for r in df.orderBy("i").select(fulltext.cover_density(F.col("occ"), F.col("met"))).collect()]
    assert len(got) > 20
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want))


def _store(spark):
    e = entries(
        spark,
        entry("e1", title="The red fox", body="jumps over the lazy dog", tags=["animals/fox"]),
        entry("e2", title="A lazy afternoon", body="dog days, not lazy dogs; a red sunset"),
        entry("e3", title="Fox News", body="nothing red here", data={"owner": "lazy bones"}),
    )
    n = notes(spark, ("n1", "e3", "the dog chased it", 5, "me"), ("n2", "e3", "lazy later", 60 * 24 * 3, "me"))
    return e, n


def _match(spark, rows, **kw):
    e, n = _store(spark)
    q = broadcast_if_small(spark.createDataFrame(rows, "query_id int, query string"))
    return {(r["query_id"], r["id"]) for r in fulltext.match(q, e, n, **kw).collect()}


def test_words_phrases_or_and_minus(spark):
    rows = [(1, "lazy dog"), (2, '"lazy dog"'), (3, "fox -jumps"), (4, "sunset or bones"), (5, "fox -\"lazy dog\""), (6, "!!!"), (7, "-fox")]
    assert _match(spark, rows) == {
        (1, "e1"), (1, "e2"), (1, "e3"), (2, "e1"), (3, "e3"), (4, "e2"), (4, "e3"), (5, "e3"), (7, "e2"),
    }


def test_excluding_only_meets_all_others(spark):
    rows = [(1, '-"lazy dog"'), (2, "-fox -red"), (3, "-lazy"), (4, "-fox or sunset"), (5, "-fox or -afternoon"), (6, "jumps or -fox"), (7, "-nowhere")]
    assert _match(spark, rows) == {
        (1, "e2"), (1, "e3"), (4, "e2"), (5, "e1"), (5, "e2"), (5, "e3"), (6, "e1"), (6, "e2"), (7, "e1"), (7, "e2"), (7, "e3"),
    }


def test_stop_words_use_up_positions(spark):
    got = _match(spark, [(1, "the"), (2, "lazy dog")], stopwords=["the"])
    assert got == {(2, "e1"), (2, "e2"), (2, "e3")}
    e, n = _store(spark)
    pos = {r["term"]: r["pos"] for r in fulltext.occurrences(e, n, stopwords=["the"]).where("entry_id = 'e1'").collect()}
    # title: the red fox / tag: animals fox / body from 6: jumps over the lazy dog
    assert pos["red"] == 2 and pos["jumps"] == 6 and pos["lazy"] == 9 and pos["dog"] == 10 and "the" not in pos


def test_stored_postings_give_the_same(spark, tmp_path):
    e, n = _store(spark)
    held = fulltext.write_postings(fulltext.occurrences(e, n), str(tmp_path / "postings"))
    rows = [(1, "lazy dog"), (2, '"lazy dog"'), (3, "fox -jumps")]
    assert _match(spark, rows) == _match(spark, rows, postings=held)


def test_notes_continue_positions_across_days(spark):
    e, n = _store(spark)
    got = {(r["term"], r["pos"], r["w"]) for r in fulltext.occurrences(e, n).where("entry_id = 'e3'").collect()}
    # fox news | nothing red here | the dog chased it | lazy later | lazy bones
    assert {("the", 6, 0.4), ("it", 9, 0.4), ("lazy", 10, 0.4), ("later", 11, 0.4), ("lazy", 12, 0.2), ("bones", 13, 0.2)} <= got


def test_found_words_of_a_larger_store_are_dealt_to_more_tasks(spark, monkeypatch):
    rows = [(1, "lazy dog"), (2, '"lazy dog"'), (3, "fox -jumps"), (4, "sunset or bones")]
    whole, most = _match(spark, rows), int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(fulltext, "TASK_TEXT", 4)
    assert _match(spark, rows) == whole
    monkeypatch.setattr(fulltext, "TASK_TEXT", 100)
    e = entries(spark, *[entry(f"e{i}", title=f"t{i}", body="lazy dog " * 5) for i in range(200)])
    n = notes(spark, *[(f"n{i}", f"e{i}", "the lazy dog " * 4, i, "me") for i in range(200)])
    for found in fulltext._found(e, n, spark.createDataFrame([("lazy",), ("dog",)], "term string"), []):
        tasks = found.groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) > 3 * most and max(r["count"] for r in tasks) < 200


def test_pieces_of_queries_give_the_whole(spark, monkeypatch):
    e, n = _store(spark)
    q = spark.createDataFrame([(i, w) for i, w in enumerate(["laz", "red", "zz", "og d", "x", "fox", "bones"])], "query_id int, query string")
    whole = {tuple(r) for r in recall.fragments(q, e).collect()}
    monkeypatch.setattr(recall, "chunks_of", lambda df, key: [df.where(F.pmod(F.xxhash64(key), F.lit(3)) == i) for i in range(3)])
    assert {tuple(r) for r in recall.fragments(q, e).collect()} == whole == {(0, "e1"), (0, "e2"), (1, "e1"), (1, "e2"), (1, "e3"), (3, "e2"), (4, "e1"), (4, "e3"), (5, "e1"), (5, "e3")}


def test_very_long_threads_match_block_by_block(spark, monkeypatch):
    rng = random.Random(4)
    words = ["red", "fox", "lazy", "dog", "the", "sun"]
    rows = [(f"n{i:03d}", rng.choice(["e1", "e2", "e3"]), " ".join(rng.choice(words) for _ in range(rng.randint(1, 12))), i, "me") for i in range(60)]
    e, _ = _store(spark)
    n = notes(spark, *rows)
    q = [(1, "red"), (2, "red dog"), (3, '"lazy dog" fox'), (4, '"fox the sun"'), (5, "dog -sunset"), (6, "red or fox lazy"), (7, "sun the dog lazy"), (8, '-"dog dog dog dog" the')]
    asked = broadcast_if_small(spark.createDataFrame(q, "query_id int, query string"))
    run = lambda: {(r["query_id"], r["id"]): round(r["rank"], 9) for r in fulltext.match(asked, e, n).collect()}
    whole = run()
    monkeypatch.setattr(fulltext, "BLOCK", 7)
    monkeypatch.setattr(fulltext, "THREAD_CHARS", 450)
    assert 0 < fulltext.long_threads(n).count() < 3
    assert run() == whole
    monkeypatch.setattr(fulltext, "THREAD_CHARS", 1)
    assert run() == whole and len(whole) > 12


def test_work_is_done_once_per_text_not_per_pair(spark, monkeypatch):
    e = entries(spark, entry("a", title="Écluse 50% off", body="The REWH of the wood"), entry("b", title=None, body="ab_c"), entry("c", title="rewhs", body="x"))
    q = spark.createDataFrame([(1, "rewh"), (2, "ab"), (3, "0% o"), (4, "b_c"), (5, "éclus"), (6, "zz")], "query_id int, query string")
    want = {(1, "a"), (1, "c"), (2, "b"), (3, "a"), (4, "b"), (5, "a")}
    pairs = lambda df: {(r["query_id"], r["id"]) for r in df.collect()}
    few = recall.fragments(q, e)
    assert pairs(few) == want
    # a few queries are looked for in the texts, which are not cut into pieces for them
    assert "split(" not in few._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(recall, "MOST_SCANNED", 0)
    assert pairs(recall.fragments(q, e)) == want
    # titles and queries are cut into trigrams below the joins
    top = recall.text_search(q, e, notes(spark))._jdf.queryExecution().analyzed().toString()
    assert "array_intersect(g#" in top and "regexp_extract_all(lower(title" not in top.split("Join")[0]
    # the places of a query's words are worked out once per occurrence, not once per word as well (the plan then names them 4 times)
    occ = spark.sql("select array(named_struct('pos', 1L, 'k', 0, 'w', 1.0D)) as occ, array(named_struct('must', array(0), 'phrases', array(array(0)), 'must_not', array(array(0)))) as c")
    rank = occ.select(fulltext.cover_density(F.col("occ"), F.col("c")))._jdf.queryExecution().analyzed().toString()
    assert rank.count(".k) THEN") == 2


def _places(df):
    return sorted((r["entry_id"], r["term"], r["pos"], r["w"]) for r in df.select("entry_id", "term", "pos", "w").collect())


def test_words_are_placed_without_being_shuffled(spark):
    # the same note id twice, a note of no item, empty texts, trailing stop words
    e = entries(spark, entry("e1", title="The one", body="of two the", data={"k": "three"}), entry("e2", body=""), entry("e3", title="", body="four"))
    n = notes(spark, ("n1", "e1", "five the", 1, "me"), ("n1", "e3", "six", 2, "me"), ("n2", "e9", "seven", 3, "me"), ("n3", "e1", "", 4, "me"))
    for stop in ([], ["the", "of"]):
        every = fulltext.occurrences(e, n, stopwords=stop)
        wanted = every.select("term").distinct()
        assert _places(every) == _places(fulltext.occurrences(e, n, wanted, stop)) == _places(fulltext.occurrences(e, n, stopwords=stop, tasks=(2, 3)))
    # what is exploded is no longer exchanged
    plan = fulltext.occurrences(e, n)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    generates = [i for i, line in enumerate(lines) if "Generate posexplode" in line]
    joins = [i for i, line in enumerate(lines) if "Join" in line]
    assert generates and not any(j < g and depth(lines[j]) < depth(lines[g]) for j in joins for g in generates)
