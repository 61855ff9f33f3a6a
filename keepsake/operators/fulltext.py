"""Weighted full text: where words occur, which items match, how tightly.

Text is tokenised where it is read. Only occurrences of wanted words leave the
scan, so neither item bodies nor notes are ever shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions import shelves, text, values
from keepsake.functions.text import let
from keepsake.functions.english import stems
from keepsake.schema import FIELD_WEIGHTS, STOP_WORDS
from keepsake.session import broadcast_if_small, each, stored


# So many wanted words are told apart while a text is read; more are joined with every word of it.
MOST_PICKED = 512
# Wanted words found in so many bytes of text are sorted by one task.
TASK_TEXT = 16_000_000


def _kept(tokens: Column, stopwords: list[str]) -> Column:
    """Tokens with positions; a stop word is dropped but uses up its position."""
    numbered = F.transform(tokens, lambda t, i: F.struct(t.alias("term"), (i + 1).cast("bigint").alias("pos")))
    return F.filter(numbered, lambda o: ~o["term"].isin(stopwords)) if stopwords else numbered


def _last(kept: Column) -> Column:
    return F.coalesce(F.try_element_at(kept, F.lit(-1))["pos"], F.lit(0).cast("bigint"))


def _reach(tokens: Column, stopwords: list[str]) -> Column:
    """Position of the last kept token; without stop words, how many there are."""
    return _last(_kept(tokens, stopwords)) if stopwords else F.size(tokens).cast("bigint")


def item_occurrences(entries: DataFrame, stopwords: list[str] | None = None, picked: list[str] | None = None, *keep: str) -> DataFrame:
    """(entry_id, end_of_body, term, pos, w, after_notes, …) of an item's own fields, or of the ``picked`` words in them.

    Title and tags weigh most, then the body, then document values. Positions
    run on from field to field; values come after the notes, whose length is
    added later. Columns to ``keep`` ride along.
    """
    stop = stopwords or []

    def kept(tokens: Column) -> Column:
        # what stands after a field's last kept word holds no place
        return let(tokens, lambda t: F.slice(t, F.lit(1), _reach(t, stop).cast("int"))) if stop else tokens

    fields = entries.select(
        F.col("id").alias("entry_id"),
        kept(text.words(F.coalesce("title", F.lit("")))).alias("a"),
        kept(text.words(F.array_join(shelves.tag_list(F.col("tags")), " "))).alias("g"),
        kept(text.words(F.coalesce("body", F.lit("")))).alias("b"),
        kept(text.words(values.values_text(F.col("data")))).alias("c"),
        *keep,
    )
    body_at = F.size("a") + F.size("g")
    doc = fields.select(
        "entry_id", body_at.alias("body_at"), (body_at + F.size("b")).alias("values_at"), F.concat("a", "g", "b", "c").alias("doc"), *keep
    )
    return _told(doc, stop, picked, "entry_id", "body_at", "values_at", *keep).select(
        "entry_id",
        F.col("values_at").cast("bigint").alias("end_of_body"),
        "term",
        "pos",
        F.when(F.col("pos") <= F.col("body_at"), FIELD_WEIGHTS["A"]).when(F.col("pos") <= F.col("values_at"), FIELD_WEIGHTS["B"]).otherwise(FIELD_WEIGHTS["C"]).alias("w"),
        (F.col("pos") > F.col("values_at")).alias("after_notes"),
        *keep,
    )


def _told(docs: DataFrame, stop: list[str], picked: list[str] | None, *keep: str) -> DataFrame:
    """(…, term, pos): the kept words of ``doc``, a list of all words, one row each."""
    # the outer form, as in ``session.each``: no list is evaluated twice
    rows = docs.select(*keep, F.posexplode_outer("doc").alias("at", "term")).where(F.col("term").isNotNull())
    if picked is not None:
        rows = rows.where(F.col("term").isin(picked))
    elif stop:
        rows = rows.where(~F.col("term").isin(stop))
    return rows.select(*keep, "term", (F.col("at") + 1).cast("bigint").alias("pos"))


def note_spans(notes: DataFrame, stopwords: list[str] | None = None) -> DataFrame:
    """(id, entry_id, base, reach): where each note's tokens start within the notes of its item.

    A prefix sum in two levels, days first, so an item that gathers a large
    part of all notes is still summed by many tasks.
    """
    stop = stopwords or []
    tokens = text.words(F.col("body"))
    n = notes.select(
        "id",
        "entry_id",
        "created_at",
        F.to_date("created_at").alias("day"),
        F.size(tokens).cast("bigint").alias("n"),
        _reach(tokens, stop).alias("last"),
    )
    before = Window.unboundedPreceding, -1
    by_day = Window.partitionBy("entry_id").orderBy("day").rowsBetween(*before)
    days = n.groupBy("entry_id", "day").agg(F.sum("n").alias("day_n"))
    days = days.select("entry_id", "day", F.coalesce(F.sum("day_n").over(by_day), F.lit(0)).alias("day_base"))
    in_day = Window.partitionBy("entry_id", "day").orderBy("created_at", "id").rowsBetween(*before)
    base = F.col("day_base") + F.coalesce(F.sum("n").over(in_day), F.lit(0))
    return n.join(days, ["entry_id", "day"]).select(
        "id", "entry_id", base.alias("base"), F.when(F.col("last") > 0, base + F.col("last")).otherwise(0).alias("reach")
    )


def _picked(wanted: DataFrame, stop: list[str]) -> list[str] | None:
    """The wanted words but for stop words, if they are few."""
    few = [r[0] for r in wanted.select("term").distinct().limit(MOST_PICKED + 1).collect()]
    return [t for t in few if t is not None and t not in stop] if len(few) <= MOST_PICKED else None


def _dealt(texts: DataFrame, key: str, *sides: DataFrame) -> tuple[DataFrame, ...]:
    """Both sides of a join of found words, dealt by the text they stand in, so a task sorts no more of them in a larger store.

    Fewer tasks than the session shuffles to are left to it.
    """
    size = texts.agg(F.sum(F.octet_length("body")).alias("n")).first()["n"] or 0
    tasks = -(-size // TASK_TEXT)
    few = tasks <= int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sides if few else tuple(side.repartition(tasks, key) for side in sides)


def _found(entries: DataFrame, notes: DataFrame, wanted: DataFrame, stop: list[str]) -> tuple[DataFrame, DataFrame]:
    """Occurrences of wanted words in items' own fields, and in notes, the latter counted from the end of the body."""

    carried = [c for c in wanted.columns if c != "term"]
    picked = _picked(wanted, stop)
    own = item_occurrences(entries, stop, picked).join(wanted, "term")
    said = _told(notes.select("id", "entry_id", text.words(F.col("body")).alias("doc")), stop, picked, "id", "entry_id").join(wanted, "term")
    spans = note_spans(notes, stop)
    own, lengths = _dealt(entries, "entry_id", own, _note_lengths(spans))
    said, bases = _dealt(notes, "id", said, spans.select("id", "base"))
    own = own.join(lengths, "entry_id", "left").select(
        "entry_id", "term", (F.col("pos") + _shift()).alias("pos"), "w", "end_of_body", *carried
    )
    said = said.join(bases, "id").select(
        "entry_id", "term", (F.col("base") + F.col("pos")).alias("pos"), F.lit(FIELD_WEIGHTS["B"]).alias("w"), *carried
    )
    return own, said


def _note_lengths(spans: DataFrame) -> DataFrame:
    return spans.groupBy("entry_id").agg(F.max("reach").alias("note_len"))


def _shift() -> Column:
    """What a place after the notes is moved by."""
    return F.when(F.col("after_notes"), F.coalesce("note_len", F.lit(0))).otherwise(0)


def _ends(entries: DataFrame, stop: list[str]) -> DataFrame:
    """(entry_id, end_of_body): where an item's notes begin."""
    fields = (F.coalesce("title", F.lit("")), F.array_join(shelves.tag_list(F.col("tags")), " "), F.coalesce("body", F.lit("")))
    return entries.select(F.col("id").alias("entry_id"), sum((_reach(text.words(c), stop) for c in fields), F.lit(0)).alias("end_of_body"))


def occurrences(
    entries: DataFrame, notes: DataFrame, wanted: DataFrame | None = None, stopwords: list[str] | None = None, tasks: tuple[int, int] | None = None
) -> DataFrame:
    """(entry_id, term, pos, w, …) for every word, or only those in ``wanted``.

    ``wanted`` has a ``term`` column and whatever should ride along; it is
    joined right after the tokens are made. Without it, items and notes learn where they stand
    before they are cut into words, so words are never shuffled; ``tasks`` says over how many tasks the texts of items and of notes are dealt first.
    """
    stop = stopwords or []
    if wanted is not None:
        own, said = _found(entries, notes, wanted, stop)
        said = said.join(_ends(entries, stop), "entry_id").withColumn("pos", F.col("end_of_body") + F.col("pos"))
        return own.drop("end_of_body").unionByName(said.drop("end_of_body"))
    spans = note_spans(notes, stop)
    told = entries.select("id", "title", "tags", "body", "data")
    told = (told.repartition(tasks[0], "id") if tasks else told).join(_note_lengths(spans).withColumnRenamed("entry_id", "id"), "id", "left")
    own = item_occurrences(told, stop, None, "note_len").select("entry_id", "term", (F.col("pos") + _shift()).alias("pos"), "w")
    # only items with notes are read a second time
    ends = _ends(entries.join(notes.select(F.col("entry_id").alias("id")), "id", "left_semi"), stop)
    placed = notes.select("id", "entry_id", "body").join(spans.select("id", "base"), "id").join(ends, "entry_id")
    placed = placed.select("id", "entry_id", (F.col("end_of_body") + F.col("base")).alias("base"), "body")
    placed = (placed.repartition(tasks[1], "id") if tasks else placed).withColumn("doc", text.words(F.col("body")))
    said = _told(placed, stop, None, "entry_id", "base").select(
        "entry_id", "term", (F.col("base") + F.col("pos")).alias("pos"), F.lit(FIELD_WEIGHTS["B"]).alias("w")
    )
    return own.unionByName(said)


POSTING_BUCKETS = 512


def _bucket() -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(POSTING_BUCKETS)).cast("int").alias("bucket")


def write_postings(found: DataFrame, path: str) -> DataFrame:
    """Store occurrences laid out by word, and read them back for ``match``.

    Writing shuffles by word and item, which keeps a very common word
    from filling one task. ``match`` joins them whole; ``search_index`` opens the wanted words only.
    """
    placed = found.select("entry_id", "term", "pos", "w", _bucket())
    spread_out = placed.repartition("bucket", F.pmod(F.xxhash64("entry_id"), F.lit(64)))
    spread_out.sortWithinPartitions("term").write.partitionBy("bucket").parquet(path)
    return found.sparkSession.read.parquet(path)


def _floating(entries: DataFrame, notes: DataFrame, wanted: DataFrame, stop: list[str]) -> DataFrame:
    """Occurrences for matching, with positions in notes still to be shifted.

    Only distances count. Where an item matched in its own fields, those rows
    say where its body ends; where it did not, any start will do. So bodies
    need not be tokenised a second time for the sake of notes.
    """
    own, said = _found(entries, notes, wanted, stop)
    return own.withColumn("in_notes", F.lit(False)).unionByName(
        said.withColumn("in_notes", F.lit(True)).withColumn("end_of_body", F.lit(None).cast("bigint"))
    )


# -- queries ---------------------------------------------------------------------


def query_clauses(queries: DataFrame, english: bool = False) -> DataFrame:
    """Search strings as columns: words, quoted phrases, ``or`` and leading minus.

    Result: query_id, terms, and clauses as a list of ``{must, phrases, must_not}``
    whose numbers index ``terms``. A query of no words has no clauses.

    In English mode terms are stems; stop words are left out, and hold a place (-1) in phrases.
    """
    raw = F.regexp_extract_all(F.col("query"), F.lit(r'(-?"[^"]*"|\S+)'), F.lit(1))
    units = queries.select("query_id", raw.alias("raw")).select(
        "query_id",
        F.transform(
            "raw",
            lambda u, i: F.struct(
                F.size(F.filter(F.slice("raw", F.lit(1), i), lambda p: F.lower(p) == "or")).alias("clause"),
                F.startswith(u, F.lit("-")).alias("negated"),
                F.when(F.lower(u) == "or", F.array().cast("array<string>")).otherwise(text.words(u)).alias("words"),
            ),
        ).alias("units"),
    )
    units = _stemmed(units) if english else units
    said = lambda words: F.filter(words, lambda w: w != "")
    units = units.withColumn("units", F.filter("units", lambda u: F.size(said(u["words"])) > 0))
    terms = F.array_distinct(F.flatten(F.transform("units", lambda u: said(u["words"]))))
    q = units.withColumn("terms", terms)

    def index(words: Column) -> Column:
        return F.transform(words, lambda w: F.when(w == "", F.lit(-1)).otherwise((F.array_position("terms", w) - 1).cast("int")))

    def clause(c: Column) -> Column:
        mine = F.filter("units", lambda u: u["clause"] == c)
        positive = F.filter(mine, lambda u: ~u["negated"])
        return F.struct(
            F.array_distinct(F.flatten(F.transform(positive, lambda u: index(said(u["words"]))))).alias("must"),
            F.transform(F.filter(positive, lambda u: F.size(said(u["words"])) > 1), lambda u: index(u["words"])).alias("phrases"),
            F.transform(F.filter(mine, lambda u: u["negated"]), lambda u: index(u["words"])).alias("must_not"),
        )

    numbers = F.array_distinct(F.transform("units", lambda u: u["clause"]))
    return q.select("query_id", "terms", F.transform(numbers, clause).alias("clauses"))


def _stemmed(units: DataFrame) -> DataFrame:
    """The units with each word replaced by its stem, stop words by nothing."""
    words = F.array_distinct(F.flatten(F.transform("units", lambda u: u["words"])))
    used = units.select("query_id", F.explode(words).alias("term"))
    known = stems(used.select("term").distinct())
    forms = used.join(known, "term").groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "stem"))).alias("forms"))

    def one(w: Column) -> Column:
        return F.when(w.isin(STOP_WORDS), F.lit("")).otherwise(F.try_element_at("forms", w))

    new = F.transform("units", lambda u: u.withField("words", F.transform(u["words"], one)))
    return units.join(forms, "query_id", "left").select("query_id", new.alias("units"))


def _contains_phrase(occ: Column, phrase: Column) -> Column:
    """Whether the words stand next to each other in order."""

    def starts(i: Column) -> Column:
        return F.transform(F.filter(occ, lambda o: o["k"] == F.get(phrase, i)), lambda o: o["pos"] - i)

    def common(places: Column) -> Column:
        rest = F.slice(places, F.lit(2), F.size(places))
        return F.aggregate(rest, starts(F.get(places, F.lit(0))), lambda acc, i: F.array_intersect(acc, starts(i)))

    # a stop word takes a place but is not looked for
    places = F.filter(F.transform(phrase, lambda k, i: F.when(k >= 0, i)), lambda i: i.isNotNull())
    return F.size(let(places, common)) > 0


def _satisfied(occ: Column, clauses: Column) -> Column:
    """The clauses an item meets."""
    present = F.transform(occ, lambda o: o["k"])
    return F.filter(
        clauses,
        lambda c: (F.size(c["must"]) > 0)
        & (F.size(F.array_except(c["must"], present)) == 0)
        & F.forall(c["phrases"], lambda p: _contains_phrase(occ, p))
        & ~F.exists(c["must_not"], lambda p: _contains_phrase(occ, p)),
    )


def _place(pos: Column, n: Column, inv: Column) -> Column:
    return F.struct(pos.cast("bigint").alias("pos"), n.cast("bigint").alias("n"), inv.cast("double").alias("inv"))


def _nowhere() -> Column:
    """The place of a word not seen yet: before every position, so it is the oldest and starts no span."""
    return _place(F.lit(-1), F.lit(0), F.lit(0.0))


def _musts(clauses: Column) -> Column:
    """The words each clause needs."""
    return F.transform(clauses, lambda c: c["must"])


def _used(musts: Column) -> Column:
    return F.array_distinct(F.flatten(musts))


def _span_start(last: Column, musts: Column) -> Column:
    """The place where the tightest span that ends here begins."""
    return F.array_max(F.transform(musts, lambda must: F.array_min(F.transform(must, lambda k: F.get(last, k)))))


def _state(last: Column, prev: Column, n: Column, inv: Column) -> Column:
    return F.struct(
        last.alias("last"), prev.cast("bigint").alias("prev"), n.cast("bigint").alias("n"), inv.cast("double").alias("inv"), F.lit(0.0).alias("score")
    )


def _nothing_seen(musts: Column) -> Column:
    size = F.array_max(_used(musts)) + 1
    return _state(F.array_repeat(_nowhere(), size), F.lit(-1), F.lit(0), F.lit(0.0))


def _fold(occ: Column, musts: Column, start: Column) -> Column:
    """One pass over occurrences in order, keeping the last place of each word.

    The oldest of those places starts the tightest span ending here; each new
    start is one cover, worth its mean weight over one plus the words between.
    """

    def step(s: Column, o: Column) -> Column:
        here = F.struct(o["pos"].alias("pos"), s["n"].alias("n"), s["inv"].alias("inv"))
        last = F.transform(s["last"], lambda x, i: F.when(i == o["k"], here).otherwise(x))
        n, inv = s["n"] + 1, s["inv"] + F.lit(1.0) / o["w"]

        def advance(x: Column) -> Column:
            p = x["p"]
            fresh = p["pos"] > s["prev"]
            inside = n - p["n"]
            gap = o["pos"] - p["pos"] - (inside - 1)
            worth = inside / (inv - p["inv"]) / (gap + 1)
            return F.struct(
                x["last"].alias("last"),
                F.when(fresh, p["pos"]).otherwise(s["prev"]).alias("prev"),
                n.alias("n"),
                inv.alias("inv"),
                F.when(fresh, s["score"] + worth).otherwise(s["score"]).alias("score"),
            )

        # the places are worked out once, not once for every word that looks at them
        return let(last, lambda seen: let(F.struct(seen.alias("last"), _span_start(seen, musts).alias("p")), advance))

    return F.aggregate(occ, start, step)


def _relevant(occ: Column, musts: Column) -> Column:
    """Occurrences of the words some clause needs."""
    return let(
        F.struct(occ.alias("occ"), _used(musts).alias("used")),
        lambda x: F.filter(x["occ"], lambda o: F.array_contains(x["used"], o["k"])),
    )


def cover_density(occ: Column, clauses: Column) -> Column:
    """Rank by minimal covers (Clarke, Cormack and Tudhope, 2000)."""

    def rank(x: Column) -> Column:
        single = F.aggregate(x["occ"], F.lit(0.0), lambda s, o: s + o["w"])
        folded = _fold(x["occ"], x["musts"], _nothing_seen(x["musts"]))["score"]
        return F.when(F.size(_used(x["musts"])) == 1, single).otherwise(folded)

    musts = _musts(clauses)
    return let(F.struct(_relevant(occ, musts).alias("occ"), musts.alias("musts")), rank)


# A thread of more characters than this is matched in blocks of positions.
THREAD_CHARS, BLOCK = 16_000_000, 65_536
# The same for stored occurrences: matched words of one item.
THREAD_WORDS = 2_000_000


def long_threads(notes: DataFrame) -> DataFrame:
    """Items whose notes together are too long to gather in one row."""
    sizes = notes.groupBy("entry_id").agg(F.sum(F.length("body")).alias("chars"))
    return sizes.where(F.col("chars") > THREAD_CHARS).select("entry_id")


def match(
    queries: DataFrame,
    entries: DataFrame,
    notes: DataFrame,
    stopwords: list[str] | None = None,
    postings: DataFrame | None = None,
    english: bool = False,
) -> DataFrame:
    """(query_id, id, rank) of every item that satisfies a query's words.

    A query part of excluded words only is met by every item without them, at
    rank zero.

    With ``postings``, as ``write_postings`` returns them, nothing is tokenised, but all of them are read;
    ``search_index`` opens those of the wanted words only. A small
    query table is broadcast, so occurrences are picked where they are found.

    In English mode words match by stem: the store's distinct words are stemmed, and those that share a stem
    with a query are looked for.
    """
    stop = (STOP_WORDS if english else []) if stopwords is None else stopwords
    if postings is not None:
        def of(wanted: DataFrame) -> DataFrame:
            return postings.join(wanted.select("*", _bucket()), ["bucket", "term"], "left_semi").drop("bucket")

        return match_stored(queries, entries, of, english)
    q = query_clauses(queries, english)
    wanted = q.select("query_id", F.posexplode("terms").alias("k", "term"))
    if english:
        wanted = broadcast_if_small(stored(forms_of(wanted, vocabulary(entries, notes)), "query-forms"))
    found = _floating(entries, notes, wanted, stop)
    long = long_threads(notes)
    if long.isEmpty():
        hits = _match_rows(found, q)
    else:
        long = broadcast_if_small(stored(long, "long-threads"))
        theirs = lambda df, key: df.join(long.withColumnRenamed("entry_id", key), key, "left_semi")
        of_long = occurrences(theirs(entries, "id"), theirs(notes, "entry_id"), wanted, stop)
        hits = _match_rows(found.join(long, "entry_id", "left_anti"), q).unionByName(_match_blocks(of_long, q))
    return _with_excluders(hits, q, entries, lambda ids: occurrences(entries, notes, wanted.join(ids, "query_id", "left_semi"), stop))


def match_stored(queries: DataFrame, entries: DataFrame, postings_of: Callable[[DataFrame], DataFrame], english: bool = False) -> DataFrame:
    """``match`` over stored occurrences: ``postings_of`` gives those of wanted terms (term) as (term, entry_id, pos, w).

    An item that meets a part of a query holds its rarest needed word, so the lists of those
    words name the few items whose other words are looked at, and of those only items that hold all the words
    some part needs have their occurrences dealt. A word every item holds costs its own list,
    not its list times the queries that use it.
    """
    q = query_clauses(queries, english)
    wanted = stored(q.select("query_id", F.posexplode("terms").alias("k", "term")), "wanted-words")
    held = stored(postings_of(wanted.select("term").distinct()), "matched-words", alone=True)
    met = _wholly_met(q, held, _rarest_met(q, wanted, held))
    asked = broadcast_if_small(wanted)
    # pairs learn their words before they meet occurrences, so no occurrence is copied for a query its item does not meet
    found = stored(held.join(broadcast_if_small(met.join(asked, "query_id")), ["term", "entry_id"]), "met-words", alone=True)
    sizes = found.groupBy("query_id", "entry_id").agg(F.count("*").alias("n"))
    long = sizes.where(F.col("n") > THREAD_WORDS).select("entry_id").distinct()
    standing = found.withColumn("in_notes", F.lit(False)).withColumn("end_of_body", F.lit(None).cast("bigint"))
    if long.isEmpty():
        hits = _match_rows(standing, q)
    else:
        long = broadcast_if_small(stored(long, "long-threads"))
        short, of_long = standing.join(long, "entry_id", "left_anti"), found.join(long, "entry_id", "left_semi")
        hits = _match_rows(short, q).unionByName(_match_blocks(of_long, q))
    return _with_excluders(hits, q, entries, lambda ids: held.join(asked.join(ids, "query_id", "left_semi"), "term"))


def _rarest_met(q: DataFrame, wanted: DataFrame, held: DataFrame) -> DataFrame:
    """(query_id, entry_id) of items that hold, for some part of the query, the rarest word it needs."""
    counts = held.groupBy("term").agg(F.count("*").alias("n"))
    rated = wanted.join(counts, "term", "left").select("query_id", "k", "term", F.coalesce("n", F.lit(0)).alias("n"))
    needs = q.select("query_id", F.posexplode("clauses").alias("part", "c")).select("query_id", "part", F.explode("c.must").alias("k"))
    rarest = needs.join(rated, ["query_id", "k"]).groupBy("query_id", "part").agg(F.min(F.struct("n", "term")).alias("r"))
    rarest = stored(rarest.where("r.n > 0").select("query_id", F.col("r.term").alias("term")).distinct(), "rarest-words")
    return stored(held.join(broadcast_if_small(rarest), "term").select("query_id", "entry_id").distinct(), "met-items", alone=True)


def _wholly_met(q: DataFrame, held: DataFrame, met: DataFrame) -> DataFrame:
    """Those of ``met`` whose item holds all the words that some part of the query needs.

    Words are compared by hash, one list of distinct words per item; two words of one hash let an item too many
    through, which matching drops. A query of one needed word is met by its rarest word already.
    """
    musts = F.transform("clauses", lambda c: F.transform(c["must"], lambda k: F.xxhash64(F.get("terms", k))))
    asked = q.select("query_id", F.filter(musts, lambda m: F.size(m) > 0).alias("musts"))
    single = asked.where(F.exists("musts", lambda m: F.size(m) == 1)).select("query_id")
    several = met.join(broadcast_if_small(single), "query_id", "left_anti")
    words = held.select("entry_id", F.xxhash64("term").alias("word")).distinct().groupBy("entry_id").agg(F.collect_list("word").alias("words"))
    tested = several.join(words, "entry_id").join(broadcast_if_small(asked), "query_id")
    whole = tested.where(F.exists("musts", lambda m: F.size(F.array_except(m, F.col("words"))) == 0)).select("query_id", "entry_id")
    return stored(met.join(broadcast_if_small(single), "query_id", "left_semi").unionByName(whole), "wholly-met", alone=True)


def _with_excluders(hits: DataFrame, q: DataFrame, entries: DataFrame, found_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The hits and, for queries with a part of excluded words only, all items without those."""
    bare = q.where(F.exists("clauses", _only_excludes))
    if bare.isEmpty():
        return hits
    free = entries.select("id").join(broadcast_if_small(bare.select("query_id")))
    barred = _barred(found_of(bare.select("query_id")), bare)
    free = free.join(barred, ["query_id", "id"], "left_anti").join(hits, ["query_id", "id"], "left_anti")
    return hits.unionByName(free.withColumn("rank", F.lit(0.0)))


def vocabulary(entries: DataFrame, notes: DataFrame) -> DataFrame:
    """The distinct words of the store."""
    fields = [F.coalesce("title", F.lit("")), F.array_join(shelves.tag_list(F.col("tags")), " "), F.coalesce("body", F.lit("")), values.values_text(F.col("data"))]
    own = entries.select(F.array_distinct(text.words(F.concat_ws(" ", *fields))).alias("t"))
    said = notes.select(F.array_distinct(text.words(F.col("body"))).alias("t"))
    return each(own.unionByName(said), F.col("t"), "term").distinct()


def forms_of(wanted: DataFrame, words: DataFrame) -> DataFrame:
    """``wanted`` (term, …), each stem replaced by the words that have it."""
    # stored: a join on stems would push its null test down through every stage of the stemmer
    return stored(stems(words), "stems").join(wanted.withColumnRenamed("term", "stem"), "stem").drop("stem")


def _only_excludes(clause: Column) -> Column:
    return (F.size(clause["must"]) == 0) & (F.size(clause["must_not"]) > 0)


def _barred(found: DataFrame, bare: DataFrame) -> DataFrame:
    """(query_id, id) of items that hold what every excluding clause of a query excludes.

    Excluded phrases are found by counting the words that agree on where the
    phrase would start; no item's words need to meet in one row.
    """

    def name(unit: Column) -> Column:
        return F.array_join(F.transform(unit, lambda k: k.cast("string")), ",")

    b = bare.select("query_id", F.transform(F.filter("clauses", _only_excludes), lambda c: c["must_not"]).alias("out"))
    units = b.select("query_id", F.explode(F.array_distinct(F.flatten("out"))).alias("unit"))
    looked = F.size(F.filter("unit", lambda k: k >= 0))
    units = units.select("query_id", name(F.col("unit")).alias("u"), looked.alias("len"), F.posexplode("unit").alias("i", "k"))
    present = (
        found.join(units, ["query_id", "k"])
        .groupBy("query_id", "entry_id", "u", "len", (F.col("pos") - F.col("i")).alias("start"))
        .agg(F.count("*").alias("n"))
        .where(F.col("n") == F.col("len"))
        .groupBy("query_id", "entry_id")
        .agg(F.collect_set("u").alias("us"))
    )
    holds = F.forall("out", lambda c: F.exists(c, lambda unit: F.array_contains("us", name(unit))))
    return present.join(b, "query_id").where(holds).select("query_id", F.col("entry_id").alias("id"))


def _match_rows(found: DataFrame, q: DataFrame) -> DataFrame:
    """Items of ordinary length: the matched words of one item meet in one row."""
    gathered = found.groupBy("query_id", "entry_id").agg(
        F.collect_list(F.struct("pos", "k", "w", "in_notes")).alias("seen"), F.coalesce(F.max("end_of_body"), F.lit(0)).alias("end")
    )
    shifted = F.transform(
        "seen",
        lambda o: F.struct(
            (o["pos"] + F.when(o["in_notes"], F.col("end")).otherwise(0)).alias("pos"), o["k"].alias("k"), o["w"].alias("w")
        ),
    )
    grouped = gathered.select("query_id", "entry_id", F.array_sort(shifted).alias("occ"))
    # exploding a list of none or one keeps the test from being evaluated twice
    met = F.filter(F.array(_satisfied(F.col("occ"), F.col("clauses"))), lambda m: F.size(m) > 0)
    told = grouped.join(q.select("query_id", "clauses"), "query_id")
    return each(told, met, "met", "query_id", "entry_id", "occ").select(
        "query_id", F.col("entry_id").alias("id"), cover_density(F.col("occ"), F.col("met")).alias("rank")
    )


def _match_blocks(found: DataFrame, q: DataFrame) -> DataFrame:
    """The same result for items of any length, block by block of positions.

    What each block holds (words, whole phrases) is put together per item to
    decide which clauses it meets. Covers are then found in every block at once,
    each starting from the last place of each word in the blocks before it.
    Words just past a block's end are shown to it too, so that no phrase is cut.
    """
    key = ["query_id", "entry_id"]
    every = F.flatten(F.transform("clauses", lambda c: F.concat(c["phrases"], c["must_not"])))
    units = q.select("query_id", "clauses", F.array_distinct(every).alias("units"))
    units = units.withColumn("span", F.coalesce(F.array_max(F.transform("units", lambda u: F.size(u))), F.lit(1)))
    own = F.floor(F.col("pos") / BLOCK)
    spill = (F.col("pos") % BLOCK < F.col("span") - 1) & (own > 0)
    inside = F.struct(own.alias("block"), F.lit(False).alias("extra"))
    before = F.struct((own - 1).alias("block"), F.lit(True).alias("extra"))
    members = F.when(spill, F.array(inside, before)).otherwise(F.array(inside))
    placed = each(found.join(units.select("query_id", "span"), "query_id"), members, "b", *key, "pos", "k", "w")
    blocks = stored(
        placed.groupBy(*key, F.col("b.block").alias("block")).agg(
            F.array_sort(F.collect_list(F.struct("pos", "k", "w", F.col("b.extra").alias("extra")))).alias("seen")
        ),
        "blocks",
    )

    def unit_name(u: Column) -> Column:
        return F.concat(F.lit("p"), F.array_join(F.transform(u, lambda k: k.cast("string")), ","))

    def word_name(k: Column) -> Column:
        return F.concat(F.lit("k"), k.cast("string"))

    words = F.transform(F.filter("seen", lambda o: ~o["extra"]), lambda o: word_name(o["k"]))
    whole_units = F.transform(F.filter("units", lambda u: _contains_phrase(F.col("seen"), u)), unit_name)
    facts = F.concat(F.array_distinct(words), whole_units)
    held = each(blocks.join(units, "query_id"), facts, "fact", *key).groupBy(*key).agg(F.collect_set("fact").alias("facts"))
    satisfied = F.filter(
        "clauses",
        lambda c: (F.size(c["must"]) > 0)
        & F.forall(c["must"], lambda k: F.array_contains("facts", word_name(k)))
        & F.forall(c["phrases"], lambda p: F.array_contains("facts", unit_name(p)))
        & ~F.exists(c["must_not"], lambda p: F.array_contains("facts", unit_name(p))),
    )
    met = held.join(units.select("query_id", "clauses"), "query_id").select(*key, satisfied.alias("met")).where(F.size("met") > 0)

    own_words = _relevant(F.filter("seen", lambda o: ~o["extra"]), _musts(F.col("met")))
    rows = blocks.join(met, key).select(*key, "block", _musts(F.col("met")).alias("musts"), own_words.alias("occ"))
    # what each block adds by itself: how many words, and where each came last
    local = rows.select(*key, "block", _fold(F.col("occ"), F.col("musts"), _nothing_seen(F.col("musts"))).alias("s"))
    run = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = local.select(
        *key, "block", "s.last",
        F.coalesce(F.sum("s.n").over(run), F.lit(0)).alias("n0"), F.coalesce(F.sum("s.inv").over(run), F.lit(0.0)).alias("inv0"),
    )
    shifted = F.transform(
        "last",
        lambda p, k: F.struct(
            k.alias("k"),
            F.when(p["pos"] >= 0, _place(p["pos"], p["n"] + F.col("n0"), p["inv"] + F.col("inv0"))).alias("place"),
        ),
    )
    per_word = Window.partitionBy(*key, "k").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        each(sums, shifted, "l", *key, "block", "n0", "inv0")
        .select(*key, "block", "n0", "inv0", F.col("l.k").alias("k"), F.col("l.place").alias("place"))
        .withColumn("place", F.last("place", ignorenulls=True).over(per_word))
        .groupBy(*key, "block", "n0", "inv0")
        .agg(F.array_sort(F.collect_list(F.struct("k", "place"))).alias("last"))
        .select(*key, "block", "n0", "inv0", F.transform("last", lambda x: F.coalesce(x["place"], _nowhere())).alias("last"))
    )
    so_far = _span_start(F.col("last"), F.col("musts"))["pos"]
    scored = rows.join(carried, [*key, "block"]).select(
        *key, _fold(F.col("occ"), F.col("musts"), _state(F.col("last"), so_far, F.col("n0"), F.col("inv0")))["score"].alias("score")
    )
    return scored.groupBy(*key).agg(F.sum("score").alias("rank")).select("query_id", F.col("entry_id").alias("id"), "rank")


# -- snippets ----------------------------------------------------------------------

SNIPPET_WORDS, SNIPPET_MIN = 28, 8


def snippet(title: Column, body: Column, terms: Column) -> Column:
    """The stretch of title and body with most query words in it, words marked ``**``.

    The first such stretch wins; with no query word in the text, its opening
    words are shown.
    """
    shown = F.concat(F.coalesce(title, F.lit("")), F.lit(" — "), F.coalesce(body, F.lit("")))
    pieces = F.filter(F.split(shown, r"\s+"), lambda w: w != "")

    def build(x: Column) -> Column:
        hit_flags = F.transform(x["w"], lambda w: F.arrays_overlap(text.words(w), x["t"]))
        return let(F.struct(x["w"].alias("w"), hit_flags.alias("hit")), choose)

    def choose(x: Column) -> Column:
        at = F.filter(F.transform(x["hit"], lambda h, i: F.when(h, i)), lambda i: i.isNotNull())
        return let(F.struct(x["w"].alias("w"), x["hit"].alias("hit"), at.alias("at")), cut)

    def cut(x: Column) -> Column:
        # words hit within a full-length stretch that starts at each hit
        counts = F.transform(
            x["at"],
            lambda i: F.struct(
                F.size(F.filter(F.slice(x["at"], F.array_position(x["at"], i).cast("int"), F.lit(SNIPPET_WORDS)),
                                lambda j: j < i + SNIPPET_WORDS)).alias("n"),
                (-i).alias("early"),
            ),
        )
        best = F.array_max(counts)
        first = F.coalesce(-best["early"], F.lit(0))
        length = F.when(best.isNotNull(), SNIPPET_WORDS).otherwise(SNIPPET_MIN)
        marked = F.zip_with(x["w"], x["hit"], lambda w, h: F.when(h, F.concat(F.lit("**"), w, F.lit("**"))).otherwise(w))
        return F.nullif(F.array_join(F.slice(marked, first + 1, length), " "), F.lit(""))

    return let(F.struct(pieces.alias("w"), terms.alias("t")), build)
