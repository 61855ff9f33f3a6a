"""Benchmark decontamination with DataFrame functions only.

A window is ten consecutive words of a benchmark item, or a shorter item as a
whole. A document is cut into blocks of words side by side, so short that every
window that occurs in it covers one of them. Blocks meet a broadcast hash set of all
blocks of the windows; around each block found, the few windows that can lie there are spelt
out and compared as text, so hits are exact. The document's words stay in the
scanning task: nothing but ids, counts and hits is shuffled.

The benchmark is broadcast in pieces of a bounded number of words; more pieces
mean more passes over the documents.

Edge cases: a null, empty or wordless text has no words and no hits; an item
without words has no windows; repeated items count by id, rows repeated in the
documents come back as often as they went in; a null item id does not count as
an item; with an empty benchmark nothing is hit. Extra columns are ignored by
``hits`` and kept by ``remove``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import table, whole_row
from keepsake.session import stored

# A word character, before and after lower-casing A-Z.
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
# Words of benchmark windows in one broadcast: some 100 bytes each.
PIECE_WORDS = 500_000


def words_of(text: Column) -> Column:
    """Words in their own case; null has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(ANY_WORD), F.lit(0)), F.array().cast("array<string>"))


def block_words(window: int) -> int:
    """The longest block of which every stretch of ``window`` words covers one."""
    return (window + 1) // 2


def _block(words: Column, at: Column, size: int) -> Column:
    """A hash of ``size`` words from ``at``; their case plays no part."""
    return F.xxhash64(F.lit(size), F.lower(F.concat_ws(" ", *[F.get(words, at + j) for j in range(size)])))


def _spelt(words: Column, at: Column, length: Column, window: int) -> Column:
    """The words from ``at`` as text with A-Z in lower case."""
    text = F.concat_ws(" ", *[F.when(length > j, F.get(words, at + j)) for j in range(window)])
    return F.translate(text, UPPER, LOWER)


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, len, spelt and the words of every window, each once an item."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - window))
    rows = items.select("item_id", "words", F.explode(starts).alias("s")).withColumn("len", F.least(F.size("words"), F.lit(window)))
    rows = rows.select("item_id", "len", F.slice("words", F.col("s") + 1, "len").alias("words"))
    spelt = _spelt(F.col("words"), F.lit(0), F.col("len"), window)
    return rows.select("item_id", "len", spelt.alias("spelt"), "words").dropDuplicates(["item_id", "spelt"])


def _blocks_of(windows: DataFrame, lengths: list[int]) -> DataFrame:
    """block and len of all blocks in the windows."""
    made = []
    for n in lengths:
        size = block_words(n)
        at = F.explode(F.sequence(F.lit(0), F.lit(n - size))).alias("at")
        some = windows.where(F.col("len") == n).select("words", at)
        made.append(some.select(_block(F.col("words"), F.col("at"), size).alias("block"), F.lit(n).alias("len")))
    return reduce(DataFrame.union, made).distinct()


def _tiles(size: int) -> Column:
    """block, k and size of the document's blocks side by side."""
    last = F.floor(F.col("n_words") / size).cast("int") - 1
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda k: F.struct(_block(F.col("words"), k * size, size).alias("block"), k.alias("k"), F.lit(size).alias("size")))


def _found(texts: DataFrame, windows: DataFrame, lengths: list[int], window: int) -> DataFrame:
    """One row per document without hit (s is null), and one per occurrence of a window."""
    sizes = sorted({block_words(n) for n in lengths})
    none = F.struct(F.lit(None).cast("long").alias("block"), F.lit(-1).alias("k"), F.lit(0).alias("size"))
    tiles = [_tiles(b) for b in sizes]
    rows = texts.select("doc_id", "h", "words", "n_words", F.explode_outer(F.concat(F.array(none), *tiles)).alias("tile"))
    rows = rows.select("doc_id", "h", "words", "n_words", F.col("tile.block").alias("block"), F.col("tile.k").alias("k"), F.col("tile.size").alias("size"))
    # both sides are bounded by the words of one piece of the benchmark
    blocks = F.broadcast(_blocks_of(windows, lengths))
    spelt = F.broadcast(windows.select("spelt", F.xxhash64("spelt").alias("wid"), F.col("len").alias("wlen")).distinct())
    rows = rows.join(blocks, "block", "left").where(F.col("len").isNotNull() | (F.col("k") < 0))
    # a window that covers the block starts at most as far before it as it is longer
    low = F.greatest(F.lit(0), F.col("k") * F.col("size") + F.col("size") - F.col("len"))
    high = F.least(F.col("k") * F.col("size"), F.col("n_words") - F.col("len"))
    starts = F.array(*[F.when(low + j <= high, low + j) for j in range(window)])
    rows = rows.withColumn("s", F.explode(F.when(F.col("k") < 0, F.array(F.lit(None).cast("int"))).otherwise(F.filter(starts, lambda s: s.isNotNull()))))
    rows = rows.withColumn("spelt", F.when(F.col("s").isNotNull(), _spelt(F.col("words"), F.col("s"), F.col("len"), window)))
    rows = rows.join(spelt, (rows["spelt"] == spelt["spelt"]) & (rows["len"] == spelt["wlen"]), "left")
    rows = rows.where(F.col("wid").isNotNull() | (F.col("k") < 0))
    return rows.select("doc_id", "h", "n_words", (F.col("k") < 0).cast("long").alias("rows"), "s", F.col("wlen").alias("len"), "wid")


def _pieces(windows: DataFrame, piece_words: int) -> list[DataFrame]:
    words = windows.agg(F.sum("len")).first()[0] or 0
    n = -(-words // piece_words)
    if n <= 1:
        return [windows]
    return [windows.where(F.pmod(F.xxhash64("spelt"), F.lit(2 * n)) == i) for i in range(2 * n)]


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, piece_words: int = PIECE_WORDS) -> DataFrame:
    """Per document: doc_id, h (a hash of its text), n_words, n_hit, spans and items.

    ``spans`` are the (s, len) of its windows in words, ``items`` the sorted ids,
    as text, of the items whose windows occur. Rows of equal id and text are
    worked out once and given back as often as they came.
    """
    windows = stored(windows_of(benchmark, window), "benchmark-windows")
    lengths = [r[0] for r in windows.select("len").distinct().collect()]  # at most ``window`` numbers
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), words_of(F.col("text")).alias("words"))
    texts = texts.withColumn("n_words", F.size("words"))
    if not lengths:
        plain = texts.select("doc_id", "h", F.col("n_words").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"))
        return plain.withColumns({"spans": F.array().cast("array<struct<s:int,len:int>>"), "items": F.array().cast("array<string>")})
    rows = [_found(texts, piece, lengths, window) for piece in _pieces(windows, piece_words)]
    # every pass gives each document its row without hit; only those of the first are counted
    rows = reduce(DataFrame.union, [rows[0], *[r.withColumn("rows", F.lit(0).cast("long")) for r in rows[1:]]])
    span = F.when(F.col("s").isNotNull(), F.struct("s", "len"))
    per = rows.groupBy("doc_id", "h").agg(
        F.sum("rows").alias("rows"), F.max("n_words").cast("long").alias("n_words"), F.collect_set(span).alias("spans"), F.collect_set("wid").alias("wids")
    )
    per = stored(per, "benchmark-hits")
    pairs = windows.where(F.col("item_id").isNotNull()).select(F.xxhash64("spelt").alias("wid"), F.col("item_id").cast("string").alias("item_id"))
    wanted = per.where(F.size("wids") > 0).select("doc_id", "h", F.explode("wids").alias("wid"))
    items = wanted.join(pairs, "wid").groupBy(F.struct("doc_id", "h").alias("key")).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["s"], x["s"] + x["len"] - 1))))
    out = per.withColumn("key", F.struct("doc_id", "h")).join(items, "key", "left")
    out = out.select(
        "doc_id", "h", "n_words", F.size(covered).cast("long").alias("n_hit"), "spans",
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy"),
    )
    return out.drop("copy")


def remove(docs: DataFrame, benchmark: DataFrame, min_hits: int = 1, **how) -> DataFrame:
    """The documents, all columns kept, without those of ``min_hits`` hit words or more."""
    bad = hits(docs, benchmark, **how).where(F.col("n_hit") >= min_hits).select(F.struct("doc_id", "h").alias("key")).distinct()
    keyed = docs.select(whole_row(docs), F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"))
    return keyed.join(bad, "key", "left_anti").select("doc.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents with the words of windows cut out of the text.

    Texts without hits stay as they are; in the others the words left, in
    lower or upper case as they were, are joined by one space.
    """
    found = hits(docs, benchmark, **how).where("n_hit > 0").select(F.struct("doc_id", "h").alias("key"), "spans").distinct()
    keyed = docs.select(whole_row(docs), F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["s"], x["s"] + x["len"] - 1))))
    places = F.array_except(F.sequence(F.lit(0), F.size("words") - 1), covered)
    out = keyed.join(found, "key", "left").withColumn("words", F.when(F.col("spans").isNotNull(), words_of(F.col("doc.text"))))
    text = F.when(F.col("spans").isNull(), F.col("doc.text")).otherwise(F.array_join(F.transform(places, lambda i: F.get("words", i)), " "))
    return out.withColumn("doc", F.col("doc").withField("text", text)).select("doc.*")


def query(spark, sf_dir):
    got = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return got.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
SQL = f"""
with i as (select item_id, {_WORDS} w from benchmark),
iw as (select item_id, unnest(range(0, greatest(1, len(w) - {WINDOW - 1}))) s, w from i where len(w) > 0),
win as (select distinct item_id, least(len(w), {WINDOW}) n, array_to_string(w[s + 1 : s + least(len(w), {WINDOW})], ' ') t from iw),
d as (select row_number() over () nr, doc_id, {_WORDS} w from documents),
lens as (select distinct n from win),
dw as (select nr, n, unnest(range(0, len(w) - n + 1)) s, w from d, lens where len(w) >= n),
hit as (select nr, s, dw.n, item_id from (select nr, n, s, array_to_string(w[s + 1 : s + n], ' ') t from dw) dw join win on win.n = dw.n and win.t = dw.t),
per as (select nr, count(distinct p) n_hit from (select nr, unnest(range(s, s + n)) p from (select distinct nr, s, n from hit)) group by nr),
its as (select nr, count(*) n_items, string_agg(item, ',' order by item) ids from (select distinct nr, item_id::varchar item from hit where item_id is not null) group by nr)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join per using (nr) left join its using (nr)
"""
