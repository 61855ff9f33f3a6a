"""Line deduplication: an exact set-similarity join of lines with DataFrame functions only.

Equal lines are one line from the start, known by its first place (document id,
a hash of the text, line number). A line is the set of its lower-cased words, ordered by
rarity: words are counted over all documents, in a fixed number of slots. Two
lines of Jaccard similarity t share a word among their first n - ceil(t n) + 1;
those words, as hashes, are joined, under the length and the positional filter. Every row of the join
also carries the parity of its line's words by 128 slots: the words in which two lines
differ are at least as many as the bits in which their parities do, so most chance meetings go
before they leave the join. (64 slots are too few from about 100 words on: half of the bits differ
by chance, and half is no more than such lines may differ in.) What is left is verified on the hashes of all words. A line goes if an equal or
similar line comes before it, whether or not that one stays.

Edge cases: null and empty texts have no lines; lines without words stay and have
no links; repeated rows of a document are one document and come once; null
ids come before others; an empty table gives no rows. Extra columns are ignored by ``find``
and kept by ``remove``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import WORD, table, whole_row
from keepsake.session import each, stored

SIMILARITY = 0.8
SLOT_BITS = 16
RANK_STEPS = 4  # steps of rarity per doubling of a word's count
SPACES = "\t\n\x0b\x0c\r"
OTHER_SPACE = "[\t\x0b\x0c\r]"


def _pieces(text: Column) -> Column:
    """The lower-cased words between white space, and empty pieces."""
    # cutting at one character is much faster than at a pattern, and few texts need the pattern
    plain = F.split(F.replace(F.lower(text), F.lit("\n"), F.lit(" ")), " ")
    return F.when(text.rlike(OTHER_SPACE), F.split(F.lower(text), f"[{SPACES} ]")).otherwise(plain)


def _words(line: Column) -> Column:
    """Hashes of the different words: 64 bits stand for a word."""
    return F.array_distinct(F.transform(F.array_remove(_pieces(line), ""), lambda w: F.xxhash64(w)))


def _slot(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).cast("int")


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, h, line_no and line of every line with words."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), F.split("text", "\n").alias("lines"))
    # the outer form keeps Spark from cutting the text a second time, to see whether it has lines
    rows = texts.select("doc_id", "h", F.posexplode_outer("lines").alias("line_no", "line"))
    return rows.where(F.ltrim("line", F.lit(SPACES + " ")) != "")


def rarity(docs: DataFrame) -> list[int]:
    """Ranks by slot, from rare to frequent, of the words of all documents: a list of fixed length."""
    words = each(docs, _pieces(F.col("text")), "word").where("word != ''")
    per = words.groupBy(_slot(F.xxhash64("word")).alias("slot")).agg(F.count("*").alias("n"))
    ranks = [0] * (1 << SLOT_BITS)
    for slot, rank in per.select("slot", F.floor(F.log2("n") * RANK_STEPS).cast("int")).collect():  # at most one row per slot
        ranks[slot] = rank
    return ranks


def _parity(half: int) -> Column:
    """Whether the words of a set in each of 64 slots are odd in number; two halves of the words have slots of their own."""
    bit = f"shiftleft((w & 1L) ^ {1 - half}L, cast(shiftright(w, 52) & 63 AS INT))"
    return F.coalesce(F.expr(f"aggregate(words, 0L, (x, w) -> x ^ {bit})"), F.lit(0).cast("long"))


def similar_lines(distinct: DataFrame, ranks: list[int], similarity: float = SIMILARITY) -> DataFrame:
    """Linked ids (a, b) of ``distinct`` (id, line), each pair once; a further column c comes as a_c and b_c."""
    # one literal, folded from text while the plan is made
    held = F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<bigint>")
    zero = F.lit(0).cast("long")
    # rank of rarity above, hash below: one number per word, in the order of rarity;
    # two words that share a number make a candidate, never a link
    numbered = F.transform("words", lambda w: F.shiftleft(F.coalesce(F.get(held, _slot(w)), zero), 52) + w.bitwiseAND(F.lit((1 << 52) - 1)))
    # columns that cannot be null, or Spark would work out the words again to see whether they are
    sets = distinct.select("id", _words(F.col("line")).alias("words"))
    sets = sets.select("id", F.coalesce(F.size("words"), F.lit(0)).alias("n"), _parity(0).alias("even"), _parity(1).alias("odd"), F.sort_array(numbered).alias("words"))
    prefix = F.slice("words", 1, F.col("n") - F.ceil(F.col("n") * similarity - 1e-9).cast("int") + 1)
    # both sides read one shuffle of these rows; the outer form keeps Spark from evaluating the array twice
    tokens = sets.select("id", "n", "even", "odd", F.posexplode_outer(prefix).alias("at", "word")).where("word IS NOT NULL")
    a, b = tokens.alias("a"), tokens.alias("b")
    need = F.ceil((F.col("a.n") + F.col("b.n")) * (similarity / (1 + similarity)) - 1e-9)
    longer = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.id") < F.col("b.id")))
    near = longer & (F.col("a.n") >= F.col("b.n") * similarity - 1e-9) & (F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) >= need)
    apart = F.bit_count(F.col("a.even").bitwiseXOR(F.col("b.even"))) + F.bit_count(F.col("a.odd").bitwiseXOR(F.col("b.odd")))
    near = near & (apart <= F.col("a.n") + F.col("b.n") - 2 * need)
    pairs = stored(a.join(b, F.col("a.word") == F.col("b.word")).where(near).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct(), "line-pairs", alone=True)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    others = [c for c in distinct.columns if c not in ("id", "line")]
    sets = distinct.join(wanted, "id", "left_semi").select("id", *others, _words(F.col("line")).alias("words"))
    names = [*others, "words"]
    both = pairs.join(sets.toDF("a", *[f"a_{c}" for c in names]), "a").join(sets.toDF("b", *[f"b_{c}" for c in names]), "b")
    shared = F.size(F.array_intersect("a_words", "b_words"))
    alike = shared * (1 + similarity) >= similarity * (F.size("a_words") + F.size("b_words")) - 1e-9
    return both.where(alike).select("a", "b", *[f"{side}_{c}" for side in "ab" for c in others])


def find(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per line with words.

    doc_id, h (a hash of the text), line_no, class_doc_id and class_line_no (the first place of
    the line), n_links (different lines it is similar to) and removed.
    """
    place = F.struct("doc_id", "h", "line_no")
    key = F.unhex(F.md5(F.col("line").cast("binary"))).alias("key")
    rows = lines_of(docs)
    distinct = rows.groupBy(key).agg(F.min(place).alias("first"), F.first("line").alias("line"), (F.count("*") > 1).alias("repeated"))
    # the numbers are kept with the table, so they do not change
    distinct = stored(distinct.withColumn("id", F.monotonically_increasing_id()), "lines", alone=True)
    links = similar_lines(distinct.select("id", "first", "line"), rarity(docs), similarity)
    ends = F.array(*[F.struct(F.col(x).alias("id"), (F.col(f"{y}_first") < F.col(f"{x}_first")).alias("after")) for x, y in ("ab", "ba")])
    links = stored(links.select(ends.alias("ends")), "line-links", alone=True)
    ends = links.select(F.explode("ends").alias("e"))
    per = ends.groupBy("e.id").agg(F.count("*").alias("n_links"), F.max("e.after").alias("after"))
    # a line that stands in one place and has no links is not looked up: it is its own first place
    known = distinct.select("id", "key", "first", "repeated").join(per, "id", "left").where("repeated OR n_links IS NOT NULL").select("key", "first", "n_links", "after")
    out = rows.select("doc_id", "h", "line_no", key).distinct().join(known, "key", "left").withColumn("first", F.coalesce("first", place))
    removed = F.coalesce("after", F.lit(False)) | ~place.eqNullSafe(F.col("first"))
    return out.select(
        "doc_id", "h", "line_no", F.col("first.doc_id").alias("class_doc_id"), F.col("first.line_no").alias("class_line_no"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), removed.alias("removed"),
    )


def remove(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, all columns kept, without the lines that repeat or resemble earlier ones."""
    gone = find(docs, similarity).where("removed").groupBy(F.struct("doc_id", "h").alias("key")).agg(F.collect_set("line_no").alias("gone"))
    keyed = docs.select(whole_row(docs), F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key")).join(gone, "key", "left")
    left = F.filter(F.split("doc.text", "\n"), lambda x, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(F.array_join(left, "\n"))
    return keyed.withColumn("doc", F.col("doc").withField("text", text)).select("doc.*")


def prefix_length(n: int, similarity: float = SIMILARITY) -> int:
    """How many of the rarest words of a line of n words are joined."""
    return n - math.ceil(n * similarity - 1e-9) + 1


def query(spark, sf_dir):
    return find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("h")
