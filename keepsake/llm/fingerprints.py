"""Document fingerprints by I-Match over randomised lexicons, with DataFrame functions only.

A text's terms are its distinct words in lower case. Those whose inverse document
frequency lies in a chosen band are kept: terms of half of all documents say
nothing, terms of one document match nothing. The lexicon is hashed: a term has a
slot, and a slot's frequency is the number of documents with a term in it.

The kept terms meet several random subsets of the lexicon: ``SUBSETS`` at each
of ``LEVELS`` rates, every level a quarter as dense as the one before, so that
a short text and a very long one both have subsets that hold a term or two. The terms in a
subset are sorted and hashed; the hashes of all subsets that hold a term are the
fingerprint. Two texts are like each other by the share of subsets, of those that hold a term
of either, where both have the same hash; the level is the densest one that
still leaves subsets empty. For sparse subsets this share is the Jaccard similarity
of the kept terms.

Edge cases: a null text is an empty one; a text without words has an empty
fingerprint, and two empty fingerprints are wholly alike (1.0), an empty and another one not
at all (0.0); a text with fewer than ``FEWEST`` terms in the band keeps all its terms; equal texts have
equal fingerprints. In ``follow`` documents go by ascending id, null ids first, equal ids by a
hash of the text; the last one is followed by the first, a single one by itself. An empty
table gives an empty one. Extra columns are kept by ``fingerprint`` and ignored by ``query``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keepsake.llm.common import table
from keepsake.session import stored

# Not a word character, after lower-casing.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Slots of the hashed lexicon: 64 to the word, so the lexicon is 4096 numbers.
SLOT_BITS = 18
# The band: in at least so many documents, and in at most this share of them.
AT_LEAST, AT_MOST = 2, 0.02
LEVELS, SUBSETS = 4, 64
FEWEST = 8
# Subsets in use up to which a level is sparse enough to compare.
SPARSE = 40
# Documents of neighbouring ids in one bucket, and the most buckets there are.
BUCKET_ROWS, MOST_BUCKETS, COARSE = 1024, 100_000, 64


def _unsigned_right(value: Column, bits: int) -> Column:
    return F.shiftrightunsigned(value, bits)


def terms_of(text: Column) -> Column:
    """Hashes of the distinct words."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), GAPS)
    return F.array_distinct(F.array_remove(F.transform(words, lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))))


def lexicon_of(docs: DataFrame, at_least: int = AT_LEAST, at_most: float = AT_MOST) -> list[int]:
    """The slots in the band, as bits of 4096 numbers: what goes to the driver has a fixed size."""
    slots = F.array_distinct(F.transform(terms_of(F.col("text")), lambda t: _unsigned_right(t, 64 - SLOT_BITS).cast("int")))
    counts = docs.select(F.explode(slots).alias("slot")).groupBy("slot").agg(F.count("*").alias("df"))
    most = max(float(at_least), at_most * docs.count())
    fine = counts.where((F.col("df") >= at_least) & (F.col("df") <= most))
    bit = F.expr("shiftleft(1L, slot & 63)")
    rows = fine.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).collect()
    out = [0] * (1 << (SLOT_BITS - 6))
    for r in rows:
        out[r["at"]] = r["bits"]
    return out


def _bits(lexicon: list[int]) -> Column:
    """The lexicon as a constant: folded from one string, not from thousands of numbers."""
    return F.split(F.lit(",".join(map(str, lexicon))), ",").cast("array<long>")


def _entries(held: Column, starts: Column, level: int) -> Column:
    """The marks of one level: (level, subset) in the upper half, the hash of the subset's sorted terms in the lower."""
    def one(start: Column, j: Column) -> Column:
        end = F.coalesce(F.get(starts, j + 1), F.size(held))
        number = F.shiftright(F.get(held, start), 57) + level * SUBSETS
        return F.shiftleft(number, 32).bitwiseOR(F.xxhash64(F.slice(held, start + 1, end - start)).bitwiseAND(F.lit(0xFFFFFFFF)))

    return F.transform(starts, one)


def fingerprint(docs: DataFrame, lexicon: list[int], text: str = "text", name: str = "marks") -> DataFrame:
    """The rows with an array of longs, one for each subset that holds a term, ascending by subset."""
    own = f"__{name}"
    bits = _bits(lexicon)

    def in_band(t: Column) -> Column:
        slot = _unsigned_right(t, 64 - SLOT_BITS).cast("int")
        return F.getbit(F.get(bits, F.shiftright(slot, 6)), slot.bitwiseAND(F.lit(63))) == 1

    out = docs.withColumn(f"{own}_terms", terms_of(F.col(text)))
    out = out.withColumn(f"{own}_kept", F.filter(f"{own}_terms", in_band))
    kept = F.when(F.size(f"{own}_kept") >= FEWEST, F.col(f"{own}_kept")).otherwise(F.col(f"{own}_terms"))
    # the subset's number goes on top, so that sorting brings a subset's terms together
    key = lambda t: F.shiftleft(t.bitwiseAND(F.lit(SUBSETS - 1)), 57).bitwiseOR(_unsigned_right(t, 7))
    out = out.withColumn(f"{own}_0", F.array_sort(F.transform(kept, key)))
    for level in range(1, LEVELS):
        mask = F.lit(4**level - 1)
        out = out.withColumn(f"{own}_{level}", F.filter(f"{own}_0", lambda k: k.bitwiseAND(mask) == 0))
    for level in range(LEVELS):
        held = F.col(f"{own}_{level}")
        first = lambda i: (i == 0) | (F.shiftright(F.get(held, i), 57) != F.shiftright(F.get(held, i - 1), 57))  # noqa: B023, E731
        places = F.when(F.size(held) > 0, F.sequence(F.lit(0), F.size(held) - 1)).otherwise(F.array().cast("array<int>"))
        out = out.withColumn(f"{own}_at_{level}", F.filter(places, first))
    parts = [_entries(F.col(f"{own}_{n}"), F.col(f"{own}_at_{n}"), n) for n in range(LEVELS)]
    out = out.withColumn(name, F.concat(*parts))
    return out.drop(*[c for c in out.columns if c.startswith(f"{own}_")])


def likeness(a: str, b: str) -> Column:
    """How alike two arrays of marks are, 0 to 1."""
    at = lambda marks, level: F.filter(F.transform(marks, lambda m: F.shiftright(m, 32)), lambda k: F.shiftright(k, 6) == level)
    both = F.array_intersect(a, b)
    shares, last = [], F.lit(None).cast("double")
    for level in range(LEVELS):
        used = F.size(F.array_union(at(F.col(a), level), at(F.col(b), level)))
        share = F.size(at(both, level)) / used
        shares.append(F.when((used > 0) & (used <= SPARSE), share))
        last = F.coalesce(F.when(used > 0, share), last)
    return F.coalesce(*shares, last, F.lit(1.0))


def shown(marks: str) -> Column:
    """The fingerprint as text."""
    return F.array_join(F.transform(marks, lambda m: F.lower(F.hex(m))), ".")


def _bucketed(docs: DataFrame) -> DataFrame:
    """The rows with a bucket number that ascends with (doc_id, h): even stretches between quantiles of the ids."""
    rows = docs.count()
    points = [i / COARSE for i in range(COARSE + 1)]
    bounds = docs.agg(F.percentile_approx("doc_id", points, 10_000)).first()[0] or [0]
    edges = sorted(set(bounds))
    fine = max(1, -(-min(MOST_BUCKETS, max(1, rows // BUCKET_ROWS)) // len(edges)))
    widths = [max(1, -(-(b - a) // fine)) for a, b in zip(edges, edges[1:])] + [1]
    literal = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<long>")
    out = docs.withColumn("__coarse", F.greatest(F.size(F.filter(literal(edges), lambda e: e <= F.col("doc_id"))) - 1, F.lit(0)))
    into = F.floor((F.col("doc_id") - F.get(literal(edges), F.col("__coarse"))) / F.get(literal(widths), F.col("__coarse")))
    inside = F.greatest(F.least(into, F.lit(fine - 1)), F.lit(0))
    # rows without id come first and go by their hash
    many = fine * len(edges)
    spot = F.least(F.floor((F.col("h") / 2.0**64 + 0.5) * many), F.lit(many - 1)) - many
    return out.withColumn("bucket", F.when(F.col("doc_id").isNull(), spot).otherwise(F.col("__coarse") * fine + inside).cast("int")).drop("__coarse")


def follow(docs: DataFrame, lexicon: list[int]) -> DataFrame:
    """doc_id, text, marks, next_text and next_marks.

    Neighbouring ids share a bucket; the first document of each is also sent to the bucket before it, so
    every document finds its successor in one sorted pass, and texts are shuffled once.
    """
    rows = _bucketed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")))
    order = [F.col("doc_id").asc_nulls_first(), "h"]
    heads = rows.groupBy("bucket").agg(F.min_by(F.struct("doc_id", "h"), F.struct(F.coalesce("doc_id", F.lit(-(2**63))), "h")).alias("head"))
    heads = stored(heads, "fingerprint-heads")  # at most some 2 * MOST_BUCKETS rows
    last = heads.agg(F.max("bucket")).first()[0]
    before = F.lag("bucket").over(W.orderBy("bucket"))
    heads = heads.select(F.coalesce(before, F.lit(last)).alias("before"), before.isNull().cast("int").alias("late"), "head.*")
    heads = heads.select("before", "late", F.col("doc_id").alias("head_id"), F.col("h").alias("head_h"))
    met = rows.join(F.broadcast(heads), rows["doc_id"].eqNullSafe(heads["head_id"]) & (rows["h"] == heads["head_h"]), "left")
    own = F.struct("bucket", F.lit(0).alias("guest"), F.lit(0).alias("late"))
    sent = F.struct(F.col("before").alias("bucket"), F.lit(1).alias("guest"), "late")
    homes = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, sent))
    dealt = met.select("doc_id", "text", "h", F.explode(homes).alias("home")).select("doc_id", "text", "h", "home.*").repartition("bucket")
    marked = fingerprint(dealt, lexicon)
    ahead = W.partitionBy("bucket").orderBy("late", *order, "guest")
    out = marked.withColumn("next", F.lead(F.struct("text", "marks")).over(ahead)).where(F.col("guest") == 0)
    return out.select("doc_id", "text", "marks", F.col("next.text").alias("next_text"), F.col("next.marks").alias("next_marks"))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lexicon = lexicon_of(docs)
    rows = follow(docs, lexicon).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substr("next_text", F.lit(1), half))
    rows = fingerprint(rows.withColumn("edited", edited), lexicon, "edited", "edited_marks")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), shown("marks").alias("fingerprint"),
        shown("edited_marks").alias("edited_fingerprint"), likeness("marks", "edited_marks").alias("near_edited"), likeness("marks", "next_marks").alias("near_next"),
    )
