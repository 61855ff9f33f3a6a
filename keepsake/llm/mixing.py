"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. A document is taken a whole number
of times for certain, and the fraction left is its chance of one more copy: a
document's rank is the odds of a uniform number drawn from its id, divided by
the odds of its inclusion chance (Rosén's Pareto sampling), and the lowest
ranks are taken until the words of the source are full.

Edge cases: a null text has no words and is taken with no effect; null sources
are one source, the last; repeated rows are separate documents with the same
rank; an empty table gives an empty mix. Columns beyond the four inputs are
ignored by ``mix`` and kept by ``expand``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keepsake.llm.common import WORD, table, whole_row, word_count
from keepsake.session import broadcast_if_small, stored

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
SEED = "mix"
# A document of more than this share of the words still to sample counts as large.
LARGE = 0.05
# Ranks are cut into this many slices, so that only one slice of a source is ever sorted.
SLICES = 4096


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """Source, its words and its target.

    Sources by code point, nulls last, get the weights in turn and share all
    words; a target stops at ``max_copies`` times the source, and the excess is
    shared by weight among the others. One row per source, so one window.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    at = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (at % len(weights) + 1).cast("int")).cast("long")
    caps = per.select("source", "source_size", weight.alias("w"), (F.col("source_size") * max_copies).alias("cap"))
    # sources that reach their cap first come first; what they leave is shared by the weights from here on
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    left = F.sum("source_size").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) - before
    filled = caps.select("*", left.alias("left"), rest.alias("rest"))
    full = F.col("left") * F.col("w") > F.col("cap") * F.col("rest")
    level = F.max(F.when(~full, F.col("left") / F.col("rest"))).over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return filled.select("source", "source_size", F.when(full, F.col("cap").cast("double")).otherwise(level * F.col("w")).alias("target"))


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number between 0 and 1 that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def _fill(items: DataFrame, goals: DataFrame, nearest: bool) -> DataFrame:
    """The items with a mark on those taken in order of rank until their source's goal is full.

    ``nearest``: the item that crosses the goal is taken if that ends nearer to
    it; otherwise it is taken where more than half of the source is. Words are summed by slice of rank first, so
    that items are only sorted inside the one slice where the goal falls.
    """
    key = F.struct("source").alias("key")  # nulls equal nulls inside a struct
    per = items.groupBy(key, "slice").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(W.partitionBy("key").orderBy("slice")) - F.col("words")
    cut = per.select("key", "slice", before.alias("before"), "words").join(goals.select(key, "goal"), "key")
    cut = cut.where(F.col("before") + F.col("words") >= F.col("goal")).groupBy("key").agg(F.min(F.struct("slice", "before")).alias("cut"))
    bounds = goals.select(key, "goal").join(cut, "key", "left")
    marked = items.withColumn("key", key).join(broadcast_if_small(bounds), "key")
    edge = F.coalesce(F.col("slice") == F.col("cut.slice"), F.lit(False))
    clear = marked.where(~edge).withColumn("drawn", F.col("cut").isNull() | (F.col("slice") < F.col("cut.slice")))
    order = W.partitionBy("key").orderBy("rank", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, 0)
    words = F.sum("size").over(order) + F.col("cut.before")
    over = F.lit(0.5) if nearest else (F.col("chance") <= 0.5).cast("double")
    fits = words - F.col("size") * (1 - over) < F.col("goal")
    columns = [*items.columns, "drawn"]
    return clear.select(columns).union(marked.where(edge).withColumn("drawn", fits).select(columns))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """How often each document goes into the mix.

    Returns doc_id, source, size, source_size, target, copies and taken (words,
    repeats counted). The large documents of a source are filled first, up to
    their share or just past it, so that the small ones settle the rest closely.
    """
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    key = F.struct("source").alias("key")
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    whole = F.least(F.floor(ratio), F.lit(max_copies)).cast("long")
    targets = source_targets(sized, weights, max_copies).withColumn("whole", whole)
    targets = targets.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = stored(targets.withColumn("chance", F.coalesce(F.try_divide(F.col("left"), F.col("source_size")), F.lit(0.0))), "mix-targets")
    rows = sized.withColumn("key", key).join(broadcast_if_small(targets.withColumn("key", key).drop("source")), "key").drop("key")

    u = uniform(F.col("doc_id"), seed)
    rank = (u / (1 - u)) * ((1 - F.col("chance")) / F.col("chance"))
    some = rows.where(F.col("chance") > 0).withColumn("rank", rank).withColumn("large", F.col("size") > F.lit(LARGE) * F.col("left"))
    some = stored(some.withColumn("slice", F.floor(F.col("rank") / (1 + F.col("rank")) * SLICES)), "mix-ranks")
    shares = some.groupBy(key).agg((F.sum(F.when(F.col("large"), F.col("size")).otherwise(0)) * F.max("chance")).alias("goal"))
    large = stored(_fill(some.where("large"), shares.select("key.source", "goal"), nearest=False), "mix-large")
    got = large.groupBy(key).agg(F.sum(F.when(F.col("drawn"), F.col("size"))).alias("got"))
    open_ = targets.withColumn("key", key).join(got, "key", "left").select("source", (F.col("left") - F.coalesce("got", F.lit(0))).alias("goal"))
    small = _fill(some.where("not large"), open_, nearest=True)

    out = ["doc_id", "source", "size", "source_size", "target", "whole", "drawn"]
    every = rows.where("not chance > 0").withColumn("drawn", F.lit(False)).select(out).union(large.select(out)).union(small.select(out))
    copies = F.col("whole") + F.col("drawn").cast("long")
    return every.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def expand(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as it is taken, all columns kept.

    Of repeated rows each is taken as often as the most taken of them, so that
    no row is lost; the contract's figures are those of ``mix``.
    """
    row = F.struct("doc_id", "source", word_count(F.col("text")).alias("size")).alias("row")
    plan = mix(docs, **how).groupBy(F.struct("doc_id", "source", "size").alias("row")).agg(F.max("copies").alias("copies"))
    out = docs.select(whole_row(docs), row).join(plan.where("copies > 0"), "row")
    return out.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def query(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
with sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint size from documents),
per as (select source, sum(size)::bigint source_size from sized group by source),
weighed as (select *, 1 + ((row_number() over (order by source nulls last) - 1) % 3) w, 3 * source_size cap from per),
filled as (select *,
  (select sum(source_size) from per) - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as room,
  sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) rest from weighed),
level as (select max(room::double / rest::double) l from filled where not room * w > cap * rest),
targets as (select source, source_size, case when room * w > cap * rest then cap::double else (select l from level) * w end target from filled),
whole as (select *, least(floor(case when source_size > 0 then target / source_size else 0 end), 3)::bigint as whole from targets),
odds as (select *, target - whole * source_size as room, case when source_size > 0 then (target - whole * source_size) / source_size else 0 end chance from whole),
u as (select s.doc_id, s.source, s.size, o.source_size, o.target, o.whole, o.room, o.chance,
  (('0x' || substr(md5('{SEED}:' || coalesce(s.doc_id::varchar, '')), 1, 13))::bigint + 0.5::double) / 4503599627370496::double u
  from sized s join odds o on s.source is not distinct from o.source),
ranked as (select *, row_number() over () as nr, size > {LARGE}::double * room as big, (u / (1 - u)) * ((1 - chance) / chance) as rnk from u where chance > 0),
ordered as (select *, sum(size) over (partition by source, big order by rnk, doc_id nulls first, size rows between unbounded preceding and current row) words,
  sum(case when big then size else 0 end) over (partition by source) * chance as big_goal from ranked),
bigs as (select * from ordered where big and words - size * (case when chance <= 0.5 then 0 else 1 end) < big_goal),
got as (select source, sum(size) got from bigs group by source),
smalls as (select o.* from ordered o left join got g on o.source is not distinct from g.source
  where not big and words - size * 0.5::double < room - coalesce(got, 0)),
more as (select nr from bigs union all select nr from smalls),
numbered as (select u.*, 0 as extra from u where not chance > 0
  union all select doc_id, source, size, source_size, target, whole, room, chance, u, (nr in (select nr from more))::int from ranked)
select doc_id, size, source_size::bigint source_size, target, ((whole + extra) * size)::bigint taken from numbered
"""
