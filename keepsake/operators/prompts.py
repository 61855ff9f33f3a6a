"""The prompt log: appending to it and the habits it shows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions import shelves
from keepsake.schema import CAPTURE_ACTIONS

INPUT_CHARS, ERROR_CHARS = 8000, 500
# A link with more text than this around it came with a reason.
REASON_CHARS = 25


def log_prompts(calls: DataFrame, entries: DataFrame, worded: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows to append for handled calls.

    ``calls``: id, at, surface, action, input, entry_ids, ms, ok, error. Tags
    and kinds are looked up from the items a call produced, first seen first.

    Where inputs are looked up as well, ``calls`` come without them and ``worded`` adds them to the finished rows,
    so that no look-up shuffles a text. Other columns of ``calls`` ride along to it.
    """
    # cut before they travel: a call may hold a whole document
    cut = {"error": F.substring("error", 1, ERROR_CHARS)} | ({} if worded else {"input": F.substring("input", 1, INPUT_CHARS)})
    calls = calls.withColumns(cut)
    touched = (
        calls.select("id", F.posexplode("entry_ids").alias("pos", "entry_id"))
        .join(entries.select(F.col("id").alias("entry_id"), "kind", "tags"), "entry_id")
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "kind", shelves.tag_list(F.col("tags")).alias("tags")))).alias("e"))
    )
    none = F.array().cast("array<string>")
    known = calls.join(touched, "id", "left").withColumns({
        "tags": F.coalesce(F.array_distinct(F.flatten(F.transform("e", lambda x: x["tags"]))), none),
        "kinds": F.coalesce(F.array_distinct(F.transform("e", lambda x: x["kind"])), none),
        "ok": F.coalesce("ok", F.lit(True)),
    })
    if worded:
        known = worded(known).withColumn("input", F.substring("input", 1, INPUT_CHARS))
    return known.select("id", "at", "surface", "action", "input", "entry_ids", "tags", "kinds", "ms", "ok", "error")


def totals(prompts: DataFrame) -> DataFrame:
    return prompts.agg(F.count("*").alias("total"), F.min("at").alias("since"))


def count_by(prompts: DataFrame, column: str) -> DataFrame:
    return prompts.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def by_hour(prompts: DataFrame) -> DataFrame:
    return prompts.groupBy(F.hour("at").alias("hour")).agg(F.count("*").alias("n")).orderBy("hour")


def lengths(prompts: DataFrame) -> DataFrame:
    """Exact interpolated percentiles.

    Grouping by length first leaves one row per distinct length, so the
    percentile works on weights, not on every prompt.
    """
    sizes = (
        prompts.where(F.col("input").isNotNull())
        .groupBy(F.length("input").alias("n_chars"))
        .agg(F.count("*").alias("n"))
    )

    def whole(c: Column) -> Column:
        return F.coalesce(F.rint(c), F.lit(0)).cast("int")

    return sizes.agg(
        whole(F.percentile("n_chars", 0.5, F.col("n"))).alias("median"),
        whole(F.percentile("n_chars", 0.9, F.col("n"))).alias("p90"),
        F.coalesce(F.min("n_chars"), F.lit(0)).alias("shortest"),
        F.coalesce(F.max("n_chars"), F.lit(0)).alias("longest"),
    )


HABITS = ["captures", "with_url", "url_with_reason", "bare_url", "with_hashtags", "multi_entry"]


def _flagged(prompts: DataFrame) -> DataFrame:
    """(hour, one flag per habit): each text is looked through once per pattern, and only texts of captures.

    A prompt without a link has no remainder to measure, so links are taken out of those that have one.
    """
    capture = F.col("action").isin(CAPTURE_ACTIONS) & F.col("input").isNotNull()
    typed = F.when(capture, F.col("input"))
    seen = prompts.select(
        F.hour("at").alias("hour"),
        capture.alias("captures"),
        (capture & (F.size("entry_ids") > 1)).alias("multi_entry"),
        typed.alias("typed"),
    )
    # most texts hold neither sign, and looking for a sign is far cheaper than a pattern
    linked = F.contains("typed", F.lit("://")) & F.col("typed").rlike("(?i)https?://")
    tagged = F.contains("typed", F.lit("#")) & F.col("typed").rlike(r"(^|\s)#[\p{L}\p{N}]")
    seen = seen.select("hour", "captures", "multi_entry", "typed", linked.alias("linked"), tagged.alias("tagged"))
    bare = F.length(F.regexp_replace("typed", r"https?://\S+", "")) <= REASON_CHARS
    # one array, so that a flag used twice is not worked out twice
    seen = seen.select("hour", "captures", "multi_entry", F.array("linked", "tagged", F.when(F.col("linked"), bare)).alias("f"))
    flag = lambda i: F.coalesce(F.get("f", F.lit(i)), F.lit(False))
    return seen.select(
        "hour", "captures", flag(0).alias("with_url"), (flag(0) & ~flag(2)).alias("url_with_reason"),
        (flag(0) & flag(2)).alias("bare_url"), flag(1).alias("with_hashtags"), "multi_entry",
    )


def habits(prompts: DataFrame) -> DataFrame:
    return _flagged(prompts).agg(*[F.count_if(name).alias(name) for name in HABITS])


def rates(prompts: DataFrame) -> DataFrame:
    """Habits as whole percentages, and the busiest hour, in one pass."""
    hourly = _flagged(prompts).groupBy("hour").agg(F.count("*").alias("n"), *[F.count_if(name).alias(name) for name in HABITS])
    whole = hourly.agg(
        *[F.sum(name).alias(name) for name in HABITS],
        F.max_by("hour", F.struct(F.col("n"), -F.col("hour"))).alias("busiest_hour"),
        F.max("n").alias("busiest_n"),
    )

    def share(n: str, of: str) -> Column:
        return F.when(F.col(of) > 0, F.floor(F.col(n) / F.col(of) * 100 + 0.5)).cast("int").alias(f"pct_{n}")

    return whole.select(
        share("with_url", "captures"),
        share("url_with_reason", "with_url"),
        share("bare_url", "with_url"),
        share("with_hashtags", "captures"),
        "busiest_hour",
        "busiest_n",
    )


def top_shelves(prompts: DataFrame, limit: int = 12) -> DataFrame:
    return (
        prompts.select(F.explode("tags").alias("tag"))
        .groupBy("tag")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "tag")
        .limit(limit)
    )


def failures(prompts: DataFrame, limit: int = 10) -> DataFrame:
    return (
        prompts.where(~F.col("ok"))
        .groupBy("action", F.coalesce("error", F.lit("?")).alias("error"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "action", "error")
        .limit(limit)
    )
