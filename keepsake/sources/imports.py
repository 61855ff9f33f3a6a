"""Outside collections brought in as items.

A source is a JSON schema and a mapping from its rows to capture requests;
adding a source means adding an entry to ``SOURCES``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsake.operators.capture import capture
from keepsake.schema import STARRED_ITEM


@dataclass(frozen=True)
class Source:
    name: str
    schema: T.StructType
    to_requests: Callable[[DataFrame], DataFrame]


def _starred_requests(items: DataFrame) -> DataFrame:
    bare = F.struct(*[F.col(f"item.{f.name}").alias(f.name) for f in STARRED_ITEM.fields if f.name not in ("starred_at", "repo")])
    r = items.select("seq", "requested_at", F.col("item.starred_at").alias("starred_at"), F.coalesce("item.repo", bare).alias("repo"))
    r = r.where(F.coalesce("repo.id", F.lit(0)) != 0)

    def text_of(c: Column) -> Column:
        return F.nullif(c.cast("string"), F.lit(""))

    # absent values carry no key at all
    data = F.map_filter(
        F.create_map(
            F.lit("url"), F.col("repo.html_url"),
            F.lit("summary"), F.col("repo.description"),
            F.lit("owner"), F.col("repo.owner.login"),
            F.lit("language"), F.col("repo.language"),
            F.lit("stars"), F.col("repo.stargazers_count").cast("string"),
            F.lit("topics"), text_of(F.array_join("repo.topics", ", ")),
            F.lit("homepage"), text_of(F.col("repo.homepage")),
            F.lit("pushed_at"), F.col("repo.pushed_at"),
            F.lit("archived"), F.when(F.col("repo.archived"), "yes"),
            F.lit("source"), F.lit("github"),
        ),
        lambda k, v: v.isNotNull(),
    )
    none = F.lit(None)
    return r.select(
        "seq",
        F.concat(F.lit("github:repo:"), F.col("repo.id").cast("string")).alias("capture_id"),
        F.lit("repo").alias("kind"),
        F.col("repo.full_name").alias("title"),
        none.cast("string").alias("body"),
        data.alias("data"),
        F.array().cast("array<string>").alias("tags"),
        F.lit("starred").alias("status"),
        none.cast("int").alias("rating"),
        F.try_to_timestamp("starred_at").alias("occurred_at"),
        none.cast("timestamp").alias("remind_at"),
        F.lit("github").alias("source"),
        "requested_at",
    )


SOURCES = {"github": Source("github", STARRED_ITEM, _starred_requests)}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as text; they are parsed once, by the source's own schema."""
    return spark.read.text(path)


def import_requests(lines: DataFrame, requested_at: Column, source: str = "github") -> DataFrame:
    """Capture requests for JSON lines in column ``value``."""
    src = SOURCES[source]
    items = lines.select(
        # ids settle which of two copies of an item wins, whatever the file order
        F.xxhash64("value").alias("seq"),
        requested_at.alias("requested_at"),
        F.from_json("value", src.schema).alias("item"),
    )
    return src.to_requests(items)


def import_items(lines: DataFrame, entries: DataFrame, requested_at: Column, source: str = "github") -> DataFrame:
    """New items from a listing; what is stored already is left as it is."""
    return capture(import_requests(lines, requested_at, source), entries, enrich=False)


def import_counts(lines: DataFrame, created: DataFrame, requests: DataFrame) -> DataFrame:
    """imported, skipped (known already) and total seen for one listing."""
    tallies = (
        lines.select(F.lit(1).alias("seen"), F.lit(0).alias("valid"), F.lit(0).alias("made"))
        .unionByName(requests.select(F.lit(0).alias("seen"), F.lit(1).alias("valid"), F.lit(0).alias("made")))
        .unionByName(created.select(F.lit(0).alias("seen"), F.lit(0).alias("valid"), F.lit(1).alias("made")))
    )
    return tallies.agg(
        F.coalesce(F.sum("made"), F.lit(0)).alias("imported"),
        F.coalesce(F.sum("valid") - F.sum("made"), F.lit(0)).alias("skipped"),
        F.coalesce(F.sum("seen"), F.lit(0)).alias("total_seen"),
    )
