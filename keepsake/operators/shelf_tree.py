"""Shelf hierarchy: roll-ups, samples, renames and the semi join by shelf."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions import shelves, text
from keepsake.operators.filters import happened_at, live
from keepsake.session import each


def _placements(entries: DataFrame, *columns) -> DataFrame:
    """One row per live item and shelf it counts toward.

    A row's shelves are made distinct before they are exploded, so counting
    rows per shelf counts items and needs no distinct aggregate.
    """
    tags = shelves.tag_list(F.col("tags"))
    return each(entries.where(live()), shelves.nodes(tags), "tag", *columns, tags.alias("tags"))


def shelf_tree(entries: DataFrame) -> DataFrame:
    counted = (
        _placements(entries)
        .groupBy("tag")
        .agg(
            F.count("*").alias("count"),
            F.count_if(F.array_contains("tags", F.col("tag"))).alias("own"),
        )
    )
    parts = F.split("tag", "/")
    depth = F.size(parts) - 1
    return counted.select(
        "tag",
        "count",
        "own",
        depth.alias("depth"),
        F.when(depth > 0, F.array_join(F.slice(parts, F.lit(1), depth), "/")).alias("parent"),
        F.element_at(parts, -1).alias("label"),
    ).orderBy("tag")


def shelf_samples(entries: DataFrame, per_shelf: int = 3) -> DataFrame:
    """Each shelf with its count and newest items, sub-shelves included.

    The rank filter sits on the window, so Spark cuts each map task to the
    newest few per shelf before the shuffle; a huge shelf is no hot task.
    """
    placed = _placements(entries, "id", "title", happened_at().alias("at"))
    newest = Window.partitionBy("tag").orderBy(F.desc("at"), "id")
    sample = (
        placed.select("tag", "id", "title", "at", F.row_number().over(newest).alias("n"))
        .where(F.col("n") <= per_shelf)
        .groupBy("tag")
        .agg(F.sort_array(F.collect_list(F.struct("n", F.coalesce("title", F.lit("untitled")).alias("title")))).alias("s"))
    )
    counts = placed.groupBy("tag").agg(F.count("*").alias("count"))
    return counts.join(sample, "tag").select(
        "tag", "count", F.array_join(F.transform("s", lambda x: x["title"]), " · ").alias("sample")
    )


def rename_shelf(entries: DataFrame, old: str, new: str) -> DataFrame:
    """Changed rows only; everything under the shelf moves, archived rows too."""
    src, dst = text.clean_tag(F.lit(old)), text.clean_tag(F.lit(new))
    changed = entries.where((src != dst) & (src != "") & (dst != "") & shelves.on_shelf(F.col("tags"), src))
    return changed.withColumn("tags", shelves.renamed(F.col("tags"), src, dst))


def on_any_shelf(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """Items under any shelf of a table of shelves.

    The prefix test becomes an equality on exploded ancestors, so the join
    hashes instead of comparing every item with every shelf.
    """
    hits = (
        each(entries, shelves.nodes(F.col("tags")), "shelf", "id")
        .join(wanted.select("shelf").distinct(), "shelf", "left_semi")
        .select("id")
    )
    return entries.join(hits, "id", "left_semi")
