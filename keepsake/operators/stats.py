"""Store totals. Every aggregate combines on the map side before it shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions import shelves
from keepsake.operators.filters import live
from keepsake.schema import DONE_STATUSES


def totals(entries: DataFrame) -> DataFrame:
    return entries.where(live()).agg(F.count("*").alias("total"))


def by_kind(entries: DataFrame) -> DataFrame:
    """Counts per kind; open counts only items that do have a status."""
    unfinished = F.col("status").isNotNull() & ~F.col("status").isin(DONE_STATUSES)
    return (
        entries.where(live())
        .groupBy("kind")
        .agg(F.count("*").alias("count"), F.count_if(unfinished).alias("open"))
        .orderBy(F.desc("count"), "kind")
    )


def recent(entries: DataFrame, as_of: Column) -> DataFrame:
    """Saved in the last seven days, archived ones too; and live reminders due now."""
    week = F.col("created_at") > as_of - F.make_dt_interval(F.lit(7))
    overdue = live() & (F.col("remind_at") <= as_of)
    return entries.agg(F.count_if(week).alias("captured_last_7_days"), F.count_if(overdue).alias("due_now"))


def top_tags(entries: DataFrame, limit: int = 15) -> DataFrame:
    return (
        entries.where(live())
        .select(F.explode(shelves.tag_list(F.col("tags"))).alias("tag"))
        .groupBy("tag")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "tag")
        .limit(limit)
    )
