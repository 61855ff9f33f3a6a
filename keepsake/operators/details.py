"""An item with its thread and neighbours, as rows rather than nested lists.

Rows keep an item with very many notes or links from growing into one record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.session import stored


def entry_links(links: DataFrame, entries: DataFrame) -> DataFrame:
    """Both ends' view of every link: (entry_id, rel, direction, neighbour…).

    Items that are linked are picked first and written with their titles, so that whatever a title is computed from is
    read once per item, not once per link.
    """
    ends = links.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    far = entries.select("id", "kind", "title", "status").join(ends, "id", "left_semi")
    far = stored(far, "linked-items").withColumnRenamed("id", "far")

    def side(mine: str, other: str, label: str) -> Column:
        return F.struct(F.col(mine).alias("entry_id"), F.lit(label).alias("direction"), F.col(other).alias("far"))

    sides = F.array(side("from_id", "to_id", "out"), side("to_id", "from_id", "in"))
    both = links.select("rel", F.explode(sides).alias("s")).select("rel", "s.*")
    return both.join(far, "far").select(
        "entry_id", "rel", "direction", F.col("far").alias("neighbour_id"), "kind", "title", "status"
    )


def entry_detail(ids: DataFrame, entries: DataFrame, notes: DataFrame, links: DataFrame) -> DataFrame:
    """One row for each wanted item, each of its notes and each of its links.

    (entry_id, part, at, ref, label, content): notes read in order of (at, ref).
    """
    wanted = ids.select(F.col("id").alias("entry_id")).distinct()
    none = F.lit(None).cast("timestamp")
    items = entries.withColumnRenamed("id", "entry_id").join(wanted, "entry_id", "left_semi").select(
        "entry_id", F.lit("entry").alias("part"), F.col("created_at").alias("at"), F.col("entry_id").alias("ref"),
        F.col("kind").alias("label"), F.col("title").alias("content"),
    )
    known = items.select("entry_id")
    thread = notes.join(known, "entry_id", "left_semi").select(
        "entry_id", F.lit("note").alias("part"), F.col("created_at").alias("at"), F.col("id").alias("ref"),
        F.col("source").alias("label"), F.col("body").alias("content"),
    )
    around = entry_links(links, entries).join(known, "entry_id", "left_semi").select(
        "entry_id", F.lit("link").alias("part"), none.alias("at"), F.col("neighbour_id").alias("ref"),
        F.concat_ws(" ", "direction", "rel").alias("label"), F.col("title").alias("content"),
    )
    return items.unionByName(thread).unionByName(around)
