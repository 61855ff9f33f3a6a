"""Saving several linked things at once, reusing what is already stored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.functions import text
from keepsake.operators.capture import capture, stable_id
from keepsake.operators.mutate import upsert_links
from keepsake.operators.references import resolve
from keepsake.session import stored


@dataclass(frozen=True)
class BulkResult:
    created: DataFrame
    placed: DataFrame
    notes: DataFrame
    links: DataFrame
    failed_links: DataFrame


def capture_many(
    items: DataFrame, link_requests: DataFrame, entries: DataFrame, notes: DataFrame, links: DataFrame
) -> BulkResult:
    """Items, notes and links of bulk requests.

    ``items``: capture request columns plus batch_id, ref, note, note_source.
    ``link_requests``: batch_id, from, to, rel; the ends name a ref of the same
    batch, or anything a reference may name. An item whose title resolves to
    one stored item is attached to that; links with an end that resolves to
    nothing or to several items are left out and returned apart.
    """
    # what references are resolved against, read from the store once
    named = stored(entries.select("id", "title", "archived_at", "created_at"), "named-items")
    titled = items.where(text.strip_to_null(F.col("title")).isNotNull())
    resolved = resolve(titled.select(F.col("seq").alias("ref_id"), F.col("title").alias("ref")), named)
    # a full id resolves unseen; only one that is stored counts as known
    known = (
        resolved.where("status = 'ok'").select(F.col("ref_id").alias("seq"), "id").join(named.select("id"), "id", "left_semi")
    )
    known = stored(known, "known")
    fresh = stored(items.join(known.select("seq"), "seq", "left_anti"), "fresh")
    # everything below reads these two, so they are written once
    created = stored(capture(fresh.drop("batch_id", "ref", "note", "note_source"), entries), "created")
    placed = (
        known.select("seq", "id", F.lit(False).alias("created"))
        .unionByName(created.select("seq", "id", F.lit(True).alias("created")))
        .join(items.select("seq", "batch_id", "ref", "note", "note_source", "requested_at"), "seq")
    )
    placed = stored(placed, "placed")
    added = placed.select(
        stable_id(F.concat(F.lit("note:"), F.col("seq").cast("string"))).alias("id"),
        F.col("id").alias("entry_id"),
        text.strip_to_null(F.col("note")).alias("body"),
        F.col("requested_at").alias("created_at"),
        F.coalesce(text.strip_to_null(F.col("note_source")), F.lit("me")).alias("source"),
    ).where(F.col("body").isNotNull())

    # a ref used twice in a batch means the later item
    refs = (
        placed.where(F.col("ref").isNotNull())
        .groupBy("batch_id", "ref")
        .agg(F.max_by("id", "seq").alias("ref_entry"))
    )
    asked = link_requests.withColumn("link_no", F.xxhash64("batch_id", "from", "to", "rel"))
    ends = asked.select("batch_id", F.explode(F.array("from", "to")).alias("ref")).distinct()
    own = ends.join(refs, ["batch_id", "ref"], "left")
    others = own.where(F.col("ref_entry").isNull()).select("ref").distinct()
    store = named.unionByName(created.select("id", "title", "archived_at", "created_at"))
    found = resolve(others.select(F.col("ref").alias("ref_id"), "ref"), store).where("status = 'ok'")
    targets = own.join(found.select("ref", F.col("id").alias("found")), "ref", "left").select(
        "batch_id", "ref", F.coalesce("ref_entry", "found").alias("target")
    )
    targets = stored(targets, "targets")
    paired = (
        asked.join(targets.select("batch_id", F.col("ref").alias("from"), F.col("target").alias("from_id")), ["batch_id", "from"], "left")
        .join(targets.select("batch_id", F.col("ref").alias("to"), F.col("target").alias("to_id")), ["batch_id", "to"], "left")
    )
    paired = stored(paired, "paired")
    sound = F.coalesce(F.col("from_id") != F.col("to_id"), F.lit(False))
    wanted = paired.where(sound).select(
        stable_id(F.concat_ws("|", "from_id", "to_id", "rel")).alias("id"), "from_id", "to_id", "rel", "created_at"
    )
    return BulkResult(
        created=created,
        placed=placed.select("seq", "batch_id", "ref", "id", "created"),
        notes=notes.unionByName(added),
        links=upsert_links(links, wanted),
        failed_links=paired.where(~sound).select("batch_id", "from", "to", "rel"),
    )
