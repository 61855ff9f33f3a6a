"""The vector index: what is embedded, what is stale, and keeping it current."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions import shelves, values
from keepsake.operators.embedders import Embedder
from keepsake.operators.filters import live

TEXT_CHARS = 8000
MAX_DIMENSIONS = 16000
_SALTS = 32


def leading_notes(notes: DataFrame, chars: int = TEXT_CHARS) -> DataFrame:
    """Notes that begin within the first ``chars`` characters of an item's thread.

    Later ones cannot reach the embedded text. Threads are first cut within
    salted parts: a note kept overall is kept in its part, and each part keeps
    a bounded amount, so no task ever sees the whole of a huge thread.
    """
    n = notes.select("id", "entry_id", "created_at", F.substring("body", 1, chars).alias("body")).withColumn(
        "salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS))
    )

    def cut(df: DataFrame, *keys: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, -1)
        start = F.coalesce(F.sum(F.length("body") + 1).over(w), F.lit(0))
        return df.withColumn("start", start).where(F.col("start") < chars).drop("start")

    return cut(cut(n, "entry_id", "salt"), "entry_id").drop("salt")


def embedding_text(entries: DataFrame, notes: DataFrame) -> DataFrame:
    """(id, updated_at, text): title, kind, tags, body, document and thread, cut to size."""
    thread = (
        leading_notes(notes)
        .groupBy("entry_id")
        .agg(F.sort_array(F.collect_list(F.struct("created_at", "id", "body"))).alias("thread"))
        .withColumnRenamed("entry_id", "id")
    )
    own = entries.select(
        "id",
        "updated_at",
        F.concat_ws(
            "\n",
            F.nullif("title", F.lit("")),
            F.nullif("kind", F.lit("")),
            F.nullif(F.array_join(shelves.tag_list(F.col("tags")), " "), F.lit("")),
            F.nullif("body", F.lit("")),
            F.nullif(values.labelled(F.col("data"), "\n", skip=("url",)), F.lit("")),
        ).alias("text"),
    ).withColumn("text", F.substring("text", 1, TEXT_CHARS))
    said = F.nullif(F.array_join(F.transform("thread", lambda n: n["body"]), "\n"), F.lit(""))
    return own.join(thread, "id", "left").select(
        "id", "updated_at", F.substring(F.concat_ws("\n", "text", said), 1, TEXT_CHARS).alias("text")
    )


def coverage(entries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Live items with what the index holds of them."""
    held = vectors.select(F.col("entry_id").alias("id"), F.col("provider").alias("held_by"), "source_updated_at")
    return entries.where(live()).join(held, "id", "left")


def _stale() -> Column:
    return F.col("source_updated_at") < F.col("updated_at")


def pending(entries: DataFrame, vectors: DataFrame, provider: str) -> DataFrame:
    """Items never embedded, embedded by another provider, or edited since."""
    due = F.col("held_by").isNull() | (F.col("held_by") != provider) | _stale()
    return coverage(entries, vectors).where(due).drop("held_by", "source_updated_at")


def next_pending(entries: DataFrame, vectors: DataFrame, provider: str, limit: int) -> DataFrame:
    """The ``limit`` pending items edited last, the newest first: what one round of embedding takes on."""
    return pending(entries, vectors, provider).orderBy(F.desc("updated_at"), "id").limit(limit)


def status(entries: DataFrame, vectors: DataFrame, provider: str, configured: str | None = None) -> DataFrame:
    """One pass over the index: held, stale, foreign and whether it may be searched.

    ``stale`` adds both causes, so an old vector of another provider counts twice.
    """
    held = F.col("held_by").isNotNull()
    mismatch = (configured or provider) != provider
    counts = coverage(entries, vectors).agg(
        F.count("*").alias("total_entries"),
        F.count_if(held).alias("embedded"),
        F.count_if(held & _stale()).alias("edited"),
        F.count_if(held & (F.col("held_by") != provider)).alias("foreign"),
    )
    return counts.select(
        "total_entries",
        "embedded",
        (F.col("edited") + F.col("foreign")).alias("stale"),
        F.lit(mismatch).alias("provider_mismatch"),
        (F.lit(not mismatch) & (F.col("embedded") > 0)).alias("ready"),
    )


def purge_archived(vectors: DataFrame, entries: DataFrame) -> DataFrame:
    archived = entries.where(~live()).select(F.col("id").alias("entry_id"))
    return vectors.join(archived, "entry_id", "left_anti")


def spaces(vectors: DataFrame, provider: str, dimensions: int) -> DataFrame:
    """The vector spaces found in an index, and whether each is the configured one."""
    found = vectors.groupBy("provider", F.size("vec").alias("dimensions")).agg(F.count("*").alias("vectors"))
    same = (F.col("provider") == provider) & (F.col("dimensions") == dimensions)
    return found.withColumn("matches", same)


def check_space(vectors: DataFrame, embedder: Embedder, rebuild: bool = False) -> None:
    """Refuse to mix vector spaces. Rebuilding replaces the index, so anything may precede it."""
    d = embedder.dimensions
    if not isinstance(d, int) or not 1 <= d <= MAX_DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions cannot be stored")
    if rebuild:
        return
    odd = spaces(vectors, embedder.id, d).where(~F.col("matches")).first()
    if odd is not None:
        raise ValueError(
            f"the index holds {odd['vectors']} vectors of {odd['provider']} ({odd['dimensions']}), not {embedder.id} ({d}); rebuild it"
        )


@dataclass(frozen=True)
class Synced:
    vectors: DataFrame
    embedded: DataFrame


def sync(
    entries: DataFrame, notes: DataFrame, vectors: DataFrame, embedder: Embedder, as_of: Column, rebuild: bool = False
) -> Synced:
    """The index brought up to date; only items that need it are embedded."""
    due = entries.where(live()) if rebuild else pending(entries, vectors, embedder.id)
    ids = due.select("id")
    texts = embedding_text(due, notes.join(ids.withColumnRenamed("id", "entry_id"), "entry_id", "left_semi"))
    made = embedder.embed(texts.select("id", "text"), "document")
    fresh = made.join(due.select("id", "updated_at"), "id").select(
        F.col("id").alias("entry_id"),
        F.lit(embedder.id).alias("provider"),
        F.col("vec").cast("array<float>").alias("vec"),
        F.col("updated_at").alias("source_updated_at"),
        as_of.alias("embedded_at"),
    )
    if rebuild:
        return Synced(fresh, fresh)
    if "embedded_at" not in vectors.columns:
        vectors = vectors.withColumn("embedded_at", F.lit(None).cast("timestamp"))
    kept = purge_archived(vectors, entries).join(ids.withColumnRenamed("id", "entry_id"), "entry_id", "left_anti")
    return Synced(kept.select(fresh.columns).unionByName(fresh), fresh)
