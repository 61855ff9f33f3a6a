"""Listings dropped into a folder, imported as they appear."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from keepsake.operators.capture import ids_asked
from keepsake.schema import ENTRY, ENTRY_COLUMNS
from keepsake.sources.imports import import_counts, import_items, import_requests
from keepsake.streaming.capture import MERGE_EVERY, ONCE
from keepsake.streaming.ledger import add_ids, known_ids, seed_ids, stored_ids


def import_stream(
    lines: DataFrame, entries: DataFrame, requested_at: Column, path: str, checkpoint: str, source: str = "github",
    trigger: dict | None = None, merge_every: int = MERGE_EVERY,
) -> StreamingQuery:
    """New items go to ``path/items``, one row of counters per batch to ``path/counts``."""
    seed_ids(stored_ids(lines.sparkSession, f"{path}/ids"), entries)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = stored_ids(spark, f"{path}/ids")
        asked = import_requests(batch, requested_at, source)
        known = known_ids(held, ids_asked(asked), batch_id)
        import_items(batch, known, requested_at, source).select(ENTRY_COLUMNS).write.mode("overwrite").parquet(f"{path}/items/batch={batch_id}")
        made = spark.read.schema(ENTRY).parquet(f"{path}/items/batch={batch_id}")
        add_ids(held, batch_id, made, merge_every)
        import_counts(batch, made, asked).write.mode("overwrite").parquet(f"{path}/counts/batch={batch_id}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or ONCE)).start()


def batch_counts(spark, path: str) -> DataFrame:
    rows = spark.read.option("basePath", f"{path}/counts").parquet(f"{path}/counts/batch=*")
    return rows.select(F.col("batch").cast("bigint").alias("batch"), "imported", "skipped", "total_seen")
