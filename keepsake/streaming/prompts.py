"""The prompt log as a stream: counts per hour, surface and action."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from keepsake.streaming.ledger import Ledger


def hourly_counts(prompts: DataFrame) -> DataFrame:
    """Counts in event-time hours of some calls."""
    return prompts.groupBy(F.date_trunc("hour", "at").alias("hour"), "surface", "action").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("failed"))


COUNTS = "hour timestamp, surface string, action string, n long, failed long"
# batches after which the counts of all batches are merged into one part
MERGE_EVERY = 32


def counts_stream(prompts: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, merge_every: int = MERGE_EVERY) -> StreamingQuery:
    """Keep a table of counts: each batch writes what it adds to its hours.

    A batch that is retried replaces its own partition, so it counts once. No hour
    is ever closed and no state is held for it, so calls count however late they come. Now and then the parts are summed
    into one.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        ledger = Ledger(batch.sparkSession, path, COUNTS)
        ledger.add(batch_id, hourly_counts(batch))
        if (batch_id + 1) % merge_every == 0:
            ledger.merge(batch_id + 1, _summed(ledger.read(batch_id + 1)))

    return prompts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("hour", "surface", "action").agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"))


def current_counts(spark, path: str) -> DataFrame:
    """The count of every hour, surface and action over all batches."""
    return _summed(Ledger(spark, path, COUNTS).read())
