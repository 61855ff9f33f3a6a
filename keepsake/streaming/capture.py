"""Capture as a stream: retries and late flushes stay without effect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from keepsake.operators.capture import capture, ids_asked
from keepsake.schema import ENTRY, ENTRY_COLUMNS
from keepsake.streaming.ledger import add_ids, known_ids, seed_ids, stored_ids

STORED = T.StructType([*ENTRY.fields, T.StructField("batch", T.LongType())])


def captured(spark, path: str, before: int | None = None) -> DataFrame:
    """What the stream has stored, up to but not including a batch."""
    df = spark.read.schema(STORED).option("basePath", path).parquet(f"{path}/batch=*")
    return df if before is None else df.where(F.col("batch") < before)


# batches after which the stored ids are merged into one part
MERGE_EVERY = 32
ONCE = {"availableNow": True}


def capture_stream(
    requests: DataFrame, entries: DataFrame, path: str, checkpoint: str, enrich: bool = True, pages: DataFrame | None = None,
    trigger: dict | None = None, merge_every: int = MERGE_EVERY,
) -> StreamingQuery:
    """Run capture on every micro-batch against all that is stored, however old.

    Each batch writes its own partition, replacing it when the batch is retried
    after a failure, and looks at earlier ones only; so a batch counts once. What it looks at are stored ids,
    kept beside the items in folders by hash: the items themselves, and ids of other folders, are not read again.
    ``trigger`` holds the arguments of the stream's trigger.
    """
    ids = stored_ids(requests.sparkSession, f"{path}-ids")
    seed_ids(ids, entries)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = stored_ids(spark, f"{path}-ids")
        made = capture(batch, known_ids(held, ids_asked(batch), batch_id), enrich, pages)
        made.select(ENTRY_COLUMNS).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        add_ids(held, batch_id, spark.read.schema(ENTRY).parquet(f"{path}/batch={batch_id}"), merge_every)

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or ONCE)).start()


def drop_recent_retries(requests: DataFrame, within: str = "7 days") -> DataFrame:
    """The bounded variant: retries that arrive within a time span are dropped.

    State is kept for that span only. The span runs over the time of arrival, so no
    request is too late, whatever its own stamp. Requests without an id always pass.
    """
    keyed = requests.where(F.col("capture_id").isNotNull()).withColumn("arrived_at", F.current_timestamp()).withWatermark("arrived_at", within)
    once = keyed.dropDuplicatesWithinWatermark(["capture_id"]).drop("arrived_at")
    return once.unionByName(requests.where(F.col("capture_id").isNull()))
