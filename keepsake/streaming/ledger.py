"""A table that grows by one replaceable part per micro-batch and is merged now and then."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


@dataclass(frozen=True)
class Ledger:
    """Parts under ``path``: ``batch=N`` for each batch, ``merged=N`` for all before batch N.

    A batch that is retried replaces its part. A merge counts once it is listed in ``merges``; readers take the newest one
    and the batches from there on, so a merge that dies half-way is never seen. With ``bucket`` set, the parts are
    laid out in folders by a hash of that column.
    """

    spark: SparkSession
    path: str
    schema: str
    bucket: str | None = None

    def _put(self, rows: DataFrame, folder: str) -> None:
        if self.bucket is None:
            rows.write.mode("overwrite").parquet(f"{self.path}/{folder}")
        else:
            placed = rows.withColumn("bucket", self.bucket_of(self.bucket)).repartition("bucket")
            placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}")

    @staticmethod
    def bucket_of(column: str):
        return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")

    def _merged(self) -> int | None:
        try:
            return self.spark.read.schema("merged long").parquet(f"{self.path}/merges").agg(F.max("merged")).first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None  # nothing was merged yet

    def add(self, batch_id: int, rows: DataFrame) -> None:
        self._put(rows, f"batch={batch_id}")

    def merge(self, batch_id: int, rows: DataFrame) -> None:
        """``rows`` stand for everything before ``batch_id`` from now on."""
        self._put(rows, f"merged={batch_id}")
        self.spark.createDataFrame([(batch_id,)], "merged long").coalesce(1).write.mode("append").parquet(f"{self.path}/merges")

    def _parts(self, kind: str) -> DataFrame | None:
        schema = f"{self.schema}, {kind} long" + (", bucket int" if self.bucket else "")
        try:
            return self.spark.read.schema(schema).option("basePath", self.path).parquet(f"{self.path}/{kind}=*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None  # no part of this kind was written yet

    def read(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of batches before a number and of some buckets: other folders stay closed."""
        merged, parts = self._merged(), []
        if merged is not None:
            parts.append(self._parts("merged").where(F.col("merged") == merged))
        later = self._parts("batch")
        if later is not None:
            later = later if merged is None else later.where(F.col("batch") >= merged)
            parts.append(later if before is None else later.where(F.col("batch") < before))
        if buckets is not None:
            parts = [p.where(F.col("bucket").isin(buckets)) for p in parts]
        columns = [c.strip().split(" ")[0] for c in self.schema.split(",")]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])


def stored_ids(spark: SparkSession, path: str) -> Ledger:
    """The capture ids a stream has stored, with their items."""
    return Ledger(spark, path, "capture_id string, id string", "capture_id")


def known_ids(ledger: Ledger, wanted: DataFrame, before: int) -> DataFrame:
    """(capture_id, id) stored before a batch, of the ids it asks for: only their folders are read."""
    asked = wanted.select(Ledger.bucket_of("capture_id").alias("bucket")).distinct()
    buckets = [r["bucket"] for r in asked.collect()]  # at most BUCKETS numbers
    return ledger.read(before, buckets)


def seed_ids(ledger: Ledger, entries: DataFrame) -> None:
    """Take over the ids of items stored before the stream's first batch, once."""
    if ledger._merged() is None:
        ledger.merge(0, entries.where(F.col("capture_id").isNotNull()).select("capture_id", "id"))


def add_ids(ledger: Ledger, batch_id: int, made: DataFrame, merge_every: int) -> None:
    ledger.add(batch_id, made.where(F.col("capture_id").isNotNull()).select("capture_id", "id"))
    if (batch_id + 1) % merge_every == 0:
        ledger.merge(batch_id + 1, ledger.read(batch_id + 1))
