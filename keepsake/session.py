"""Session helpers: settings the operators rely on, and where to put state."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast by hand only below this many rows, and only after its
# size was looked at; everything else is left to adaptive execution.
BROADCAST_ROWS = 10_000


def build_session(app: str = "keepsake", cores: str | int = "*") -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings every operator assumes."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a side has at most ``max_rows`` rows, read no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a side for broadcast once its size is known to be bounded.

    A larger side comes back as it was, so the join shuffles instead.
    """
    return F.broadcast(df) if is_small(df, max_rows) else df


def spread(df: DataFrame) -> DataFrame:
    """Give an input of few splits one partition per core.

    A small file is a single split, and heavy text work on it would run in one
    task. Large inputs have splits enough and pass through unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def chunks_of(df: DataFrame, key: str, max_rows: int = BROADCAST_ROWS) -> list[DataFrame]:
    """Split a table into pieces of about ``max_rows`` rows by key hash.

    Used where a nested loop cannot be avoided: each piece is small enough to
    broadcast, and the pieces together are the whole table.
    """
    if is_small(df, max_rows):
        return [df]
    # half-size buckets leave room for uneven hashing
    n = max(2, -(-2 * df.count() // max_rows))
    return [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def each(df: DataFrame, array: Column, name: str, *keep: str | Column) -> DataFrame:
    """One row per element of a computed array.

    A plain explode makes Spark add a not-empty filter below it, which would
    evaluate the array expression a second time; the outer form does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def state_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for tables and stream state.

    The shared folder is the one the cluster names; only where none is set, as
    in local tests, a temporary folder stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        return tempfile.mkdtemp(prefix=f"{name}-")
    run = spark.range(1).select(F.expr("uuid()")).first()[0]
    return f"{base.rstrip('/')}/{name}-{run}"


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_gone(spark: SparkSession) -> Iterator[None]:
    """The shuffle files behind what is written inside go once it is written."""
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO, before)


def stored(df: DataFrame, name: str, alone: bool = False) -> DataFrame:
    """Write a result as a table in the shared folder and read it back.

    Cuts the lineage of what several later steps use, in a place that outlives
    the executors that made it. ``alone`` is for large results of large shuffles: it is packed
    more tightly, and the shuffle files behind it go once it is written.
    """
    spark = df.sparkSession
    path = f"{state_dir(spark, name)}/table"
    if alone:
        with shuffles_gone(spark):
            df.write.option("compression", "zstd").parquet(path)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
