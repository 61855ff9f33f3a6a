"""Helpers several operators share."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but ASCII white space, unchanged.
WORD = r"[^\x20\x09-\x0D]+"
# Upper-case ASCII letters to lower case, for bytes.translate.
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_part(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def raw(text: Column) -> Column:
    """The UTF-8 bytes of a text, empty for null: Python sees the same bytes as Spark."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def quoted(name: str) -> str:
    """A column name as it stands, dots and quotes in it included."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, ``doc``: whatever their names are, none can meet a name of an operator."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("doc")


def free_name(docs: DataFrame, name: str) -> str:
    """The name, or with underscores in front until no column has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


SCORED = 1024  # rows scored and sent back at once


def with_score(docs: DataFrame, column: str, scores: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.Array]]) -> DataFrame:
    """The documents with a column of scores worked out from their texts; a column of that name is replaced.

    ``scores`` gives an array for each batch of a column ``text`` of bytes. On the way through the
    workers columns have numbers for names, so names of any kind come back as they were. A text is sent
    to a worker once, and rows go on in pieces, so that no worker holds two copies of a batch.
    """
    others = [c for c in docs.columns if c.lower() != column.lower()]
    sent = others if "text" in [c.lower() for c in others] else [*others, "text"]
    at = [c.lower() for c in sent].index("text")
    numbered = docs.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(sent)])
    schema = numbered.select(*numbered.columns[: len(others)], F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[pa.RecordBatch] = deque()

        def seen() -> Iterator[pa.RecordBatch]:
            for got in batches:
                for start in range(0, got.num_rows, SCORED):
                    piece = got.slice(start, SCORED)
                    waiting.append(piece)
                    # the same bytes as Spark's, empty for null
                    yield pa.RecordBatch.from_arrays([piece.column(at).cast(pa.binary()).fill_null(b"")], ["text"])

        for made in scores(seen()):
            got = waiting.popleft()
            yield pa.RecordBatch.from_arrays([*got.columns[: len(others)], made], names=[*got.schema.names[: len(others)], "score"])

    return numbered.mapInArrow(run, schema).toDF(*others, column)
