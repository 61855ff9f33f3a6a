"""WARC archives written and read as streams of bounded chunks.

Payloads are written as records of at most ``chunk`` bytes: a longer one becomes
a first record and continuation records (the format's own segmentation), which
follow each other in one file. Reading gives a chunk table: one row per chunk
with the record's id, the chunk's number, its bytes, and the length and digest
of the payload up to and including it. Neither side holds a whole file, nor,
when reading, a whole payload.

Edge cases: a null payload is empty; null page ids are written as such, and
never name the response; a group of equal payloads whose ids are all null is all
responses, and so are repeated rows of the largest id; line breaks in a URL are
dropped; an empty table gives no records. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm.common import raw, table
from keepsake.session import state_dir

CHUNK = 1 << 20
MIN_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
BREAK = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CHUNK_SCHEMA = "page_id long, record_type string, refers_to long, chunk_no int, is_last boolean, payload_bytes long, payload_digest string, expected_digest string, data binary"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32: forty bits, ten hex digits, make eight letters."""
    digest = F.sha1(payload)
    letters = []
    for at in range(4):
        bits = F.conv(F.substring(digest, 10 * at + 1, 10), 16, 10).cast("long")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, 35 - 5 * i).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for i in range(8)]
    return F.concat(*letters)


def plan_records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to.

    The response of a payload is found from digests alone, summed up before the
    shuffle; pages join the payloads that occur more than once.
    """
    rows = pages.select("page_id", "url", raw(F.col("html")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    per = rows.groupBy("payload_digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("copies"))
    per = per.where((F.col("copies") > 1) & F.col("first_id").isNotNull()).drop("copies")
    rows = rows.join(per, "payload_digest", "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("payload_bytes") >= min_bytes)
    rows = rows.withColumn("record_type", F.when(again, "revisit").otherwise("response"))
    return rows.withColumn("refers_to", F.when(again, F.col("first_id"))).drop("first_id")


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def records(planned: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row ``value`` per record without its closing break, segments of a payload in order."""
    revisit = F.col("record_type") == "revisit"
    segments = F.when(revisit, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / chunk).cast("int")))
    cut = planned.withColumn("segments", segments).withColumn("segment", F.explode(F.sequence(F.lit(1), "segments")))
    body = F.when(revisit, F.lit(b"")).when(F.col("segments") == 1, F.col("payload")).otherwise(F.substring("payload", (F.col("segment") - 1) * chunk + 1, F.lit(chunk)))
    cut = cut.withColumn("body", body)

    def line(name: str, *value: Column, when: Column | None = None) -> Column:
        text = F.concat(F.lit(f"{name}: "), *value, F.lit("\r\n"))
        return text if when is None else F.when(when, text).otherwise(F.lit(""))

    many, first = F.col("segments") > 1, F.col("segment") == 1
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(first, F.col("record_type")).otherwise(F.lit("continuation"))),
        line("WARC-Record-ID", F.when(first, _urn(F.col("page_id"))).otherwise(F.concat(F.rtrim(_urn(F.col("page_id")), F.lit(">")), F.lit(":"), F.col("segment").cast("string"), F.lit(">")))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", ""), when=F.col("url").isNotNull()),
        line("WARC-Payload-Digest", F.lit("sha1:"), F.col("payload_digest"), when=first),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string"), when=first),
        line("WARC-Refers-To", F.when(revisit, _urn(F.col("refers_to"))).otherwise(F.lit("")), when=revisit),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), when=revisit),
        line("WARC-Segment-Number", F.col("segment").cast("string"), when=many),
        line("WARC-Segment-Origin-ID", _urn(F.col("page_id")), when=many & ~first),
        line("WARC-Segment-Total-Length", F.col("payload_bytes").cast("string"), when=many & (F.col("segment") == F.col("segments"))),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.octet_length("body").cast("string")),
    )
    # the writer ends each row with the break that closes a record
    return cut.select(F.concat(head.cast("binary"), F.lit(b"\r\n"), F.col("body")).cast("string").alias("value"))


def write_archives(pages: DataFrame, path: str, chunk: int = CHUNK, min_bytes: int = MIN_BYTES) -> str:
    """Write gzipped archives, one per task."""
    records(plan_records(pages, min_bytes), chunk).write.option("lineSep", BREAK).option("compression", "gzip").text(path)
    return path


def _number(urn: str | None) -> int | None:
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">").split(":")[0]
    return int(name) if name.lstrip("-").isdigit() else None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows of a stream of pieces that ended in a break each.

    A piece is a header, a payload, or part of a payload that holds breaks
    itself: Content-Length tells. A running digest is carried from chunk to
    chunk, over the continuation records too.
    """
    columns = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int32()), ("is_last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("expected_digest", pa.string()), ("data", pa.binary())])
    out: list[tuple] = []
    held = 0
    fields: dict[str, str] | None = None
    origin: dict[str, str] = {}
    need, got, body, digest, seen, number = 0, 0, [], hashlib.sha1(), 0, 0

    def made() -> pa.RecordBatch:
        rows = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(rows, schema)], columns)

    pieces = (piece.as_py() for batch in batches for piece in batch.column(0))
    again: list[bytes] = []  # what followed a record within one piece
    while True:
        piece = again.pop() if again else next(pieces, None)
        if piece is None:
            break
        if fields is None:
            if not piece:
                continue
            lines = piece.decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"not a record: {lines[0][:60]!r}")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            need, got, body = int(fields["Content-Length"]), -len(BREAK), []
            continue
        body.append(piece)
        got += len(BREAK) + len(piece)
        if got < need:
            continue
        data = BREAK.encode().join(body)
        if got > need:
            # a payload that ends in half a break: the reader took it for the break's first half
            data, rest = data[:need], data[need:]
            if not rest.startswith(BREAK.encode()):
                raise ValueError("a record is longer than its Content-Length")
            again.append(rest[len(BREAK) :])
        if fields["WARC-Type"] != "continuation":
            origin, digest, seen, number = fields, hashlib.sha1(), 0, 0
        elif fields["WARC-Segment-Origin-ID"] != origin["WARC-Record-ID"]:
            raise ValueError("a continuation without its record")
        digest.update(data)
        seen += len(data)
        total, kind = int(origin["WARC-Payload-Length"]), origin["WARC-Type"]
        expected = origin["WARC-Payload-Digest"].removeprefix("sha1:")
        last = kind == "revisit" or seen == total
        running = expected if kind == "revisit" else base64.b32encode(digest.copy().digest()).decode()
        if last and running != expected:
            raise ValueError("a payload differs from its digest")
        out.append((_number(origin["WARC-Record-ID"]), kind, _number(origin.get("WARC-Refers-To")), number, last, total if kind == "revisit" else seen, running, expected, data))
        number, fields, held = number + 1, None, held + len(data)
        if held > 4 << 20 or len(out) >= 5000:
            yield made()
            out, held = [], 0
    if fields is not None or (origin and origin["WARC-Type"] != "revisit" and seen != int(origin["WARC-Payload-Length"])):
        raise ValueError("an archive ends inside a record")
    if out:
        yield made()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of archives: columns of CHUNK_SCHEMA.

    A compressed archive is one stream in one task, cut at breaks; tasks may
    read several archives one after another.
    """
    pieces = spark.read.option("lineSep", BREAK).schema("value string").text(path)
    return pieces.select(F.col("value").cast("binary").alias("value")).mapInArrow(_parse, CHUNK_SCHEMA)


def query(spark, sf_dir):
    path = write_archives(table(spark, sf_dir, "pages"), f"{state_dir(spark, 'warc')}/archives")
    last = read_archives(spark, path).where("is_last")
    return last.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_LETTERS = " || ".join(f"substr('{BASE32}', (((('0x' || substr(sha1(body), {10 * g + 1}, 10))::bigint >> {35 - 5 * i}) & 31) + 1)::int, 1)" for g in range(4) for i in range(8))
SQL = f"""
with p as (select page_id, coalesce(html, '') body from pages),
d as (select page_id, strlen(body)::bigint payload_bytes, {_LETTERS} payload_digest from p),
m as (select *, max(page_id) over (partition by payload_digest) first_id from d)
select page_id, payload_bytes, payload_digest,
  case when first_id is not null and page_id is distinct from first_id and payload_bytes >= {MIN_BYTES} then 'revisit' else 'response' end record_type,
  case when page_id is distinct from first_id and payload_bytes >= {MIN_BYTES} then first_id end refers_to
from m
"""
