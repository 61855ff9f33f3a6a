"""Token ids in Parquet list columns, laid out for selective reads.

One row per document in ascending id order: its id, its tokens as a list of
int32, their number, and where they start in the file's stream. The token column is
delta encoded (or dictionary encoded), row groups and pages have set sizes, and
the writer's page indexes let a reader of a few ids skip the other pages;
a reader of lengths and offsets never touches the tokens.

Edge cases: a null or empty text is the end id alone; null ids come first; rows
of equal id are ordered by their text, and repeated rows follow each other; an
empty table gives an empty data set. Other columns are left out of the files.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keepsake.llm.common import raw, table
from keepsake.session import state_dir

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
# Words whose ids a worker remembers, and bytes of ids it hands on at once.
CACHE_WORDS = 800_000
TEXTS_AT_ONCE, WORDS_AT_ONCE, PART = 64, 256, "|"
# Marks that may follow letters or digits; letters and spaces whose treatment is not by single character.
MARKS = ".,!?;:|#$%&*"
BY_PLACE = "\x1c\x1d\x1e\x1f\u03a3\u0130"
CHUNK_BYTES = 8 << 20
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
FILE_SCHEMA = "doc_id long, tokens array<int>, n_tokens int, local_start long, part int"


class WordEncoder:
    """Encodes texts with a tokenizer that lower-cases and whose pieces never cross white space.

    White space is dropped by it, so a text's ids are those of its words one
    after another, and those of letters followed by marks are the ids of both
    parts; each distinct part is encoded once and remembered, the least recent
    half being forgotten first. Texts that hold a special token's string once they are
    lower-cased, control characters that only Python counts as space, or letters
    whose lower case depends on their place are encoded whole.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cache_words = cache_words // 2
        (self.part_id,) = self.tokenizer.encode(PART, add_special_tokens=False).ids

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        if len(self.known) > self.cache_words:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new, parts = set(), []
        for word in words.difference(known):
            if word in older:
                known[word] = older[word]
                continue
            stem = word.rstrip(MARKS)
            if len(stem) < len(word) and stem and stem[-1].isalnum():
                parts.append((word, stem, word[len(stem) :]))
                for part in parts[-1][1:]:
                    if part not in known:
                        if part in older:
                            known[part] = older[part]
                        else:
                            new.add(part)
            else:
                new.add(word)
        plain = [w for w in new if w.isalnum()]
        for at in range(0, len(plain), WORDS_AT_ONCE):
            self._learn_joined(plain[at : at + WORDS_AT_ONCE])
        other = [w for w in new if not w.isalnum()]
        for word, got in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)):
            known[word] = np.array(got.ids, "<u4").tobytes()
        for word, stem, marks in parts:
            known[word] = known[stem] + known[marks]

    def _learn_joined(self, words: list[str]) -> None:
        """Words of letters and digits in one call, parted by a mark whose id they cannot have."""
        ids = np.array(self.tokenizer.encode_batch_fast([f" {PART} ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.append(np.flatnonzero(ids == self.part_id), len(ids))
        if len(ends) != len(words):
            raise ValueError("the tokenizer's pieces cross white space")
        body, at = ids.tobytes(), 0
        for word, end in zip(words, ends.tolist()):
            self.known[word] = body[4 * at : 4 * end]
            at = end + 1

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        lower = [t.lower() for t in texts]
        split = [None if any(s in low for s in self.special) or any(c in t for c in BY_PLACE) else low.split() for t, low in zip(texts, lower)]
        words = set().union(*[s for s in split if s])
        self._learn(words)
        known = self.known.__getitem__
        return [self._whole(t) if s is None else b"".join(map(known, s)) for t, s in zip(texts, split)]


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker, so that they share what it remembers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _encoding(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batch(ids, bodies, starts, part) -> pa.RecordBatch:
        sizes = np.array([len(b) // 4 for b in bodies], np.int32)
        flat = pa.array(np.frombuffer(b"".join(bodies), "<i4"))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)
        columns = [pa.array(ids, pa.int64()), lists, pa.array(sizes), pa.array(starts, pa.int64()), pa.array([part] * len(ids), pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "tokens", "n_tokens", "local_start", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, end, part, at = word_encoder(path), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        ids, bodies, starts, held = [], [], [], 0
        for got in batches:
            for low in range(0, got.num_rows, TEXTS_AT_ONCE):
                some = got.slice(low, TEXTS_AT_ONCE)
                texts = [t.as_py().decode("utf-8", "replace") for t in some.column("text")]
                for doc_id, body in zip(some.column("doc_id").to_pylist(), encoder.encode(texts)):
                    ids.append(doc_id)
                    bodies.append(body + end)
                    starts.append(at)
                    at += len(body) // 4 + 1
                    held += len(body) + 4
                if held >= CHUNK_BYTES:
                    yield batch(ids, bodies, starts, part)
                    ids, bodies, starts, held = [], [], [], 0
        if ids:
            yield batch(ids, bodies, starts, part)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, encoding: str = "delta", row_group: int = ROW_GROUP_BYTES, page: int = PAGE_BYTES) -> str:
    """Encode ``text`` and write the token files, ordered by doc_id over all files.

    The texts are range partitioned by id before they are encoded, so each is
    encoded once; a task then writes its stretch of ids as it goes. ``encoding``
    is "delta" or "dictionary".
    """
    parts = max(1, docs.rdd.getNumPartitions())
    texts = docs.select("doc_id", raw(F.col("text")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    ordered = texts.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)
    out = ordered.mapInArrow(_encoding(tokenizer, end_id), FILE_SCHEMA).write
    out = out.option("parquet.block.size", row_group).option("parquet.page.size", page).option("parquet.writer.version", "v2")
    out.option("parquet.enable.dictionary#tokens.list.element", str(encoding == "dictionary").lower()).parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """The token rows, or those with low <= doc_id <= high: the bounds reach the page indexes."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    return rows if high is None else rows.where(F.col("doc_id") <= high)


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """part and base: the ids in all files before it. One row per written file, read from lengths only."""
    per = spark.read.schema(FILE_SCHEMA).parquet(path).groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("n"))
    return per.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for got in batches:
        lists = got.column("tokens")
        flat = np.asarray(lists.values.to_numpy(zero_copy_only=False), "<i4")
        edges = lists.offsets.to_numpy()
        crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:])]
        columns = [got.column("doc_id"), got.column("part"), got.column("local_start"), pa.array(np.diff(edges).astype(np.int64)), pa.array(crcs, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start in the whole stream, n_tokens and the checksum of its ids."""
    got = read_tokens(spark, path).select("doc_id", "part", "local_start", "tokens")
    rows = got.mapInArrow(_sums, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    # one row per file, so this side is bounded by the number of files
    rows = rows.join(F.broadcast(offsets(spark, path)), "part")
    return rows.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def tokenise(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write the token files into the shared folder and give what is read back."""
    path = write_tokens(docs, f"{state_dir(spark, 'tokens')}/files", tokenizer_path())
    return digests(spark, path)


def query(spark, sf_dir):
    return tokenise(spark, table(spark, sf_dir, "documents"))
