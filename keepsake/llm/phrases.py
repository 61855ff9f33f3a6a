"""Phrase collocations mined with double-array tries over Apriori-safe candidates.

Words are counted first. Frequent ones get numbers, and texts become blocks of numbers, in
which 0 stands for a rarer word or the end of a piece, so nothing that holds one can be a
candidate. A block also has a state per position: the number of the frequent phrase of the current length
that starts there, at first the word itself. Two frequent phrases of k words that start side by
side are a candidate of k + 1 words, both its parts are frequent. Tasks propose
such pairs once each with a count, so a common pair is added up before it is shuffled.

The candidates of a level form a trie from (state, next word) to the new state, laid out as a
double array over the bytes of the word's number and broadcast. All positions of a block
advance at once, one numpy step per byte; accepting states are counted by bincount, the
counts of all shards are added up, and the new states replace the old ones in the blocks.
A dictionary or trie is broadcast in pieces of a bounded size; more pieces mean more
passes, not larger broadcasts.

Edge cases: a null text is an empty one, a null lang is ``und``; texts without words, and languages without
a phrase of ``least`` occurrences, give nothing; repeated rows count as often as they come, null
ids are as good as others (ids are not read); phrases of equal score go by count, then by their
bytes; an empty table has no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keepsake.llm.common import ASCII_LOWER, raw, table
from keepsake.session import stored

LEAST, LONGEST, TOP = 100, 5, 2000
# Words of one dictionary, and phrases of one trie: some 150 and 40 bytes each.
WORD_PIECE, TRIE_PIECE = 400_000, 1_000_000
# Positions of a block, distinct words or pairs a task holds before it passes them on.
BLOCK, HELD = 1 << 17, 1 << 20
STRETCHES = 4096

_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
# A-Z to lower case, tab to space, the ends of pieces to line feeds.
_TABLE = bytes(10 if c in _ENDS else 32 if c == 9 else ASCII_LOWER[c] for c in range(256))
BLOCKS = "words binary, state binary"  # packed numbers; without states the words are the states


def words_of(text: bytes) -> Iterator[bytes]:
    """The words of a text in order, with a line feed at each end of a piece."""
    return filter(None, text.translate(_TABLE).replace(b"\n", b" \n ").split(b" "))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def out() -> pa.RecordBatch:
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items() if w != b"\n"]
        rows += [(lang, None, c.total() - c[b"\n"]) for lang, c in counts.items()]
        counts.clear()
        types = (pa.string(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 3, types)], ["lang", "word", "n"])

    for got in batches:
        for lang, text in zip(got.column("lang").to_pylist(), got.column("text")):
            counts.setdefault(lang, Counter()).update(words_of(text.as_py()))
            if sum(map(len, counts.values())) > HELD:
                yield out()
    yield out()


def count_words(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, word and a of the frequent words; the row without word has all words of the language."""
    counts = texts.mapInArrow(_count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("a"))
    return stored(counts.where(F.col("word").isNull() | (F.col("a") >= least)), "phrase-words")


def _numbered(rows: DataFrame, *key: str) -> DataFrame:
    """The rows with ``state`` from 1, dense: numbered in hash pieces, each piece after the one before."""
    pieces = max(1, -(-rows.count() // WORD_PIECE))
    dealt = rows.withColumn("__piece", F.pmod(F.xxhash64(*key), F.lit(pieces)).cast("int"))
    sizes = dict(dealt.groupBy("__piece").count().collect())  # one row per piece
    ends = np.cumsum([0] + [sizes.get(p, 0) for p in range(pieces)]).tolist()
    base = F.get(F.array(*[F.lit(e) for e in ends]), F.col("__piece"))
    place = F.row_number().over(W.partitionBy("__piece").orderBy(*key))
    return dealt.withColumn("state", (place + base).cast("int")).drop("__piece")


class Tally:
    """Counts of codes, passed on when many."""

    def __init__(self):
        self.codes, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.new: list[np.ndarray] = []
        self.waiting = 0

    def add(self, codes: np.ndarray) -> None:
        self.new.append(codes)
        self.waiting += len(codes)

    def batches(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if self.new and (last or self.waiting > HELD):
            codes, counts = np.unique(np.concatenate(self.new), return_counts=True)
            self.new, self.waiting = [], 0
            self.codes, at = np.unique(np.concatenate([self.codes, codes]), return_inverse=True)
            # exact: counts of a task stay far below 2**53
            self.counts = np.bincount(at, np.concatenate([self.counts, counts]), len(self.codes)).astype(np.int64)
        if len(self.codes) and (last or len(self.codes) > HELD):
            yield pa.RecordBatch.from_arrays([pa.array(self.codes), pa.array(self.counts)], ["code", "n"])
            self.codes, self.counts = self.codes[:0], self.counts[:0]


def _count(blocks: DataFrame, pairs: bool, least: int) -> DataFrame:
    """prev, next and n: how often states stand side by side, and with next 0 how often each one is accepted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepted, tally = Counter(), Tally()
        for got in batches:
            for held in got.column("state"):
                state = _unpacked(held)
                some = state[state > 0]
                if len(some):
                    base = int(some.min())
                    counts = np.bincount(some - base)
                    seen = np.flatnonzero(counts)
                    accepted.update(dict(zip((seen + base).tolist(), counts[seen].tolist())))
                if pairs:
                    left = state[:-1].astype(np.int64)
                    both = (left > 0) & (state[1:] > 0)
                    tally.add((left[both] << 32) | state[1:][both])
                    yield from tally.batches()
                if len(accepted) > HELD:
                    yield _accepted(accepted)
        yield _accepted(accepted)
        yield from tally.batches(last=True)

    counts = blocks.select(F.coalesce("state", "words").alias("state")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    low = F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    return stored(counts.where(F.col("n") >= least).select(F.shiftright("code", 32).cast("int").alias("prev"), low.alias("next"), "n"), "phrase-counts")


def _accepted(counts: Counter) -> pa.RecordBatch:
    codes = np.fromiter(counts.keys(), np.int64, len(counts)) << 32
    out = pa.RecordBatch.from_arrays([pa.array(codes), pa.array(list(counts.values()), pa.int64())], ["code", "n"])
    counts.clear()
    return out


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers in rows of four bytes shrink well; only the worker that uses them unpacks them, block by block."""
    return len(numbers).to_bytes(4, "little") + pa.compress(numbers.tobytes(), "zstd", asbytes=True)


def _unpacked(packed: pa.Scalar) -> np.ndarray:
    held = packed.as_buffer()
    size = int.from_bytes(held[:4].to_pybytes(), "little")
    return np.frombuffer(pa.decompress(held[4:], 4 * size, "zstd"), np.int32)


def _block(words: np.ndarray, state: np.ndarray | None) -> pa.RecordBatch:
    packed = [_packed(words), None if state is None else _packed(state)]
    return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed], ["words", "state"])


def _encode(texts: DataFrame, words: DataFrame) -> DataFrame:
    """Blocks of word numbers. Beyond one dictionary, texts go through pass by pass."""
    spark = texts.sparkSession
    total = words.count()
    pieces = max(1, -(-total // WORD_PIECE))
    rows = texts.withColumn("words", F.lit(None).cast("binary"))
    for piece in range(pieces):
        known: dict[str, dict[bytes, int]] = {}
        low, high = piece * WORD_PIECE, (piece + 1) * WORD_PIECE
        for r in words.where((F.col("state") > low) & (F.col("state") <= high)).select("lang", "word", "state").toLocalIterator():
            known.setdefault(r["lang"], {})[bytes(r["word"])] = r["state"]
        shared = spark.sparkContext.broadcast(known)
        if piece < pieces - 1:
            rows = stored(rows.mapInArrow(_filling(shared), "lang string, text binary, words binary"), "phrase-texts")
    return stored(rows.mapInArrow(_blocks(shared), BLOCKS), "phrase-blocks")


def _numbers(known: dict[str, dict[bytes, int]], got: pa.RecordBatch) -> Iterator[tuple[str, pa.Scalar, np.ndarray]]:
    for lang, text, before in zip(got.column("lang").to_pylist(), got.column("text"), got.column("words")):
        number = known.get(lang, {}).get
        now = np.fromiter(map(number, words_of(text.as_py()), repeat(0)), np.int32)
        if before.is_valid:
            now = np.maximum(now, np.frombuffer(before.as_buffer(), np.int32))
        yield lang, text, now


def _filling(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            words = [n.tobytes() for _, _, n in _numbers(shared.value, got)]
            yield pa.RecordBatch.from_arrays([got.column("lang"), got.column("text"), pa.array(words, pa.binary())], ["lang", "text", "words"])

    return run


def _blocks(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, gap = [], 0, np.zeros(1, np.int32)
        for got in batches:
            # numbers of words belong to one language, so languages never mix in a phrase
            for _, _, numbers in _numbers(shared.value, got):
                held += [numbers, gap]
                size += len(numbers) + 1
                if size >= BLOCK:
                    yield _block(np.concatenate(held), None)
                    held, size = [], 0
        if held:
            yield _block(np.concatenate(held), None)

    return run


class Trie:
    """A double array from (state, word) to a new state.

    The word's number goes byte by byte, so a node has at most 256 children. A slot holds
    the node it belongs to (``owner``) and, by its own node number, where its children start
    (``base``) or the state it accepts (``to``). Nodes 1 to ``roots`` are the states low + 1 to
    low + roots; node roots + 1 + s is slot s. Node 0 has no children.
    """

    def __init__(self, low: int, roots: int, prev: np.ndarray, word: np.ndarray, state: np.ndarray, digits: int):
        self.low, self.roots, self.digits = low, roots, digits
        size = 1024 + 2 * digits * len(prev)
        self.owner, self.to, self.base = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(roots + 1 + size, np.int32)
        node = prev.astype(np.int64) - low
        for digit in range(digits):
            byte = (word >> (8 * (digits - 1 - digit))) & 255
            slots, at = self._place(*np.unique(node << 8 | byte, return_inverse=True))
            node = roots + 1 + slots[at]
        self.to[node - roots - 1] = state
        used = np.flatnonzero(self.owner >= 0)
        end = (used[-1] if len(used) else 0) + 257  # any byte may be tried from the last base
        self._grow(end)
        self.owner, self.to, self.base = self.owner[:end], self.to[:end], self.base[: roots + 1 + end]

    def _grow(self, size: int) -> None:
        more = size - len(self.owner)
        if more > 0:
            more += len(self.owner) // 2
            self.owner = np.concatenate([self.owner, np.full(more, -1, np.int32)])
            self.to = np.concatenate([self.to, np.zeros(more, np.int32)])
            self.base = np.concatenate([self.base, np.zeros(more, np.int32)])

    def _place(self, edges: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the (node, byte) edges: nodes of many children first, each in the first gap that takes them."""
        nodes, starts, counts = np.unique(edges >> 8, return_index=True, return_counts=True)
        slots = np.empty(len(edges), np.int64)
        free, tried = np.flatnonzero(self.owner < 0), 0
        many = np.flatnonzero(counts > 1)
        for n in many[np.argsort(-counts[many], kind="stable")]:
            own = slice(starts[n], starts[n] + counts[n])
            bytes_ = (edges[own] & 255).astype(np.int64)
            base = -1
            while base < 0:
                some = free[tried : tried + 64]
                if len(some) < 64:
                    self._grow(len(self.owner) + 4096)
                    free, tried = np.flatnonzero(self.owner < 0), max(0, tried - 64)
                    some = free[tried : tried + 64]
                starts_at = some - bytes_[0]
                self._grow(int(starts_at[-1]) + 256)
                fits = (starts_at >= 0) & (self.owner[np.maximum(starts_at, 0)[:, None] + bytes_] < 0).all(1)
                if fits.any():
                    base = int(starts_at[fits.argmax()])
                else:
                    tried += 64  # gaps passed over are left to nodes of one child
            slots[own] = base + bytes_
            self.owner[base + bytes_] = nodes[n]
            self.base[nodes[n]] = base
        ones = np.flatnonzero(counts == 1)
        byte = (edges[starts[ones]] & 255).astype(np.int64)
        self._grow(int((self.owner >= 0).sum()) + len(ones) + 512)
        free = np.flatnonzero(self.owner < 0)
        free = free[free >= 255][: len(ones)]  # so that every base is 0 or more
        if len(free) < len(ones):
            self._grow(len(self.owner) + len(ones) + 512)
            free = np.flatnonzero(self.owner < 0)
            free = free[free >= 255][: len(ones)]
        slots[starts[ones]] = free
        self.owner[free] = nodes[ones]
        self.base[nodes[ones]] = free - byte
        return slots, at

    def advance(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose (state, word) the trie accepts, and their new states; all positions go together."""
        node = state.astype(np.int64) - self.low
        at = np.flatnonzero((state > self.low) & (node <= self.roots) & (word > 0))
        node, word = node[at], word[at]
        slot = node
        for digit in range(self.digits):
            slot = self.base[node] + ((word >> (8 * (self.digits - 1 - digit))) & 255)
            fits = self.owner[slot] == node
            at, word, slot = at[fits], word[fits], slot[fits]
            node = self.roots + 1 + slot.astype(np.int64)
        return at, self.to[slot]


def _stretches(phrases: DataFrame, before: int) -> list[tuple[int, int]]:
    """(low, high] of the states before, so that each has about ``TRIE_PIECE`` phrases or a single histogram bar."""
    width = -(-(before + 1) // STRETCHES)
    counts = dict(phrases.groupBy(F.floor(F.col("prev") / width).cast("int").alias("s")).count().collect())  # at most STRETCHES rows
    out, low, size = [], 0, 0
    for s in sorted(counts):
        if size and size + counts[s] > TRIE_PIECE:
            out.append((low, s * width - 1))
            low, size = s * width - 1, 0
        size += counts[s]
    return [*out, (low, before)]


def _trie(phrases: DataFrame, low: int, high: int, digits: int) -> Trie:
    got = phrases.where((F.col("prev") > low) & (F.col("prev") <= high)).select("prev", "last", "state").toPandas().sort_values(["prev", "last"])
    return Trie(low, high - low, got["prev"].to_numpy(), got["last"].to_numpy(), got["state"].to_numpy(), digits)


def _advanced(blocks: DataFrame, shared, length: int, last: bool) -> DataFrame:
    """One pass: states advance where this trie accepts them. ``last`` tells that no trie of the level follows.

    ``state`` has the states of the level before, and after them, once a pass has been made, those of this level.
    Blocks without a state left cannot grow a phrase and are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie: Trie = shared.value
        for got in batches:
            for flat, held in zip(got.column("words"), got.column("state")):
                words = _unpacked(flat)
                both = _unpacked(held) if held.is_valid else words
                state, new = both[: len(words)], both[len(words) :]
                new = new.copy() if len(new) else np.zeros(len(words), np.int32)
                reach = max(0, len(words) - length + 1)
                at, to = trie.advance(state[:reach], words[length - 1 :])
                new[at] = to
                if not last:
                    yield _block(words, np.concatenate([state, new]))
                elif new.any():
                    yield _block(_wanted(words, new, length), new)

    return stored(blocks.mapInArrow(run, BLOCKS), "phrase-states")


def _wanted(words: np.ndarray, state: np.ndarray, length: int) -> np.ndarray:
    """The words with 0 wherever no longer phrase can reach: one needs a state at its first and at its second word."""
    both = np.zeros(len(state) + 1, np.int32)
    both[1:-1] = np.cumsum((state[:-1] > 0) & (state[1:] > 0))
    both[-1] = both[-2]
    ends = np.arange(1, len(words) + 1)
    return np.where(both[ends] > both[np.maximum(ends - length - 1, 0)], words, np.int32(0))


def _candidates(counts: DataFrame, level: DataFrame) -> DataFrame:
    """Phrases one word longer whose parts are frequent: state, prev, next, last word, words, and counts of first and last parts."""
    pairs = counts.where(F.col("next") > 0).select("prev", "next")
    left = level.select(F.col("state").alias("prev"), "lang", F.col("words").alias("l_words"), F.col("pre").alias("l_pre"), F.col("a").alias("l_a"))
    right = level.select(F.col("state").alias("next"), "last", F.element_at("words", -1).alias("r_word"), F.col("suf").alias("r_suf"), F.col("a").alias("r_a"))
    made = pairs.join(left, "prev").join(right, "next").select(
        "prev", "next", "last", "lang", F.concat("l_words", F.array("r_word")).alias("words"),
        F.concat("l_pre", F.array("l_a")).alias("pre"), F.concat(F.array("r_a"), "r_suf").alias("suf"),
    )
    return stored(_numbered(made, "prev", "next"), "phrase-candidates")


def frequent(texts: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, list[DataFrame]]:
    """Words per language (lang, n), and per length from 2 the phrases: state, prev, next, lang, words, pre, suf, a.

    ``pre`` counts the first 1, 2, … words of a phrase, ``suf`` the last k - 1, k - 2, … words.
    """
    texts = texts.select(F.coalesce("lang", F.lit("und")).alias("lang"), raw(F.col("text")).alias("text"))
    counted = count_words(texts, least)
    totals = counted.where(F.col("word").isNull()).select("lang", F.col("a").alias("n"))
    none = F.array().cast("array<long>")
    words = stored(_numbered(counted.where(F.col("word").isNotNull()), "lang", "word"), "phrase-dictionary")
    level = words.select("state", F.col("state").alias("last"), "lang", F.array(F.col("word").cast("string")).alias("words"), none.alias("pre"), none.alias("suf"), "a")
    before = words.count()
    digits = max(1, -(-int(before).bit_length() // 8))
    levels: list[DataFrame] = []
    if not before:
        return totals, levels
    blocks = _encode(texts, words)
    counts = _count(blocks, longest > 1, least)
    for length in range(2, longest + 1):
        found = _candidates(counts, level)
        n_found = found.count()
        if not n_found:
            break
        stretches = _stretches(found, before)
        for i, (low, high) in enumerate(stretches):
            shared = texts.sparkSession.sparkContext.broadcast(_trie(found, low, high, digits))
            blocks = _advanced(blocks, shared, length, i == len(stretches) - 1)
            shared.unpersist()
        counts = _count(blocks, length < longest, least)
        totals_of = counts.where(F.col("next") == 0).select(F.col("prev").alias("state"), F.col("n").alias("a"))
        level = stored(found.join(totals_of, "state"), "phrase-level")
        levels.append(level)
        before = n_found
    return totals, levels


def _score(n: str) -> Column:
    """The lowest score of all cuts and its counts; whole numbers of 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    one = lambda l, j: F.struct(  # noqa: E731, E741
        F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide(F.col("a")) * wide(F.col(n)), wide(l) * wide(F.get("suf", j))).alias("score"),
        j.alias("j"), l.alias("l"), F.get("suf", j).alias("r"),
    )
    return F.array_min(F.transform("pre", one))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases."""
    totals, levels = frequent(docs, least, longest)
    kept = []
    for i, level in enumerate(levels):
        rows = level
        if i + 1 < len(levels):
            # a longer phrase counts no more than its parts, so those one word longer tell for all
            longer = levels[i + 1].select(F.explode(F.array("prev", "next")).alias("state"), "a").groupBy("state").agg(F.max("a").alias("over"))
            rows = level.join(longer, "state", "left").where(F.col("over").isNull() | (F.col("over") < F.col("a")))
        kept.append(rows.select("lang", F.array_join("words", " ").alias("phrase"), "a", "pre", "suf"))
    if not kept:
        return totals.select("lang", F.lit(1).alias("rank"), F.lit("").alias("phrase"), *[F.lit(0).cast("long").alias(c) for c in ("a", "l", "r")], "n", F.lit(0).cast("long").alias("score")).limit(0)
    rows = reduce(DataFrame.union, kept).join(totals, "lang").withColumn("best", _score("n"))
    order = W.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = rows.select("lang", F.row_number().over(order).alias("rank"), "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").cast("long").alias("score"))
    return ranked.where(F.col("rank") <= top)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return collocations(docs).withColumn("rank", F.col("rank").cast("long"))


SQL = rf"""
with d as (select coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) piece from d)),
tot as (select lang, sum(len(w))::hugeint n from p group by 1),
g as materialized (select lang, k, array_to_string(w[s : s + k - 1], ' ') phrase, count(*)::bigint f
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) s from p, range(1, {LONGEST + 1}) t(k) where len(w) >= k) group by all having count(*) >= {LEAST}),
c as (select lang, k, phrase, f a, string_split(phrase, ' ') w from g where k > 1),
cuts as (select lang, phrase, j, array_to_string(w[1 : j], ' ') x, array_to_string(w[j + 1 :], ' ') y from c, range(1, {LONGEST}) t(j) where j < k),
s as (select c.lang, c.phrase, c.a, u.j, x.f l, y.f r, tot.n, (1000::hugeint * c.a * tot.n) // (x.f::hugeint * y.f) score
  from c join cuts u on u.lang = c.lang and u.phrase = c.phrase join tot on tot.lang = c.lang
  join g x on x.lang = c.lang and x.phrase = u.x join g y on y.lang = c.lang and y.phrase = u.y),
best as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
parts as (select lang, array_to_string(w[i : i + m - 1], ' ') phrase, max(a) over_a from c, range(2, {LONGEST}) t(m), range(1, {LONGEST}) q(i) where m < k and i + m - 1 <= k group by all),
kept as (select b.* from best b left join parts o on o.lang = b.lang and o.phrase = b.phrase where o.over_a is null or 100 * o.over_a < 100 * a)
select * from (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) rank, phrase, a, l, r, n::bigint n, score::bigint score from kept) where rank <= {TOP}
"""
