"""Items of the same kind with the same or nearly the same title."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions import text
from keepsake.operators.filters import live
from keepsake.schema import DEDUPE_KINDS, FUZZY_DUPLICATE
from keepsake.session import broadcast_if_small, stored

SHOWN = 5
# how many of a title's possible look-alikes are compared at a time, newest first
HEAD = 64
# How many titles, and how many trigrams, meet on each side of a task, and how many bits tell two sets apart.
BLOCK_TITLES, BLOCK_GRAMS, SIGN_BITS = 16_384, 2_000_000, 1024
# titles in steps of half the size ratio that two look-alikes may have are at most so many steps apart
BANDS_APART = 2
_FOUND = "tid long, other long, age long, newest string"


def _runs(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """All elements in one array, and where each list begins in it."""
    return np.concatenate(lists.to_numpy()), np.concatenate([[0], np.cumsum(lists.map(len).to_numpy())])


def _signs(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of bits per set: whether an odd number of its elements falls on each. Two sets differ in at least as many elements as bits."""
    out = np.empty((len(starts) - 1, SIGN_BITS), dtype=np.float32)
    for a in range(0, len(out), 1024):
        b = min(a + 1024, len(out))
        rows = np.repeat(np.arange(b - a), np.diff(starts[a : b + 1]))
        at = rows * SIGN_BITS + np.mod(values[starts[a] : starts[b]], SIGN_BITS)
        out[a:b] = (np.bincount(at, minlength=(b - a) * SIGN_BITS) & 1).reshape(b - a, SIGN_BITS)
    return out


def _block_alike(left: pd.DataFrame, right: pd.DataFrame, threshold: float, slack: float, enough: int) -> pd.DataFrame:
    """The ``enough`` newest look-alikes in one block for each title of another.

    Signs and sizes rule most pairs out by one matrix product; of the rest, sets are compared newest first, until there are enough.
    """
    right = right.sort_values(["age", "newest"], ignore_index=True)
    (lv, ls), (rv, rs) = _runs(left["g"]), _runs(right["g"])
    n, m = np.diff(ls), np.diff(rs)
    terms, codes = np.unique(rv, return_inverse=True)
    present = np.zeros(len(terms) + 1, dtype=np.int64)
    places = np.searchsorted(terms, lv)
    places[(places < len(terms)) & (terms[np.minimum(places, len(terms) - 1)] != lv)] = len(terms)
    l_sign, r_sign = _signs(lv, ls), _signs(rv, rs)
    r_bits, r_ids, l_ids = r_sign.sum(axis=1), right["tid"].to_numpy(), left["tid"].to_numpy()
    found = []
    for a in range(0, len(left), 512):
        part = l_sign[a : a + 512]
        apart = part.sum(axis=1)[:, None] + r_bits - 2 * (part @ r_sign.T)
        sizes = n[a : a + 512, None]
        may = (apart <= (sizes + m) * ((1 - slack) / (1 + slack))) & (m >= sizes * slack) & (sizes >= m * slack)
        may &= l_ids[a : a + 512, None] != r_ids
        for i in np.flatnonzero(may.any(axis=1)):
            near, mine, kept = np.flatnonzero(may[i]), places[ls[a + i] : ls[a + i + 1]], 0
            present[mine] = 1
            present[-1] = 0
            for b in range(0, len(near), HEAD):
                some = near[b : b + HEAD]
                held = present[np.concatenate([codes[rs[j] : rs[j + 1]] for j in some])]
                shared = np.add.reduceat(held, np.concatenate([[0], np.cumsum(m[some])[:-1]]))
                score = (shared / (n[a + i] + m[some] - shared)).astype(np.float32).astype(np.float64)
                alike = some[score > threshold][: enough - kept]
                found.append((np.full(len(alike), a + i), alike))
                kept += len(alike)
                if kept >= enough:
                    break
            present[mine] = 0
    rows = np.concatenate([f[0] for f in found]) if found else np.empty(0, int)
    cols = np.concatenate([f[1] for f in found]) if found else np.empty(0, int)
    return pd.DataFrame({"tid": l_ids[rows], "other": r_ids[cols], "age": right["age"].to_numpy()[cols], "newest": right["newest"].to_numpy()[cols]})


def similar_titles(titles: DataFrame, threshold: float = FUZZY_DUPLICATE, enough: int = SHOWN + 1) -> DataFrame:
    """(kind, title, other): the ``enough`` newest look-alikes of each asked title, or all if fewer.

    ``titles``: distinct (kind, title) with ``asked``, and of the newest stored item that holds
    it ``age``, smaller the newer, and its id as ``newest``; both are null if none does.

    Exact, whatever trigrams titles share. Titles lie in cells by kind and number of trigrams, and the cells are
    cut into bounded blocks. Two blocks meet in one task where their sizes allow look-alikes, so no pair of titles
    is ever a row of a shuffle: a block passes on the few newest of each title.
    """
    slack = threshold - 1e-6
    named = stored(titles.withColumn("tid", F.monotonically_increasing_id()), "title-numbers")
    # from here on titles are numbers and so are their trigrams
    sets = named.select("tid", "kind", "asked", "age", "newest", text.trigram_numbers(F.col("title")).alias("g")).withColumn("n", F.size("g"))
    band = F.floor(F.log(F.col("n")) * (BANDS_APART / -math.log(slack))).cast("int")
    sets = stored(sets.withColumn("band", F.when(F.col("n") > 0, band)), "title-grams").where(F.col("n") > 0)
    sides = {"q": sets.where("asked").select("kind", "band", "tid", "n", "g")}
    sides["c"] = sets.where(F.col("age").isNotNull()).select("kind", "band", "tid", "n", "g", "age", "newest")

    def cells(side: str) -> DataFrame:
        blocks = F.greatest(F.ceil(F.sum("n") / BLOCK_GRAMS), F.ceil(F.count("*") / BLOCK_TITLES)).cast("int")
        return sides[side].groupBy("kind", F.col("band").alias(f"{side}c")).agg(blocks.alias(f"{side}n"))

    # a few rows per kind
    met = stored(cells("q").join(cells("c"), "kind").where(F.abs(F.col("qc") - F.col("cc")) <= BANDS_APART), "title-cells")

    def dealt(side: str, other: str) -> DataFrame:
        """Each title in its own block, once for every block it meets."""
        own = F.pmod(F.xxhash64("tid"), F.col(f"{side}n")).cast("int").alias(f"{side}b")
        theirs = F.explode(F.sequence(F.lit(0), F.col(f"{other}n") - 1)).alias(f"{other}b")
        rows = sides[side].withColumnRenamed("band", f"{side}c").join(broadcast_if_small(met), ["kind", f"{side}c"])
        # aliases keep the two sides of one table apart
        kept = [F.col(c).alias(c) for c in ("kind", "qc", "cc", "tid", "g", "age", "newest") if c in rows.columns]
        return rows.select(own, theirs, *kept)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"tid": [], "other": [], "age": [], "newest": []})
        return _block_alike(left, right, threshold, slack, enough)

    at = ["kind", "qc", "cc", "qb", "cb"]
    pairs = dealt("q", "c").groupBy(*at).cogroup(dealt("c", "q").groupBy(*at)).applyInPandas(run, _FOUND)
    first = Window.partitionBy("tid").orderBy("age", "newest")
    both = pairs.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= enough).select("tid", F.col("other").alias("other_id"))
    other = named.select(F.col("tid").alias("other_id"), F.col("title").alias("other"))
    return both.join(named.select("tid", "kind", "title"), "tid").join(other, "other_id").select("kind", "title", "other")


def find_duplicates(probes: DataFrame, entries: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(id, duplicate_id, …): up to five newest live look-alikes per probe.

    All work is on distinct titles, however many copies share one. A title needs
    only its six newest live holders, one more than is shown, because a probe
    may be among them; so a title held by a third of the store costs six rows.
    """
    named = F.col("title").isNotNull() & (F.col("title") != "") & F.col("kind").isin(DEDUPE_KINDS)
    p = probes.where(named).select("id", "kind", F.lower("title").alias("title"))
    c = entries.where(named & live()).select(
        "kind",
        F.lower("title").alias("title"),
        F.struct(
            F.col("created_at"), F.col("id"), F.col("title").alias("title"), F.col("status")
        ).alias("e"),
    )
    newest = _newest(c, ["kind", "title"])
    asked = p.select("kind", "title").distinct()
    pairs = asked.select("kind", "title", F.col("title").alias("other"))
    if fuzzy:
        known = F.when(F.col("e.created_at").isNotNull(), F.struct((-F.unix_micros("e.created_at")).alias("age"), F.col("e.id").alias("newest")))
        held = newest.groupBy("kind", "title").agg(F.min(known).alias("k")).select("kind", "title", "k.*")
        both = asked.withColumn("asked", F.lit(True)).join(held, ["kind", "title"], "full_outer")
        pairs = pairs.unionByName(similar_titles(both.withColumn("asked", F.coalesce("asked", F.lit(False)))))
    found = pairs.join(newest.select("kind", F.col("title").alias("other"), "e"), ["kind", "other"])
    ranked = _newest(found.select("kind", "title", "e"), ["kind", "title"])
    # six small structs per title ride to the probes in one list
    lists = ranked.groupBy("kind", "title").agg(F.collect_list("e").alias("es"))
    others = F.filter(F.col("es"), lambda e: e["id"] != F.col("id"))
    shown = F.slice(F.array_sort(others, _newest_first), 1, SHOWN)
    return (
        p.join(lists, ["kind", "title"])
        .select("id", "kind", F.posexplode(shown).alias("n", "d"))
        .select(
            "id", "kind", (F.col("n") + 1).alias("position"), F.col("d.id").alias("duplicate_id"),
            F.col("d.title").alias("title"), F.col("d.status").alias("status"), F.col("d.created_at").alias("created_at"),
        )
    )


def _newest(df: DataFrame, keys: list[str], n: int = SHOWN + 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("e.created_at"), "e.id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("rank")


def _newest_first(a: Column, b: Column) -> Column:
    later = F.when(a["created_at"] > b["created_at"], -1).when(a["created_at"] < b["created_at"], 1)
    return F.coalesce(later, F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1), F.lit(0))
