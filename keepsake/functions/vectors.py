"""Vector expressions: norms, distances and the deterministic word-hash embedder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepsake.functions.text import let

# fixed values: 32-bit FNV-1a
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalise(v: Column) -> Column:
    # a zero vector is divided by one and stays as it is
    def scale(s: Column) -> Column:
        return F.transform(s["v"], lambda x: x.cast("double") / s["length"])

    return let(F.struct(v.alias("v"), F.coalesce(F.nullif(norm(v), F.lit(0.0)), F.lit(1.0)).alias("length")), scale)


def fnv1a(word: Column) -> Column:
    """Unsigned 32-bit hash of an ASCII word."""
    return F.aggregate(
        F.split(word, ""),
        F.lit(FNV_OFFSET).cast("bigint"),
        lambda h, ch: (h.bitwiseXOR(F.ascii(ch).cast("bigint")) * F.lit(FNV_PRIME).cast("bigint")).bitwiseAND(
            F.lit(4294967295).cast("bigint")
        ),
    )


def word_slot(word: Column, dims: int) -> Column:
    h = fnv1a(word)
    return (F.least(h, F.lit(4294967296).cast("bigint") - h) % dims).cast("int")
