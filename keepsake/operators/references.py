"""From what a person types to the item they mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions import text
from keepsake.operators.filters import live
from keepsake.session import broadcast_if_small, each

FULL_ID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
ID_PREFIX = "(?i)^[0-9a-f]{4,}$"
OPTIONS = 5
# ids hold a hyphen after eight digits, so longer runs of digits match none
SHORTEST, LONGEST = 4, 8


def resolve(refs: DataFrame, entries: DataFrame) -> DataFrame:
    """(ref_id, ref, status, id, options) for each reference.

    A full id stands for itself, four or more hex digits are an id prefix, and
    anything else is an exact title of a live item. Status is ok, none or
    ambiguous; the first five candidates are listed when ambiguous.
    """
    r = refs.select("ref_id", "ref", text.strip_to_null(F.col("ref")).alias("r"))
    r = r.withColumn(
        "form",
        F.when(F.col("r").isNull(), "blank")
        .when(F.col("r").rlike(FULL_ID), "id")
        .when(F.col("r").rlike(ID_PREFIX), "prefix")
        .otherwise("title"),
    )
    keyed = r.select("ref_id", "form", F.lower("r").alias("key"))
    wanted = keyed.where("form IN ('prefix', 'title')").select("form", "key").distinct()
    found = _holders(wanted, entries)
    shown = F.concat(F.substring("id", 1, 8), F.lit(" ("), F.coalesce("title", F.lit("untitled")), F.lit(")"))
    # five rows a key at most, whatever the number of references to it
    lists = found.groupBy("form", "key").agg(
        F.count("*").alias("hits"), F.min_by("id", "n").alias("hit"), F.sort_array(F.collect_list(F.struct("n", shown.alias("o")))).alias("options")
    )
    candidates = keyed.join(lists, ["form", "key"]).select("ref_id", "hits", "hit", "options")
    status = (
        F.when(F.col("form") == "blank", "none")
        .when(F.col("form") == "id", "ok")
        .when(F.col("hits").isNull(), "none")
        .when(F.col("hits") > 1, "ambiguous")
        .otherwise("ok")
    )
    return (
        r.join(candidates, "ref_id", "left")
        .withColumn("status", status)
        .select(
            "ref_id",
            "ref",
            "status",
            F.when(F.col("form") == "id", F.lower("r")).when(F.col("status") == "ok", F.col("hit")).alias("id"),
            F.when(F.col("status") == "ambiguous", F.array_join(F.transform("options", lambda o: o["o"]), ", ")).alias("options"),
        )
    )


def _holders(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """(form, key, id, title, n): the five first holders of each wanted key.

    Keys meet the store once each, and a map task keeps five holders a key, so a title
    that a third of the store holds, asked for by many, costs five rows a task.
    """
    lengths = F.sequence(F.lit(SHORTEST), F.lit(LONGEST))
    # each id is spelt out in its possible prefixes, which makes this an equality join
    prefixes = F.transform(lengths, lambda n: F.struct(F.lit("prefix").alias("form"), F.substr("id", F.lit(1), n).alias("key"), F.lit(0).cast("long").alias("age")))
    named = F.struct(F.lit("title").alias("form"), F.lower("title").alias("key"), (-F.unix_micros("created_at")).alias("age"))
    keys = F.concat(prefixes, F.when(live() & F.col("title").isNotNull(), F.array(named)).otherwise(F.array().cast("array<struct<form:string,key:string,age:bigint>>")))
    offered = each(entries, keys, "k", "id", "title").select("id", "title", "k.*").join(broadcast_if_small(wanted), ["form", "key"])
    first = Window.partitionBy("form", "key").orderBy("age", "id")
    return offered.withColumn("n", F.row_number().over(first)).where(F.col("n") <= OPTIONS).select("form", "key", "id", "title", "n")
