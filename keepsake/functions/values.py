"""The open document of an item: string values under string keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepsake.schema import KIND_FIELDS


def ordered_pairs(data: Column) -> Column:
    """Entries ordered by key length, then key, as stored documents are."""
    pairs = F.transform(
        F.map_entries(data),
        lambda e: F.struct(F.length(e["key"]).alias("n"), e["key"].alias("key"), e["value"].alias("value")),
    )
    return F.coalesce(F.array_sort(pairs), F.array().cast("array<struct<n:int,key:string,value:string>>"))


def values_text(data: Column) -> Column:
    kept = F.filter(ordered_pairs(data), lambda p: p["value"].isNotNull())
    return F.array_join(F.transform(kept, lambda p: p["value"]), " ")


def labelled(data: Column, separator: str, skip: tuple[str, ...] = ()) -> Column:
    """``key: value`` for every filled key, joined."""
    kept = F.filter(
        ordered_pairs(data),
        lambda p: p["value"].isNotNull() & (p["value"] != "") & ~p["key"].isin(list(skip) or [""]),
    )
    return F.array_join(F.transform(kept, lambda p: F.concat(p["key"], F.lit(": "), p["value"])), separator)


def kind_field(kind: Column, data: Column, key: str) -> Column:
    """A document value, present only for the kinds that own the field."""
    owners = [k for k, keys in KIND_FIELDS.items() if key in keys]
    return F.when(kind.isin(owners), F.try_element_at(data, F.lit(key)))


def merge(old: Column, patch: Column) -> Column:
    """Shallow merge in which a null value removes its key."""
    none = F.create_map().cast("map<string,string>")
    merged = F.map_concat(
        F.map_filter(F.coalesce(old, none), lambda k, v: ~F.array_contains(F.map_keys(F.coalesce(patch, none)), k)),
        F.coalesce(patch, none),
    )
    return F.map_filter(merged, lambda k, v: v.isNotNull())


def as_text(data: Column) -> Column:
    """A canonical one-line rendering, for comparing documents."""
    return F.array_join(F.transform(ordered_pairs(data), lambda p: F.concat(p["key"], F.lit("="), p["value"])), ";")
