"""Shelf paths: ``ai/harness`` sits under ``ai``; hyphens are literal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag_list(tags: Column) -> Column:
    return F.coalesce(tags, F.array().cast("array<string>"))


def under(tag: Column, shelf: Column) -> Column:
    """The shelf itself or anything below it."""
    return (tag == shelf) | F.startswith(tag, F.concat(shelf, F.lit("/")))


def on_shelf(tags: Column, shelf: Column | str) -> Column:
    shelf = F.lit(shelf) if isinstance(shelf, str) else shelf
    return F.exists(tag_list(tags), lambda t: under(t, shelf))


def paths(tag: Column) -> Column:
    """Every level of a path: a, a/b, a/b/c."""
    parts = F.split(tag, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
    )


def nodes(tags: Column) -> Column:
    """Distinct shelves an item counts toward, ancestors included."""
    found = F.array_distinct(F.flatten(F.transform(tag_list(tags), paths)))
    return F.filter(found, lambda n: n != "")


def renamed(tags: Column, old: Column, new: Column) -> Column:
    def one(t: Column) -> Column:
        moved = F.concat(new, F.substr(t, F.length(old) + 1))
        return F.when(t == old, new).when(F.startswith(t, F.concat(old, F.lit("/"))), moved).otherwise(t)

    return F.array_sort(F.array_distinct(F.transform(tag_list(tags), one)))
