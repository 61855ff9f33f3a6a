"""Listings and resurfacing views: filter, order, take the top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions import shelves, text
from keepsake.operators.filters import EntryFilter, engaged, happened_at, live, page_size, still_open
from keepsake.schema import LIST_MAX, PROMPTS_MAX, QUEUE_MAX, UNTOUCHED_STATUSES
from keepsake.session import each


def _top(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Sort and cut; the id settles ties so a page is the same on every run."""
    ordered = df.orderBy(*order, F.col("id"))
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def list_entries(entries: DataFrame, filters: EntryFilter = EntryFilter()) -> DataFrame:
    return _top(filters.apply(entries), [happened_at().desc()], filters.size, max(0, filters.offset))


def by_ids(entries: DataFrame, ids: DataFrame, filters: EntryFilter = EntryFilter()) -> DataFrame:
    return filters.apply(entries).join(ids.select("id"), "id", "left_semi")


def due(entries: DataFrame, as_of: Column, within_days: int = 0, limit: int = 50) -> DataFrame:
    return _top(entries.where(live() & is_due(as_of, within_days)), [F.col("remind_at").asc()], page_size(limit))


def is_due(as_of: Column, within_days: int) -> Column:
    return F.col("remind_at") <= as_of + F.make_dt_interval(F.lit(max(0, within_days)))


def open_items(entries: DataFrame, kind: str, limit: int = 50) -> DataFrame:
    wanted = F.col("kind") == text.normalize_kind(F.lit(kind))
    return _top(entries.where(wanted & live() & still_open()), [happened_at().desc()], page_size(limit))


def watchlist(entries: DataFrame, view: str = "want") -> DataFrame:
    if view == "want":
        return open_items(entries, "movie", LIST_MAX)
    status = "watched" if view == "watched" else None
    return list_entries(entries, EntryFilter(kind="movie", status=status, limit=LIST_MAX))


def recently_engaged(entries: DataFrame, limit: int = 50) -> DataFrame:
    last = F.greatest(F.col("updated_at"), happened_at())
    return _top(entries.where(live() & engaged()), [last.desc()], page_size(limit))


def unfiled(entries: DataFrame, limit: int = 50) -> DataFrame:
    untagged = F.size(shelves.tag_list(F.col("tags"))) == 0
    return _top(entries.where(live() & untagged & engaged()), [F.col("created_at").desc()], page_size(limit))


def untouched_imports(entries: DataFrame, limit: int = 8) -> DataFrame:
    kept = live() & F.col("status").isin(UNTOUCHED_STATUSES)
    return _top(entries.where(kept), [happened_at().desc()], page_size(limit))


def check_queue(entries: DataFrame, shelf: str, limit: int = 25) -> DataFrame:
    """Items under a shelf, never-checked first, then the longest unchecked."""
    name = F.regexp_replace(F.lower(text.strip(F.lit(shelf))), "^#", "")
    kept = entries.where(live() & shelves.on_shelf(F.col("tags"), name))
    order = [F.col("last_checked_at").asc_nulls_first(), F.col("created_at").desc()]
    return _top(kept, order, min(limit, QUEUE_MAX))


def recent_prompts(prompts: DataFrame, limit: int = 50, surface: str | None = None) -> DataFrame:
    kept = prompts.where(F.col("surface") == surface) if surface else prompts
    return _top(kept, [F.col("at").desc()], min(limit, PROMPTS_MAX))


def briefing(entries: DataFrame, as_of: Column) -> DataFrame:
    """The orientation digest: each section's top rows, labelled and ranked.

    One scan: an item is offered to every section that takes it, with that section's order as one
    ascending number, and a section keeps its first rows while the store is read.
    """
    recent = -F.unix_micros(F.greatest(F.col("updated_at"), happened_at()))
    newest = -F.unix_micros(happened_at())
    sections = [
        ("due", 10, is_due(as_of, 0), F.unix_micros("remind_at")),
        ("recent", 10, engaged(), recent),
        ("watchlist", 8, (F.col("kind") == "movie") & still_open(), newest),
        ("open_tasks", 10, (F.col("kind") == "task") & still_open(), newest),
        ("recent_people", 5, F.col("kind") == "person", newest),
        ("collected", 6, F.col("status").isin(UNTOUCHED_STATUSES), newest),
    ]
    places = [
        F.when(taken, F.struct(F.lit(name).alias("section"), F.lit(size).alias("size"), order.alias("key"))) for name, size, taken, order in sections
    ]
    offered = each(entries.where(live()), F.filter(F.array(*places), lambda p: p.isNotNull()), "s", "id", "kind", "title", "status")
    first = Window.partitionBy("section").orderBy("key", "id")
    ranked = offered.select("s.*", "id", "kind", "title", "status").withColumn("position", F.row_number().over(first))
    kept = ranked.where(F.col("position") <= max(size for _, size, _, _ in sections)).where(F.col("position") <= F.col("size"))
    return kept.select("section", "position", "id", "kind", "title", "status")
