"""The composable item filter every listing and recall operator shares."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions import shelves, text
from keepsake.schema import DONE_STATUSES, LIST_DEFAULT, LIST_MAX, UNTOUCHED_STATUSES


def page_size(limit: int | None) -> int:
    return LIST_DEFAULT if not limit or limit < 1 else min(limit, LIST_MAX)


def live() -> Column:
    return F.col("archived_at").isNull()


def happened_at() -> Column:
    """When the thing happened, else when it was saved."""
    return F.coalesce("occurred_at", "created_at")


def still_open() -> Column:
    return F.col("status").isNull() | ~F.col("status").isin(DONE_STATUSES)


def engaged() -> Column:
    return F.col("status").isNull() | ~F.col("status").isin(UNTOUCHED_STATUSES)


@dataclass(frozen=True)
class EntryFilter:
    kind: str | None = None
    kinds: list[str] = field(default_factory=list)
    status: str | None = None
    tags: list[str] = field(default_factory=list)
    tags_mode: str = "all"
    since: str | None = None
    until: str | None = None
    include_archived: bool = False
    limit: int | None = None
    offset: int = 0

    @property
    def size(self) -> int:
        return page_size(self.limit)

    def condition(self) -> Column:
        """All predicates as one conjunction, so scans can push them down."""
        parts = [] if self.include_archived else [live()]
        kinds = list(self.kinds) or ([self.kind] if self.kind else [])
        if kinds:
            parts.append(F.col("kind").isin([_kind(k) for k in kinds]))
        if self.status:
            parts.append(F.col("status") == self.status.strip())
        wanted = _tags(self.tags)
        if wanted:
            hits = [shelves.on_shelf(F.col("tags"), t) for t in wanted]
            parts.append(reduce(lambda a, b: a | b if self.tags_mode == "any" else a & b, hits))
        if self.since:
            parts.append(F.col("created_at") >= F.lit(self.since).cast("timestamp"))
        if self.until:
            parts.append(F.col("created_at") <= F.lit(self.until).cast("timestamp"))
        return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)

    def apply(self, entries: DataFrame) -> DataFrame:
        return entries.where(self.condition())


def _kind(kind: str) -> Column:
    return text.normalize_kind(F.lit(kind))


def _tags(tags: list[str]) -> list[Column]:
    """Shelf names the caller typed, put in normal form by the same rule as stored ones."""
    return [text.clean_tag(F.lit(t)) for t in tags if t.strip().lstrip("#").strip("/ ")]
