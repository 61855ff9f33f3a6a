"""Changes to stored tables. Each operator returns the next snapshot of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions import text, values
from keepsake.schema import ENTRY_COLUMNS

UNWATCHED = {"updated_at", "last_checked_at"}


def changed(old: str, new: str, columns: list[str] = ENTRY_COLUMNS) -> Column:
    """Whether an update counts as an edit: anything but the check time moved."""
    def differs(c: str) -> Column:
        a, b = F.col(f"{old}.{c}"), F.col(f"{new}.{c}")
        if c == "data":
            a, b = values.ordered_pairs(a), values.ordered_pairs(b)
        return ~a.eqNullSafe(b)

    edited = F.lit(False)
    for c in columns:
        if c not in UNWATCHED:
            edited = edited | differs(c)
    only_checked = ~edited & differs("last_checked_at")
    return ~only_checked


def touched_at(old: str, new: str, as_of: Column) -> Column:
    return F.when(changed(old, new), as_of).otherwise(F.col(f"{old}.updated_at"))


def add_notes(notes: DataFrame, new_notes: DataFrame) -> DataFrame:
    """Append notes; blank ones are refused, an unnamed author is the owner."""
    kept = new_notes.select(
        "id",
        "entry_id",
        text.strip_to_null(F.col("body")).alias("body"),
        "created_at",
        F.coalesce(text.strip_to_null(F.col("source")), F.lit("me")).alias("source"),
    ).where(F.col("body").isNotNull())
    return notes.unionByName(kept)


def touch_parents(entries: DataFrame, new_notes: DataFrame, as_of: Column) -> DataFrame:
    """A note counts as an edit of its item."""
    parents = new_notes.where(text.strip_to_null(F.col("body")).isNotNull()).select(F.col("entry_id").alias("id"))
    noted = parents.distinct().withColumn("noted", F.lit(True))
    return (
        entries.join(noted, "id", "left")
        .withColumn("updated_at", F.when(F.col("noted"), as_of).otherwise(F.col("updated_at")))
        .select(entries.columns)
    )


def upsert_links(links: DataFrame, new_links: DataFrame) -> DataFrame:
    """Unique (from, to, rel); an existing link survives, self links are refused.

    The earliest row per key is taken by an aggregate, which combines in the
    map tasks, so a pair linked millions of times costs nothing extra.
    """
    blank_rel = F.coalesce(text.strip_to_null(F.col("rel")), F.lit("related"))
    fresh = new_links.withColumn("rel", blank_rel).where(F.col("from_id") != F.col("to_id"))
    both = links.select(F.lit(0).alias("gen"), "id", "from_id", "to_id", "rel", "created_at").unionByName(
        fresh.select(F.lit(1).alias("gen"), "id", "from_id", "to_id", "rel", "created_at")
    )
    return (
        both.groupBy("from_id", "to_id", "rel")
        .agg(F.min(F.struct("gen", "created_at", "id")).alias("first"))
        .select("first.id", "from_id", "to_id", "rel", F.col("first.created_at").alias("created_at"))
    )


def delete_entries(ids: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Remove items with all that hangs on them.

    ``tables`` may hold entries, notes, links and vectors; each comes back
    without the rows of the deleted ids.
    """
    gone = ids.select("id").distinct()
    keys = {"entries": ["id"], "notes": ["entry_id"], "links": ["from_id", "to_id"], "vectors": ["entry_id"]}
    out = {}
    for name, df in tables.items():
        for key in keys[name]:
            df = df.join(gone.withColumnRenamed("id", key), key, "left_anti").select(df.columns)
        out[name] = df
    return out


def set_to(value: Column) -> Column:
    """A patch field: what to set, which may be null. An absent field stays null itself."""
    return F.struct(value.alias("value"))


SETTABLE = ["title", "body", "status", "rating", "occurred_at", "remind_at"]


def check_patches(patches: DataFrame) -> DataFrame:
    """Refuse patches that both replace and extend the tags, and two patches for one id."""
    patches = patches.where(F.col("id").isNotNull())
    repeated = F.count(F.lit(1)).over(Window.partitionBy("id")) > 1
    both = F.col("tags").isNotNull() & (F.size(F.coalesce("add_tags", F.array().cast("array<string>"))) > 0)
    return patches.withColumn(
        "id",
        F.when(both, F.raise_error(F.lit("a patch cannot hold both tags and add_tags")))
        .when(repeated, F.raise_error(F.lit("one id has several patches")))
        .otherwise(F.col("id")),
    )


def fold_patches(patches: DataFrame) -> DataFrame:
    """One patch per id that does what its patches (with ``seq``) do one after another.

    Fields and document keys take their last setting; tags their last replacement and what was added after it.
    Everything is an aggregate, so an id patched millions of times is combined where its patches are read.
    """
    rows = patches.where(F.col("id").isNotNull())
    plain = [c for c in [*SETTABLE, "kind", "archived"] if c in patches.columns]
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in plain]
    replaced = F.max(F.when(F.col("tags").isNotNull(), F.col("seq"))).alias("replaced")
    fields = rows.groupBy("id").agg(*last, replaced, F.max_by("tags", F.when(F.col("tags").isNotNull(), F.col("seq"))).alias("tags"))

    added = rows.where(F.size(F.coalesce("add_tags", F.array().cast("array<string>"))) > 0).select("id", "seq", "add_tags")
    later = added.join(fields.select("id", "replaced"), "id").where(F.col("replaced").isNull() | (F.col("seq") > F.col("replaced")))
    adds = later.select("id", F.explode("add_tags").alias("tag")).groupBy("id").agg(F.collect_set("tag").alias("adds"))

    keys = rows.where(F.col("data").isNotNull()).select("id", "seq", F.explode("data").alias("key", "value"))
    # a null value is a setting too, so it rides in a struct
    settings = keys.groupBy("id", "key").agg(F.max_by(F.struct("value"), "seq").alias("v"))
    data = settings.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "v.value"))).alias("data"))

    out = fields.join(adds, "id", "left").join(data, "id", "left")
    both = F.array_sort(F.array_union(text.clean_tags(F.col("tags")), text.clean_tags(F.col("adds"))))
    return out.select(
        "id", *plain, F.when(F.col("adds").isNull(), F.col("tags")).when(F.col("tags").isNotNull(), both).alias("tags"),
        F.when(F.col("tags").isNull(), F.col("adds")).alias("add_tags"), "data",
    )


def apply_updates(entries: DataFrame, patches: DataFrame, as_of: Column) -> DataFrame:
    """The item table after partial updates.

    ``patches``: id, kind, data, tags, add_tags, archived, and for each settable
    column a one-field struct ``{value}`` whose absence leaves the column alone.
    Several patches for one id are refused: they would multiply the item; ``fold_patches`` makes one of them.
    """
    p = check_patches(patches)
    p = p.select(F.col("id").alias("pid"), *[F.col(c).alias(f"p_{c}") for c in p.columns if c != "id"])
    e = entries.join(p, entries["id"] == p["pid"], "left")
    added = text.clean_tags(F.col("p_add_tags"))
    tags = (
        F.when(F.col("p_tags").isNotNull(), text.clean_tags(F.col("p_tags")))
        .when(F.size(F.coalesce("p_add_tags", F.array().cast("array<string>"))) > 0, F.array_sort(F.array_union("tags", added)))
        .otherwise(F.col("tags"))
    )
    new = {c: F.when(F.col(f"p_{c}").isNotNull(), F.col(f"p_{c}.value")).otherwise(F.col(c)) for c in SETTABLE}
    new["kind"] = F.when(F.col("p_kind").isNotNull(), text.normalize_kind(F.col("p_kind"))).otherwise(F.col("kind"))
    new["tags"] = tags
    new["data"] = F.when(F.col("p_data").isNotNull(), values.merge(F.col("data"), F.col("p_data"))).otherwise(F.col("data"))
    new["archived_at"] = (
        F.when(F.col("p_archived"), as_of)
        .when(~F.col("p_archived"), F.lit(None).cast("timestamp"))
        .otherwise(F.col("archived_at"))
    )
    # a patch that names no field is no update at all
    names = [F.col(f"p_{c}").isNotNull() for c in SETTABLE + ["kind", "tags", "data", "archived"]]
    names.append(F.size(F.coalesce("p_add_tags", F.array().cast("array<string>"))) > 0)
    any_field = F.lit(False)
    for n in names:
        any_field = any_field | n
    new["updated_at"] = F.when(F.coalesce(any_field, F.lit(False)), as_of).otherwise(F.col("updated_at"))
    return e.select(*[new.get(c, F.col(c)).alias(c) for c in entries.columns])


def mark_checked(entries: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """Stamp the check time; the edit time stays."""
    seen = ids.select("id").distinct().withColumn("seen", F.lit(True))
    return (
        entries.join(seen, "id", "left")
        .withColumn("last_checked_at", F.when(F.col("seen"), as_of).otherwise(F.col("last_checked_at")))
        .select(entries.columns)
    )
