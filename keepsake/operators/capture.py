"""Capture: normalise requests, keep retries from storing anything twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions import text
from keepsake.schema import ENTRY_COLUMNS, EXTRACTION


def _string_map() -> Column:
    return F.create_map().cast("map<string,string>")


def stable_id(key: Column) -> Column:
    """An id derived from a key, so a rerun of a lost task writes the same row."""
    h = F.sha2(key, 256)
    return F.concat_ws("-", *[F.substring(h, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def normalise(requests: DataFrame, enrich: bool = True, pages: DataFrame | None = None) -> DataFrame:
    """Requests in stored form; those with no title, body or link are left out.

    With ``enrich`` a link is promoted into the document and its page, looked up
    in ``pages`` (url, title, description, site, author), names the item unless
    the caller chose a telling title. Without ``pages`` the link names itself.
    """
    none = F.array().cast("array<string>")
    body = text.strip_to_null(F.col("body"))
    r = (
        requests.withColumn("capture_id", text.strip_to_null(F.col("capture_id")))
        .withColumn("kind", text.normalize_kind(F.col("kind")))
        .withColumn("data", F.coalesce("data", _string_map()))
        .withColumn("given_title", text.strip_to_null(F.col("title")))
        .withColumn("tags", text.clean_tags(F.concat(F.coalesce("tags", none), text.hashtags(body))))
        .withColumn("body", text.without_hashtags(body))
        .withColumn("title", F.coalesce("given_title", text.derive_title(F.col("body"))))
        .withColumn("url", text.extract_url(F.try_element_at("data", F.lit("url")), F.col("body"), F.col("title")))
    )
    # a title or link can only come from these; testing the sources keeps the
    # pushed-down filter from repeating every expression above
    given_url = text.extract_url(F.try_element_at("data", F.lit("url")))
    r = r.where(F.col("given_title").isNotNull() | F.col("body").isNotNull() | given_url.isNotNull())
    if enrich:
        r = _enrich(r, pages)
    return r.withColumn("status", text.status_or_default(F.col("status"), F.col("kind"))).drop("given_title", "url")


def _enrich(r: DataFrame, pages: DataFrame | None) -> DataFrame:
    has_url = F.col("url").isNotNull()
    keep_title = F.col("given_title").isNotNull() & ~text.is_weak_title(F.col("given_title"), F.col("tags"))
    fields = ("title", "description", "site", "author")
    blank = [F.lit(None).cast("string").alias(f"page_{c}") for c in fields]
    if pages is None:
        r = r.select("*", *blank)
    else:
        # A page is one row per address, so the join cannot multiply requests.
        # Requests without a link stay out of it: their nulls would all meet in one task.
        meta = pages.select(F.col("url"), *[F.col(c).alias(f"page_{c}") for c in fields])
        linked = r.where(has_url).join(meta, "url", "left")
        r = linked.unionByName(r.where(~has_url).select("*", *blank))
    fetched = ~keep_title | (F.coalesce(F.try_element_at("data", F.lit("summary")), F.lit("")) == "")

    def page(c: str) -> Column:
        return F.when(has_url & fetched, F.nullif(F.col(f"page_{c}"), F.lit("")))

    added = F.map_filter(
        F.create_map(
            F.lit("url"), F.col("url"), F.lit("summary"), page("description"),
            F.lit("source"), page("site"), F.lit("author"), page("author"),
        ),
        # the address always replaces what was given; the rest only fills gaps
        lambda k, v: v.isNotNull() & ((k == "url") | (F.coalesce(F.try_element_at("data", k), F.lit("")) == "")),
    )
    kept = F.map_filter("data", lambda k, v: ~F.array_contains(F.map_keys(added), k))
    named = F.when(~keep_title, page("title"))
    return (
        r.withColumn("title", F.coalesce(named, F.col("title"), text.title_from_url(F.col("url")), F.col("url")))
        .withColumn("data", F.when(has_url, F.map_concat(kept, added)).otherwise(F.col("data")))
        .withColumn("kind", F.when(has_url & (F.col("kind") == "thought"), "reading").otherwise(F.col("kind")))
        .withColumn("body", F.when(has_url & text.is_url_only(F.col("body")), None).otherwise(F.col("body")))
        .drop("page_title", "page_description", "page_site", "page_author")
    )


def _with_id(requests: DataFrame) -> DataFrame:
    return requests.withColumn("capture_id", text.strip_to_null(F.col("capture_id")))


def first_writers(requests: DataFrame, order: str = "seq") -> DataFrame:
    """One request per capture id, the earliest. All rows here carry an id.

    The rank filter lets Spark drop later retries inside each map task, so a
    device that resent one id millions of times ships a row per task.
    """
    w = Window.partitionBy("capture_id").orderBy(order)
    return requests.withColumn("turn", F.row_number().over(w)).where("turn = 1").drop("turn")


def _stored_ids(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("capture_id").isNotNull()).select("capture_id", F.col("id").alias("stored_id"))


def ids_asked(requests: DataFrame) -> DataFrame:
    """The capture ids a batch of requests carries."""
    return _with_id(requests).where(F.col("capture_id").isNotNull()).select("capture_id").distinct()


def to_store(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Requests that are neither retries within the batch nor replays of stored ids.

    Runs before normalisation and enrichment, so a batch of retries stays cheap.
    Requests without an id never collide; they skip the window and the join.
    """
    r = _with_id(requests)
    keyed = r.where(F.col("capture_id").isNotNull())
    fresh = first_writers(keyed).join(_stored_ids(entries), "capture_id", "left_anti")
    return fresh.unionByName(r.where(F.col("capture_id").isNull()))


def capture(
    requests: DataFrame, entries: DataFrame, enrich: bool = True, pages: DataFrame | None = None
) -> DataFrame:
    """New items for a batch of requests; retries of known ids yield none.

    ``requests``: seq, capture_id, kind, title, body, data, tags, status, rating,
    occurred_at, remind_at, source, requested_at. Nothing stored is changed, and of
    ``entries`` only id and capture_id are read.
    """
    rows = normalise(to_store(requests, entries), enrich, pages)
    key = F.coalesce("capture_id", F.concat(F.lit("request:"), F.col("seq").cast("string")))
    none = F.lit(None).cast("timestamp")
    return (
        rows.withColumn("id", stable_id(key))
        .withColumn("source", F.coalesce("source", F.lit("api")))
        .withColumn("archived_at", none)
        .withColumn("last_checked_at", none)
        .withColumn("created_at", F.col("requested_at"))
        .withColumn("updated_at", F.col("requested_at"))
        .select("seq", *ENTRY_COLUMNS)
    )


def outcomes(requests: DataFrame, entries: DataFrame, created: DataFrame) -> DataFrame:
    """For each request the item it stands for, and whether this request made it."""
    r = _with_id(requests.select("seq", "capture_id"))
    made = created.select(F.col("seq").alias("made_by"), "capture_id", F.col("id").alias("new_id"))
    unkeyed = r.where(F.col("capture_id").isNull()).join(
        made.where(F.col("capture_id").isNull()).select(F.col("made_by").alias("seq"), "new_id"), "seq"
    )
    keyed = (
        r.where(F.col("capture_id").isNotNull())
        .join(_stored_ids(entries), "capture_id", "left")
        .join(made.where(F.col("capture_id").isNotNull()), "capture_id", "left")
        .where(F.coalesce("stored_id", "new_id").isNotNull())
    )
    return unkeyed.select("seq", F.col("new_id").alias("id"), F.lit(True).alias("created")).unionByName(
        keyed.select(
            "seq",
            F.coalesce("stored_id", "new_id").alias("id"),
            (F.col("stored_id").isNull() & (F.col("seq") == F.col("made_by"))).alias("created"),
        )
    )


def explode_jots(jots: DataFrame) -> DataFrame:
    """Free-text dumps and their extracted JSON, as one request per part.

    Parts are numbered in the capture id, so a retried dump lands on the same
    rows. A dump nothing was extracted from is kept word for word.
    """
    none = F.array().cast("array<string>")
    typed = text.hashtags(F.col("text"))
    parts = (
        jots.withColumn("clean", text.without_hashtags(F.col("text")))
        .where(F.col("clean").isNotNull())
        .withColumn("typed", typed)
        .withColumn("entries", F.from_json("extracted", EXTRACTION)["entries"])
        .select("*", F.posexplode_outer("entries").alias("pos", "e"))
    )
    verbatim = F.col("e").isNull()
    pairs = F.filter(F.col("e.data"), lambda p: (p["key"] != "") & (p["value"] != ""))
    # a repeated key takes its last value
    last = F.filter(
        F.transform(pairs, lambda p, i: F.struct(i.alias("i"), p["key"].alias("key"), p["value"].alias("value"))),
        lambda p: ~F.exists(F.slice(pairs, p["i"] + 2, F.size(pairs)), lambda later: later["key"] == p["key"]),
    )
    return parts.select(
        F.concat("capture_id", F.lit("#"), F.coalesce("pos", F.lit(0)).cast("string")).alias("capture_id"),
        F.when(verbatim, "thought").otherwise(F.col("e.kind")).alias("kind"),
        F.col("e.title").alias("title"),
        F.when(verbatim, F.col("clean")).otherwise(F.col("e.body")).alias("body"),
        F.coalesce(
            F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"]))), _string_map()
        ).alias("data"),
        F.concat(F.coalesce("e.tags", none), "typed").alias("tags"),
        F.col("e.status").alias("status"),
        F.col("e.rating").alias("rating"),
        F.try_to_timestamp("e.occurred_at").alias("occurred_at"),
        F.try_to_timestamp("e.remind_at").alias("remind_at"),
        "source",
        "requested_at",
    )


def store(entries: DataFrame, created: DataFrame) -> DataFrame:
    """The next snapshot of the item table."""
    return entries.select(ENTRY_COLUMNS).unionByName(created.select(ENTRY_COLUMNS))
