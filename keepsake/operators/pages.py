"""Page jobs over a crawl table: metadata, change notes and news."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions import text
from keepsake.operators.capture import stable_id

HTML_CHARS, TITLE_CHARS, DESCRIPTION_CHARS, AUTHOR_CHARS = 250_000, 200, 500, 120
NEWS_PER_ENTRY, CITED_BY_DEFAULT, CITED_AT_MOST, RECENT_RESEARCH = 8, 3, 5, 3
SEARCH_SUFFIX = "news funding launch acquisition"
# Fixed value: how a summary says that there is nothing to tell.
NOTHING_NEW = "NOTHING_NEW"


def _meta(html: Column, *names: str) -> Column:
    """First filled meta tag of the named ones; attributes stand in either order."""
    found = []
    for name in names:
        label = rf"(?:property|name)=[\"']{name}[\"']"
        value = r"content=[\"']([^\"']*)[\"']"
        for pattern in (rf"(?i)<meta[^>]+{label}[^>]+{value}", rf"(?i)<meta[^>]+{value}[^>]+{label}"):
            found.append(text.let(F.regexp_extract(html, pattern, 1), lambda x: F.when(text.strip(x) != "", x)))
    return text.decode_entities(F.coalesce(*found))


def page_meta(pages: DataFrame) -> DataFrame:
    """(url, title, description, site, author) read from the head of each page."""
    head = pages.select("url", F.substring("html", 1, HTML_CHARS).alias("html"))
    html = F.col("html")
    in_tag = F.regexp_extract(html, r"(?i)<title[^>]*>([\s\S]{0,300}?)</title>", 1)
    raw = head.select(
        "url",
        F.coalesce(
            _meta(html, "og:title", "twitter:title"), text.let(text.decode_entities(in_tag), lambda x: F.when(x != "", x))
        ).alias("title"),
        _meta(html, "og:description", "twitter:description", "description").alias("description"),
        text.site_name(_meta(html, "og:site_name"), F.col("url")).alias("site"),
        _meta(html, "author", "article:author").alias("author"),
    )
    return raw.select(
        "url",
        F.substring(text.qualify_title(F.col("title"), F.col("site"), F.col("url")), 1, TITLE_CHARS).alias("title"),
        F.substring("description", 1, DESCRIPTION_CHARS).alias("description"),
        "site",
        F.substring("author", 1, AUTHOR_CHARS).alias("author"),
    )


def one_per_url(meta: DataFrame) -> DataFrame:
    """A crawl may hold an address twice; keep one row, the same one every time."""
    fields = F.struct("title", "description", "site", "author")
    return meta.groupBy("url").agg(F.max(fields).alias("m")).select("url", "m.*")


def page_changes(entries: DataFrame, meta: DataFrame, as_of: Column) -> DataFrame:
    """Research notes for items whose own page no longer says what was saved."""
    url = F.try_element_at("data", F.lit("url"))
    known = entries.where(url.isNotNull()).select(
        "id", "title", url.alias("url"), F.try_element_at("data", F.lit("summary")).alias("summary")
    )
    page = meta.select("url", F.col("title").alias("page_title"), F.col("description").alias("page_description"))

    def moved(now: str, before: str) -> Column:
        return (F.coalesce(F.col(now), F.lit("")) != "") & ~F.col(now).eqNullSafe(F.col(before))

    retitled, reworded = moved("page_title", "title"), moved("page_description", "summary")
    body = F.concat_ws(
        " ",
        F.lit("Its own page changed since last check."),
        F.when(retitled, F.concat(F.lit("Now titled: "), "page_title")),
        F.when(reworded, F.concat(F.lit("Now says: "), "page_description")),
    )
    return known.join(page, "url").where(retitled | reworded).select(
        stable_id(F.concat_ws("|", F.lit("research"), "id", as_of.cast("string"))).alias("id"),
        F.col("id").alias("entry_id"),
        body.alias("body"),
        as_of.alias("created_at"),
        F.lit("research").alias("source"),
    )


def checked_since() -> Column:
    return F.coalesce("last_checked_at", "occurred_at", "created_at")


def check_subject(entries: DataFrame, suffix: str = SEARCH_SUFFIX) -> DataFrame:
    """(id, subject): what to look for: the site's name, else the title, and the bare domain."""
    site = F.try_element_at("data", F.lit("source"))
    domain = text.bare_domain(F.try_element_at("data", F.lit("url")))
    parts = [F.coalesce(site, "title"), domain, F.lit(suffix)]
    return entries.select("id", F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]).alias("subject"))


def news_since(entries: DataFrame, news: DataFrame, per_entry: int = NEWS_PER_ENTRY) -> DataFrame:
    """(entry_id, rank, url, title, published): newest items on an entry's domain since it was checked.

    ``news``: domain, url, title, published. Ranking the news of a domain first
    makes this exact and small: what is new for an entry is a head of the same
    newest few, so a busy domain never meets all its entries pair by pair.
    """
    newest = Window.partitionBy("domain").orderBy(F.desc("published"), "url")
    heads = news.where(F.col("published").isNotNull()).withColumn("rank", F.row_number().over(newest))
    heads = heads.where(F.col("rank") <= per_entry).select("domain", "rank", "url", "title", "published")
    tracked = entries.select(
        F.col("id").alias("entry_id"),
        text.bare_domain(F.try_element_at("data", F.lit("url"))).alias("domain"),
        checked_since().alias("since"),
    ).where(F.col("domain").isNotNull())
    return (
        tracked.join(heads, "domain")
        .where(F.col("published") >= F.col("since"))
        .select("entry_id", "rank", "url", "title", "published")
    )


def news_notes(found: DataFrame, summaries: DataFrame, as_of: Column) -> DataFrame:
    """Research notes from summaries (entry_id, text), with the sources they used.

    Sources are the addresses a summary quotes, else the first three, at most
    five in the footer. At most eight addresses ride along per item. Summaries
    that are empty or say that nothing is new make no note.
    """
    urls = found.groupBy("entry_id").agg(F.sort_array(F.collect_list(F.struct("rank", "url"))).alias("found"))
    listed = F.transform("found", lambda x: x["url"])
    quoted = F.filter(listed, lambda u: F.contains(F.col("text"), u))
    cited = text.let(quoted, lambda q: F.when(F.size(q) > 0, q).otherwise(F.slice(listed, 1, CITED_BY_DEFAULT)))
    told = summaries.withColumn("text", text.strip_to_null(F.col("text"))).where(~F.upper("text").startswith(NOTHING_NEW))
    footer = F.concat(F.lit("\n\nSources: "), F.array_join(F.slice(cited, 1, CITED_AT_MOST), " · "))
    return told.join(urls, "entry_id").select(
        stable_id(F.concat_ws("|", F.lit("news"), "entry_id", as_of.cast("string"))).alias("id"),
        "entry_id",
        F.concat("text", footer).alias("body"),
        as_of.alias("created_at"),
        F.lit("research").alias("source"),
    )


def recent_research(notes: DataFrame) -> DataFrame:
    """(entry_id, already): what the last three research notes of each item said."""
    newest = Window.partitionBy("entry_id").orderBy(F.desc("created_at"), F.desc("id"))
    last = notes.where(F.col("source") == "research").withColumn("n", F.row_number().over(newest))
    last = last.where(F.col("n") <= RECENT_RESEARCH)
    said = F.split_part("body", F.lit("\n\nSources:"), F.lit(1))
    return last.groupBy("entry_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), said.alias("t")))), lambda x: x["t"]), "\n"
        ).alias("already")
    )
