"""Page jobs and the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.functions import text, values
from keepsake.functions.text import iso
from keepsake.operators import capture as cap
from keepsake.operators import pages as pg
from keepsake.plans import oracle_text as o
from keepsake.plans.ingest import FRESH, REQUESTS, SID, steps
from keepsake.plans.oracle_tables import at
from keepsake.plans.registry import query
from keepsake.session import state_dir
from keepsake.sources import bindings as b
from keepsake.sources import imports
from keepsake.streaming import capture as capture_stream
from keepsake.streaming import imports as import_stream
from keepsake.streaming import prompts as prompt_stream

META = f"""
select page_id, url, substring({o.qualified('t', o.site('null::varchar', 'url'), 'url')}, 1, 200) as title, {o.site('null::varchar', 'url')} as site
from (select page_id, url, nullif({o.decoded("regexp_extract(html, '(?i)<title[^>]*>([^<]{0,300}?)</title>', 1)")}, '') as t from pages)"""


@query("page_meta", "select url, title, null::varchar as description, site, null::varchar as author from meta", meta=META)
def _(spark, sf):
    return pg.page_meta(b.pages(spark, sf))


TAGGED = f"""
select page_id, url, substring({o.qualified('t', o.site('s', 'url'), 'url')}, 1, 200) as title, {o.site('s', 'url')} as site, description, author
from (select page_id, url, case when page_id % 5 = 0 then 'OG ' || page_id || ' & co' when page_id % 5 = 1 then 'Tw ' || page_id
      else nullif({o.decoded("regexp_extract(html, '(?i)<title[^>]*>([^<]{0,300}?)</title>', 1)")}, '') end as t,
    case when page_id % 4 = 0 then 'Site ' || page_id % 7 end as s,
    case page_id % 6 when 0 then 'Og says ' || page_id || '!' when 1 then 'Bird ' || page_id when 3 then 'Plain words of ' || page_id end as description,
    case when page_id % 2 = 0 then 'Author ' || page_id % 11 when page_id % 3 = 1 then 'Writer ' || page_id end as author from pages)"""


@query("page_meta_tags", "select url, title, description, site, author from tagged", tagged=TAGGED)
def _(spark, sf):
    """All five columns from pages that carry meta tags."""
    return pg.page_meta(b.tagged_pages(spark, sf))


def _link_requests(spark, sf):
    """Documents that save a crawled page; some with a title of their own, some filed under a shelf's name."""
    p = b.pages(spark, sf)
    n = p.count()
    d = F.col("doc_id")
    docs = b.documents(spark, sf).withColumn("page_id", d % n).join(p.select("page_id", "url"), "page_id")
    none = F.lit(None)
    return docs.select(
        d.alias("seq"),
        none.cast("string").alias("capture_id"),
        F.lit("thought").alias("kind"),
        F.when(d % 3 == 0, b.first_line_title(F.col("text"))).when(d % 3 == 1, F.upper("source")).alias("title"),
        F.when(d % 2 == 0, F.concat(F.lit("My take "), "url")).otherwise(F.col("url")).alias("body"),
        F.when(d % 5 == 0, F.create_map(F.lit("source"), F.col("lang"))).alias("data"),
        F.array("source").alias("tags"),
        none.cast("string").alias("status"),
        none.cast("int").alias("rating"),
        none.cast("timestamp").alias("occurred_at"),
        none.cast("timestamp").alias("remind_at"),
        F.lit("api").alias("source"),
        b.as_of().alias("requested_at"),
    )


@query(
    "enrich_captures",
    f"""select doc_id as seq, 'reading' as kind, 'queued' as status,
          case when doc_id % 3 = 0 and not {o.weak('own', '[source]')} then {o.strip('own')} else m.title end as title,
          case when doc_id % 2 = 0 then 'My take ' || l.url end as body,
          concat('url=', l.link, ';source=', case when doc_id % 5 = 0 then lang else m.site end) as data
        from (select d.*, m.url, {o.url('m.url')} as link, split_part(text, chr(10), 1) as own
          from documents d join pages m on m.page_id = d.doc_id % (select count(*) from pages)) l
        left join (select url, max(title) as title, max(site) as site from meta group by 1) m on m.url = l.link""",
    meta=META,
)
def _(spark, sf):
    meta = pg.one_per_url(pg.page_meta(b.pages(spark, sf)))
    return cap.normalise(_link_requests(spark, sf), pages=meta).select(
        "seq", "kind", "status", "title", "body", values.as_text(F.col("data")).alias("data")
    )


LINKED = f"""
select e.*, p.url, case when p.url is not null and e.doc_id % 2 = 0
    then regexp_replace(trim(replace(regexp_extract(p.html, '<title>([^<]*)</title>', 1), '&amp;', '&')), '\\s+', ' ', 'g')
    when p.url is not null then 'stale title' else e.title end as kept_title
from entries e left join pages p on e.kind = 'reading' and p.page_id = e.doc_id % (select count(*) from pages)"""


@query(
    "page_changes",
    """select l.id as entry_id, 'Its own page changed since last check. Now titled: ' || m.title as body, 'research' as source
       from linked_entries l join (select url, max(title) as title from meta group by 1) m on m.url = l.url where m.title <> l.kept_title""",
    meta=META, linked_entries=LINKED,
)
def _(spark, sf):
    meta = pg.one_per_url(pg.page_meta(b.pages(spark, sf)))
    return pg.page_changes(b.linked_entries(spark, sf), meta, b.as_of()).select("entry_id", "body", "source")


@query(
    "page_changes_worded",
    """select id as entry_id, concat_ws(' ', 'Its own page changed since last check.', case when retitled then 'Now titled: ' || title end,
         case when description is not null then 'Now says: ' || description end) as body
       from (select l.id, m.title, m.description, coalesce(m.title, '') <> '' and m.title is distinct from l.kept_title as retitled
         from linked_entries l join (select * from tagged qualify row_number() over (partition by url order by title desc nulls last,
           description desc nulls last, site desc nulls last, author desc nulls last) = 1) m on m.url = l.url)
       where retitled or description is not null""",
    tagged=TAGGED, linked_entries=LINKED,
)
def _(spark, sf):
    """Titles and descriptions that moved, from pages with meta tags."""
    meta = pg.one_per_url(pg.page_meta(b.tagged_pages(spark, sf)))
    return pg.page_changes(b.linked_entries(spark, sf), meta, b.as_of()).select("entry_id", "body")


@query(
    "check_subject",
    f"select id, concat_ws(' ', data_source, {o.domain('url')}, 'news funding launch acquisition') as subject from linked_entries",
    linked_entries=LINKED,
)
def _(spark, sf):
    return pg.check_subject(b.linked_entries(spark, sf))


def _news(spark, sf):
    """Pages read as published articles."""
    p = F.col("page_id")
    return b.pages(spark, sf).select(
        text.bare_domain(F.col("url")).alias("domain"), "url",
        F.concat(F.lit("Article "), p.cast("string")).alias("title"), b.at(b.JAN_01, (p * 977) % 43200).alias("published"),
    )


NEWS = f"select {o.domain('url')} as domain, url, 'Article ' || page_id as title, {at('2024-01-01', '(page_id * 977) % 43200')} as published from pages"
FOUND = f"""
select entry_id, n, url, title, published from (
  select l.id as entry_id, l.last_checked_at, w.url, w.title, w.published, row_number() over (partition by l.id order by w.published desc, w.url) as n
  from linked_entries l join news w on w.domain = {o.domain('l.url')}
  where w.published >= coalesce(l.last_checked_at, l.occurred_at, l.created_at)) where n <= 8"""


@query(
    "news_since",
    "select entry_id, n as rank, url, title, strftime(published, '%Y-%m-%dT%H:%M:%S.%fZ') as published from found",
    linked_entries=LINKED, news=NEWS, found=FOUND,
)
def _(spark, sf):
    out = pg.news_since(b.linked_entries(spark, sf), _news(spark, sf))
    return out.select("entry_id", F.col("rank").cast("bigint").alias("rank"), "url", "title", iso(F.col("published")).alias("published"))


@query(
    "news_notes",
    """select entry_id, case when max(title) filter (where n = 1) like '%3' then 'See ' || max(url) filter (where n = 1) || ' now' || chr(10) || chr(10) || 'Sources: ' || string_agg(url, ' · ' order by n)
           filter (where n <= 5 and contains('See ' || u1 || ' now', url))
         else 'Nothing quoted' || chr(10) || chr(10) || 'Sources: ' || string_agg(url, ' · ' order by n) filter (where n <= 3) end as body
       from (select *, max(case when n = 1 then url end) over (partition by entry_id) as u1 from found) group by entry_id
       having max(title) filter (where n = 1) not like '%5'""",
    linked_entries=LINKED, news=NEWS, found=FOUND,
)
def _(spark, sf):
    found = pg.news_since(b.linked_entries(spark, sf), _news(spark, sf))
    # stands in for a written summary: some quote the newest article, some quote none, some have nothing to tell
    summaries = found.where("rank = 1").select(
        "entry_id",
        F.when(F.col("title").endswith("3"), F.concat(F.lit(" See "), "url", F.lit(" now "))).when(F.col("title").endswith("5"), " nothing_new since then").otherwise("Nothing quoted").alias("text"),
    )
    return pg.news_notes(found, summaries, b.as_of()).select("entry_id", "body")


@query(
    "recent_research",
    """select entry_id, string_agg(split_part(body, chr(10) || chr(10) || 'Sources:', 1), chr(10) order by n desc) as already from (
         select *, row_number() over (partition by entry_id order by created_at desc, id desc) as n from notes where source = 'research') where n <= 3 group by 1""",
)
def _(spark, sf):
    return pg.recent_research(b.notes(spark, sf))


# -- streams -------------------------------------------------------------------------


def _finish(q):
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def _streamed(spark, sf, name, schema):
    """A table's file, or the part files of its folder. A pattern, because a stream takes a plain path for a folder."""
    return spark.readStream.schema(schema).parquet(f"{sf}/{{{name}.parquet}}")


@query(
    "stream_capture",
    f"""select {SID} as id, capture_id, kind, title, status from (select *, sha256(coalesce(capture_id, 'request:' || seq)) as h from normal)""",
    requests=REQUESTS, fresh=FRESH, **steps("fresh"),
)
def _(spark, sf):
    """The capture requests again, this time read as a stream."""
    path = state_dir(spark, "stream-capture")
    docs = _streamed(spark, sf, "documents", b.documents(spark, sf).schema)
    requests = b.requests_of(docs)
    _finish(capture_stream.capture_stream(requests, b.entries(spark, sf), f"{path}/items", f"{path}/checkpoint"))
    return capture_stream.captured(spark, f"{path}/items").select("id", "capture_id", "kind", "title", "status")


@query(
    "stream_capture_batches",
    f"""select {SID} as id, capture_id, kind, title, status from (select *, sha256(coalesce(capture_id, 'request:' || seq)) as h from normal)""",
    requests=REQUESTS, fresh=FRESH, **steps("fresh"),
)
def _(spark, sf):
    """The capture requests in three batches, in order, the last of which brings all earlier ids again."""
    path = state_dir(spark, "stream-capture-batches")
    requests = b.requests_of(b.documents(spark, sf))
    first, last = requests.agg(F.min("seq"), F.max("seq")).first()
    middle = F.lit((first + last) // 2)
    again = requests.where(F.col("capture_id").isNotNull() & (F.col("seq") <= middle))
    for part in (requests.where(F.col("seq") <= middle), requests.where(F.col("seq") > middle), again):
        part.write.mode("append").parquet(f"{path}/inbox")
        stream = spark.readStream.schema(requests.schema).parquet(f"{path}/inbox")
        _finish(capture_stream.capture_stream(stream, b.entries(spark, sf), f"{path}/items", f"{path}/checkpoint", merge_every=2))
    return capture_stream.captured(spark, f"{path}/items").select("id", "capture_id", "kind", "title", "status")


HOURS = """select strftime(date_trunc('hour', at_time), '%Y-%m-%dT%H:%M:%S.%fZ') as hour, surface, action, count(*) as n, count(*) filter (where not ok) as failed
       from prompts group by 1, 2, 3"""


@query("stream_prompts", HOURS)
def _(spark, sf):
    path = state_dir(spark, "stream-prompts")
    events = _streamed(spark, sf, "events", b.table(spark, sf, "events").schema)
    calls = b.calls_of(events, b.documents(spark, sf))
    _finish(prompt_stream.counts_stream(calls, f"{path}/counts", f"{path}/checkpoint"))
    return prompt_stream.current_counts(spark, f"{path}/counts").withColumn("hour", iso(F.col("hour")))


@query("stream_prompts_late", HOURS)
def _(spark, sf):
    """The prompt log in three batches at least: the newest calls first, the oldest last."""
    path = state_dir(spark, "stream-prompts-late")
    calls = b.calls_of(b.table(spark, sf, "events"), b.documents(spark, sf)).select("id", "at", "surface", "action", "ok")
    first, last = calls.agg(F.min("at"), F.max("at")).first()
    third = F.floor(3 * (F.unix_micros("at") - F.unix_micros(F.lit(first))) / (F.unix_micros(F.lit(last)) - F.unix_micros(F.lit(first)) + 1))
    parts = [third == 2, third == 1, F.coalesce(third, F.lit(0)) == 0]
    for part in parts:
        calls.where(part).write.mode("append").parquet(f"{path}/inbox")
        stream = spark.readStream.schema(calls.schema).parquet(f"{path}/inbox")
        _finish(prompt_stream.counts_stream(stream, f"{path}/counts", f"{path}/checkpoint"))
    return prompt_stream.current_counts(spark, f"{path}/counts").withColumn("hour", iso(F.col("hour")))


@query(
    "stream_import",
    """select count(*) filter (where p_partkey % 17 <> 16 and p_partkey <> 0) as imported, 0 as skipped, count(*) as total_seen from part""",
)
def _(spark, sf):
    """Listings written to a folder, imported file by file."""
    path = state_dir(spark, "stream-import")
    b.import_json(spark, sf).repartition(3).write.text(f"{path}/inbox")
    lines = spark.readStream.option("maxFilesPerTrigger", 1).schema("value string").text(f"{path}/inbox")
    _finish(import_stream.import_stream(lines, b.entries(spark, sf), b.as_of(), f"{path}/store", f"{path}/checkpoint"))
    counts = import_stream.batch_counts(spark, f"{path}/store")
    return counts.agg(F.sum("imported").alias("imported"), F.sum("skipped").alias("skipped"), F.sum("total_seen").alias("total_seen"))
