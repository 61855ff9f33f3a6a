"""Text rules and the write side: capture, imports, updates, links, deletes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.functions import text, values
from keepsake.functions.text import iso
from keepsake.operators import capture as cap
from keepsake.operators import mutate
from keepsake.plans import oracle_text as o
from keepsake.plans.oracle_tables import AS_OF as NOW
from keepsake.plans.oracle_tables import at
from keepsake.plans.registry import query
from keepsake.sources import bindings as b
from keepsake.sources import imports

SID = "concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32])"

REQUESTS = f"""
select doc_id as seq, case when doc_id % 6 = 0 then 'device:' || (doc_id % 300) end as capture_id,
  case doc_id % 11 when 0 then 'note' when 1 then 'Film' when 2 then ' contact ' when 3 then 'essay' when 4 then 'todo' when 5 then 'fact'
    when 6 then 'restaurant' when 7 then 'project' when 8 then 'github' when 9 then '' else 'memo' end as raw_kind,
  case when doc_id % 4 = 0 and doc_id % 10 <> 8 then split_part(text, chr(10), 1) end as title,
  case when doc_id % 10 = 8 then null when doc_id % 10 = 9 then 'https://example.com/x/' || source || '_report.html' else concat(text,
    case when doc_id % 2 = 0 then ' #ai/harness #' || source else '' end,
    case when doc_id % 3 = 0 then ' https://example.com/a/b_' || doc_id || '.pdf.' else '' end) end as body,
  lang, case when doc_id % 10 = 8 then 'https://example.com/docs/Some_Long%20Name+' || source || '.pdf?x=1' end as data_url,
  ['#Lang / ' || upper(lang), source, source || '/'] as tags,
  case when doc_id % 12 = 0 then ' starred ' else '' end as status,
  {at('2024-01-31', 'doc_id % 1440')} as requested_at
from documents"""

STEP1 = f"""
select *, {o.kind('raw_kind')} as kind0, {o.strip_null('title')} as given, {o.strip_null('body')} as b0 from {{source}}"""
STEP2 = f"""
select *, list_concat(tags, {o.hashtags('b0')}) as raw_tags, {o.untagged('b0')} as b1 from step1"""
STEP3 = f"""
select *, {o.tags_all('raw_tags')} as tags1, coalesce(given, {o.title_of('b1')}) as title1 from step2"""
STEP4 = f"""
select *, {o.distinct('tags1')} as tags2, {o.url('data_url', 'b1', 'title1')} as url from step3
where coalesce(title1, b1, {o.url('data_url', 'b1', 'title1')}) is not null"""
NORMAL = f"""
select seq, capture_id, requested_at, case when kind0 = 'thought' and url is not null then 'reading' else kind0 end as kind,
  coalesce(title1, {o.url_title('url')}, url) as title,
  case when url is not null and {o.url_only('b1')} then null else b1 end as body,
  concat(case when url is not null then 'url=' || url || ';' else '' end, 'lang=' || lang) as data,
  array_to_string(tags2, ' ') as tags,
  coalesce({o.strip_null('status')}, {o.default_status("case when kind0 = 'thought' and url is not null then 'reading' else kind0 end")}) as status
from step4"""

PLAIN = f"""
select seq, kind0 as kind, title1 as title, b1 as body,
  concat(case when data_url is not null then 'url=' || data_url || ';' else '' end, 'lang=' || lang) as data,
  array_to_string(tags2, ' ') as tags, coalesce({o.strip_null('status')}, {o.default_status('kind0')}) as status from step4"""


def steps(source: str) -> dict[str, str]:
    return {"step1": STEP1.format(source=source), "step2": STEP2, "step3": STEP3, "step4": STEP4, "normal": NORMAL}


FRESH = """
select * from requests r where capture_id is null or (seq = (select min(seq) from requests q where q.capture_id = r.capture_id)
  and not exists (select 1 from entries e where e.capture_id = r.capture_id))"""


# -- scalar rules ---------------------------------------------------------------


@query("normalize_kind", f"select seq, raw_kind, {o.kind('raw_kind')} as kind from requests", requests=REQUESTS)
def _(spark, sf):
    return b.capture_requests(spark, sf).select("seq", F.col("kind").alias("raw_kind"), text.normalize_kind(F.col("kind")).alias("kind"))


@query(
    "default_status",
    f"select id, coalesce({o.strip_null('status')}, {o.default_status('kind')}) as status from entries",
)
def _(spark, sf):
    return b.entries(spark, sf).select("id", text.status_or_default(F.col("status"), F.col("kind")).alias("status"))


@query("derive_title", f"select seq, {o.title_of('body')} as title from requests", requests=REQUESTS)
def _(spark, sf):
    return b.capture_requests(spark, sf).select("seq", text.derive_title(F.col("body")).alias("title"))


@query(
    "clean_tags",
    f"select seq, array_to_string({o.distinct('t1')}, ' ') as tags from (select seq, {o.tags_all('tags')} as t1 from requests)",
    requests=REQUESTS,
)
def _(spark, sf):
    return b.capture_requests(spark, sf).select("seq", F.array_join(text.clean_tags(F.col("tags")), " ").alias("tags"))


@query(
    "extract_hashtags",
    f"select seq, {o.untagged('body')} as text, array_to_string({o.hashtags('body')}, ' ') as tags from requests",
    requests=REQUESTS,
)
def _(spark, sf):
    c = F.col("body")
    return b.capture_requests(spark, sf).select(
        "seq", text.without_hashtags(c).alias("text"), F.array_join(text.hashtags(c), " ").alias("tags")
    )


@query("extract_url", f"select seq, {o.url('data_url', 'body', 'title')} as url from requests", requests=REQUESTS)
def _(spark, sf):
    return b.capture_requests(spark, sf).select(
        "seq", text.extract_url(F.try_element_at("data", F.lit("url")), F.col("body"), F.col("title")).alias("url")
    )


@query("url_only", f"select seq, {o.url_only('body')} as url_only from requests", requests=REQUESTS)
def _(spark, sf):
    return b.capture_requests(spark, sf).select("seq", text.is_url_only(F.col("body")).alias("url_only"))


@query(
    "weak_title",
    f"""select id, {o.weak('title', 'tags')} as weak, {o.weak("split_part(title, ' ', 1)", "list_append(tags, lower(split_part(title, ' ', 1)))")} as weak_word from entries""",
)
def _(spark, sf):
    word = F.split_part("title", F.lit(" "), F.lit(1))
    return b.entries(spark, sf).select(
        "id",
        text.is_weak_title(F.col("title"), F.col("tags")).alias("weak"),
        text.is_weak_title(word, F.array_append("tags", F.lower(word))).alias("weak_word"),
    )


@query("title_from_url", f"select page_id, url, {o.url_title('url')} as title from pages")
def _(spark, sf):
    return b.pages(spark, sf).select("page_id", "url", text.title_from_url(F.col("url")).alias("title"))


@query(
    "site_name",
    f"select page_id, {o.site('null::varchar', 'url')} as plain, {o.site(o.host('url'), 'url')} as from_host, {o.site(repr('The Site'), 'url')} as declared from pages",
)
def _(spark, sf):
    u = F.col("url")
    return b.pages(spark, sf).select(
        "page_id",
        text.site_name(F.lit(None).cast("string"), u).alias("plain"),
        text.site_name(text.url_host(u), u).alias("from_host"),
        text.site_name(F.lit("The Site"), u).alias("declared"),
    )


@query(
    "qualify_title",
    f"""select page_id, {o.qualified("split_part(t, ' ', 1)", "null::varchar", 'url')} as short, {o.qualified('t', 'null::varchar', 'url')} as whole,
          {o.qualified("case when page_id % 2 = 0 then ' Overview ' else 'FAQ' end", "null::varchar", 'url')} as generic
        from (select page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) as t from pages)""",
)
def _(spark, sf):
    u, none = F.col("url"), F.lit(None).cast("string")
    t = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return b.pages(spark, sf).select(
        "page_id",
        text.qualify_title(F.split_part(t, F.lit(" "), F.lit(1)), none, u).alias("short"),
        text.qualify_title(t, none, u).alias("whole"),
        text.qualify_title(F.when(F.col("page_id") % 2 == 0, " Overview ").otherwise("FAQ"), none, u).alias("generic"),
    )


@query("decode_entities", f"select page_id, md5({o.decoded('html')}) as digest, length({o.decoded('html')}) as n_chars from pages")
def _(spark, sf):
    t = text.decode_entities(F.col("html"))
    return b.pages(spark, sf).select("page_id", t.alias("t")).select(
        "page_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n_chars")
    )


@query("json_values", "select id, concat_ws(' ', data_lang, data_source, data_n_chars) as detail from entries")
def _(spark, sf):
    return b.entries(spark, sf).select("id", values.values_text(F.col("data")).alias("detail"))


# -- capture ----------------------------------------------------------------------


@query("capture_normalise", "select seq, kind, title, body, data, tags, status from normal", requests=REQUESTS, **steps("requests"))
def _(spark, sf):
    return cap.normalise(b.capture_requests(spark, sf)).select(
        "seq", "kind", "title", "body", values.as_text(F.col("data")).alias("data"), F.array_join("tags", " ").alias("tags"), "status"
    )


@query("capture_plain", "select * from plain", requests=REQUESTS, plain=PLAIN, **steps("requests"))
def _(spark, sf):
    return cap.normalise(b.capture_requests(spark, sf), enrich=False).select(
        "seq", "kind", "title", "body", values.as_text(F.col("data")).alias("data"), F.array_join("tags", " ").alias("tags"), "status"
    )


@query(
    "capture_idempotent",
    f"""select {SID} as id, capture_id, kind, title, tags, status, strftime(requested_at, '%Y-%m-%dT%H:%M:%S.%fZ') as created_at
        from (select *, sha256(coalesce(capture_id, 'request:' || seq)) as h from normal)""",
    requests=REQUESTS, fresh=FRESH, **steps("fresh"),
)
def _(spark, sf):
    made = cap.capture(b.capture_requests(spark, sf), b.entries(spark, sf))
    return made.select("id", "capture_id", "kind", "title", F.array_join("tags", " ").alias("tags"), "status", iso(F.col("created_at")).alias("created_at"))


@query(
    "capture_outcomes",
    f"""select seq, {SID} as id, created from (
          select seq, sha256(coalesce(capture_id, 'request:' || seq)) as h,
            capture_id is null or seq = (select min(seq) from requests q where q.capture_id = r.capture_id) as created
          from requests r where capture_id is null or not exists (select 1 from entries e where e.capture_id = r.capture_id))
        union all select r.seq, e.id, false from requests r join entries e on e.capture_id = r.capture_id""",
    requests=REQUESTS,
)
def _(spark, sf):
    r, e = b.capture_requests(spark, sf), b.entries(spark, sf)
    return cap.outcomes(r, e, cap.capture(r, e))


@query(
    "jot_explode",
    f"""select concat_ws(':', 'jot', conv_id, turn) || '#' || i as capture_id, case when role = 'user' then 'note' else 'essay' end as kind, line as body,
          role || ' talk/log' as tags, 'line=' || i as data
        from (select *, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as i from conversations where conv_id % 5 <> 0)
        union all
        select concat_ws(':', 'jot', conv_id, turn) || '#0', 'thought', {o.untagged("'said ' || text || ' #talk/log'")},
          array_to_string({o.hashtags("'said ' || text || ' #talk/log'")}, ' '), ''
        from conversations where conv_id % 5 = 0""",
)
def _(spark, sf):
    return cap.explode_jots(b.jots(spark, sf)).select(
        "capture_id", "kind", "body", F.array_join("tags", " ").alias("tags"), values.as_text(F.col("data")).alias("data")
    )


IMPORTED = """
select concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) as id, 'github:repo:' || p_partkey as capture_id,
  p_brand || '/' || p_name as title, 'starred' as status,
  case when p_partkey % 5 <> 0 then '2024-01-02T00:00:00.000000Z' end as occurred_at,
  concat('url=https://example.com/', p_partkey, ';owner=', lower(p_brand), ';stars=', p_size, ';source=github;topics=', lower(p_type)) as data
from (select *, sha256('github:repo:' || p_partkey) as h from part where p_partkey % 17 <> 16 and p_partkey <> 0)"""


@query("import_items", IMPORTED)
def _(spark, sf):
    made = imports.import_items(b.import_json(spark, sf), b.entries(spark, sf), b.as_of())
    return made.select("id", "capture_id", "title", "status", iso(F.col("occurred_at")).alias("occurred_at"), values.as_text(F.col("data")).alias("data"))


@query(
    "import_counts",
    "select 0 as imported, count(*) filter (where p_partkey % 17 <> 16 and p_partkey <> 0) as skipped, count(*) as total_seen from part",
)
def _(spark, sf):
    """A second import of the same listing: everything is known by then."""
    lines, stored = b.import_json(spark, sf), b.entries(spark, sf)
    first = imports.import_items(lines, stored, b.as_of())
    after = cap.store(stored, first)
    return imports.import_counts(
        lines, imports.import_items(lines, after, b.as_of()), imports.import_requests(lines, b.as_of())
    )


# -- updates ------------------------------------------------------------------------


def _new_notes(spark, sf):
    """Documents read as new notes; some are blank and most name no author."""
    d = F.col("doc_id")
    n = b.documents(spark, sf).count()
    return b.documents(spark, sf).select(
        b.make_id(d + 1000000).alias("id"),
        b.make_id((d * 3) % n).alias("entry_id"),
        F.when(d % 4 == 0, "  \n ").otherwise(F.concat(F.lit(" \n"), "text", F.lit("  "))).alias("body"),
        b.as_of().alias("created_at"),
        F.when(d % 3 == 0, F.lit(" ")).when(d % 3 == 1, F.col("lang")).alias("source"),
    )


NEW_NOTES = rf"""
select concat(lpad(lower(hex(doc_id + 1000000)), 8, '0'), '-0000-4000-8000-000000000000') as id,
  concat(lpad(lower(hex(cast((doc_id * 3) % (select count(*) from documents) as bigint))), 8, '0'), '-0000-4000-8000-000000000000') as entry_id,
  {o.strip('text')} as body, {NOW} as created_at, case when doc_id % 3 = 1 then lang else 'me' end as source
from documents where doc_id % 4 <> 0 and {o.strip_null('text')} is not null"""


@query("add_notes", "select id, entry_id, body, source from notes union all select id, entry_id, body, source from new_notes", new_notes=NEW_NOTES)
def _(spark, sf):
    return mutate.add_notes(b.notes(spark, sf), _new_notes(spark, sf)).select("id", "entry_id", "body", "source")


@query(
    "touch_rule",
    f"""select id, strftime(case when id in (select entry_id from new_notes) then {NOW} else updated_at end, '%Y-%m-%dT%H:%M:%S.%fZ') as after_note,
          strftime(updated_at, '%Y-%m-%dT%H:%M:%S.%fZ') as after_check,
          strftime(case when status is not null or last_checked_at is null then {NOW} else updated_at end, '%Y-%m-%dT%H:%M:%S.%fZ') as after_edit
        from entries""",
    new_notes=NEW_NOTES,
)
def _(spark, sf):
    e = b.entries(spark, sf)
    noted = mutate.touch_parents(e, _new_notes(spark, sf), b.as_of()).select("id", iso(F.col("updated_at")).alias("after_note"))
    checked = mutate.mark_checked(e, e, b.as_of()).select("id", iso(F.col("updated_at")).alias("after_check"))
    # an update that clears the status and the check time: an edit wherever there was a status to clear
    pair = e.select("id", F.struct("*").alias("old")).withColumn(
        "new",
        F.col("old").withField("status", F.lit(None).cast("string")).withField("last_checked_at", F.lit(None).cast("timestamp")),
    )
    edited = pair.select("id", iso(mutate.touched_at("old", "new", b.as_of())).alias("after_edit"))
    return noted.join(checked, "id").join(edited, "id")


@query(
    "upsert_links",
    """select id, from_id, to_id, rel, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ') as created_at from (
         select id, from_id, to_id, rel, created_at, 1 as gen from link_requests where from_id <> to_id
         union all select concat_ws('/', 'stored', from_id, to_id), to_id, from_id, rel, timestamp '2030-01-01', 0 from links)
       qualify row_number() over (partition by from_id, to_id, rel order by gen, created_at, id) = 1""",
)
def _(spark, sf):
    """Requests against a store that holds every link the other way round, some of which are requested too."""
    stored = b.links(spark, sf).select(
        F.concat_ws("/", F.lit("stored"), "from_id", "to_id").alias("id"), F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "rel",
        F.lit("2030-01-01").cast("timestamp").alias("created_at"),
    )
    out = mutate.upsert_links(stored, b.link_requests(spark, sf))
    return out.select("id", "from_id", "to_id", "rel", iso(F.col("created_at")).alias("created_at"))


@query(
    "apply_updates",
    f"""select id, case when doc_id % 3 = 0 then 'movie' else kind end as kind,
          case when doc_id % 4 = 1 then null when doc_id % 4 = 2 then 'renamed ' || doc_id else title end as title,
          case when doc_id % 4 <> 0 then 7 else rating end as rating,
          array_to_string(case when doc_id % 5 = 0 then ['x/y'] when doc_id % 5 = 1 then list_sort(list_distinct(list_concat(tags, ['inbox', 'new/shelf']))) else tags end, ' ') as tags,
          concat(case when doc_id % 2 = 0 then 'lang=' || data_lang || ';' else '' end,
            case when doc_id % 2 = 1 then 'extra=1;' else '' end, 'source=', data_source, ';n_chars=', data_n_chars) as data,
          case when doc_id % 7 = 0 then {NOW} when doc_id % 7 = 1 then null else archived_at end is not null as archived,
          strftime({NOW}, '%Y-%m-%dT%H:%M:%S.%fZ') as updated_at
        from entries""",
)
def _(spark, sf):
    d = F.col("d")
    e = b.entries(spark, sf)
    none = F.lit(None)
    patches = e.select("id", F.conv(F.substring("id", 1, 8), 16, 10).cast("bigint").alias("d")).select(
        "id",
        F.when(d % 3 == 0, " Film").alias("kind"),
        F.when(d % 4 == 1, mutate.set_to(none.cast("string"))).when(
            d % 4 == 2, mutate.set_to(F.concat(F.lit("renamed "), d.cast("string")))
        ).alias("title"),
        F.when(F.lit(False), mutate.set_to(F.lit(""))).alias("body"),
        F.when(F.lit(False), mutate.set_to(F.lit(""))).alias("status"),
        F.when(d % 4 != 0, mutate.set_to(F.lit(7))).alias("rating"),
        F.when(F.lit(False), mutate.set_to(none.cast("timestamp"))).alias("occurred_at"),
        F.when(F.lit(False), mutate.set_to(none.cast("timestamp"))).alias("remind_at"),
        F.when(d % 5 == 0, F.array(F.lit("#X / y/"))).alias("tags"),
        F.when(d % 5 == 1, F.array(F.lit("New/Shelf"), F.lit("inbox"))).alias("add_tags"),
        F.when(d % 2 == 1, F.create_map(F.lit("lang"), none.cast("string"), F.lit("extra"), F.lit("1"))).otherwise(
            F.create_map(F.lit("absent"), none.cast("string"))
        ).alias("data"),
        F.when(d % 7 == 0, True).when(d % 7 == 1, False).alias("archived"),
    )
    out = mutate.apply_updates(e, patches, b.as_of())
    return out.select(
        "id", "kind", "title", F.col("rating").cast("bigint").alias("rating"), F.array_join("tags", " ").alias("tags"),
        values.as_text(F.col("data")).alias("data"), F.col("archived_at").isNotNull().alias("archived"), iso(F.col("updated_at")).alias("updated_at"),
    )


@query(
    "apply_updates_folded",
    f"""select id, case when doc_id % 4 = 3 then 'movie' else kind end as kind,
          case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then 'second' else 'first' end as title,
          case when doc_id % 2 = 0 then 2 else 1 end as rating,
          array_to_string(case when doc_id % 5 = 0 then ['new', 'z'] when doc_id % 5 = 1 then ['late', 'z'] else list_sort(list_distinct(list_concat(tags, ['early']))) end, ' ') as tags,
          concat(case when doc_id % 2 = 1 then 'lang=' || data_lang || ';' else '' end, case when doc_id % 2 = 1 then 'note=one;' else 'note=two;' end,
            'source=', data_source, ';n_chars=', data_n_chars) as data,
          strftime({NOW}, '%Y-%m-%dT%H:%M:%S.%fZ') as updated_at
        from entries""",
)
def _(spark, sf):
    """Two patches an item, the later one first in the table, folded in order."""
    e = b.entries(spark, sf)
    d = F.conv(F.substring("id", 1, 8), 16, 10).cast("bigint")
    none, no_tags = F.lit(None), F.lit(None).cast("array<string>")
    unset = F.when(F.lit(False), mutate.set_to(F.lit("")))
    still = F.when(F.lit(False), mutate.set_to(none.cast("timestamp")))

    def patch(seq, kind, title, rating, tags, add, data):
        return e.select(
            "id", F.lit(seq).alias("seq"), kind.alias("kind"), title.alias("title"), unset.alias("body"), unset.alias("status"), rating.alias("rating"),
            still.alias("occurred_at"), still.alias("remind_at"), tags.alias("tags"), add.alias("add_tags"), data.alias("data"), none.cast("boolean").alias("archived"),
        )

    first = patch(
        1, F.when(d % 4 == 3, "place"), mutate.set_to(F.lit("first")), mutate.set_to(F.lit(1)),
        F.when(d % 5 == 1, F.array(F.lit("z"))), F.when(d % 5 != 1, F.array(F.lit("early"))),
        F.create_map(F.lit("note"), F.lit("one")),
    )
    second = patch(
        2, F.when(d % 4 == 3, "Film"), F.when(d % 3 == 0, mutate.set_to(none.cast("string"))).when(d % 3 == 1, mutate.set_to(F.lit("second"))),
        F.when(d % 2 == 0, mutate.set_to(F.lit(2))), F.when(d % 5 == 0, F.array(F.lit("new"), F.lit("z"))), F.when(d % 5 == 1, F.array(F.lit("late"))).otherwise(no_tags),
        F.when(d % 2 == 0, F.create_map(F.lit("note"), F.lit("two"), F.lit("lang"), none.cast("string"))),
    )
    out = mutate.apply_updates(e, mutate.fold_patches(second.unionByName(first)), b.as_of())
    return out.select(
        "id", "kind", "title", F.col("rating").cast("bigint").alias("rating"), F.array_join("tags", " ").alias("tags"),
        values.as_text(F.col("data")).alias("data"), iso(F.col("updated_at")).alias("updated_at"),
    )


_KEPT = "(select id from entries where archived_at is null)"


@query(
    "delete_cascade",
    f"""select 'entries' as tbl, id as a, kind as b, title as c from entries where id in {_KEPT}
       union all select 'notes', id, entry_id, body from notes where entry_id not in (select id from entries where archived_at is not null)
       union all select 'links', from_id, to_id, rel from links where from_id not in (select id from entries where archived_at is not null)
         and to_id not in (select id from entries where archived_at is not null)
       union all select 'vectors', entry_id, provider, cast(len(vec) as varchar) from vectors where entry_id not in (select id from entries where archived_at is not null)""",
)
def _(spark, sf):
    e = b.entries(spark, sf)
    left = mutate.delete_entries(
        e.where("archived_at is not null"), entries=e, notes=b.notes(spark, sf), links=b.links(spark, sf), vectors=b.vectors(spark, sf)
    )
    shown = {
        "entries": ("id", "kind", "title"), "notes": ("id", "entry_id", "body"), "links": ("from_id", "to_id", "rel"),
        "vectors": ("entry_id", "provider", F.size("vec").cast("string")),
    }
    parts = [
        df.select(F.lit(name).alias("tbl"), *[(F.col(c) if isinstance(c, str) else c).alias(x) for c, x in zip(shown[name], "abc")])
        for name, df in left.items()
    ]
    return reduce(DataFrame.unionByName, parts)
