"""Links, details, references, duplicates and bulk capture."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.functions.text import iso
from keepsake.operators import bulk, details, duplicates, references
from keepsake.plans.oracle_tables import make_id
from keepsake.plans.registry import query
from keepsake.plans.search import similarity, trigrams
from keepsake.sources import bindings as b

LINKED = """
select l.from_id as entry_id, l.rel, 'out' as direction, e.id as neighbour_id, e.kind, e.title, e.status from links l join entries e on e.id = l.to_id
union all select l.to_id, l.rel, 'in', e.id, e.kind, e.title, e.status from links l join entries e on e.id = l.from_id"""


@query("entry_links", "select * from linked", linked=LINKED)
def _(spark, sf):
    return details.entry_links(b.links(spark, sf), b.entries(spark, sf))


@query(
    "entry_detail",
    """with wanted as (select id from entries where remind_at is not null)
       select id as entry_id, 'entry' as part, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ') as at_time, id as ref, kind as label, title as content
         from entries where id in (select id from wanted)
       union all select entry_id, 'note', strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ'), id, source, body from notes where entry_id in (select id from wanted)
       union all select entry_id, 'link', null, neighbour_id, direction || ' ' || rel, title from linked where entry_id in (select id from wanted)""",
    linked=LINKED,
)
def _(spark, sf):
    e = b.entries(spark, sf)
    out = details.entry_detail(e.where("remind_at is not null"), e, b.notes(spark, sf), b.links(spark, sf))
    return out.withColumn("at_time", iso(F.col("at"))).drop("at")


def _refs(spark, sf):
    """Documents read as references: full ids, prefixes, titles, and misses."""
    d = F.col("doc_id")
    title = b.first_line_title(F.col("text"))
    ref = (
        F.when(d % 6 == 0, F.upper(b.make_id(d + 7)))
        .when(d % 6 == 1, F.concat(F.lit("  "), F.substring(b.make_id(d), 1, 8)))
        .when(d % 6 == 2, F.upper(F.substring(F.sha1(d.cast("string")), 1, 5)))
        .when(d % 6 == 3, F.concat(F.translate(title, "eai", "EAI"), F.lit(" ")))
        .when(d % 6 == 4, F.concat(title, F.lit(" not there")))
        .otherwise(F.when(d % 5 == 0, " ").otherwise(F.substring(b.make_id(d), 1, 7)))
    )
    return b.documents(spark, sf).select(d.alias("ref_id"), ref.alias("ref"))


REFS = f"""
select doc_id as ref_id, case doc_id % 6 when 0 then upper({make_id('doc_id + 7')}) when 1 then '  ' || substring({make_id('doc_id')}, 1, 8)
   when 2 then upper(substring(sha1(cast(doc_id as varchar)), 1, 5)) when 3 then translate(title, 'eai', 'EAI') || ' '
   when 4 then title || ' not there' else case when doc_id % 5 = 0 then ' ' else substring({make_id('doc_id')}, 1, 7) end end as ref
from (select doc_id, split_part(text, chr(10), 1) as title from documents)"""


@query(
    "resolve_refs",
    """with typed as (select ref_id, ref, lower(trim(ref)) as k, regexp_matches(trim(ref), '(?i)^[0-9a-f]{4,}$') as is_prefix,
           regexp_matches(trim(ref), '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') as is_id from refs),
         hits as (select t.ref_id, e.id, e.title, 0 as age from typed t join entries e on t.is_prefix and starts_with(e.id, t.k)
           union all select t.ref_id, e.id, e.title, -epoch_us(e.created_at) from typed t join entries e on not t.is_prefix and not t.is_id and lower(e.title) = t.k
             where e.archived_at is null and t.k <> ''),
         ranked as (select *, row_number() over (partition by ref_id order by age, id) as n, count(*) over (partition by ref_id) as c from hits),
         top as (select ref_id, max(c) as c, min(id) filter (where n = 1) as id, string_agg(substring(id, 1, 8) || ' (' || title || ')', ', ' order by n) as options
           from ranked where n <= 5 group by 1)
       select t.ref_id, t.ref, case when t.is_id then 'ok' when h.c is null then 'none' when h.c > 1 then 'ambiguous' else 'ok' end as status,
         case when t.is_id then t.k when h.c = 1 then h.id end as id, case when h.c > 1 then h.options end as options
       from typed t left join top h on h.ref_id = t.ref_id""",
    refs=REFS,
)
def _(spark, sf):
    return references.resolve(_refs(spark, sf), b.entries(spark, sf))


DUP_G = {"named": f"select *, lower(title) as lt, {trigrams('title')} as g from entries where kind in ('movie', 'person', 'place', 'reading') and title <> ''"}


def _dups(extra: str) -> str:
    return f"""select id, kind, position, duplicate_id, title, status from (
       select p.id, p.kind, c.id as duplicate_id, c.title, c.status, row_number() over (partition by p.id order by c.created_at desc, c.id) as position
       from named p join named c on c.kind = p.kind and c.id <> p.id and c.archived_at is null and (c.lt = p.lt {extra}))
     where position <= 5"""


@query("find_duplicates", _dups(f"or {similarity('p.g', 'c.g')} > 0.55::double"), **DUP_G)
def _(spark, sf):
    e = b.entries(spark, sf)
    out = duplicates.find_duplicates(e, e)
    return out.select("id", "kind", F.col("position").cast("bigint").alias("position"), "duplicate_id", "title", "status")


@query("find_duplicates_exact", _dups(""), **DUP_G)
def _(spark, sf):
    e = b.entries(spark, sf)
    out = duplicates.find_duplicates(e, e, fuzzy=False)
    return out.select("id", "kind", F.col("position").cast("bigint").alias("position"), "duplicate_id", "title", "status")


def _bulk(spark, sf):
    """Conversations read as bulk captures: one item per turn, the first linked to the rest."""
    c, t = F.col("conv_id"), F.col("turn")
    n = b.documents(spark, sf).count()
    titles = b.entries(spark, sf).select(F.col("id").alias("title_of"), F.col("title").alias("stored_title"))
    turns = b.table(spark, sf, "conversations").withColumn("title_of", b.make_id((c * 13 + t) % n)).join(titles, "title_of")
    seq = c * 1000 + t
    items = turns.select(
        seq.alias("seq"),
        F.lit(None).cast("string").alias("capture_id"),
        F.lit("fact").alias("kind"),
        F.when(t % 2 == 0, F.col("stored_title")).otherwise(F.concat(F.lit("Turn "), seq.cast("string"))).alias("title"),
        F.col("text").alias("body"),
        F.create_map().cast("map<string,string>").alias("data"),
        F.array(F.col("role")).alias("tags"),
        F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("int").alias("rating"),
        F.lit(None).cast("timestamp").alias("occurred_at"),
        F.lit(None).cast("timestamp").alias("remind_at"),
        F.lit("mcp").alias("source"),
        b.at(b.JAN_31, t).alias("requested_at"),
        c.alias("batch_id"),
        F.concat(F.lit("r"), t.cast("string")).alias("ref"),
        F.when(t % 3 == 0, F.concat(F.lit(" note on "), seq.cast("string"))).alias("note"),
        F.when(t % 2 == 0, F.lit("tool")).alias("note_source"),
    )
    requests = turns.select(
        c.alias("batch_id"),
        F.lit("r0").alias("from"),
        F.when(t % 5 == 4, "nowhere at all").when(t % 5 == 3, F.col("stored_title")).otherwise(F.concat(F.lit("r"), t.cast("string"))).alias("to"),
        F.lit("compares").alias("rel"),
        b.at(b.JAN_31, t).alias("created_at"),
    )
    return items, requests


SID = "concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32])"
BULK = {
    "turns": f"select c.*, e.title as stored_title, conv_id * 1000 + turn as seq from conversations c join entries e on e.id = {make_id('(conv_id * 13 + turn) % (select count(*) from documents)')}",
    "unique_titles": "select lower(title) as lt, min(id) as id from entries where archived_at is null group by 1 having count(*) = 1",
    "bulk_items": """select t.*, case when turn % 2 = 0 then stored_title else 'Turn ' || seq end as title, sha256('request:' || seq) as h from turns t""",
    "bulk_placed": f"""select i.*, coalesce(u.id, {SID}) as id, u.id is null as created from bulk_items i left join unique_titles u on u.lt = lower(trim(i.title)) and i.turn % 2 = 0""",
    "all_titles": """select lt, min(id) as id from (select lower(title) as lt, id from entries where archived_at is null
        union all select lower(trim(title)), id from bulk_placed where created) group by 1 having count(*) = 1""",
    "bulk_links": """select t.conv_id, 'r0' as from_ref, case when turn % 5 = 4 then 'nowhere at all' when turn % 5 = 3 then stored_title else 'r' || turn end as to_ref from turns t""",
    "bulk_ends": """select l.conv_id, l.from_ref, l.to_ref, a.id as from_id, coalesce(b.id, u.id) as to_id from bulk_links l
        left join bulk_placed a on a.conv_id = l.conv_id and 'r' || a.turn = l.from_ref
        left join bulk_placed b on b.conv_id = l.conv_id and 'r' || b.turn = l.to_ref
        left join all_titles u on u.lt = lower(trim(l.to_ref))""",
}


@query(
    "capture_many",
    """select 'item' as part, cast(seq as varchar) as key, id as a, case when created then 'created' else 'reused' end as b from bulk_placed
       union all select 'link', 'compares', from_id, to_id from (select distinct from_id, to_id from bulk_ends where from_id <> to_id)
       union all select 'link', rel, from_id, to_id from links
       union all select 'note', source, entry_id, body from notes
       union all select 'failed', cast(conv_id as varchar), from_ref, to_ref from bulk_ends where coalesce(from_id = to_id, true)
       union all select 'note', case when turn % 2 = 0 then 'tool' else 'me' end, id, 'note on ' || seq from bulk_placed where turn % 3 = 0""",
    **BULK,
)
def _(spark, sf):
    items, requests = _bulk(spark, sf)
    held = b.links(spark, sf).select(F.concat_ws("/", "from_id", "to_id", "rel").alias("id"), "from_id", "to_id", "rel", b.as_of().alias("created_at"))
    r = bulk.capture_many(items, requests, b.entries(spark, sf), b.notes(spark, sf), held)
    return (
        r.placed.select(F.lit("item").alias("part"), F.col("seq").cast("string").alias("key"), F.col("id").alias("a"), F.when(F.col("created"), "created").otherwise("reused").alias("b"))
        .unionByName(r.links.select(F.lit("link").alias("part"), F.col("rel").alias("key"), F.col("from_id").alias("a"), F.col("to_id").alias("b")))
        .unionByName(r.failed_links.select(F.lit("failed").alias("part"), F.col("batch_id").cast("string").alias("key"), F.col("from").alias("a"), F.col("to").alias("b")))
        .unionByName(r.notes.select(F.lit("note").alias("part"), F.col("source").alias("key"), F.col("entry_id").alias("a"), F.col("body").alias("b")))
    )
