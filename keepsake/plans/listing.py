"""Filters, listings, resurfacing views, totals and shelves."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.functions import shelves
from keepsake.functions.text import iso
from keepsake.operators import shelf_tree as tree
from keepsake.operators import stats, views
from keepsake.operators.filters import EntryFilter, happened_at
from keepsake.plans.oracle_tables import AS_OF as NOW
from keepsake.plans.registry import BRIEF, brief, query
from keepsake.sources import bindings as b

HAPPENED = "coalesce(occurred_at, created_at)"
NOT_DONE = "(status is null or status not in ('watched', 'done', 'read', 'dropped', 'abandoned', 'cancelled'))"
ENGAGED = "(status is null or status not in ('starred', 'imported', 'saved'))"


def under(shelf: str) -> str:
    return f"len(list_filter(tags, lambda t: t = '{shelf}' or starts_with(t, '{shelf}/'))) > 0"


@query("list_entries", f"select {BRIEF} from entries where archived_at is null order by {HAPPENED} desc, id limit 25 offset 10")
def _(spark, sf):
    return brief(views.list_entries(b.entries(spark, sf), EntryFilter(offset=10)))


@query(
    "filters",
    f"""select {BRIEF} from entries where kind in ('movie', 'task') and status = 'want' and created_at >= timestamp '2024-01-02'
        and created_at <= timestamp '2024-01-29' and archived_at is null""",
)
def _(spark, sf):
    f = EntryFilter(kinds=["Film", "todo"], status=" want ", since="2024-01-02", until="2024-01-29")
    return brief(f.apply(b.entries(spark, sf)))


@query("by_ids", f"select {BRIEF} from entries where id in (select to_id from links) and kind = 'reading' and archived_at is null")
def _(spark, sf):
    ids = b.links(spark, sf).select(F.col("to_id").alias("id"))
    return brief(views.by_ids(b.entries(spark, sf), ids, EntryFilter(kind="essay")))


@query("shelf_match", f"select {BRIEF} from entries where {under('lang')} and archived_at is null")
def _(spark, sf):
    return brief(EntryFilter(tags=[" #Lang/ "]).apply(b.entries(spark, sf)))


@query("shelf_all", f"select {BRIEF} from entries where {under('lang/en')} and {under('inbox')} and archived_at is null")
def _(spark, sf):
    return brief(EntryFilter(tags=["lang / en", "inbox"]).apply(b.entries(spark, sf)))


@query("shelf_any", f"select {BRIEF} from entries where ({under('lang/de')} or {under('src3')})")
def _(spark, sf):
    f = EntryFilter(tags=["lang/de", "src3"], tags_mode="any", include_archived=True)
    return brief(f.apply(b.entries(spark, sf)))


@query(
    "shelf_semi",
    f"""select {BRIEF} from entries e where exists (select 1 from (select distinct 'lang/fr/' || source as s from documents
          union all select distinct source from documents where lang = 'es') w,
          (select unnest(e.tags) as t) u where t = s or starts_with(t, s || '/'))""",
)
def _(spark, sf):
    docs = b.documents(spark, sf)
    wanted = docs.select(F.concat(F.lit("lang/fr/"), "source").alias("shelf")).union(
        docs.where("lang = 'es'").select("source")
    )
    return brief(tree.on_any_shelf(b.entries(spark, sf), wanted))


@query("due", f"select {BRIEF} from entries where archived_at is null and remind_at <= {NOW} + interval 3 day order by remind_at, id limit 50")
def _(spark, sf):
    return brief(views.due(b.entries(spark, sf), b.as_of(), 3))


@query("open_items", f"select {BRIEF} from entries where kind = 'task' and archived_at is null and {NOT_DONE} order by {HAPPENED} desc, id limit 50")
def _(spark, sf):
    return brief(views.open_items(b.entries(spark, sf), "todo"))


@query(
    "watchlist",
    f"""select * from (select 'want' as view, {BRIEF} from entries where kind = 'movie' and archived_at is null and {NOT_DONE}
          order by {HAPPENED} desc, id limit 200)
        union all select * from (select 'watched', {BRIEF} from entries where kind = 'movie' and archived_at is null
          and status = 'watched' order by {HAPPENED} desc, id limit 200)
        union all select * from (select 'all', {BRIEF} from entries where kind = 'movie' and archived_at is null
          order by {HAPPENED} desc, id limit 200)""",
)
def _(spark, sf):
    e = b.entries(spark, sf)
    parts = [brief(views.watchlist(e, v)).withColumn("view", F.lit(v)) for v in ("want", "watched", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "recently_engaged",
    f"""select {BRIEF} from entries where archived_at is null and {ENGAGED}
        order by greatest(updated_at, {HAPPENED}) desc, id limit 50""",
)
def _(spark, sf):
    return brief(views.recently_engaged(b.entries(spark, sf)))


@query("unfiled", f"select {BRIEF} from entries where archived_at is null and len(tags) = 0 and {ENGAGED} order by created_at desc, id limit 50")
def _(spark, sf):
    return brief(views.unfiled(b.entries(spark, sf)))


@query("collected", f"select {BRIEF} from entries where archived_at is null and status in ('starred', 'imported', 'saved') order by {HAPPENED} desc, id limit 8")
def _(spark, sf):
    return brief(views.untouched_imports(b.entries(spark, sf)))


@query(
    "check_queue",
    f"""select {BRIEF} from entries where archived_at is null and {under('lang/en')}
        order by last_checked_at asc nulls first, created_at desc, id limit 50""",
)
def _(spark, sf):
    return brief(views.check_queue(b.entries(spark, sf), " #Lang/en", 80))


@query(
    "recent_prompts",
    """select id, surface, action, substring(input, 1, 8000) as input, cast(ms as bigint) as ms, ok, error from prompts where surface = 'cli' order by at_time desc, id limit 500""",
)
def _(spark, sf):
    rows = views.recent_prompts(b.prompts(spark, sf), 900, "cli")
    return rows.select("id", "surface", "action", "input", F.col("ms").cast("bigint").alias("ms"), "ok", "error")


def _section(name: str, where: str, order: str, limit: int) -> str:
    return f"""select * from (select '{name}' as section, row_number() over (order by {order}, id) as position, id, kind, title, status
      from entries where archived_at is null and {where} order by {order}, id limit {limit})"""


@query(
    "briefing",
    " union all ".join(
        [
            _section("due", f"remind_at <= {NOW}", "remind_at", 10),
            _section("recent", ENGAGED, f"greatest(updated_at, {HAPPENED}) desc", 10),
            _section("watchlist", f"kind = 'movie' and {NOT_DONE}", f"{HAPPENED} desc", 8),
            _section("open_tasks", f"kind = 'task' and {NOT_DONE}", f"{HAPPENED} desc", 10),
            _section("recent_people", "kind = 'person'", f"{HAPPENED} desc", 5),
            _section("collected", "status in ('starred', 'imported', 'saved')", f"{HAPPENED} desc", 6),
        ]
    ),
)
def _(spark, sf):
    return views.briefing(b.entries(spark, sf), b.as_of()).withColumn("position", F.col("position").cast("bigint"))


@query("stats_totals", "select count(*) as total from entries where archived_at is null")
def _(spark, sf):
    return stats.totals(b.entries(spark, sf))


@query(
    "stats_by_kind",
    """select kind, count(*) as count, count(*) filter (where status is not null and status not in
         ('watched', 'done', 'read', 'dropped', 'abandoned', 'cancelled')) as open from entries where archived_at is null group by kind""",
)
def _(spark, sf):
    return stats.by_kind(b.entries(spark, sf))


@query(
    "stats_recent",
    f"""select count(*) filter (where created_at > {NOW} - interval 7 day) as captured_last_7_days,
          count(*) filter (where archived_at is null and remind_at <= {NOW}) as due_now from entries""",
)
def _(spark, sf):
    return stats.recent(b.entries(spark, sf), b.as_of())


@query(
    "top_tags",
    """select tag, count(*) as count from (select unnest(tags) as tag from entries where archived_at is null)
       group by tag order by count(*) desc, tag limit 15""",
)
def _(spark, sf):
    return stats.top_tags(b.entries(spark, sf))


PLACED = """
select distinct e.id, e.title, coalesce(e.occurred_at, e.created_at) as at_time, u.tag as full_tag,
  array_to_string(string_split(u.tag, '/')[1:g.i], '/') as tag
from entries e, (select id as uid, unnest(tags) as tag from entries) u, (select unnest(range(1, 20)) as i) g
where u.uid = e.id and g.i <= len(string_split(u.tag, '/')) and e.archived_at is null"""


@query(
    "shelf_tree",
    """select tag, count(distinct id) as count, count(distinct case when full_tag = tag then id end) as own,
         cast(len(string_split(tag, '/')) - 1 as bigint) as depth,
         case when contains(tag, '/') then array_to_string(string_split(tag, '/')[1:-2], '/') end as parent,
         string_split(tag, '/')[-1] as label from placed group by tag""",
    placed=PLACED,
)
def _(spark, sf):
    return tree.shelf_tree(b.entries(spark, sf)).withColumn("depth", F.col("depth").cast("bigint"))


@query(
    "shelf_samples",
    """select tag, max(n_all) as count, string_agg(coalesce(title, 'untitled'), ' · ' order by n) filter (where n <= 3) as sample
       from (select *, row_number() over (partition by tag order by at_time desc, id) as n, count(*) over (partition by tag) as n_all
             from (select distinct id, title, at_time, tag from placed)) group by tag""",
    placed=PLACED,
)
def _(spark, sf):
    return tree.shelf_samples(b.entries(spark, sf))


@query(
    "rename_shelf",
    """select id, array_to_string(list_sort(list_distinct(list_transform(tags, lambda t: case when t = 'lang/en' then 'words/english'
         when starts_with(t, 'lang/en/') then 'words/english' || substr(t, 8) else t end))), ' ') as tags
       from entries where len(list_filter(tags, lambda t: t = 'lang/en' or starts_with(t, 'lang/en/'))) > 0""",
)
def _(spark, sf):
    out = tree.rename_shelf(b.entries(spark, sf), "#lang / EN", "words/english/")
    return out.select("id", F.array_join("tags", " ").alias("tags"))


@query(
    "sort_times",
    f"select id, strftime({HAPPENED}, '%Y-%m-%dT%H:%M:%S.%fZ') as happened_at, strftime(greatest(updated_at, {HAPPENED}), '%Y-%m-%dT%H:%M:%S.%fZ') as engaged_at from entries",
)
def _(spark, sf):
    return b.entries(spark, sf).select(
        "id",
        iso(happened_at()).alias("happened_at"),
        iso(F.greatest(F.col("updated_at"), happened_at())).alias("engaged_at"),
    )


@query(
    "kind_fields",
    """select id, kind, case when kind = 'reading' then data_source end as source, data_lang as lang,
         cast(data_n_chars as bigint) as n_chars from entries""",
)
def _(spark, sf):
    from keepsake.functions.values import kind_field

    return b.entries(spark, sf).select(
        "id",
        "kind",
        kind_field(F.col("kind"), F.col("data"), "source").alias("source"),
        F.try_element_at("data", F.lit("lang")).alias("lang"),
        F.try_element_at("data", F.lit("n_chars")).cast("bigint").alias("n_chars"),
    )


@query(
    "shelf_nodes",
    "select id, string_agg(distinct tag, ' ' order by tag) as nodes from placed group by id",
    placed=PLACED,
)
def _(spark, sf):
    e = b.entries(spark, sf).where("archived_at is null")
    return e.select("id", F.array_join(F.array_sort(shelves.nodes(F.col("tags"))), " ").alias("nodes")).where("nodes <> ''")
