"""The same bindings as common table expressions for the SQL checks."""

from __future__ import annotations

import re

ID = "concat(lpad(lower(hex({0})), 8, '0'), '-0000-4000-8000-000000000000')"
ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%fZ')"
WS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
AS_OF = "timestamp '2024-01-31 00:00:00'"


def make_id(n: str) -> str:
    return ID.format(f"cast({n} as bigint)")


def iso(c: str) -> str:
    return ISO.format(c)


def at(day: str, minutes: str) -> str:
    return f"(timestamp '{day} 00:00:00' + to_minutes(cast({minutes} as bigint)))"


N = "(select count(*) from documents)"

TABLES: dict[str, str] = {}

TABLES["entries"] = f"""
select {make_id('doc_id')} as id, doc_id,
  case doc_id % 9 when 0 then 'thought' when 1 then 'movie' when 2 then 'person' when 3 then 'reading'
    when 4 then 'task' when 5 then 'fact' when 6 then 'place' when 7 then 'idea' else 'repo' end as kind,
  split_part(text, chr(10), 1) as title, text as body,
  lang as data_lang, source as data_source, cast(n_chars as varchar) as data_n_chars,
  case when doc_id % 13 = 0 then cast([] as varchar[]) when doc_id % 2 = 0 then ['lang/' || lang, source]
    else ['lang/' || lang || '/' || source, 'inbox'] end as tags,
  case when doc_id % 9 = 1 then case doc_id % 4 when 0 then 'watched' when 1 then 'want' when 2 then 'dropped' end
    when doc_id % 9 = 3 then case when doc_id % 3 = 0 then 'read' else 'queued' end
    when doc_id % 9 = 4 then case when doc_id % 2 = 0 then 'done' else 'open' end
    when doc_id % 9 = 8 then 'starred' end as status,
  case when doc_id % 5 = 0 then cast(doc_id % 10 + 1 as integer) end as rating,
  {at('2024-01-01', '(doc_id*37) % 43200')} as created_at,
  {at('2024-01-01', '(doc_id*37) % 43200 + (doc_id % 5) * 1440')} as updated_at,
  case when doc_id % 3 = 0 then {at('2023-12-01', '(doc_id*53) % 43200')} end as occurred_at,
  case when doc_id % 7 = 0 then {at('2024-01-15', '(doc_id*29) % 43200')} end as remind_at,
  case when doc_id % 11 = 0 then timestamp '2024-01-30 00:00:00' end as archived_at,
  case when doc_id % 4 = 0 then {at('2024-01-10', '(doc_id*17) % 20000')} end as last_checked_at,
  case when doc_id % 6 = 0 then 'device:' || doc_id end as capture_id
from documents"""

TABLES["notes"] = f"""
select {make_id('conv_id*100+turn')} as id, {make_id('(conv_id*7+turn) % ' + N)} as entry_id, text as body,
  {at('2024-01-20', '(conv_id*61+turn*3) % 14400')} as created_at,
  case role when 'user' then 'me' when 'assistant' then 'research' else 'api' end as source
from conversations"""

TABLES["link_requests"] = f"""
select {make_id('o_orderkey')} as id, {make_id('o_custkey % ' + N)} as from_id, {make_id('o_orderkey % ' + N)} as to_id,
  case o_orderstatus when 'F' then 'recommended' when 'P' then 'about' else 'related' end as rel,
  o_orderdate as created_at
from orders"""

TABLES["links"] = "select distinct from_id, to_id, rel from link_requests where from_id <> to_id"

TABLES["keyed_events"] = f"select *, event_id % {N} as k from events"

TABLES["prompts"] = f"""
select {make_id('event_id')} as id, ts as at_time,
  case user_id % 5 when 0 then 'web' when 1 then 'api' when 2 then 'cli' when 3 then 'telegram' else 'mcp' end as surface,
  case event_type when 'click' then 'capture' when 'view' then 'ask' when 'purchase' then 'jot'
    when 'signup' then 'flow_capture' else 'telegram_capture' end as action,
  concat(case when event_id % 3 = 0 then 'https://example.com/p/' || event_id || ' ' else '' end,
    case when event_id % 6 = 0 then '' else d.text end,
    case when event_id % 4 = 0 then ' #' || d.lang || '/' || d.source else '' end) as input,
  case when event_id % 8 = 0 then 2 when event_type = 'view' then 0 else 1 end as n_entries, k,
  cast(floor(value) as integer) as ms, event_type <> 'error' as ok,
  case when event_type = 'error' and event_id % 2 = 0 then 'timeout' end as error
from keyed_events join documents d on d.doc_id = k"""

TABLES["prompt_entries"] = f"""
select p.id, p.pos, e.kind, e.tags, e.id as entry_id
from (select id, 0 as pos, k as doc_id from prompts where n_entries >= 1
      union all select id, 1, (k + 1) % {N} from prompts where n_entries = 2) p
join entries e on e.doc_id = p.doc_id"""

TABLES["vectors"] = f"""
select {make_id('vec_id')} as entry_id, case when vec_id % 19 = 0 then 'old:64' else 'table:64' end as provider,
  cast(embedding as double[]) as vec, {at('2024-01-03', '(vec_id*37) % 43200')} as source_updated_at, label
from embeddings"""

# -- full text: tokens of each field with running positions -----------------------
TABLES["note_tokens"] = r"""
select n.entry_id, n.created_at, n.id, regexp_extract_all(lower(n.body), '[\p{L}\p{N}]+') as t from notes n"""

TABLES["note_bases"] = """
select entry_id, t, coalesce(sum(len(t)) over (partition by entry_id order by created_at, id
  rows between unbounded preceding and 1 preceding), 0) as base from note_tokens"""

TABLES["entry_tokens"] = r"""
select e.id, regexp_extract_all(lower(coalesce(e.title, '')), '[\p{L}\p{N}]+') as ta,
  regexp_extract_all(lower(array_to_string(e.tags, ' ')), '[\p{L}\p{N}]+') as tg,
  regexp_extract_all(lower(coalesce(e.body, '')), '[\p{L}\p{N}]+') as tb,
  regexp_extract_all(lower(concat_ws(' ', e.data_lang, e.data_source, e.data_n_chars)), '[\p{L}\p{N}]+') as tc,
  coalesce(n.total, 0) as note_total
from entries e left join (select entry_id, sum(len(t)) as total from note_tokens group by 1) n on n.entry_id = e.id"""

TABLES["postings"] = """
select id as entry_id, unnest(ta) as term, unnest(range(1, len(ta) + 1)) as pos, 1.0::double as w from entry_tokens
union all select id, unnest(tg), len(ta) + unnest(range(1, len(tg) + 1)), 1.0 from entry_tokens
union all select id, unnest(tb), len(ta) + len(tg) + unnest(range(1, len(tb) + 1)), 0.4 from entry_tokens
union all select n.entry_id, unnest(n.t), len(e.ta) + len(e.tg) + len(e.tb) + n.base + unnest(range(1, len(n.t) + 1)), 0.4
  from note_bases n join entry_tokens e on e.id = n.entry_id
union all select id, unnest(tc), len(ta) + len(tg) + len(tb) + note_total + unnest(range(1, len(tc) + 1)), 0.2 from entry_tokens"""

TABLES["recall_queries"] = """
select * from (values (0, 'thanedble'), (1, 'harness'), (2, 'the rewh'), (3, 'inoran hehely'), (4, 'Eriner thanea'),
  (5, 'And therhean is esnda reedes'), (6, 'ledre'), (7, 'zzqqxx'), (8, '  '), (9, 'de la')) as v(query_id, query)"""


def with_tables(sql: str, **extra: str) -> str:
    """Prefix a statement with every table expression it reaches, in order."""
    known = {**TABLES, **extra}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in order and re.search(rf"\b(from|join)\s+{name}\b", text, re.I):
                visit(known[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    if not order:
        return sql
    head = ",\n".join(f"{n} as materialized ({known[n].strip()})" for n in order)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {head},\n{body[5:]}"
    return f"with {head}\n{body}"
