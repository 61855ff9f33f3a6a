"""Full text, fuzzy titles and text recall."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.functions import text
from keepsake.operators import fulltext, recall
from keepsake.operators.search_index import SearchIndex
from keepsake.operators.filters import EntryFilter
from keepsake.plans import oracle_text as o
from keepsake.plans.oracle_stem import STEMS, STOPS
from keepsake.plans.oracle_tables import TABLES
from keepsake.plans.registry import query
from keepsake.session import broadcast_if_small, spread, state_dir
from keepsake.sources import bindings as b

WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"


def trigrams(x: str) -> str:
    w = WORDS.format(f"coalesce({x}, '')")
    return (
        f"list_distinct(flatten(list_transform({w}, lambda w: list_transform(range(1, length(w) + 2),"
        " lambda i: substring('  ' || w || ' ', i, 3)))))"
    )


def similarity(a: str, b_: str) -> str:
    """Two trigram lists compared, in single precision like the score."""
    shared = f"len(list_intersect({a}, {b_}))"
    return f"cast(coalesce(cast(cast({shared} as double) / nullif(len({a}) + len({b_}) - {shared}, 0) as float), 0) as double)"


TERMS = r"""
select query_id, term, row_number() over (partition by query_id order by first) - 1 as k, count(*) over (partition by query_id) as n from (
  select query_id, term, min(i) as first from (select query_id, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}]+')) as term,
    unnest(range(1, len(regexp_extract_all(lower(query), '[\p{L}\p{N}]+')) + 1)) as i from asked) group by 1, 2)"""
ASKED = f"select query_id, {o.strip_null('query')} as query from recall_queries where {o.strip_null('query')} is not null"
OCC = "select t.query_id, p.entry_id, p.pos, p.w, t.k, t.n from postings p join terms t on t.term = p.term"
MATCHED = """
select query_id, entry_id from occ group by query_id, entry_id having count(distinct k) = max(n)"""


def covers(max_terms: int) -> dict[str, str]:
    """Minimal covers by window functions: the last place of each word, and the oldest of them."""
    lasts = ", ".join(
        f"max(pos) filter (where k = {k}) over (partition by query_id, entry_id order by pos) as l{k}" for k in range(max_terms)
    )
    arms = " ".join(
        f"when n = {n} then case when {' and '.join(f'l{k} is not null' for k in range(n))} then least({', '.join(f'l{k}' for k in range(n))}) end"
        for n in range(1, max_terms + 1)
    )
    return {
        "placed_occ": f"""select *, row_number() over (partition by query_id, entry_id order by pos) as c,
          sum(1 / w) over (partition by query_id, entry_id order by pos) as inv, {lasts} from occ""",
        "starts": f"select *, case {arms} end as p from placed_occ",
        "spans": "select *, lag(p) over (partition by query_id, entry_id order by pos) as before from starts",
        "ranked": """select s.query_id, s.entry_id,
            sum((s.c - b.c + 1) / (s.inv - b.inv + 1 / b.w) / (1 + (s.pos - s.p) - (s.c - b.c))) as rank
          from spans s join placed_occ b on b.query_id = s.query_id and b.entry_id = s.entry_id and b.pos = s.p
          where s.p is not null and (s.before is null or s.p > s.before) group by 1, 2""",
    }


FTS = {"terms": TERMS, "occ": OCC, "matched": MATCHED, "asked": ASKED, **covers(5)}


@query("fts_postings", "select entry_id, count(*) as n, count(distinct term) as n_terms, sum(pos) as pos_sum, max(pos) as last, round(sum(w), 4) as weight from postings group by 1")
def _(spark, sf):
    p = fulltext.occurrences(spread(b.entries(spark, sf)), spread(b.notes(spark, sf)))
    return p.groupBy("entry_id").agg(
        F.count("*").alias("n"), F.count_distinct("term").alias("n_terms"), F.sum("pos").cast("decimal(38,0)").cast("bigint").alias("pos_sum"),
        F.max("pos").alias("last"), F.round(F.sum("w"), 4).alias("weight"),
    )


@query("fts_match", "select query_id, entry_id as id from matched", **FTS)
def _(spark, sf):
    q = broadcast_if_small(b.recall_queries(spark).where(F.trim("query") != ""))
    return fulltext.match(q, spread(b.entries(spark, sf)), spread(b.notes(spark, sf))).select("query_id", "id")


def _ranks(spark, sf, rows):
    q = broadcast_if_small(b.typed_queries(spark, rows))
    return fulltext.match(q, spread(b.entries(spark, sf)), spread(b.notes(spark, sf))).withColumn("rank", F.round("rank", 6))


def _with_queries(rows):
    values = ", ".join(f"({i}, '{q}')" for i, q in rows)
    return {**FTS, "asked": f"select * from (values {values}) as v(query_id, query)"}


ONE = [(1, "the"), (2, "src3"), (3, "therhean"), (4, "fr")]
TWO = [(1, "the of"), (2, "de la"), (3, "inoran hehely"), (4, "src3 inbox")]
THREE = [(1, "the of and"), (2, "de la que"), (3, "in to is was"), (4, "lang en src7 the")]


@query("fts_rank1", "select query_id, entry_id as id, round(rank, 6) as rank from ranked", **_with_queries(ONE))
def _(spark, sf):
    return _ranks(spark, sf, ONE)


@query("fts_rank2", "select query_id, entry_id as id, round(rank, 6) as rank from ranked", **_with_queries(TWO))
def _(spark, sf):
    return _ranks(spark, sf, TWO)


@query("fts_rank3", "select query_id, entry_id as id, round(rank, 6) as rank from ranked", **_with_queries(THREE))
def _(spark, sf):
    return _ranks(spark, sf, THREE)


BOOLEAN = [(1, '"of the" -de'), (2, "rewh or hehely"), (3, "the -that -\"in the\""), (4, '"en la" or "de la" src1')]


@query(
    "fts_boolean",
    """with has as (select distinct entry_id, term from postings),
         pairs as (select distinct a.entry_id, a.term as t1, b.term as t2 from postings a join postings b on a.entry_id = b.entry_id and b.pos = a.pos + 1
           where a.term in ('of', 'in', 'en', 'de') and b.term in ('the', 'la'))
       select 1 as query_id, entry_id as id from pairs where t1 = 'of' and t2 = 'the' and entry_id not in (select entry_id from has where term = 'de')
       union all select distinct 2, entry_id from has where term in ('rewh', 'hehely')
       union all select 3, entry_id from has where term = 'the' and entry_id not in (select entry_id from has where term = 'that')
         and entry_id not in (select entry_id from pairs where t1 = 'in' and t2 = 'the')
       union all select distinct 4, entry_id from pairs p where (t1 = 'en' and t2 = 'la')
         or (t1 = 'de' and t2 = 'la' and entry_id in (select entry_id from has where term = 'src1'))""",
)
def _(spark, sf):
    return _ranks(spark, sf, BOOLEAN).select("query_id", "id")


def _index(spark, sf, english=False):
    path = state_dir(spark, "search-index")
    return SearchIndex.build(spread(b.entries(spark, sf)), spread(b.notes(spark, sf)), path, english)


@query("fts_indexed", "select query_id, entry_id as id, round(rank, 6) as rank from ranked", **_with_queries(THREE))
def _(spark, sf):
    """The three-word ranks again, from an index that is opened at those words only."""
    q = broadcast_if_small(b.typed_queries(spark, THREE))
    return _index(spark, sf).match(q, b.entries(spark, sf)).withColumn("rank", F.round("rank", 6))


ENGLISH = [(1, "thanedbles"), (2, "the of"), (3, "inorans hehely"), (4, "the esndas or reedes -of"), (5, '"rewhing the hehely"'), (6, "ering -\"and rean\"")]
ENGLISH_TABLES = {
    **STEMS,
    "vocabulary": "select distinct term from postings union select unnest(['thanedbles', 'inorans', 'hehely', 'esndas', 'reedes', 'rewhing', 'ering', 'rean'])",
    "stop": f"select unnest({STOPS}) as term",
    "has": "select p.entry_id, s.stem, p.pos from postings p join stems s on s.term = p.term where p.term not in (select term from stop)",
    "of_word": "select w.word, h.entry_id, h.pos from (select s.term as word, s.stem from stems s) w join has h on h.stem = w.stem",
}


@query(
    "fts_english",
    """select 1 as query_id, entry_id as id from (select distinct entry_id from of_word where word = 'thanedbles')
       union all select 3, entry_id from (select distinct entry_id from of_word where word = 'inorans' intersect select entry_id from of_word where word = 'hehely')
       union all select 4, entry_id from (select entry_id from of_word where word = 'esndas' union select entry_id from of_word where word = 'reedes')
       union all select distinct 5, x.entry_id from of_word x join of_word y on x.entry_id = y.entry_id and y.pos = x.pos + 2 where x.word = 'rewhing' and y.word = 'hehely'
       union all select 6, entry_id from (select distinct entry_id from of_word where word = 'ering'
         except select entry_id from of_word where word = 'rean')""",
    **ENGLISH_TABLES,
)
def _(spark, sf):
    """Words match by stem, and stop words only hold their places."""
    q = broadcast_if_small(b.typed_queries(spark, ENGLISH))
    return fulltext.match(q, spread(b.entries(spark, sf)), spread(b.notes(spark, sf)), english=True).select("query_id", "id")


def _number(c):
    return F.conv(F.substring(c, 1, 8), 16, 10).cast("long")


def _later(entries, notes):
    """The store some edits later: items renamed, extended, gone and new; notes gone and new."""
    n = _number("id")
    edited = entries.withColumn("title", F.when(n % 13 == 2, F.concat(F.lit("Thanedble "), "title")).otherwise(F.col("title")))
    edited = edited.withColumn("body", F.when(n % 13 == 4, F.concat("body", F.lit(" the rewh in la"))).otherwise(F.col("body")))
    new = entries.where(n % 50 == 7).withColumn("id", F.concat(F.lit("f"), F.substring("id", 2, 35)))
    said = entries.where(n % 23 == 1).select(
        F.concat(F.lit("e"), F.substring("id", 2, 35)).alias("id"), F.col("id").alias("entry_id"), F.lit("and esnda of the hehely").alias("body"),
        F.col("updated_at").alias("created_at"), F.lit("me").alias("source"),
    )
    return edited.where(n % 17 != 5).unionByName(new), notes.where(_number("id") % 11 != 3).unionByName(said)


LATER = {
    "entries_old": TABLES["entries"],
    "entries": """select * replace (case when doc_id % 13 = 2 then 'Thanedble ' || title else title end as title,
        case when doc_id % 13 = 4 then body || ' the rewh in la' else body end as body) from entries_old where doc_id % 17 <> 5
      union all select * replace ('f' || substring(id, 2) as id) from entries_old where doc_id % 50 = 7""",
    "notes_old": TABLES["notes"],
    "notes": """select id, entry_id, body, created_at, source from notes_old where cast('0x' || substring(id, 1, 8) as bigint) % 11 <> 3
      union all select 'e' || substring(id, 2), id, 'and esnda of the hehely', updated_at, 'me' from entries_old where doc_id % 23 = 1""",
}


@query("fts_refresh", "select query_id, entry_id as id, round(rank, 6) as rank from ranked", **{**_with_queries(THREE), **LATER})
def _(spark, sf):
    """An index that followed the edits finds what one built anew would."""
    index = _index(spark, sf)
    e, n = _later(spread(b.entries(spark, sf)), spread(b.notes(spark, sf)))
    q = broadcast_if_small(b.typed_queries(spark, THREE))
    return index.refresh(e, n).match(q, e).withColumn("rank", F.round("rank", 6))


TITLE_G = {"title_g": f"select id, title, {trigrams('title')} as g from entries", "asked_g": f"select query_id, query, {trigrams('query')} as g from asked"}


@query(
    "trigram_sim",
    f"""select e.id, a.query_id, round({similarity('e.g', 'a.g')}, 6) as sim from title_g e cross join asked_g a""",
    **TITLE_G, asked="select 5 as query_id, 'And therhean is esnda reedes' as query",
)
def _(spark, sf):
    typed = F.lit("And therhean is esnda reedes")
    sim = text.trigram_similarity(F.col("title"), typed).cast("double")
    return spread(b.entries(spark, sf)).select("id", F.lit(5).alias("query_id"), F.round(sim, 6).alias("sim"))


@query(
    "fuzzy_titles",
    f"select a.query_id, e.id from title_g e cross join asked_g a where {similarity('e.g', 'a.g')} > 0.3::double",
    **TITLE_G, asked=ASKED,
)
def _(spark, sf):
    q = broadcast_if_small(b.recall_queries(spark).where(F.trim("query") != ""))
    return recall.fuzzy_titles(q, spread(b.entries(spark, sf)))


def scored(fuzzy: bool = True) -> dict[str, str]:
    sim = similarity("e.g", "a.g") if fuzzy else "0::double"
    near = f"or {sim} > 0.3::double" if fuzzy else ""
    return {
        **FTS,
        **TITLE_G,
        "live": "select e.*, coalesce(occurred_at, created_at) as at_time, g.g from entries e join title_g g on g.id = e.id where archived_at is null",
        "word_hits": "select m.query_id, m.entry_id, r.rank from matched m join ranked r on r.query_id = m.query_id and r.entry_id = m.entry_id",
        "scored": f"""select a.query_id, e.id, e.at_time, e.kind, round(coalesce(h.rank, 0) * 4 + {sim}
              + case when e.title ilike '%' || a.query || '%' then 0.5 else 0 end, 6) as score
            from live e cross join asked_g a left join word_hits h on h.query_id = a.query_id and h.entry_id = e.id
            where h.rank is not null or e.title ilike '%' || a.query || '%' or e.body ilike '%' || a.query || '%' {near}""",
    }


@query(
    "text_search",
    """select query_id, id, score, position from (select *, row_number() over (partition by query_id order by score desc, at_time desc, id) as position
         from scored) where position <= 25
       union all select q.query_id, e.id, 0.0, e.position from recall_queries q, (select id, row_number() over (order by coalesce(occurred_at, created_at) desc, id) as position
         from entries where archived_at is null) e where trim(q.query) = '' and e.position <= 25""",
    **scored(),
)
def _(spark, sf):
    hits = recall.text_search(b.recall_queries(spark), spread(b.entries(spark, sf)), spread(b.notes(spark, sf)))
    return hits.withColumn("position", F.col("position").cast("bigint"))


@query(
    "text_search_indexed",
    """select query_id, id, score, position from (select *, row_number() over (partition by query_id order by score desc, at_time desc, id) as position
         from scored) where position <= 25""",
    **scored(),
)
def _(spark, sf):
    """Recall from the stored index: words, fragments and title trigrams."""
    q = b.recall_queries(spark).where(F.trim("query") != "")
    hits = recall.text_search(q, spread(b.entries(spark, sf)), b.notes(spark, sf), index=_index(spark, sf))
    return hits.withColumn("position", F.col("position").cast("bigint"))


@query(
    "text_search_plain",
    """select query_id, id, score, position from (select *, row_number() over (partition by query_id order by score desc, at_time desc, id) as position
         from scored where kind = 'reading') where position <= 10""",
    **scored(fuzzy=False),
)
def _(spark, sf):
    """Without fuzzy matching, within one kind."""
    q = broadcast_if_small(b.recall_queries(spark).where(F.trim("query") != ""))
    hits = recall.text_search(q, spread(b.entries(spark, sf)), spread(b.notes(spark, sf)), EntryFilter(kind="essay", limit=10), fuzzy=False)
    return hits.withColumn("position", F.col("position").cast("bigint"))


def _recall_of_kind(kind, text_query):
    def run(spark, sf):
        q = b.typed_queries(spark, [(0, text_query)])
        hits = recall.text_search(q, spread(b.entries(spark, sf)), spread(b.notes(spark, sf)), EntryFilter(kind=kind, limit=50))
        return hits.withColumn("position", F.col("position").cast("bigint"))

    return run


def _kind_oracle(kind, typed):
    return (
        f"""select query_id, id, score, position from (select *, row_number() over (partition by query_id order by score desc, at_time desc, id) as position
         from scored where kind = '{kind}') where position <= 50""",
        {**scored(), "asked": f"select 0 as query_id, '{typed}' as query"},
    )


_sql, _tables = _kind_oracle("person", "the rewh")
query("people", _sql, **_tables)(_recall_of_kind("person", "the rewh"))
_sql, _tables = _kind_oracle("repo", "thanedble")
query("repos", _sql, **_tables)(_recall_of_kind("repo", "thanedble"))


SNIPPETS = {
    **scored(),
    "hits": """select query_id, id, score, position from (select *, row_number() over (partition by query_id order by score desc, at_time desc, id) as position
         from scored) where position <= 25
       union all select q.query_id, e.id, 0.0, e.position from recall_queries q, (select id, row_number() over (order by coalesce(occurred_at, created_at) desc, id) as position
         from entries where archived_at is null) e where trim(q.query) = '' and e.position <= 25""",
    "shown": f"""select h.*, list_filter(string_split_regex(coalesce(e.title, '') || ' — ' || coalesce(e.body, ''), '\\s+'), lambda x: x <> '') as p,
         {WORDS.format("q.query")} as t from hits h join entries e on e.id = h.id join recall_queries q on q.query_id = h.query_id""",
    "flagged": f"select *, list_transform(p, lambda x: len(list_intersect({WORDS.format('x')}, t)) > 0) as hit from shown",
    "spots": "select query_id, id, i, len(list_filter(hit[i : i + 27], lambda y: y)) as n from flagged, range(1, len(hit) + 1) as r(i) where hit[i]",
    "best": "select * from spots qualify row_number() over (partition by query_id, id order by n desc, i) = 1",
}


@query(
    "snippet",
    """select f.query_id, f.id, f.score, f.position, nullif(array_to_string(list_transform(
         range(coalesce(i, 1), least(len(p), coalesce(i, 1) + case when i is null then 7 else 27 end) + 1),
         lambda k: case when hit[k] then '**' || p[k] || '**' else p[k] end), ' '), '') as snippet
       from flagged f left join best b on b.query_id = f.query_id and b.id = f.id""",
    **SNIPPETS,
)
def _(spark, sf):
    q, e = b.recall_queries(spark), spread(b.entries(spark, sf))
    hits = recall.text_search(q, e, spread(b.notes(spark, sf)))
    return recall.with_snippets(hits, q, e).withColumn("position", F.col("position").cast("bigint"))
