"""Embedding, the vector index, nearest neighbours, fusion and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.functions import vectors as v
from keepsake.functions.text import iso
from keepsake.operators import asking, hybrid, index, nearest, recall
from keepsake.operators.embedders import BatchFunction, WordHash
from keepsake.operators.filters import EntryFilter, live
from keepsake.operators.search_index import SearchIndex
from keepsake.plans.registry import query
from keepsake.plans.search import FTS, TERMS, covers, scored
from keepsake.schema import QUESTION_STOPWORDS
from keepsake.session import spread, state_dir
from keepsake.sources import bindings as b

TEXTS = """
select e.id, e.updated_at, e.archived_at, substring(concat_ws(chr(10), nullif(e.title, ''), e.kind, nullif(array_to_string(e.tags, ' '), ''), nullif(e.body, ''),
  'lang: ' || data_lang, 'source: ' || data_source, 'n_chars: ' || data_n_chars, n.thread), 1, 8000) as text
from entries e left join (select entry_id, string_agg(body, chr(10) order by created_at, id) as thread from notes group by 1) n on n.entry_id = e.id"""
STUB = {
    "texts": TEXTS,
    "stub_words": "select id, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) as word from texts",
    "stub_hash": """select word, least(h, 4294967296 - h) % 64 as slot from (select word, list_reduce(list_prepend(cast(2166136261 as bigint),
        list_transform(string_split(word, ''), lambda c: cast(ascii(c) as bigint))), lambda h, c: (xor(h, c) * 16777619) & 4294967295) as h
        from (select distinct word from stub_words))""",
    "stub_counts": "select id, slot, count(*) as n from stub_words w join stub_hash h on h.word = w.word group by 1, 2",
    "stub": "select id, slot, n / sqrt(sum(n * n) over (partition by id)) as x from stub_counts",
}


@query("embedding_text", "select id, md5(text) as digest, length(text) as n_chars from texts", texts=TEXTS)
def _(spark, sf):
    t = index.embedding_text(b.entries(spark, sf), b.notes(spark, sf))
    return t.select("id", F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("n_chars"))


@query("stub_embed", "select id, slot, round(x, 6) as x from stub", **STUB)
def _(spark, sf):
    texts = index.embedding_text(spread(b.entries(spark, sf)), b.notes(spark, sf))
    made = WordHash(64).embed(texts)
    return made.select("id", F.posexplode_outer("vec").alias("slot", "x")).where("x > 0").select(
        "id", F.col("slot").cast("bigint").alias("slot"), F.round("x", 6).alias("x")
    )


@query("l2_normalise", "select vec_id, unnest(range(0, 64)) as slot, round(unnest(list_transform(s, lambda x: x / sqrt(list_sum(list_transform(s, lambda y: y * y))))), 6) as x from (select vec_id, list_transform(embedding, lambda x: cast(x as double) * (1 + vec_id)) as s from embeddings)")
def _(spark, sf):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") + 1))
    e = b.table(spark, sf, "embeddings").select("vec_id", F.posexplode(v.l2_normalise(scaled)).alias("slot", "x"))
    return e.select("vec_id", F.col("slot").cast("bigint").alias("slot"), F.round("x", 6).alias("x"))


@query(
    "embed_provider",
    "select id, cast(length(text) as double) as n_chars, cast(len(regexp_extract_all(text, 'e')) as double) as n_e from texts",
    texts=TEXTS,
)
def _(spark, sf):
    """A caller's own embedder, run in batches on the executors."""

    def lengths(texts: list[str], role: str) -> list:
        return [[float(len(t)), float(t.count("e"))] for t in texts]

    texts = index.embedding_text(b.entries(spark, sf), b.notes(spark, sf))
    made = BatchFunction("lengths:2", lengths, batch_size=64).embed(texts, "document")
    return made.select("id", F.get("vec", F.lit(0)).alias("n_chars"), F.get("vec", F.lit(1)).alias("n_e"))


# -- index upkeep ---------------------------------------------------------------------

PENDING = """
select id from entries where archived_at is null
except select m.entry_id from vectors m, entries e where e.id = m.entry_id and m.provider = 'table:64' and m.source_updated_at >= e.updated_at"""


@query("embed_pending", "select id from pending", pending=PENDING)
def _(spark, sf):
    return index.pending(b.entries(spark, sf), b.vectors(spark, sf), b.PROVIDER).select("id")


@query(
    "embed_status",
    """with held as (select cast(m.source_updated_at < e.updated_at as integer) + cast(m.provider <> 'table:64' as integer) as faults
         from vectors m, entries e where e.id = m.entry_id and e.archived_at is null)
       select (select count(*) from entries where archived_at is null) as total_entries, count(*) as embedded,
         coalesce(cast(sum(faults) as bigint), 0) as stale, false as provider_mismatch, count(*) > 0 as ready from held""",
)
def _(spark, sf):
    return index.status(b.entries(spark, sf), b.vectors(spark, sf), b.PROVIDER)


@query("embed_purge", "select entry_id, provider from vectors where entry_id not in (select id from entries where archived_at is not null)")
def _(spark, sf):
    return index.purge_archived(b.vectors(spark, sf), b.entries(spark, sf)).select("entry_id", "provider")


@query(
    "embed_guard",
    "select provider, len(vec) as dimensions, count(*) as vectors, provider = 'table:64' and len(vec) = 64 as matches from vectors group by 1, 2, 4",
)
def _(spark, sf):
    return index.spaces(b.vectors(spark, sf), b.PROVIDER, 64).withColumn("dimensions", F.col("dimensions").cast("bigint"))


@query(
    "embed_sync",
    """select p.id as entry_id, 'stub:64' as provider, strftime(e.updated_at, '%Y-%m-%dT%H:%M:%S.%fZ') as source_updated_at, true as fresh,
         round(coalesce(s.x, 0), 4) as first_slot
       from pending p join entries e on e.id = p.id left join stub s on s.id = p.id and s.slot = 0
       union all select m.entry_id, case m.provider when 'table:64' then 'stub:64' else m.provider end, strftime(m.source_updated_at, '%Y-%m-%dT%H:%M:%S.%fZ'), false, round(m.vec[1], 4)
       from vectors m where m.entry_id not in (select id from entries where archived_at is not null) and m.entry_id not in (select id from pending)""",
    **STUB, pending=PENDING,
)
def _(spark, sf):
    held = b.vectors(spark, sf).withColumn("provider", F.when(F.col("provider") == b.PROVIDER, "stub:64").otherwise(F.col("provider")))
    out = index.sync(spread(b.entries(spark, sf)), b.notes(spark, sf), held, WordHash(64), b.as_of()).vectors
    return out.select(
        "entry_id", "provider", iso(F.col("source_updated_at")).alias("source_updated_at"),
        F.col("embedded_at").isNotNull().alias("fresh"), F.round(F.get("vec", F.lit(0)).cast("double"), 4).alias("first_slot"),
    )


# -- nearest neighbours ------------------------------------------------------------------

CENTROIDS = """
select label as query_id, list(x order by slot) as vec from (select label, slot, avg(x) as x from
  (select label, unnest(range(1, 65)) as slot, unnest(vec) as x from vectors) group by 1, 2) group by 1"""


def _near(source: str, ceiling: float) -> dict[str, str]:
    return {
        "query_vecs": source,
        "near": f"""select query_id, entry_id, dist, row_number() over (partition by query_id order by dist, entry_id) as rank from (
            select q.query_id, m.entry_id, round(greatest(list_cosine_distance(m.vec, q.vec), 0), 9) as dist
            from query_vecs q cross join vectors m join entries e on e.id = m.entry_id where e.archived_at is null) where dist < {ceiling}""",
        "kept": """select query_id, entry_id, dist, rank from (select *, min(dist) over (partition by query_id) as best,
            max(case when rank = 3 then dist end) over (partition by query_id) as third from near where rank <= 30)
            where (third is null or third - best >= 0.012) and dist <= best + {margin}""",
    }


SELF = "select entry_id as query_id, vec from vectors where provider = 'table:64'"


def _centroid_queries(spark, sf):
    vec = b.vectors(spark, sf)
    return nearest.centroids(vec, F.col("label")).withColumn("provider", F.lit(b.PROVIDER))


def _shown(df):
    return df.select("query_id", "entry_id", F.round("dist", 6).alias("dist"), F.col("rank").cast("bigint").alias("rank"))


@query("vector_knn", "select query_id, entry_id, round(dist, 6) as dist, rank from near where rank <= 30", **_near(CENTROIDS, 0.9))
def _(spark, sf):
    return _shown(nearest.nearest(_centroid_queries(spark, sf), b.vectors(spark, sf), b.entries(spark, sf), b.PROVIDER, ceiling=0.9))


@query("vector_knn_self", "select query_id, entry_id, round(dist, 6) as dist, rank from near where rank <= 30", **_near(SELF, 0.9))
def _(spark, sf):
    """Every vector asks; those of another provider find nothing."""
    vec = b.vectors(spark, sf)
    return _shown(nearest.nearest(vec.withColumnRenamed("entry_id", "query_id"), vec, b.entries(spark, sf), b.PROVIDER, ceiling=0.9))


def _with_margin(tables, margin):
    return {**tables, "kept": tables["kept"].replace("{margin}", str(margin))}


@query("vector_cutoff", "select query_id, entry_id, round(dist, 6) as dist, rank from kept", **_with_margin(_near(CENTROIDS, 0.9), 0.25))
def _(spark, sf):
    q = _centroid_queries(spark, sf)
    return _shown(nearest.vector_search(q, b.vectors(spark, sf), b.entries(spark, sf), b.PROVIDER, ceiling=0.9, margin=0.25))


@query("vector_cutoff_default", "select query_id, entry_id, round(dist, 6) as dist, rank from kept", **_with_margin(_near(SELF, 0.6), 0.08))
def _(spark, sf):
    vec = b.vectors(spark, sf)
    return _shown(nearest.vector_search(vec.withColumnRenamed("entry_id", "query_id"), vec, b.entries(spark, sf), b.PROVIDER))


# -- fusion --------------------------------------------------------------------------------

HYBRID_KINDS = ["movie", "reading", "repo", "thought"]
_IN = "kind in ('movie', 'reading', 'repo', 'thought')"


@query(
    "hybrid_search",
    f"""with t as (select * from (select query_id, id, score, row_number() over (partition by query_id order by score desc, at_time desc, id) as tr from scored where {_IN}) where tr <= 25
           union all select * from (select q.query_id, e.id, 0.0, row_number() over (partition by q.query_id order by coalesce(occurred_at, created_at) desc, id) as tr from recall_queries q
             cross join entries e where trim(q.query) = '' and e.archived_at is null and {_IN}) where tr <= 25),
         vv as (select query_id, entry_id as id, rank as vr from kept where query_id in (select query_id from asked)),
         u as (select coalesce(t.query_id, vv.query_id) as query_id, coalesce(t.id, vv.id) as id, t.score, tr, vr,
             max(case when vr is not null then 1 else 0 end) over (partition by coalesce(t.query_id, vv.query_id)) as any_vector
           from t full outer join vv on vv.query_id = t.query_id and vv.id = t.id),
         f as (select query_id, id, tr, round(case when any_vector = 1 then coalesce(1.0::double / (60 + tr), 0) + coalesce(1.0::double / (60 + vr), 0) else score end, 9) as score,
             case when tr is not null and vr is not null then 'both' when vr is not null then 'vector' else 'text' end as via
           from u where tr is not null or id in (select id from entries where archived_at is null and {_IN})),
         p as (select query_id, id, score, via, row_number() over (partition by query_id order by score desc, tr nulls last, id) as position from f)
       select * from p where position <= 25""",
    **{**scored(), **_with_margin(_near(CENTROIDS, 0.9), 0.25)},
)
def _(spark, sf):
    q = b.recall_queries(spark).join(_centroid_queries(spark, sf), "query_id", "left")
    out = hybrid.hybrid_search(
        q, spread(b.entries(spark, sf)), spread(b.notes(spark, sf)), b.vectors(spark, sf), b.PROVIDER,
        EntryFilter(kinds=HYBRID_KINDS), ceiling=0.9, margin=0.25,
    )
    return out.withColumn("position", F.col("position").cast("bigint"))


# -- questions --------------------------------------------------------------------------------


def _questions(spark, sf):
    """Whole benchmark passages read as questions, with planned searches: the question itself, its halves, one word, or nonsense."""
    i = F.col("item_id")
    w = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    half = F.floor(F.size(w) / 2).cast("int")
    lead = F.array_join(w, " ")
    plan = (
        F.when(i % 4 == 0, F.array().cast("array<string>"))
        .when(i % 4 == 1, F.array(F.array_join(F.slice(w, F.lit(1), half), " "), F.array_join(F.slice(w, half + 1, F.size(w)), " ")))
        .when(i % 4 == 2, F.array(F.concat(F.lit("zz"), F.get(w, F.lit(2)), F.lit("qq"))))
        .otherwise(F.array(F.get(w, F.lit(1))))
    )
    kind = F.when(i % 3 == 0, "essay").when(i % 3 == 1, "nosuchkind")
    tail = F.when(i % 8 == 2, "xqzv").otherwise(lead)
    return b.table(spark, sf, "benchmark").select(
        i.alias("question_id"), F.concat(F.lit(" What about "), tail, F.lit("? ")).alias("question"), kind.alias("kind"), plan.alias("queries")
    )


_STOP = ", ".join(f"'{w}'" for w in QUESTION_STOPWORDS)
QUESTIONS = r"""
select item_id as question_id, 'What about ' || case when item_id % 8 = 2 then 'xqzv' else array_to_string(w, ' ') end || '?' as question,
  case item_id % 3 when 0 then 'reading' when 1 then 'nosuchkind' end as kind,
  case item_id % 4 when 0 then cast([] as varchar[]) when 1 then [array_to_string(w[1 : len(w) // 2], ' '), array_to_string(w[len(w) // 2 + 1 :], ' ')] when 2 then ['zz' || w[3] || 'qq'] else [w[2]] end as queries
from (select item_id, regexp_extract_all(text, '[\p{L}\p{N}]+') as w from benchmark)"""
# questions are long, so covers are worked out for the items that hold every word only
MOST_WORDS = 64
LONG_COVERS = covers(MOST_WORDS)
LONG_COVERS["placed_occ"] = LONG_COVERS["placed_occ"].replace("from occ", "from occ_met")
ASK = {
    **scored(),
    **LONG_COVERS,
    "occ_met": "select o.* from occ o join matched m on m.query_id = o.query_id and m.entry_id = o.entry_id",
    "terms": TERMS,
    "questions": QUESTIONS,
    "planned": "select question_id, kind, unnest(qs) as query, unnest(range(0, len(qs))) as no from (select *, case when len(queries) > 0 then queries else [question] end as qs from questions)",
    "spoken": f"""select question_id, unnest(ws) as query, unnest(range(0, len(ws))) as no from (select question_id,
        list_filter(list_filter(ws, lambda x, i: list_position(ws, x) = i), lambda x: x not in ({_STOP}))[1:6] as ws from (select question_id,
          regexp_extract_all(lower(question), '[a-z][a-z''-]{{3,}}') as ws from questions))""",
    "asks": """select row_number() over (order by stage, question_id, no) as query_id, * from (
        select 1 as stage, question_id, kind, query, no from planned union all select 2, question_id, null, query, no from planned where kind is not null
        union all select 3, question_id, null, query, no from spoken)""",
    "asked": "select query_id, query from asks",
    "stage_hits": """select * from (select a.stage, a.question_id, a.no, s.id, s.score, row_number() over (partition by s.query_id order by s.score desc, s.at_time desc, s.id) as position
        from scored s join asks a on a.query_id = s.query_id where a.kind is null or a.kind = s.kind) where position <= 10""",
    "first_stage": "select question_id, min(stage) as stage from stage_hits group by 1",
    "merged": """select stage, question_id, id, score, row_number() over (partition by question_id order by score desc, seen, id) as rank from (
        select h.stage, h.question_id, h.id, max(h.score) as score, min(h.no * 1000 + h.position) as seen from stage_hits h
        join first_stage f on f.question_id = h.question_id and f.stage = h.stage group by 1, 2, 3)""",
    "candidates": """select question_id, stage, id, score, rank from merged where rank <= 24
        union all select question_id, 4, id, 0.0, rank from (select q.question_id, e.id, row_number() over (partition by q.question_id order by coalesce(e.occurred_at, e.created_at) desc, e.id) as rank
          from questions q cross join entries e where q.question_id not in (select question_id from first_stage) and e.archived_at is null and (q.kind is null or q.kind = e.kind)) where rank <= 24""",
}


def _candidates(spark, sf):
    e, n = spread(b.entries(spark, sf)), spread(b.notes(spark, sf))
    words = SearchIndex.build(e, n, state_dir(spark, "ask-index"))

    def search(queries):
        return recall.text_search(queries, e, n, EntryFilter(limit=asking.PER_QUERY), index=words)

    return asking.retrieve(_questions(spark, sf), e, search)


@query("ask_retrieval", "select * from candidates", **ASK)
def _(spark, sf):
    out = _candidates(spark, sf)
    return out.select("question_id", F.col("stage").cast("bigint").alias("stage"), "id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(
    "multi_query_merge",
    """select question_id, id, score, rank from (select question_id, id, score, row_number() over (partition by question_id order by score desc, seen, id) as rank
         from (select query_id % 2 as question_id, id, max(score) as score, min((query_id // 2) * 1000 + position) as seen from (select *,
           row_number() over (partition by query_id order by score desc, at_time desc, id) as position from scored) where position <= 10 group by 1, 2)) where rank <= 24""",
    **scored(),
)
def _(spark, sf):
    q = b.recall_queries(spark).where(F.trim("query") != "")
    hits = recall.text_search(q, spread(b.entries(spark, sf)), spread(b.notes(spark, sf)), EntryFilter(limit=asking.PER_QUERY))
    named = hits.select((F.col("query_id") % 2).alias("question_id"), F.floor(F.col("query_id") / 2).alias("query_no"), "id", "score", "position")
    return asking.merge_queries(named).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "ask_context",
    """select c.question_id, c.rank, c.id, concat_ws(chr(10), '[' || substring(e.id, 1, 8) || '] ' || coalesce(title, '(untitled)') || ' — ' || kind, 'status: ' || status,
         'rating: ' || rating || '/10', 'tags: ' || nullif(array_to_string(tags, ', '), ''), 'captured: ' || strftime(coalesce(occurred_at, created_at), '%Y-%m-%d'),
         'reminder: ' || strftime(remind_at, '%Y-%m-%d'), 'lang: ' || data_lang || ' | source: ' || data_source || ' | n_chars: ' || data_n_chars,
         case when length(body) > 600 then substring(body, 1, 600) || '…' else nullif(body, '') end) as block
       from entries e join (select id as question_id, id, 1 as rank from entries where archived_at is null) c on e.id = c.id""",
)
def _(spark, sf):
    """Every live item as a grounding block."""
    e = b.entries(spark, sf)
    c = e.where(live()).select(F.col("id").alias("question_id"), "id", F.lit(1).cast("bigint").alias("rank"))
    return asking.context_blocks(c, e)


_BLOCK = """'[' || substring(e.id, 1, 8) || '] ' || coalesce(title, '(untitled)') || ' — ' || e.kind, 'status: ' || status,
         'rating: ' || rating || '/10', 'tags: ' || nullif(array_to_string(tags, ', '), ''), 'captured: ' || strftime(coalesce(occurred_at, created_at), '%Y-%m-%d'),
         'reminder: ' || strftime(remind_at, '%Y-%m-%d'), 'lang: ' || data_lang || ' | source: ' || data_source || ' | n_chars: ' || data_n_chars,
         case when length(body) > 600 then substring(body, 1, 600) || '…' else nullif(body, '') end"""


@query(
    "ask_grounding",
    f"""select question_id, string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) as context from (
         select c.question_id, c.rank, concat_ws(chr(10), {_BLOCK}, t.lines) as block from candidates c join entries e on e.id = c.id
         left join (select c.question_id, c.id, string_agg('note (' || strftime(n.created_at, '%Y-%m-%d') || '): ' || n.body, chr(10) order by n.created_at, n.id) as lines
           from candidates c join notes n on n.entry_id = c.id where c.rank <= 8 group by 1, 2) t on t.question_id = c.question_id and t.id = c.id)
       group by 1""",
    **ASK,
)
def _(spark, sf):
    """Each question's whole grounding text."""
    return asking.contexts(_candidates(spark, sf), b.entries(spark, sf), b.notes(spark, sf))


@query(
    "ask_context_notes",
    """select question_id, rank, c.id, n.id as note_id, 'note (' || strftime(n.created_at, '%Y-%m-%d') || '): ' || n.body as line
       from candidates c join notes n on n.entry_id = c.id where rank <= 8""",
    **ASK,
)
def _(spark, sf):
    out = asking.context_notes(_candidates(spark, sf), b.notes(spark, sf))
    return out.select("question_id", F.col("rank").cast("bigint").alias("rank"), "id", "note_id", "line")
