"""The store's tables bound onto the supplied parquet files.

Each function derives one table from whole input tables; nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.session import prepare, spread

# midnights, as seconds since the epoch in UTC
JAN_01, JAN_02, JAN_03, JAN_10, JAN_15, JAN_20, JAN_30, JAN_31 = (
    1704067200 + 86400 * d for d in (0, 1, 2, 9, 14, 19, 29, 30)
)
DEC_01 = 1704067200 - 86400 * 31


def as_of() -> Column:
    """The moment time-dependent operators are asked about."""
    return F.timestamp_seconds(F.lit(JAN_31))


PROVIDER = "table:64"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def make_id(n: Column) -> Column:
    return F.concat(F.lpad(F.lower(F.hex(n)), 8, "0"), F.lit("-0000-4000-8000-000000000000"))


def at(start: int, minutes: Column) -> Column:
    return F.timestamp_seconds(F.lit(start) + minutes * 60)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def count_of(df: DataFrame) -> int:
    """Row count, read from file footers."""
    return df.count()


def first_line_title(body: Column) -> Column:
    return F.split_part(body, F.lit("\n"), F.lit(1))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    created = at(JAN_01, (d * 37) % 43200)
    status = (
        F.when((d % 9 == 1) & (d % 4 == 0), "watched")
        .when((d % 9 == 1) & (d % 4 == 1), "want")
        .when((d % 9 == 1) & (d % 4 == 2), "dropped")
        .when((d % 9 == 3) & (d % 3 == 0), "read")
        .when(d % 9 == 3, "queued")
        .when((d % 9 == 4) & (d % 2 == 0), "done")
        .when(d % 9 == 4, "open")
        .when(d % 9 == 8, "starred")
    )
    kinds = F.array(*[F.lit(k) for k in ("thought", "movie", "person", "reading", "task", "fact", "place", "idea", "repo")])
    lang = F.concat(F.lit("lang/"), "lang")
    tags = (
        F.when(d % 13 == 0, F.array().cast("array<string>"))
        .when(d % 2 == 0, F.array(lang, F.col("source")))
        .otherwise(F.array(F.concat(lang, F.lit("/"), "source"), F.lit("inbox")))
    )
    return documents(spark, sf_dir).select(
        make_id(d).alias("id"),
        F.get(kinds, (d % 9).cast("int")).alias("kind"),
        first_line_title(F.col("text")).alias("title"),
        F.col("text").alias("body"),
        F.create_map(
            F.lit("lang"), "lang", F.lit("source"), "source", F.lit("n_chars"), F.col("n_chars").cast("string")
        ).alias("data"),
        tags.alias("tags"),
        status.alias("status"),
        F.when(d % 5 == 0, (d % 10 + 1).cast("int")).alias("rating"),
        F.when(d % 3 == 0, at(DEC_01, (d * 53) % 43200)).alias("occurred_at"),
        F.when(d % 7 == 0, at(JAN_15, (d * 29) % 43200)).alias("remind_at"),
        F.lit("api").alias("source"),
        F.when(d % 11 == 0, F.timestamp_seconds(F.lit(JAN_30))).alias("archived_at"),
        created.alias("created_at"),
        at(JAN_01, (d * 37) % 43200 + (d % 5) * 1440).alias("updated_at"),
        F.when(d % 4 == 0, at(JAN_10, (d * 17) % 20000)).alias("last_checked_at"),
        F.when(d % 6 == 0, F.concat(F.lit("device:"), d.cast("string"))).alias("capture_id"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = count_of(documents(spark, sf_dir))
    c, t = F.col("conv_id"), F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        make_id(c * 100 + t).alias("id"),
        make_id((c * 7 + t) % n).alias("entry_id"),
        F.col("text").alias("body"),
        at(JAN_20, (c * 61 + t * 3) % 14400).alias("created_at"),
        F.when(F.col("role") == "user", "me").when(F.col("role") == "assistant", "research").otherwise("api").alias("source"),
    )


def link_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as requested links, repeats and self links included."""
    n = count_of(documents(spark, sf_dir))
    rel = F.when(F.col("o_orderstatus") == "F", "recommended").when(F.col("o_orderstatus") == "P", " about ").otherwise(" ")
    return table(spark, sf_dir, "orders").select(
        make_id(F.col("o_orderkey")).alias("id"),
        make_id(F.col("o_custkey") % n).alias("from_id"),
        make_id(F.col("o_orderkey") % n).alias("to_id"),
        rel.alias("rel"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = count_of(documents(spark, sf_dir))
    rel = F.when(F.col("o_orderstatus") == "F", "recommended").when(F.col("o_orderstatus") == "P", "about").otherwise("related")
    return (
        table(spark, sf_dir, "orders")
        .select(
            make_id(F.col("o_custkey") % n).alias("from_id"),
            make_id(F.col("o_orderkey") % n).alias("to_id"),
            rel.alias("rel"),
        )
        .where(F.col("from_id") != F.col("to_id"))
        .distinct()
    )


def prompt_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls_of(table(spark, sf_dir, "events"), documents(spark, sf_dir))


def calls_of(events: DataFrame, docs: DataFrame) -> DataFrame:
    """Events, at rest or streamed, read as handled calls, each worded after one document."""
    worded = _worded(_bare_calls(events, count_of(docs)), docs)
    return worded.select("id", "at", "surface", "action", "input", "entry_ids", "ms", "ok", "error")


def _bare_calls(events: DataFrame, n: int) -> DataFrame:
    """Calls without their inputs, with the event's number and that of the document they are worded after."""
    e = F.col("event_id")
    surface = F.get(F.array(*[F.lit(s) for s in ("web", "api", "cli", "telegram", "mcp")]), (F.col("user_id") % 5).cast("int"))
    action = (
        F.when(F.col("event_type") == "click", "capture")
        .when(F.col("event_type") == "view", "ask")
        .when(F.col("event_type") == "purchase", "jot")
        .when(F.col("event_type") == "signup", "flow_capture")
        .otherwise("telegram_capture")
    )
    ids = (
        F.when(e % 8 == 0, F.array(make_id(F.col("k")), make_id((F.col("k") + 1) % n)))
        .when(F.col("event_type") == "view", F.array().cast("array<string>"))
        .otherwise(F.array(make_id(F.col("k"))))
    )
    error = F.when((F.col("event_type") == "error") & (e % 2 == 0), "timeout")
    return events.withColumn("k", e % n).select(
        "k",
        "event_id",
        make_id(e).alias("id"),
        F.col("ts").cast("timestamp").alias("at"),
        surface.alias("surface"),
        action.alias("action"),
        ids.alias("entry_ids"),
        F.floor("value").cast("int").alias("ms"),
        (F.col("event_type") != "error").alias("ok"),
        error.alias("error"),
    )


def _worded(calls: DataFrame, docs: DataFrame) -> DataFrame:
    """Calls with their inputs; those of no document drop out."""
    e = F.col("event_id")
    wording = F.concat(
        F.when(e % 3 == 0, F.concat(F.lit("https://example.com/p/"), e.cast("string"), F.lit(" "))).otherwise(""),
        F.when(e % 6 == 0, "").otherwise(F.col("text")),
        F.when(e % 4 == 0, F.concat(F.lit(" #"), "lang", F.lit("/"), "doc_source")).otherwise(""),
    )
    texts = docs.select(F.col("doc_id").alias("k"), "text", "lang", F.col("source").alias("doc_source"))
    return calls.join(texts, "k").withColumn("input", wording)


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepsake.operators.prompts import INPUT_CHARS, log_prompts

    docs = documents(spark, sf_dir)
    # a prompt is cut to so many letters, so no more of a document need travel
    texts = docs.withColumn("text", F.substring("text", 1, INPUT_CHARS))
    calls = _bare_calls(table(spark, sf_dir, "events"), count_of(docs))
    return log_prompts(calls, entries(spark, sf_dir), lambda known: _worded(known, texts))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        make_id(v).alias("entry_id"),
        F.when(v % 19 == 0, "old:64").otherwise(PROVIDER).alias("provider"),
        F.col("embedding").alias("vec"),
        at(JAN_03, (v * 37) % 43200).alias("source_updated_at"),
        "label",
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"))


def tagged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with meta tags of their own in front: both orders of attributes, both quotes, some tags outranked by others."""
    p = F.col("page_id")
    n = p.cast("string")

    def tag(when: Column, *pieces) -> Column:
        return F.when(when, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in pieces])).otherwise("")

    tags = [
        tag(p % 5 == 0, '<meta property="og:title" content="OG ', n, ' &amp; co">'),
        tag(p % 5 < 2, "<meta content='Tw ", n, "' name='twitter:title'>"),
        tag(p % 3 == 0, '<META NAME="description" data-x="1" CONTENT="Plain words of ', n, '">'),
        tag(p % 6 == 0, '<meta content="Og says ', n, '&#33;" property="og:description" />'),
        tag(p % 6 == 1, '<meta property="og:description" content=" "><meta name="twitter:description" content="Bird ', n, '">'),
        tag(p % 4 == 0, '<meta property="og:site_name" content="Site ', (p % 7).cast("string"), '">'),
        tag(p % 2 == 0, '<meta name="author" content="Author ', (p % 11).cast("string"), '">'),
        tag(p % 3 == 1, '<meta content="Writer ', n, '" property="article:author">'),
    ]
    return pages(spark, sf_dir).withColumn("html", F.concat(*tags, "html"))


def linked_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with readings tied to a crawled page; odd ones carry an outdated title."""
    p = pages(spark, sf_dir)
    n = count_of(p)
    crawl = p.select(
        F.col("page_id"),
        F.col("url"),
        F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), "&amp;", "&").alias("page_title"),
    )
    base = entries(spark, sf_dir).withColumn("doc_id", F.conv(F.substring("id", 1, 8), 16, 10).cast("bigint"))
    reading = F.col("kind") == "reading"
    joined = (
        base.where(reading)
        .withColumn("page_id", F.col("doc_id") % n)
        .join(crawl, "page_id", "left")
        .unionByName(base.where(~reading), allowMissingColumns=True)
    )
    kept = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace(F.trim("page_title"), r"\s+", " ")).otherwise("stale title")
    url = F.when(F.col("url").isNotNull(), F.create_map(F.lit("url"), F.col("url"))).otherwise(
        F.create_map().cast("map<string,string>")
    )
    return joined.withColumn("title", F.when(F.col("url").isNotNull(), kept).otherwise(F.col("title"))).withColumn(
        "data", F.map_concat("data", url)
    ).drop("doc_id", "page_id", "url", "page_title")


def capture_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_of(spread(documents(spark, sf_dir)))


def requests_of(docs: DataFrame) -> DataFrame:
    """Documents, at rest or streamed, read as capture requests with typed hashtags and links."""
    d = F.col("doc_id")
    body = F.concat(
        "text",
        F.when(d % 2 == 0, F.concat(F.lit(" #ai/harness #"), "source")).otherwise(""),
        F.when(d % 3 == 0, F.concat(F.lit(" https://example.com/a/b_"), d.cast("string"), F.lit(".pdf."))).otherwise(""),
    )
    raw_kind = F.get(
        F.array(*[F.lit(k) for k in ("note", "Film", " contact ", "essay", "todo", "fact", "restaurant", "project", "github", "", "memo")]),
        (d % 11).cast("int"),
    )
    return docs.select(
        d.alias("seq"),
        F.when(d % 6 == 0, F.concat(F.lit("device:"), (d % 300).cast("string"))).alias("capture_id"),
        raw_kind.alias("kind"),
        F.when((d % 4 == 0) & (d % 10 != 8), first_line_title(F.col("text"))).alias("title"),
        F.when(d % 10 == 8, F.lit(None).cast("string")).when(d % 10 == 9, F.concat(F.lit("https://example.com/x/"), F.col("source"), F.lit("_report.html"))).otherwise(body).alias("body"),
        F.when(
            d % 10 == 8,
            F.create_map(F.lit("lang"), F.col("lang"), F.lit("url"), F.concat(F.lit("https://example.com/docs/Some_Long%20Name+"), "source", F.lit(".pdf?x=1"))),
        ).otherwise(F.create_map(F.lit("lang"), F.col("lang"))).alias("data"),
        F.array(F.concat(F.lit("#Lang / "), F.upper("lang")), F.col("source"), F.concat(F.col("source"), F.lit("/"))).alias("tags"),
        F.when(d % 12 == 0, " starred ").otherwise(F.lit("")).alias("status"),
        F.lit(None).cast("int").alias("rating"),
        F.lit(None).cast("timestamp").alias("occurred_at"),
        F.lit(None).cast("timestamp").alias("remind_at"),
        F.lit("api").alias("source"),
        at(JAN_31, d % 1440).alias("requested_at"),
    )


def jots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns read as jots: one element of extracted JSON per line; some were found empty."""
    c, t = F.col("conv_id"), F.col("turn")
    none = F.lit(None).cast("string")
    lines = F.when(c % 5 != 0, F.split("text", "\n")).otherwise(F.array().cast("array<string>"))
    parts = F.transform(
        lines,
        lambda line, i: F.struct(
            F.when(F.col("role") == "user", "note").otherwise("essay").alias("kind"),
            none.alias("title"),
            line.alias("body"),
            F.array(F.col("role")).alias("tags"),
            F.array(
                F.struct(F.lit("line").alias("key"), F.lit("replaced").alias("value")),
                F.struct(F.lit("").alias("key"), F.lit("dropped").alias("value")),
                F.struct(F.lit("line").alias("key"), i.cast("string").alias("value")),
            ).alias("data"),
            none.alias("status"),
        ),
    )
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", F.lit("jot"), c.cast("string"), t.cast("string")).alias("capture_id"),
        F.concat(F.lit("said "), "text", F.lit(" #talk/log")).alias("text"),
        F.to_json(F.struct(parts.alias("entries"))).alias("extracted"),
        F.lit("jot").alias("source"),
        at(JAN_31, c % 1440).alias("requested_at"),
    )


def import_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts read as starred-repository JSON lines; every fifth in the bare shape."""
    repo = F.struct(
        F.when(F.col("p_partkey") % 17 != 16, F.col("p_partkey")).alias("id"),
        F.concat("p_brand", F.lit("/"), "p_name").alias("full_name"),
        F.concat(F.lit("https://example.com/"), F.col("p_partkey").cast("string")).alias("html_url"),
        F.col("p_size").alias("stargazers_count"),
        F.array(F.lower("p_type")).alias("topics"),
        F.struct(F.lower("p_brand").alias("login")).alias("owner"),
    )
    wrapped = F.to_json(F.struct(F.lit("2024-01-02T00:00:00Z").alias("starred_at"), repo.alias("repo")))
    return table(spark, sf_dir, "part").select(
        F.when(F.col("p_partkey") % 5 == 0, F.to_json(repo)).otherwise(wrapped).alias("value")
    )


def recall_queries(spark: SparkSession) -> DataFrame:
    """What a person types: one or two words, a slip of the keys, a fragment, a miss, nothing."""
    rows = [
        (0, "thanedble"),
        (1, "harness"),
        (2, "the rewh"),
        (3, "inoran hehely"),
        (4, "Eriner thanea"),
        (5, "And therhean is esnda reedes"),
        (6, "ledre"),
        (7, "zzqqxx"),
        (8, "  "),
        (9, "de la"),
    ]
    return typed_queries(spark, rows)


def typed_queries(spark: SparkSession, rows: list[tuple[int, str]]) -> DataFrame:
    """Queries as inline values, whose size the optimizer knows."""
    values = ", ".join(f"({i}, '{q}')" for i, q in rows)
    return prepare(spark).sql(f"select * from values {values} as v(query_id, query)")
