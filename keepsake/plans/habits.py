"""The prompt log and what it shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.functions.text import iso
from keepsake.operators import prompts as p
from keepsake.plans.registry import query
from keepsake.sources import bindings as b

CAPTURES = "action in ('jot', 'capture', 'flow_capture', 'flow_capture_many', 'telegram_capture') and input is not null"
RESIDUE = r"length(regexp_replace(input, 'https?://\S+', '', 'g'))"
# One row of flags per call; the habits are sums of them.
FLAGS = rf"""select regexp_matches(input, '(?i)https?://') as linked, {RESIDUE} > 25 as reasoned,
  regexp_matches(input, '(^|\s)#[\p{{L}}\p{{N}}]') as tagged, n_entries > 1 as several from prompts where {CAPTURES}"""
HABITS = f"""select count(*) as captures, {", ".join(f"coalesce(cast(sum(cast({of} as integer)) as bigint), 0) as {name}" for name, of in (
    ("with_url", "linked"), ("url_with_reason", "(linked and reasoned)"), ("bare_url", "(linked and not reasoned)"), ("with_hashtags", "tagged"), ("multi_entry", "several")))}
from ({FLAGS})"""


@query(
    "log_prompts",
    """select p.id, p.surface, p.action, substring(p.input, 1, 8000) as input, coalesce(t.tags, '') as tags, coalesce(k.kinds, '') as kinds,
         cast(p.ms as bigint) as ms, p.ok, p.error
       from prompts p
       left join (select id, string_agg(tag, ' ' order by first) as tags from
           (select id, tag, min(pos * 1000 + i) as first from (select id, pos, unnest(tags) as tag, unnest(range(1, len(tags) + 1)) as i
              from prompt_entries) group by id, tag) group by id) t on t.id = p.id
       left join (select id, string_agg(kind, ' ' order by first) as kinds from
           (select id, kind, min(pos) as first from prompt_entries group by id, kind) group by id) k on k.id = p.id""",
)
def _(spark, sf):
    return b.prompts(spark, sf).select(
        "id", "surface", "action", "input",
        F.array_join("tags", " ").alias("tags"), F.array_join("kinds", " ").alias("kinds"),
        F.col("ms").cast("bigint").alias("ms"), "ok", "error",
    )


@query("prompt_totals", "select count(*) as total, strftime(min(at_time), '%Y-%m-%dT%H:%M:%S.%fZ') as since from prompts")
def _(spark, sf):
    return p.totals(b.prompt_calls(spark, sf)).withColumn("since", iso(F.col("since")))


@query("prompts_by_surface", "select surface, count(*) as n from prompts group by 1")
def _(spark, sf):
    return p.count_by(b.prompt_calls(spark, sf), "surface")


@query("prompts_by_action", "select action, count(*) as n from prompts group by 1")
def _(spark, sf):
    return p.count_by(b.prompt_calls(spark, sf), "action")


@query(
    "prompt_lengths",
    """select cast(round_even(coalesce(quantile_cont(length(input), 0.5), 0), 0) as bigint) as median,
         cast(round_even(coalesce(quantile_cont(length(input), 0.9), 0), 0) as bigint) as p90,
         coalesce(min(length(input)), 0) as shortest, coalesce(max(length(input)), 0) as longest from prompts where input is not null""",
)
def _(spark, sf):
    out = p.lengths(b.prompt_calls(spark, sf))
    return out.select(*[F.col(c).cast("bigint").alias(c) for c in out.columns])


@query("prompt_habits", HABITS)
def _(spark, sf):
    return p.habits(b.prompt_calls(spark, sf))


@query(
    "prompt_rates",
    f"""select cast(floor(h.with_url * 100.0 / nullif(h.captures, 0) + 0.5) as bigint) as pct_with_url,
         cast(floor(h.url_with_reason * 100.0 / nullif(h.with_url, 0) + 0.5) as bigint) as pct_url_with_reason,
         cast(floor(h.bare_url * 100.0 / nullif(h.with_url, 0) + 0.5) as bigint) as pct_bare_url,
         cast(floor(h.with_hashtags * 100.0 / nullif(h.captures, 0) + 0.5) as bigint) as pct_with_hashtags,
         b.hour as busiest_hour, b.n as busiest_n
       from ({HABITS}) h,
         (select extract(hour from at_time) as hour, count(*) as n from prompts group by 1 order by n desc, hour limit 1) b""",
)
def _(spark, sf):
    out = p.rates(b.prompt_calls(spark, sf))
    return out.select(*[F.col(c).cast("bigint").alias(c) for c in out.columns])


@query(
    "prompt_shelves",
    """select tag, count(*) as n from (select distinct id, unnest(tags) as tag from prompt_entries) group by tag
       order by count(*) desc, tag limit 12""",
)
def _(spark, sf):
    return p.top_shelves(b.prompts(spark, sf))


@query("prompts_by_hour", "select extract(hour from at_time) as hour, count(*) as n from prompts group by 1")
def _(spark, sf):
    return p.by_hour(b.prompt_calls(spark, sf)).withColumn("hour", F.col("hour").cast("bigint"))


@query("prompt_failures", "select action, coalesce(error, '?') as error, count(*) as n from prompts where not ok group by 1, 2 order by n desc, action, error limit 10")
def _(spark, sf):
    return p.failures(b.prompt_calls(spark, sf))
