"""Text and vector recall fused by rank (Cormack, Clarke and Büttcher, 2009)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake.operators.filters import EntryFilter
from keepsake.operators.nearest import vector_search
from keepsake.operators.recall import text_search
from keepsake.operators.search_index import SearchIndex
from keepsake.operators.views import by_ids
from keepsake.schema import RRF_K


def fuse(text_hits: DataFrame, vector_hits: DataFrame, entries: DataFrame, filters: EntryFilter = EntryFilter()) -> DataFrame:
    """(query_id, id, score, via, position).

    ``text_hits``: query_id, id, score, position. ``vector_hits``: query_id,
    entry_id, rank. Each side adds 1 / (60 + rank). An item only the vectors
    found must pass the filters, but one that fails still holds its rank. A
    query the vectors know nothing for keeps its text scores.
    """
    t = text_hits.select("query_id", "id", "score", F.col("position").alias("text_rank"), F.lit(None).cast("int").alias("vector_rank"))
    v = vector_hits.select(
        "query_id", F.col("entry_id").alias("id"), F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("int").alias("text_rank"), F.col("rank").alias("vector_rank"),
    )
    # one row per side and pair: the outer join is a union and a small aggregate
    both = (
        t.unionByName(v)
        .groupBy("query_id", "id")
        .agg(F.max("score").alias("score"), F.max("text_rank").alias("text_rank"), F.max("vector_rank").alias("vector_rank"))
    )
    allowed = by_ids(entries, v, filters).select("id", F.lit(True).alias("allowed"))
    per_query = Window.partitionBy("query_id")
    has_text, has_vector = F.col("text_rank").isNotNull(), F.col("vector_rank").isNotNull()

    def part(rank: str):
        return F.coalesce(F.lit(1.0) / (F.col(rank) + RRF_K), F.lit(0.0))

    fused = (
        both.withColumn("any_vector", F.max(has_vector).over(per_query))
        .join(allowed, "id", "left")
        .where(has_text | F.col("allowed"))
        .withColumn("score", F.round(F.when(F.col("any_vector"), part("text_rank") + part("vector_rank")).otherwise(F.col("score")), 9))
        .withColumn("via", F.when(has_text & has_vector, "both").when(has_vector, "vector").otherwise("text"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("text_rank"), "id")
    return (
        fused.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= filters.size)
        .select("query_id", "id", "score", "via", "position")
    )


def hybrid_search(
    queries: DataFrame, entries: DataFrame, notes: DataFrame, vectors: DataFrame, provider: str,
    filters: EntryFilter = EntryFilter(), postings: DataFrame | None = None, index: SearchIndex | None = None, **cutoffs,
) -> DataFrame:
    """Recall for queries with text and vector: query_id, query, provider, vec.

    A blank query is a listing, so its vector is not looked at.
    """
    text_hits = text_search(queries.select("query_id", "query"), entries, notes, filters, postings=postings, index=index)
    asked = queries.where(F.trim("query") != "").where(F.col("vec").isNotNull())
    vector_hits = vector_search(asked, vectors, entries, provider, **cutoffs)
    return fuse(text_hits, vector_hits, entries, filters)
