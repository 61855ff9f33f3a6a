"""Headline queries, timed: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from keepsake.operators import capture  # noqa: E402
from keepsake.plans.catalog import QUERIES  # noqa: E402
from keepsake.session import build_session, stored  # noqa: E402
from keepsake.sources import bindings  # noqa: E402

HEADLINE = [
    "list_entries",
    "shelf_tree",
    "shelf_samples",
    "briefing",
    "prompt_habits",
    "prompt_lengths",
    "capture_normalise",
    "capture_idempotent",
    "import_items",
    "apply_updates",
    "entry_links",
    "resolve_refs",
    "find_duplicates",
    "fts_match",
    "fts_rank3",
    "text_search",
    "stub_embed",
    "embed_sync",
    "vector_knn",
    "vector_knn_self",
    "hybrid_search",
    "page_meta",
    "enrich_captures",
    "news_since",
]
# Run too, but not part of the total, which stays comparable from round to round.
MORE = ["text_search_indexed", "fts_refresh", "ask_retrieval", "capture_many", "stream_capture"]


def timed(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def replay(spark, sf_dir: str) -> dict[str, float]:
    """Seconds of a first delivery, and of the same requests once their ids are stored."""
    requests = bindings.capture_requests(spark, sf_dir).where("capture_id IS NOT NULL")
    entries = bindings.entries(spark, sf_dir)
    out = {}
    for name in ("first", "replay"):
        t0 = time.perf_counter()
        made = stored(capture.capture(requests, entries), f"bench-{name}")
        out[name] = round(time.perf_counter() - t0, 3)
        entries = entries.unionByName(made.select(entries.columns))
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    QUERIES["list_entries"](spark, sf_dir).count()  # start the executors before the clock
    seconds = {}
    for name in names:
        seconds[name] = round(timed(spark, name, sf_dir), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    more = {name: round(timed(spark, name, sf_dir), 3) for name in ([] if sys.argv[1:] else MORE)}
    delivery = {} if sys.argv[1:] else replay(spark, sf_dir)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "more": more, "delivery": delivery, "sf": float(sf)}))


if __name__ == "__main__":
    main()
