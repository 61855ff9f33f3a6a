import json

from helpers import REQUEST, entries, requests
from pyspark.sql import functions as F

from keepsake.streaming import capture as cs
from keepsake.streaming import imports as ims
from keepsake.streaming import prompts as ps


def _run(q):
    q.awaitTermination()
    assert q.exception() is None


def test_replays_in_later_batches_are_no_ops(spark, tmp_path):
    box, out, mark = (str(tmp_path / d) for d in ("in", "out", "mark"))
    requests(spark, {"capture_id": "a", "body": "one"}, {"body": "free"}, {"capture_id": "a", "body": "retry"}).coalesce(1).write.parquet(box)
    def start():
        stream = spark.readStream.schema(REQUEST).parquet(box)
        _run(cs.capture_stream(stream, entries(spark), out, mark))
    start()
    requests(spark, {"seq": 10, "capture_id": "a", "body": "late"}, {"seq": 11, "capture_id": "b", "body": "two"}, {"seq": 12, "body": "free"}).coalesce(1).write.mode("append").parquet(box)
    start()
    rows = cs.captured(spark, out).collect()
    assert sorted((r["capture_id"] or "", r["body"]) for r in rows) == [("", "free"), ("", "free"), ("a", "one"), ("b", "two")]
    assert {r["batch"] for r in rows} == {0, 1}


def test_bounded_dedup_keeps_unkeyed(spark, tmp_path):
    box, out, mark = (str(tmp_path / d) for d in ("in", "out", "mark"))
    requests(spark, {"capture_id": "a"}, {"capture_id": "a"}, {}, {}).write.parquet(box)
    kept = cs.drop_recent_retries(spark.readStream.schema(REQUEST).parquet(box))
    _run(kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start())
    got = [r["capture_id"] for r in spark.read.parquet(out).collect()]
    assert sorted(got, key=str) == [None, None, "a"]


def test_hourly_counts_accumulate(spark, tmp_path):
    box, out, mark = (str(tmp_path / d) for d in ("in", "out", "mark"))
    schema = "at timestamp, surface string, action string, ok boolean"
    def add(rows):
        df = spark.createDataFrame(rows, "at string, surface string, action string, ok boolean")
        df.select(F.to_timestamp("at").alias("at"), "surface", "action", "ok").coalesce(1).write.mode("append").parquet(box)
        _run(ps.counts_stream(spark.readStream.schema(schema).parquet(box), out, mark))
    add([("2024-01-01 10:05:00", "web", "ask", True), ("2024-01-01 10:55:00", "web", "ask", False)])
    add([("2024-01-01 10:30:00", "web", "ask", True), ("2024-01-01 11:00:00", "api", "jot", True)])
    got = {(r["hour"].hour, r["surface"]): (r["n"], r["failed"]) for r in ps.current_counts(spark, out).collect()}
    assert got == {(10, "web"): (3, 1), (11, "api"): (1, 0)}


def test_late_calls_count(spark, tmp_path):
    box, out, mark = (str(tmp_path / d) for d in ("in", "out", "mark"))
    schema = "at timestamp, surface string, action string, ok boolean"
    for day, ok in (("20", True), ("21", True), ("03", False), ("20", False), ("03", True)):
        df = spark.createDataFrame([(f"2024-01-{day} 10:05:00", "web", "ask", ok)], "at string, surface string, action string, ok boolean")
        df.select(F.to_timestamp("at").alias("at"), "surface", "action", "ok").coalesce(1).write.mode("append").parquet(box)
        _run(ps.counts_stream(spark.readStream.schema(schema).parquet(box), out, mark))
    got = {r["hour"].day: (r["n"], r["failed"]) for r in ps.current_counts(spark, out).collect()}
    assert got == {20: (2, 1), 21: (1, 0), 3: (2, 1)}


def test_late_requests_pass_the_bounded_dedup(spark, tmp_path):
    box, out, mark = (str(tmp_path / d) for d in ("in", "out", "mark"))
    for minutes, key in ((60 * 24 * 30, "new"), (60 * 24 * 31, "newer"), (0, "late"), (0, "late")):
        requests(spark, {"capture_id": key, "minutes": minutes}, {"minutes": minutes}).coalesce(1).write.mode("append").parquet(box)
        kept = cs.drop_recent_retries(spark.readStream.schema(REQUEST).parquet(box))
        _run(kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start())
    stored = spark.read.parquet(out)
    assert sorted((r["capture_id"] for r in stored.collect()), key=str) == [None, None, None, None, "late", "new", "newer"]
    assert "arrived_at" not in stored.columns


def test_streams_read_tables_in_parts(spark, tmp_path):
    import os

    import pytest

    import __spark_entry__ as contract

    sf, parts = "/root/testdata/sf0.001", str(tmp_path / "parts")
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    for name in os.listdir(sf):
        if name.endswith(".parquet"):
            spark.read.parquet(f"{sf}/{name}").repartition(3).write.parquet(f"{parts}/{name}")
    for name in ("stream_capture", "stream_prompts"):
        want, got = (sorted(map(tuple, contract.queries()[name](spark, d).collect()), key=repr) for d in (sf, parts))
        assert want and got == want


def test_imports_count_what_is_known(spark, tmp_path):
    box, out, mark = (str(tmp_path / d) for d in ("in", "out", "mark"))
    def add(*items):
        spark.createDataFrame([(json.dumps(i),) for i in items], "value string").coalesce(1).write.mode("append").text(box)
        lines = spark.readStream.schema("value string").text(box)
        _run(ims.import_stream(lines, entries(spark), F.lit("2024-01-31").cast("timestamp"), out, mark))
    add({"starred_at": "2024-01-02T00:00:00Z", "repo": {"id": 1, "full_name": "o/one", "topics": ["x", "y"], "archived": True, "description": None}}, {"id": 2, "full_name": "o/two"}, {"repo": {"full_name": "no id"}})
    add({"repo": {"id": 1, "full_name": "o/one again"}}, {"repo": {"id": 3, "full_name": "o/three"}})
    counts = {r["batch"]: (r["imported"], r["skipped"], r["total_seen"]) for r in ims.batch_counts(spark, out).collect()}
    assert counts == {0: (2, 0, 3), 1: (1, 1, 2)}
    rows = {r["capture_id"]: r for r in cs.captured(spark, f"{out}/items").collect()}
    one = rows["github:repo:1"]
    assert one["title"] == "o/one" and one["status"] == "starred" and one["data"]["topics"] == "x, y" and one["data"]["archived"] == "yes" and "summary" not in one["data"]


def test_stored_ids_are_read_by_folder_and_merged(spark, tmp_path):
    from keepsake.streaming import ledger

    ids = ledger.stored_ids(spark, str(tmp_path / "ids"))
    row = lambda ks: spark.createDataFrame([(k, f"i-{k}") for k in ks], "capture_id string, id string")
    assert ids.read().count() == 0
    ledger.seed_ids(ids, row(["s1", "s2"]))
    ledger.seed_ids(ids, row(["never"]))
    for n in range(5):
        ledger.add_ids(ids, n, row([f"b{n}x{k}" for k in range(200)]), merge_every=3)
    ledger.add_ids(ids, 4, row(["again"]), merge_every=3)  # a retried batch replaces its part
    wanted = row(["b1x7", "again", "nobody"]).select("capture_id")
    known = ledger.known_ids(ids, wanted, 5)
    plan = known._jdf.queryExecution().executedPlan().toString()
    filters = [line.split("PartitionFilters: [")[1].split("], PushedFilters")[0] for line in plan.split("\n") if "PartitionFilters" in line]
    assert len(filters) == 2 and all("bucket#" in f and " IN (" in f for f in filters)
    used = {(r["merged"], r["bucket"]) for r in ids._parts("merged").where("capture_id IN ('b1x7', 's1')").collect()}
    assert {m for m, _ in used} == {0, 3} and {"b1x7", "again"} <= {r["capture_id"] for r in known.collect()}
    assert "merged#" in filters[0] and "= 3" in filters[0]
    every = {r["capture_id"] for r in ids.read().collect()}
    assert every == {"s1", "s2", "again"} | {f"b{n}x{k}" for n in range(4) for k in range(200)}
    assert {r["capture_id"] for r in ids.read(3).collect()} == every - {"again"} - {f"b3x{k}" for k in range(200)}


def test_merged_counts_stay_the_same(spark, tmp_path):
    from keepsake.streaming.ledger import Ledger

    counts = Ledger(spark, str(tmp_path / "c"), ps.COUNTS)
    for n in range(4):
        counts.add(n, spark.sql(f"select timestamp '2024-01-01 0{n % 2}:00:00' hour, 'web' surface, 'ask' action, {n + 1}L n, 0L failed"))
    before = {tuple(r) for r in ps.current_counts(spark, counts.path).collect()}
    counts.merge(3, ps._summed(counts.read(3)))
    assert {tuple(r) for r in ps.current_counts(spark, counts.path).collect()} == before and len(before) == 2
