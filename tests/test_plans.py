"""The physical plans that matter at scale."""

from helpers import entries, entry, requests
from pyspark.sql import functions as F

from keepsake.operators import capture, fulltext, shelf_tree, views
from keepsake.operators.filters import EntryFilter
from keepsake.session import broadcast_if_small


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    path = str(tmp_path / "entries")
    entries(spark, entry("a"), entry("b", kind="movie")).write.parquet(path)
    stored = spark.read.parquet(path)
    p = plan(views.list_entries(stored, EntryFilter(kinds=["Film", "todo"], status="want", since="2024-01-02")).select("id"))
    assert "In(kind, [movie,task])" in p and "IsNull(archived_at)" in p and "EqualTo(status,want)" in p and "GreaterThanOrEqual(created_at" in p
    assert "TakeOrderedAndProject" in p
    schema = p.split("ReadSchema: ")[1].split(">")[0]
    assert "body" not in schema and "data" not in schema


def test_top_k_per_key_is_cut_before_the_shuffle(spark):
    p = plan(capture.first_writers(requests(spark, {"capture_id": "a"})))
    assert "WindowGroupLimit" in p and "Partial" in p
    assert "WindowGroupLimit" in plan(shelf_tree.shelf_samples(entries(spark, entry("a", tags=["x"]))))


def test_matching_broadcasts_the_words_and_crosses_nothing(spark):
    e = entries(spark, entry("a", title="red"))
    n = spark.createDataFrame([], "id string, entry_id string, body string, created_at timestamp, source string")
    q = broadcast_if_small(spark.createDataFrame([(1, "red")], "query_id int, query string"))
    p = plan(fulltext.match(q, e, n))
    assert "BroadcastHashJoin" in p and "CartesianProduct" not in p and "NestedLoop" not in p


def test_requests_without_an_id_skip_the_join(spark):
    e = entries(spark, entry("a", capture_id="k"))
    r = requests(spark, {"body": "x"}, {"capture_id": "k", "body": "y"})
    fresh = capture.to_store(r, e)
    assert [x["body"] for x in fresh.collect()] == ["x"]
    assert "Union" in plan(fresh)
    assert fresh.where(F.col("capture_id").isNotNull()).count() == 0
