"""Hand rows in the shape of the store's tables."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from keepsake.schema import ENTRY, NOTE

T0 = datetime(2024, 1, 1)


def entry(id, kind="thought", title=None, body=None, minutes=0, **more):
    at = T0 + timedelta(minutes=minutes)
    row = {
        "id": id, "kind": kind, "title": title, "body": body, "data": {}, "tags": [], "status": None, "rating": None,
        "occurred_at": None, "remind_at": None, "source": "api", "archived_at": None, "created_at": at, "updated_at": at,
        "last_checked_at": None, "capture_id": None,
    }
    row.update(more)
    return tuple(row[f] for f in ENTRY.fieldNames())


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), ENTRY)


def notes(spark, *rows):
    made = [(i, e, b, T0 + timedelta(minutes=m), s) for i, e, b, m, s in rows]
    return spark.createDataFrame(made, NOTE)


REQUEST = (
    "seq long, capture_id string, kind string, title string, body string, data map<string,string>, tags array<string>, "
    "status string, rating int, occurred_at timestamp, remind_at timestamp, source string, requested_at timestamp"
)


def requests(spark, *rows):
    made = []
    for i, r in enumerate(rows):
        made.append((
            r.get("seq", i), r.get("capture_id"), r.get("kind"), r.get("title"), r.get("body"), r.get("data"), r.get("tags"),
            r.get("status"), r.get("rating"), None, None, r.get("source", "api"), T0 + timedelta(minutes=r.get("minutes", 0)),
        ))
    return spark.createDataFrame(made, REQUEST)


def as_of():
    return F.lit(datetime(2024, 2, 1))


def apply(spark, rule, *values):
    """A one-column rule over hand values."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(rule(F.col("v"))).collect()]
