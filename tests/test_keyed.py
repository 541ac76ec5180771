"""Keyed streaming state against plain loops, with restarts and former state."""

import math
from datetime import datetime, timedelta

import pytest

from lodestar.streaming import keyed

START = datetime(2024, 1, 1)
REJECTS = "key string, seq long, at timestamp, body string, accepted boolean"
EVENTS = "key string, seq long, event string, item_id string, label string, rows long, at timestamp"


def fed(spark, path, batches, schema, start, checkpoint):
    """Each batch is a run of the query that ends; the next goes on from its checkpoint."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        start(spark.readStream.schema(schema).parquet(f"{path}/in"), checkpoint).awaitTermination()


def reject(key, seq, seconds, accepted=False):
    return (key, seq, START + timedelta(seconds=seconds), f"b{seq}", accepted)


@pytest.mark.parametrize("with_former", [False, True])
def test_buffers_by_key_after_restarts(spark, tmp_path, with_former):
    path = f"file://{tmp_path}"
    former = [reject("a", -1, 95)[:4], reject("old", -2, 99)[:4]]
    batches = [
        [reject("a", i, i) for i in range(10)] + [reject("b", 100, 5), reject("b", 101, 6, True)],
        [reject("a", 9, 9), *(reject("a", i, 90 + i) for i in range(10, 13)), reject("c", 7, 101)],
    ]
    rate = math.log(2) / 40  # a quarter is left after 80 seconds
    initial = spark.createDataFrame(former, "key string, seq long, at timestamp, body string") if with_former else None
    fed(spark, path, batches, REJECTS, lambda s, at: keyed.buffer_rejects(s, at, 4, rate, 0.25, initial=initial), f"{path}/c")
    found = sorted((r["key"], r["seq"], r["body"]) for r in keyed.buffered(spark, f"{path}/c").collect())
    # The last time is 102 s, so what came before 22 s has gone; of "a" the last four by number stayed each time.
    expected = [("a", i, f"b{i}") for i in (10, 11, 12)] + [("c", 7, "b7")]
    assert found == sorted(expected + ([("old", -2, "b-2")] if with_former else []))


def test_pending_items_under_a_budget(spark, tmp_path):
    path = f"file://{tmp_path}"
    at = lambda s: START + timedelta(seconds=s)
    event = lambda key, seq, what, item, s, rows=1: (key, seq, what, item, "x", rows, at(s))
    batches = [
        [event("k", 1, "cached", "i1", 1), event("k", 2, "cached", "i2", 2), event("k", 3, "cached", "i3", 3), event("m", 1, "cached", "i1", 1)],
        [event("k", 4, "blocked", "i3", 4), event("k", 5, "cached", "i4", 5), event("k", 6, "cached", "i1", 6, 99), event("k", 7, "resolved", "i2", 7)],
        [event("k", 8, "cached", "i5", 8), event("k", 9, "cached", "i6", 9), event("k", 10, "resolved", "i3", 10)],
    ]
    fed(spark, path, batches, EVENTS, lambda s, c: keyed.pending_items(s, c, 2), f"{path}/c")
    found = {(r["key"], r["item_id"]): (r["location"], r["status"], r["rows"]) for r in keyed.items(spark, f"{path}/c").collect()}
    # i1 goes over budget first; the blocked i3 next, then i4 (i2 was resolved); i3 is resolved in the archive.
    assert found == {("k", "i1"): ("archived", "pending", 1), ("k", "i4"): ("archived", "pending", 1), ("k", "i5"): ("hot", "pending", 1), ("k", "i6"): ("hot", "pending", 1), ("m", "i1"): ("hot", "pending", 1)}


def test_items_that_wait_too_long_are_archived(spark, tmp_path):
    path = f"file://{tmp_path}"
    at = lambda s: START + timedelta(seconds=s)
    initial = spark.createDataFrame([("k", "i0", "x", 5, "pending", "hot", at(0)), ("k", "done", "x", 5, "pending", "archived", at(0))], "key string, item_id string, label string, rows long, status string, location string, at timestamp")
    batches = [[("k", 1, "cached", "i1", "x", 1, at(50))], [("z", 2, "cached", "i2", "x", 1, at(100))]]
    fed(spark, path, batches, EVENTS, lambda s, c: keyed.pending_items(s, c, 9, wait=60, initial=initial), f"{path}/c")
    found = {r["item_id"]: r["location"] for r in keyed.items(spark, f"{path}/c").collect()}
    assert found == {"i0": "archived", "done": "archived", "i1": "hot", "i2": "hot"}
