"""Streams over several files, one a trigger, with late and repeated rows, against batch versions."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from lucerna.catalog.stream_queries import drained
from lucerna.operators.evidence import latest_round
from lucerna.operators.records import compact_events
from lucerna.streaming import feeds

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


@pytest.fixture()
def place(tmp_path):
    return f"file://{tmp_path}"


def stream_of(spark, place, name, schema, files):
    """A stream of these lists of rows, a file and a trigger each."""
    folder = f"{place}/{name}"
    local = folder.removeprefix("file://")
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        for file in os.listdir(local):
            if file.startswith("part") and not os.path.exists(f"{local}/.{file}.seen"):
                open(f"{local}/.{file}.seen", "w").close()
                os.utime(f"{local}/{file}", (time.time() - 1000 + i, time.time() - 1000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def collected(spark, stream, place):
    drained_query = drained(stream, feeds.once_a_batch(f"{place}/out"), place)
    rows = spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{place}/out").collect() if os.path.exists(f"{place}/out".removeprefix("file://")) else []
    return drained_query, rows


CLAIMS = "analysis_id long, claim_id long, attempt int"


def test_latest_rounds_over_batches(spark, place):
    files = [[(1, 10, 0), (2, 20, None), (3, 30, 2), (5, 50, None)], [(1, 11, 1), (2, 21, None), (3, 31, 1)], [(4, 40, 0), (1, 12, 1), (5, 51, 0)]]
    held = feeds.LatestRounds(spark, f"{place}/rounds", CLAIMS, buckets=3)
    assert held.read().count() == 0
    drained(stream_of(spark, place, "in", CLAIMS, files), held.merge, place)
    every = spark.createDataFrame([x for f in files for x in f], CLAIMS)
    want = sorted(tuple(r) for r in latest_round(every).collect())
    key = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert key(held.read().collect()) == key(latest_round(every).collect()) and (1, 10, 0) not in want
    # A replayed batch changes nothing; a batch whose rows were written without its version is done again.
    held.merge(spark.createDataFrame(files[1], CLAIMS), 1)
    spark.createDataFrame([(9, 90, 9, 0)], CLAIMS + ", bucket int").write.partitionBy("bucket").parquet(f"{place}/rounds/rows/3")
    assert key(held.read().collect()) == key(latest_round(every).collect())
    held.merge(spark.createDataFrame([(1, 13, 2)], CLAIMS), 3)
    assert key(held.read().collect()) == key(latest_round(every.union(spark.createDataFrame([(1, 13, 2)], CLAIMS))).collect())


EVENTS = "run_id long, event_id long, ts timestamp, event string, message string"


def test_compaction_while_events_arrive(spark, place):
    files = [
        [(1, 1, at(0), "a", "x"), (1, 2, at(1), "a", "longer"), (2, 3, at(1), "b", None), (1, 6, at(6), "b", "m")],
        # Within the delay, and before rows that are there.
        [(1, 4, at(3), "a", "short"), (1, 5, at(4), "b", "first"), (2, 7, at(2), "b", "some"), (2, 8, None, "b", "no time")],
        [(1, 9, at(30), "b", "last one"), (1, 10, at(31), "c", "c"), (2, 11, at(30), "a", "y")],
        [(-1, 99, at(100_000), "end", None)],
    ]
    stream = stream_of(spark, place, "in", EVENTS, files).withWatermark("ts", "10 minutes")
    _, got = collected(spark, feeds.compacted(stream), place)
    every = spark.createDataFrame([x for f in files[:3] for x in f if x[2]], EVENTS)
    want = {(r.run_id, r.island, r.event, r.ts, r.events, r.message) for r in compact_events(every).collect()}
    assert {tuple(r) for r in got} == want and len(got) == len(want) == 5


def test_idle_runs_close(spark, place):
    files = [[(1, 1, at(0), "a", "x")], [(2, 2, at(300), "b", "y")], [(1, 3, at(301), "a", "z")], [(-1, 99, at(100_000), "end", None)]]
    import pandas as pd

    stream = stream_of(spark, place, "in", EVENTS, files).withWatermark("ts", "1 minute")
    _, got = collected(spark, feeds.compacted(stream, pd.Timedelta(hours=1)), place)
    assert sorted((r.run_id, r.island, r.events) for r in got) == [(1, 1, 1), (1, 2, 1), (2, 1, 1)]


TICKETS = "ticket string, event_id long, ts timestamp, event string"


def test_tickets_leave_the_state(spark, place):
    second = lambda s: START + dt.timedelta(seconds=s)
    files = [
        [(f"t{i}", i, second(i), "issue") for i in range(20)] + [("t0", 100, second(5), "use"), ("t0", 101, second(6), "use")],
        [("t1", 102, second(50), "use"), ("t2", 103, second(90), "use"), ("never", 104, second(60), "use")],
        [("late", 105, second(1000), "issue")],
        [("late", 106, second(1030), "use"), ("t5", 107, second(1031), "use")],
    ]
    stream = stream_of(spark, place, "in", TICKETS, files).withWatermark("ts", "10 seconds")
    done, got = collected(spark, feeds.ticket_checks(stream, expire=True), place)
    assert {r.event_id: r.accepted for r in got} == {100: True, 101: False, 102: True, 103: False, 104: False, 106: True, 107: False}
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in done.recentProgress if p["stateOperators"]]
    assert max(sizes) >= 20 and sizes[-1] < 5


def test_revocations_between_streams(spark, place):
    hour = lambda h: START + dt.timedelta(hours=h)
    requests = [[(1, "a", hour(1)), (2, "b", hour(2))], [(3, "a", hour(5)), (4, "b", hour(6)), (5, "a", hour(20))], [(6, "c", hour(21)), (-1, "end", hour(900))]]
    revoked = [[("a", hour(1.5), hour(10))], [("b", hour(6), hour(6.5)), ("a", hour(3), hour(8)), ("b", hour(1), hour(1.5))], [("end2", hour(900), hour(901))]]
    left = stream_of(spark, place, "requests", "request_id long, token string, ts timestamp", requests).withWatermark("ts", "1 hour")
    right = stream_of(spark, place, "revoked", "token string, revoked_at timestamp, expires_at timestamp", revoked).withWatermark("revoked_at", "1 hour")
    done, got = collected(spark, feeds.checked_requests(left, right, "12 hours"), place)
    assert {r.request_id: r.revoked for r in got if r.request_id > 0} == {1: False, 2: False, 3: True, 4: True, 5: False, 6: False}
    assert len(got) == len({r.request_id for r in got})
    joined = [max(p["stateOperators"], key=lambda o: o["numRowsTotal"])["numRowsTotal"] for p in done.recentProgress if p["stateOperators"]]
    assert joined[-1] < max(joined)


def test_feed_with_repeats_and_late_rows(spark, place):
    schema = "event_id long, ts timestamp"
    files = [[(1, at(0)), (1, at(0)), (2, at(1))], [(2, at(1)), (3, at(60)), (3, at(61))], [(6, at(61))], [(4, at(2)), (5, at(55)), (3, at(62))]]
    stream = stream_of(spark, place, "in", schema, files).withWatermark("ts", "10 minutes")
    done, got = collected(spark, feeds.event_feed(stream), place)
    assert sorted(r.event_id for r in got) == [1, 2, 3, 5, 6]
    # Of the last file, event 4 came after the watermark that the batch before had.
    assert feeds.dropped_late(done) == 1
    replay = spark.createDataFrame([(7, at(0))], schema)
    for _ in range(2):
        feeds.once_a_batch(f"{place}/again")(replay, 4)
    assert spark.read.parquet(f"{place}/again").count() == 1
    assert feeds.event_stream(spark, f"{place}/in", schema).isStreaming


def test_lockouts_without_a_time(spark):
    rows = spark.createDataFrame([(1, 1, None, False), (1, 2, at(0), False)], "user_id long, event_id long, ts timestamp, success boolean")
    assert [r.event_id for r in feeds.lockouts(rows).collect()] == [2]


def test_rounds_without_attempts(spark):
    rows = spark.createDataFrame([(1, 1, None), (1, 2, None)], CLAIMS)
    assert latest_round(rows).count() == 2 and rows.where(F.col("attempt").isNull()).count() == 2
