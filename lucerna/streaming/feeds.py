"""Structured Streaming versions of the event-feed operators.

Stream time is the event's; watermarks bound the state. Operators whose rule needs more than a window keep state
per key with transformWithStateInPandas, on the RocksDB store. Rows without a time are left out of what is ordered by time.

Results that later rows take back can't be appended: they are merged by key into a versioned table (LatestRounds), once a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.evidence import latest_round

# Events after which a run says no more.
TERMINAL = ["analysis.completed", "analysis.failed", "analysis.abstained", "analysis.timeout"]


def event_stream(spark: SparkSession, path: str, schema: StructType | str, ts: str = "ts", delay: str = "10 minutes", files: int | None = None) -> DataFrame:
    """STM-01: appended files as an event stream with a watermark."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def event_feed(events: DataFrame, key: str = "event_id") -> DataFrame:
    """STM-01: each event once. events has a watermark: repeats within its delay are dropped, and so is what comes later than that."""
    return events.dropDuplicatesWithinWatermark([key])


def once_a_batch(path: str):
    """A sink for foreachBatch that writes each batch's rows to a place of its own: a batch that is replayed after a failure replaces itself."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return keep


def dropped_late(query: StreamingQuery) -> int:
    """Rows that came after their watermark, from the query's progress."""
    return sum(operator["numRowsDroppedByWatermark"] for progress in query.recentProgress for operator in progress["stateOperators"])


def retained(events: DataFrame, now, days: int = 30, ts: str = "ts") -> DataFrame:
    """STM-03: rows within the time to live."""
    return events.where(F.col(ts) > now - F.expr(f"INTERVAL {days} DAYS"))


def rate_limited(events: DataFrame, key: str, limit: int, span: str = "1 minute", ts: str = "ts") -> DataFrame:
    """STM-05: key, window and requests where they exceed the limit; batch and stream alike."""
    counts = events.groupBy(F.window(ts, span).alias("w"), key).agg(F.count(F.lit(1)).alias("requests"))
    return counts.where(F.col("requests") > limit).select(key, F.col("w.start").alias("window_start"), "requests")


def lockout_sessions(failures: DataFrame, key: str, limit: int = 5, gap: str = "900 seconds", ts: str = "ts") -> DataFrame:
    """STM-04's approximation: sessions of failures with at least `limit` of them."""
    sessions = failures.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("failures"))
    return sessions.select(key, F.col("w.start").alias("session_start"), "failures", (F.col("failures") >= limit).alias("locked"))


def live_counters(events: DataFrame, column: str) -> DataFrame:
    """STM-08: totals that only grow; complete or update mode."""
    return events.groupBy(column).agg(F.count(F.lit(1)).alias("total"))


def not_revoked(requests: DataFrame, revoked: DataFrame, now) -> DataFrame:
    """STM-07: requests whose token isn't on the list of unexpired revocations."""
    return requests.join(revoked.where(F.col("expires_at") > now).select("token"), "token", "left_anti")


def checked_requests(requests: DataFrame, revocations: DataFrame, longest: str = "24 hours") -> DataFrame:
    """STM-07 for streams: request_id, token, ts and revoked: whether a revocation of the token held at the request's time.

    requests: request_id, token, ts; revocations: token, revoked_at, expires_at; both with watermarks. No token lives longer than
    `longest`, so revocations leave the state that long after their time, and a request waits until the watermark of revocations has passed it.
    """
    taken = revocations.select(F.col("token").alias("_token"), "revoked_at", "expires_at")
    within = F.expr(f"revoked_at <= ts AND revoked_at >= ts - INTERVAL {longest}")
    joined = requests.join(taken, (requests["token"] == taken["_token"]) & within & (taken["expires_at"] > requests["ts"]), "left_outer")
    # Several revocations of a token are one answer.
    return joined.select("request_id", "token", "ts", F.col("revoked_at").isNotNull().alias("revoked")).dropDuplicatesWithinWatermark(["request_id"])


def in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's new rows of a batch by time, without those that have none."""
    events = pd.concat(list(rows))
    return events[events["ts"].notna()].sort_values(["ts", "event_id"])


class Lockout(StatefulProcessor):
    """STM-04 exactly: failures within the gap add up, success clears, attempts while locked aren't recorded."""

    limit, gap = 5, 900.0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("failures", "failures int, last double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = in_order(rows)
        count, last = self.state.get() if self.state.exists() else (0, 0.0)
        out = []
        for event_id, ts, ok in zip(events["event_id"], events["ts"], events["success"], strict=True):
            at = ts.timestamp()
            if at - last > self.gap:
                count = 0
            locked = count >= self.limit
            if not locked:
                count, last = (0, at) if ok else (count + 1, at)
            out.append((key[0], int(event_id), locked))
        self.state.update((int(count), float(last)))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "locked"])

    def close(self) -> None:
        pass


def lockouts(attempts: DataFrame) -> DataFrame:
    """STM-04: user_id, event_id and whether the attempt met a lock. attempts: user_id, event_id, ts, success."""
    return attempts.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=Lockout(), outputStructType="user_id long, event_id long, locked boolean", outputMode="Append", timeMode="None"
    )


class Tickets(StatefulProcessor):
    """STM-06: a ticket is good once, within 60 seconds of its issue. Its state goes when the watermark has passed that time."""

    valid = 60.0

    def __init__(self, timers: bool = False):
        self.timers = timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("ticket", "issued double, used boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = in_order(rows)
        issued, used = self.state.get() if self.state.exists() else (None, False)
        out = []
        for event_id, ts, kind in zip(events["event_id"], events["ts"], events["event"], strict=True):
            at = ts.timestamp()
            if kind == "issue":
                issued, used = at, False
            else:
                good = issued is not None and not used and 0 <= at - issued <= self.valid
                used = used or good
                out.append((key[0], int(event_id), good))
        if issued is not None:
            self.state.update((float(issued), bool(used)))
            if self.timers:
                self.handle.registerTimer(int((issued + self.valid) * 1000) + 1)
        yield pd.DataFrame(out, columns=["ticket", "event_id", "accepted"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A ticket that was issued again has a later end.
        if self.state.exists() and (self.state.get()[0] + self.valid) * 1000 < timerValues.getCurrentWatermarkInMs():
            self.state.clear()
        yield pd.DataFrame({"ticket": [], "event_id": [], "accepted": []}).astype({"ticket": "object", "event_id": "int64", "accepted": "bool"})

    def close(self) -> None:
        pass


def ticket_checks(events: DataFrame, expire: bool = False) -> DataFrame:
    """STM-06. events: ticket, event_id, ts, event (issue or use); with `expire` they have a watermark, and tickets leave the state."""
    return events.groupBy("ticket").transformWithStateInPandas(
        statefulProcessor=Tickets(expire), outputStructType="ticket string, event_id long, accepted boolean", outputMode="Append", timeMode="EventTime" if expire else "None"
    )


class LatestRounds:
    """STM-10: claims of each analysis' last round, in a versioned table that every batch of a stream is merged into.

    Rows are placed by a hash of the analysis into buckets. A batch rewrites the buckets that it touches, under its own number, and then
    one row a bucket in `versions` says so: a bucket's latest version is its state. A batch that is there already is not merged again,
    and one that failed half-way replaces its own rows. Null attempts count as in latest_round.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "analysis_id", buckets: int = 8):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.schema = f"{schema}, bucket int"

    def versions(self) -> list:
        """The latest version of each bucket."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return []
        return self.spark.read.schema("bucket int, batch long").parquet(f"{self.path}/versions").groupBy("bucket").agg(F.max("batch").alias("batch")).collect()

    def _read(self, versions: list) -> DataFrame:
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.path}/rows/{v.batch}").where(F.col("bucket") == v.bucket) for v in versions]
        out = self.spark.createDataFrame([], self.schema)
        for part in parts:
            out = out.unionByName(part)
        return out

    def read(self) -> DataFrame:
        return self._read(self.versions()).drop("bucket")

    def merge(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch."""
        versions = self.versions()
        if any(v.batch >= number for v in versions):
            return
        placed = batch.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")).persist()
        touched = sorted(r.bucket for r in placed.select("bucket").distinct().collect())
        if touched:
            before = self._read([v for v in versions if v.bucket in touched])
            merged = latest_round(before.unionByName(placed.select(before.columns)), self.key)
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/{number}")
            self.spark.createDataFrame([(b, number) for b in touched], "bucket int, batch long").coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
        placed.unpersist()


class Compaction(StatefulProcessor):
    """STM-11: neighbouring events of one name as one row, while they arrive.

    Rows wait until the watermark has passed them, since earlier ones may still come; then they extend the key's open run, or close it and open the next.
    A run that has been idle so long in event time closes too.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, event_id long, event string, message string")
        self.run = handle.getValueState("run", "island long, event string, first long, last long, events long, message string, message_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = in_order(rows)
        new = [
            (int(ts.value // 1000), int(i), e, m) for ts, i, e, m in zip(events["ts"], events["event_id"], events["event"], events["message"], strict=True)
        ]
        if new:
            self.waiting.appendList(new)
            # A timer is due when the watermark has reached it; rows of that very millisecond may still come.
            self.handle.registerTimer(min(x[0] for x in new) // 1000 + 1)
        yield self._rows(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get())
        ready = [x for x in waiting if x[0] // 1000 < reached]
        rest = waiting[len(ready) :]
        run, out = self.run.get() if self.run.exists() else None, []
        for us, event_id, event, message in ready:
            if run and run[1] == event and us - run[3] <= self.idle_ms * 1000:
                island, _, first, _, events, longest, longest_id = run
                better = message is not None and (longest is None or len(message) > len(longest))
                run = (island, event, first, us, events + 1, message if better else longest, event_id if better else longest_id)
            else:
                out += [run] if run else []
                run = ((run[0] if run else 0) + 1, event, us, us, 1, message, event_id)
        if run and not rest and run[3] // 1000 + self.idle_ms < reached:
            out.append(run)
            run = (run[0], None, 0, 0, 0, None, 0)
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        elif ready:
            self.waiting.clear()
        if run:
            self.run.update(run)
            if run[1] is not None and not rest:
                self.handle.registerTimer(run[3] // 1000 + self.idle_ms + 1)
        yield self._rows(key, [x for x in out if x[1] is not None])

    def _rows(self, key, runs: list) -> pd.DataFrame:
        out = pd.DataFrame([(key[0], i, e, pd.Timestamp(f, unit="us"), n, m) for i, e, f, _, n, m, _ in runs], columns=["run_id", "island", "event", "ts", "events", "message"])
        return out.astype({"run_id": "int64", "island": "int64", "events": "int64", "ts": "datetime64[us]"})

    def close(self) -> None:
        pass


def compacted(events: DataFrame, idle: pd.Timedelta = pd.Timedelta(days=30)) -> DataFrame:
    """STM-11. events: run_id, event_id, ts, event, message, with a watermark on ts. Closed runs alone come out, each once; as
    compact_events has them where no pause inside a run is longer than `idle`."""
    return events.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=Compaction(int(idle / pd.Timedelta(milliseconds=1))), outputStructType="run_id long, island long, event string, ts timestamp, events long, message string",
        outputMode="Append", timeMode="EventTime",
    )


class Consumer(StatefulProcessor):
    """STM-02: a run's events until a terminal one; nothing after it, and an end when the run is idle too long."""

    idle_ms = 360_000

    def __init__(self, timers: bool = True):
        self.timers = timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = in_order(rows)
        done = self.state.get()[0] if self.state.exists() else False
        out = []
        for event_id, event in zip(events["event_id"], events["event"], strict=True):
            if done:
                break
            out.append((key[0], int(event_id), event))
            done = event in TERMINAL
        self.state.update((bool(done),))
        if self.timers:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if self.timers and not done:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=["run_id", "event_id", "event"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.update((True,))
        yield pd.DataFrame({"run_id": [key[0]], "event_id": [-1], "event": ["idle"]})

    def close(self) -> None:
        pass


def run_feed(events: DataFrame, idle_timers: bool = True) -> DataFrame:
    """STM-02. events: run_id, event_id, ts, event. Without idle timers a run over what is available ends by itself."""
    return events.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=Consumer(idle_timers), outputStructType="run_id long, event_id long, event string", outputMode="Append",
        timeMode="ProcessingTime" if idle_timers else "None",
    )
