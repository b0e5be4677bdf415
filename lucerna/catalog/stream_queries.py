"""Streaming operators run to the end of what is there; results are what the sink holds then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import shared_folder
from ..streaming import feeds
from . import query, table

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
END = "2100-01-01"


def drained(stream: DataFrame, sink, place: str, mode: str = "append") -> StreamingQuery:
    """One run over what is available, into a foreachBatch sink."""
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        done = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").foreachBatch(sink).trigger(availableNow=True).start()
        done.awaitTermination()
    finally:
        if before is not None:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return done


def new_place(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The stream's output as a table in the shared folder, after one run over what is available."""
    spark, place = stream.sparkSession, new_place(stream.sparkSession)
    drained(stream, feeds.once_a_batch(f"{place}/out"), place, mode)
    # No batch at all, without input, leaves no folder.
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{place}/out/batch=-1")
    out = spark.read.option("basePath", f"{place}/out").schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(f"{place}/out")
    if mode == "complete":
        last = out.agg(F.max("batch").alias("last"))
        out = out.join(F.broadcast(last), out["batch"] == last["last"]).drop("last")  # one row
    return out.drop("batch")


def events_stream(spark, d) -> DataFrame:
    schema = table(spark, d, "events").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    return reader.parquet(f"{d}/events*").withColumn("ts", F.col("ts").cast("timestamp"))


def with_end(spark, events: DataFrame) -> DataFrame:
    """The stream with one more row, of no user, so late that the watermark passes all others: the feed's end."""
    place = f"{new_place(spark)}/end"
    schema = events.schema
    row = spark.range(1).select(*[(F.lit(END).cast("timestamp") if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])
    row.write.parquet(place)
    return events.unionByName(spark.readStream.schema(schema).parquet(place))


@query("SELECT event_type, count(*) AS total FROM events GROUP BY 1")
def stm08_live_counters(spark, d):
    return run_to_end(feeds.live_counters(events_stream(spark, d), "event_type"), "complete")


@query("SELECT event_id, user_id, event_type FROM events")
def stm01_event_feed(spark, d):
    """The table's events twice over: each comes out once."""
    twice = events_stream(spark, d).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("_copy"), "*").drop("_copy")
    return run_to_end(feeds.event_feed(twice.withWatermark("ts", "10 minutes")).select("event_id", "user_id", "event_type"))


@query()
def stm04_lockout_exact(spark, d):
    rows = events_stream(spark, d).select("user_id", "event_id", "ts", (F.col("event_type") == "purchase").alias("success"))
    return run_to_end(feeds.lockouts(rows))


@query()
def stm06_tickets(spark, d):
    rows = events_stream(spark, d).select((F.col("user_id") % 40).cast("string").alias("ticket"), "event_id", "ts", F.when(F.col("event_type") == "view", "issue").otherwise("use").alias("event"))
    return run_to_end(feeds.ticket_checks(rows))


@query("SELECT user_id AS analysis_id, event_id AS claim_id, attempt FROM (SELECT *, max(attempt) OVER (PARTITION BY user_id) AS m FROM (SELECT *, CASE WHEN event_id % 4 > 0 THEN (event_id % 3)::INT END AS attempt FROM events)) WHERE m IS NULL OR attempt = m")
def stm10_latest_round(spark, d):
    attempt = F.when(F.col("event_id") % 4 > 0, (F.col("event_id") % 3).cast("int"))
    rows = events_stream(spark, d).select(F.col("user_id").alias("analysis_id"), F.col("event_id").alias("claim_id"), attempt.alias("attempt"))
    place = new_place(spark)
    held = feeds.LatestRounds(spark, f"{place}/rounds", "analysis_id long, claim_id long, attempt int")
    drained(rows, held.merge, place)
    return held.read()


@query(
    """
    WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NULL OR lag(event_type) OVER w <> event_type THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM m)
    SELECT user_id, island::BIGINT AS island, event_type AS event, min(ts) AS ts, count(*) AS events, (list(props ORDER BY length(props) DESC, ts, event_id))[1] AS message FROM i GROUP BY 1, 2, 3
    """
)
def stm11_compacted_feed(spark, d):
    events = with_end(spark, events_stream(spark, d)).select(F.coalesce("user_id", F.lit(-1)).alias("run_id"), F.coalesce("event_id", F.lit(-1)).alias("event_id"), "ts", F.col("event_type").alias("event"), F.col("props").alias("message"))
    out = run_to_end(feeds.compacted(events.withWatermark("ts", "10 minutes"))).where("run_id >= 0")
    return out.select(F.col("run_id").alias("user_id"), "island", "event", F.col("ts").cast("timestamp_ntz").alias("ts"), "events", "message")


@query(
    "SELECT e.event_id, EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'error' AND r.user_id = e.user_id AND r.ts <= e.ts AND r.ts + INTERVAL 6 HOUR > e.ts) AS revoked FROM events e WHERE e.event_type <> 'error'"
)
def stm07_checked_requests(spark, d):
    """Errors revoke their user's token for six hours; all other events ask whether it holds."""
    ended = lambda: with_end(spark, events_stream(spark, d))
    requests = ended().where("event_type IS NULL OR event_type <> 'error'").select(F.coalesce("event_id", F.lit(-1)).alias("request_id"), F.coalesce("user_id", F.lit(-1)).alias("token"), "ts")
    revocations = ended().where("event_type IS NULL OR event_type = 'error'").select(F.coalesce("user_id", F.lit(-2)).alias("token"), F.col("ts").alias("revoked_at"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("expires_at"))
    out = feeds.checked_requests(requests.withWatermark("ts", "10 minutes"), revocations.withWatermark("revoked_at", "10 minutes"), "6 hours")
    return run_to_end(out).where("request_id >= 0").select(F.col("request_id").alias("event_id"), "revoked")


@query(
    "WITH r AS (SELECT *, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) "
    "SELECT user_id AS run_id, event_id, CASE WHEN event_type = 'error' THEN 'analysis.failed' ELSE event_type END AS event FROM r WHERE coalesce(before, 0) = 0"
)
def stm02_run_feed(spark, d):
    event = F.when(F.col("event_type") == "error", "analysis.failed").otherwise(F.col("event_type"))
    return run_to_end(feeds.run_feed(events_stream(spark, d).select(F.col("user_id").alias("run_id"), "event_id", "ts", event.alias("event")), idle_timers=False))
