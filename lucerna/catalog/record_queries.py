"""Counters, latencies, pages, snapshots, caches and exports over events and the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as n
from ..operators import evaluate as ev
from ..operators import evidence as e
from ..operators import records as rec
from ..streaming import feeds
from . import query, table

# ---- counts and latencies ----


@query("WITH b AS (SELECT DISTINCT source AS kb_id FROM documents UNION ALL SELECT 'empty') SELECT kb_id, count(d.doc_id) AS doc_count FROM b LEFT JOIN documents d ON d.source = b.kb_id GROUP BY 1")
def agg01_docs_per_kb(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("kb_id"), "doc_id")
    bases = docs.select("kb_id").distinct().unionByName(spark.sql("SELECT 'empty' AS kb_id"))
    return rec.document_counts(bases, docs)


@query("SELECT user_id, round(avg(value), 6) AS mean_reliability, count(value) AS scored_runs, count(*) FILTER (event_type IS NOT NULL) AS claims, round(avg((event_type = 'purchase')::INT), 6) AS supported_share FROM (SELECT user_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value, event_type FROM events) GROUP BY 1")
def agg04_dashboard(spark, d):
    rows = table(spark, d, "events")
    runs = rows.select("user_id", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("reliability"))
    claims = rows.select("user_id", F.when(F.col("event_type") == "purchase", "supported").otherwise("other").alias("state"))
    out = ev.dashboard(runs, claims, "user_id")
    return out.select("user_id", F.round("mean_reliability", 6).alias("mean_reliability"), "scored_runs", "claims", F.round("supported_share", 6).alias("supported_share"))


@query("SELECT upper(event_type) AS state, count(*) AS total FROM events GROUP BY 1")
def agg05_state_histogram(spark, d):
    return ev.counters(table(spark, d, "events").select(F.upper("event_type").alias("state")), "state")


@query("SELECT event_type, count(value) AS count, round(min(value), 6) AS min, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS max FROM events GROUP BY 1")
def agg07_latency(spark, d):
    out = ev.latency_summary(table(spark, d, "events"), "value", "event_type")
    return out.select("event_type", "count", *[F.round(c, 6).alias(c) for c in ("min", "p50", "p95", "max")])


@query("SELECT user_id, CASE WHEN count(ts) >= 2 THEN round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0, 3) END AS span_ms FROM events GROUP BY 1")
def agg08_trace_span(spark, d):
    return ev.trace_spans(table(spark, d, "events"), "user_id", "ts").select("user_id", F.round("span_ms", 3).alias("span_ms"))


@query(
    r"SELECT event_type AS method, regexp_replace('/u/' || user_id::VARCHAR || '/x', '/\d+(/|$)', '/:id\1', 'g') AS path, 200 + event_id % 3 AS status, count(*) AS requests, round(sum(value), 4) AS latency_sum, count(value) AS latency_count FROM events GROUP BY ALL"
)
def agg11_http_counters(spark, d):
    rows = table(spark, d, "events").select(
        F.col("event_type").alias("method"), F.concat(F.lit("/u/"), F.col("user_id").cast("string"), F.lit("/x")).alias("path"), (200 + F.col("event_id") % 3).alias("status"), F.col("value").alias("ms")
    )
    return ev.http_counters(rows).withColumn("latency_sum", F.round("latency_sum", 4))


@query("SELECT event_type, sum(event_id % 7)::BIGINT AS total FROM events GROUP BY 1")
def agg12_counters(spark, d):
    return ev.counters(table(spark, d, "events").select("event_type", (F.col("event_id") % 7).alias("amount")), "event_type", "amount")


@query(
    "WITH c AS (SELECT user_id AS run_id, event_type AS model, CASE WHEN event_id % 2 = 0 THEN event_id % 90 ELSE greatest(1, length(props) // 4) END AS i, greatest(1, length(event_type) // 4) AS o FROM events), "
    "m AS (SELECT run_id, model, count(*) AS calls, sum(i)::BIGINT AS tokens_in, sum(o)::BIGINT AS tokens_out FROM c GROUP BY 1, 2) SELECT *, (sum(calls) OVER (PARTITION BY run_id))::BIGINT AS run_calls, sum(calls) OVER (PARTITION BY run_id) >= 24 AS exhausted FROM m"
)
def agg13_call_ledger(spark, d):
    k = F.col("event_id")
    rows = table(spark, d, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("model"), F.when(k % 2 == 0, k % 90).alias("input_tokens"), F.lit(None).cast("long").alias("output_tokens"),
        F.col("props").alias("prompt"), F.col("event_type").alias("answer"),
    )
    return ev.call_ledger(rows, 24)


@query("SELECT event_type, count(*) FILTER (value > 50) AS hits, count(*) AS lookups, round(avg((value > 50)::INT), 9) AS hit_rate FROM events GROUP BY 1")
def agg18_hit_rate(spark, d):
    out = ev.hit_rate(table(spark, d, "events").select("event_type", (F.col("value") > 50).alias("hit")), "event_type")
    return out.withColumn("hit_rate", F.round("hit_rate", 9))


# ---- filters, pages, windows ----


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_custkey = 7 THEN 'ok' ELSE 'forbidden' END AS access FROM orders WHERE o_orderstatus = 'F'")
def fil01_ownership(spark, d):
    rows = table(spark, d, "orders").withColumn("user_id", F.col("o_custkey").cast("string"))
    return rec.owned(rows, "7", o_orderstatus="F").select("o_orderkey", "o_custkey", "access")


@query("SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'VERIFIED' ELSE 'CORRUPTED' END AS s, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS t FROM events) WHERE s IS NOT NULL AND s <> 'VERIFIED' AND NOT coalesce(t, false)")
def fil04_null_filters(spark, d):
    k = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", F.when(k % 5 == 0, F.lit(None)).when(k % 2 == 0, "VERIFIED").otherwise("CORRUPTED").alias("s"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("t"))
    return rows.where(rec.not_in_or_null(F.col("s"), "VERIFIED") & rec.not_true(F.col("t"))).select("event_id")


@query("SELECT conv_id, turn FROM conversations WHERE (contains(lower(coalesce(text, '')), 'the') OR contains(lower(coalesce(role, '')), 'the')) AND upper(role) = 'USER'")
def fil09_search(spark, d):
    return rec.search(table(spark, d, "conversations"), "THE", "text", "role", role="user").select("conv_id", "turn")


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 OR page_id % 3 = 0 OR page_id % 5 = 0 THEN 'web' ELSE 'kb' END AS source FROM pages")
def fil11_evidence_source(spark, d):
    k = F.col("page_id")
    source = rec.evidence_source(F.when(k % 2 == 0, F.col("url")), F.when(k % 3 == 0, "Web_search").otherwise("dense"), F.when(k % 5 == 0, "web_1").otherwise("e1"))
    return table(spark, d, "pages").select("page_id", source.alias("source"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200 OFFSET 30")
def top07_page(spark, d):
    return rec.page(table(spark, d, "orders"), 500, 30, order="o_orderdate", tie="o_orderkey").select("o_orderkey", "o_orderdate")


@query("SELECT event_id, greatest(1, least(50, event_id % 80 - 10)) AS top_k FROM events")
def top12_clamps(spark, d):
    return table(spark, d, "events").select("event_id", rec.clamp(F.col("event_id") % 80 - 10, 1, 50).alias("top_k"))


@query("SELECT conv_id, count(*) AS turns, sha256(string_agg(turn::VARCHAR || role, '|' ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def top14_detail(spark, d):
    rows = rec.children(table(spark, d, "conversations"), "conv_id", "turn", "role")
    said = F.array_join(F.transform("rows", lambda x: F.concat(x["turn"].cast("string"), x["role"])), "|")
    return rows.select("conv_id", F.size("rows").cast("long").alias("turns"), n.text_hash(said).alias("digest"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 10 ORDER BY o_orderdate DESC, o_orderkey LIMIT 1000)")
def top13_user_claims(spark, d):
    claims = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("analysis_id"), "l_linenumber", F.lit("nobody").alias("user_id"))
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("analysis_id"), F.col("o_custkey").cast("string").alias("user_id"), F.col("o_orderdate").alias("created_at"))
    return rec.user_claims(claims, runs, "10").select(F.col("analysis_id").alias("l_orderkey"), "l_linenumber")


@query("SELECT label, o_orderkey FROM (SELECT o_orderkey, '#' || (row_number() OVER (ORDER BY o_orderdate, o_orderkey))::VARCHAR AS label FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25))")
def win08_timeline(spark, d):
    return rec.timeline(table(spark, d, "orders"), 25, "o_orderdate", "o_orderkey").select("label", "o_orderkey")


@query(
    """
    WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NULL OR lag(event_type) OVER w <> event_type THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM m)
    SELECT user_id, island::BIGINT AS island, event_type AS event, min(ts) AS ts, count(*) AS events, (list(props ORDER BY length(props) DESC, event_id ASC))[1] AS message FROM i GROUP BY 1, 2, 3
    """
)
def win04_compact_events(spark, d):
    rows = table(spark, d, "events").withColumnsRenamed({"event_type": "event", "props": "message"})
    return rec.compact_events(rows, "user_id")


@query(
    "SELECT 'claim' AS kind, l_orderkey AS analysis_id, l_linenumber::VARCHAR AS id, o_orderpriority AS query FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' "
    "UNION ALL SELECT 'evidence', l_orderkey, l_partkey::VARCHAR, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'A' AND l_linestatus <> 'O'"
)
def join05_conflicts(spark, d):
    lines = table(spark, d, "lineitem")
    claims = lines.select(F.col("l_orderkey").alias("analysis_id"), F.col("l_linenumber").alias("claim_id"), F.lit("t").alias("text"), F.when(F.col("l_returnflag") == "R", "CONTRADICTED").otherwise("N").alias("state"), F.col("l_shipdate").alias("created_at"))
    status = F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") != "O"), "CORRUPTED").when(F.col("l_returnflag") == "R", "VERIFIED")
    evidence = lines.select(F.col("l_orderkey").alias("analysis_id"), F.col("l_partkey").alias("evidence_id"), F.lit("t").alias("text"), status.alias("integrity_status"), F.col("l_shipdate").alias("created_at"))
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("analysis_id"), F.col("o_orderpriority").alias("query"))
    return rec.conflicts(runs, claims, evidence).select("kind", "analysis_id", "id", "query")


@query("SELECT source AS kb_id, count(*) FILTER (doc_id % 3 > 0) AS points, count(*) FILTER (source NOT IN ('src1', 'src2')) AS chunks, false AS reindex FROM documents WHERE source NOT IN ('src3') GROUP BY 1 UNION ALL SELECT 'src3', 0, count(*), true FROM documents WHERE source = 'src3'")
def ret10_reindex(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("kb_id"), "doc_id")
    points = rows.where("kb_id <> 'src3' AND doc_id % 3 > 0")
    return e.reindex_needed(points, rows.where("kb_id NOT IN ('src1', 'src2')"))


# ---- writes ----


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id % 2 DESC, doc_id) AS n FROM documents WHERE false) UNION ALL SELECT max_by(doc_id, n_chars * 2000000000 + (doc_id % 2) * 1000000000 + doc_id), max_by(lang, n_chars * 2000000000 + (doc_id % 2) * 1000000000 + doc_id) FROM documents GROUP BY source")
def snk01_upsert(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", "lang", (F.col("n_chars") * 2_000_000_000 + F.col("doc_id") % 2 * 1_000_000_000 + F.col("doc_id")).alias("at"))
    return rec.upsert(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), "source", "at").select("doc_id", "lang")


@query("SELECT doc_id, source FROM documents WHERE source NOT IN ('src1', 'src2') UNION ALL SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2') AND doc_id % 8 < 4")
def snk02_replace(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source")
    return rec.replace_document(rows, rows.where("source IN ('src1', 'src2') AND doc_id % 8 < 4"), "source")


@query("SELECT event_type AS event, 'events_total{event=\"' || event_type || '\"} ' || count(*)::VARCHAR AS line FROM events GROUP BY 1")
def snk07_prometheus(spark, d):
    counts = ev.counters(table(spark, d, "events").select(F.col("event_type").alias("event")), "event")
    lines = rec.prometheus(counts, "events_total", "event")
    return lines.select(F.regexp_extract("line", '"(.*)"', 1).alias("event"), "line")


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 AND page_id > 0 THEN md5(url)[1:24] || '/' || md5(html)[1:24] || '/p' || page_id::VARCHAR || '.png' END AS ref, CASE WHEN page_id % 2 = 0 AND page_id > 0 THEN 'k/d/p' || page_id::VARCHAR || '.png' END AS moved FROM pages")
def snk05_page_images(spark, d):
    h = lambda c: F.substring(F.md5(F.encode(c, "UTF-8")), 1, 24)
    kb = F.when(F.col("page_id") % 2 == 0, h("url")).otherwise("../x")
    ref = rec.page_image_ref(kb, h("html"), F.col("page_id"))
    return table(spark, d, "pages").select("page_id", ref.alias("ref")).select("page_id", "ref", rec.moved_image_ref(F.col("ref"), F.lit("k"), F.lit("d")).alias("moved"))


@query()
def snk06_dossier(spark, d):
    lines = table(spark, d, "lineitem")
    claims = lines.select(F.col("l_orderkey").alias("analysis_id"), F.col("l_linenumber").alias("claim_id"), F.col("l_linestatus").alias("text"), F.col("l_returnflag").alias("state"))
    evidence = claims.select("analysis_id", F.col("claim_id").alias("evidence_id"), "text", F.col("state").alias("integrity_status"))
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("analysis_id"), F.col("o_orderpriority").alias("query"), F.col("o_orderstatus").alias("answer"))
    return rec.dossier(runs, claims, evidence)


@query("SELECT source AS kb_id, min(doc_id) AS doc_id, sha256(text) AS content_hash FROM documents n WHERE doc_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM documents s WHERE s.doc_id % 3 <> 0 AND s.source = n.source AND s.text = n.text) GROUP BY 1, 3")
def kb04_add_documents(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("kb_id"), "doc_id", n.text_hash(F.col("text")).alias("content_hash"))
    return rec.add_documents(rows.where("doc_id % 3 <> 0"), rows.where("doc_id % 3 = 0")).select("kb_id", "doc_id", "content_hash")


@query("SELECT doc_id AS old_doc_id, sha256(doc_id::VARCHAR || '/2.0')[1:24] AS doc_id, sha256('src1/2.0')[1:24] AS kb_id, true AS is_snapshot FROM documents WHERE source = 'src1' AND doc_id % 4 <> 0")
def kb01_snapshot(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("kb_id"), F.lit("1.0").alias("version"), F.when(F.col("doc_id") % 4 == 0, True).alias("is_snapshot"))
    return rec.snapshot_documents(rows, "src1", "2.0").select("old_doc_id", "doc_id", "kb_id", "is_snapshot")


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN user_id + 1000000 ELSE user_id END AS user_id FROM events")
def join07_remap(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id")
    ids = rows.where("user_id % 2 = 0").select(F.col("user_id").alias("old"), (F.col("user_id") + 1_000_000).alias("new")).distinct()
    return rec.remap(rows, ids, "user_id")


@query("SELECT * FROM (VALUES ('src1', 'other_parent'), ('src2', 'ok'), ('src3', 'not_a_snapshot'), ('gone', 'not_found')) t(kb_id, verdict)")
def kb02_rollback_checks(spark, d):
    bases = table(spark, d, "documents").select(F.col("source").alias("kb_id")).distinct().select(
        "kb_id", (F.col("kb_id") != "src3").alias("is_snapshot"), F.when(F.col("kb_id") == "src2", "src0").alias("parent_kb_id")
    )
    points = table(spark, d, "documents").select(F.col("source").alias("kb_id"))
    out = None
    for kb in ("src1", "src2", "src3", "gone"):
        part = rec.rollback_check(bases, points, "src0", kb).select(F.lit(kb).alias("kb_id"), "verdict")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT doc_id, source <> 'src4' AND doc_id % 4 = 0 AS is_snapshot FROM documents WHERE source <> 'src1'")
def kb02_promote(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("kb_id"), (F.col("doc_id") % 4 == 0).alias("is_snapshot"))
    return rec.promote(rows, "src1", "src4").select("doc_id", "is_snapshot")


@query("SELECT doc_id FROM documents WHERE source NOT IN ('src1', 'src5')")
def kb03_delete(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source")
    return rec.without_document(rows, rows.where("source IN ('src1', 'src5')"), "source").select("doc_id")


@query("SELECT source AS kb_id, count(DISTINCT lang) AS spaces, count(DISTINCT lang) <= 1 AS pinned FROM documents GROUP BY 1")
def idx02_pin_check(spark, d):
    return e.pin_check(table(spark, d, "documents").select(F.col("source").alias("kb_id"), F.col("lang").alias("embedding_model"), F.lit(64).alias("embedding_dim")))


# ---- caches ----


@query("SELECT DISTINCT sha256('document:m:' || lower(trim(text))) AS cache_key FROM documents EXCEPT SELECT sha256('document:m:' || lower(trim(text))) FROM documents WHERE doc_id % 2 = 0")
def join14_cache_misses(spark, d):
    rows = table(spark, d, "documents").select("doc_id", n.cache_key(F.col("text"), "m").alias("cache_key"))
    return rec.cache_misses(rows.select("cache_key").distinct(), rows.where("doc_id % 2 = 0"))


@query("SELECT event_id AS entry_id FROM (SELECT event_id, ts FROM events WHERE event_id % 2 = 0 OR (event_type = 'purchase' AND event_id % 3 > 0) ORDER BY ts DESC, event_id LIMIT 500)")
def ret11_cache_admit(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("entry_id"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "purchase", "PASS").otherwise("FAIL").alias("verdict"), (F.col("event_id") % 3 == 0).alias("web_search"))
    stored = rows.where("entry_id % 2 = 0").select("entry_id", "created_at")
    return rec.cache_admit(stored, rows.where("entry_id % 2 = 1")).select("entry_id")


@query("SELECT event_id FROM events WHERE user_id % 7 > 0 AND ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def ret12_cache_live(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("kb_id"), F.col("ts").alias("created_at"))
    latest = rows.agg(F.max("created_at").alias("m")).first()["m"]
    live = rec.cache_live(rows, F.lit(latest))
    return rec.cache_invalidate(live, rows.where("kb_id % 7 = 0")).select("event_id")


# ---- windows over events, in batch form ----


@query("SELECT user_id, time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, count(*) AS requests FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def stm05_rate_limit(spark, d):
    out = feeds.rate_limited(table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", 1)
    return out.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "requests")


@query(
    """
    WITH f AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS f FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    i AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM f)
    SELECT user_id, min(ts) AS session_start, count(*) AS failures, count(*) >= 3 AS locked FROM i GROUP BY user_id, s
    """
)
def stm04_lockout_sessions(spark, d):
    rows = table(spark, d, "events").where("event_type = 'error'").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = feeds.lockout_sessions(rows, "user_id", 3, "12 hours")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "failures", "locked")


@query("SELECT event_id FROM events e WHERE NOT (user_id % 5 = 0 AND user_id % 10 > 0)")
def stm07_revoked(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("token"))
    now = F.lit("2026-01-01").cast("timestamp")
    revoked = rows.where("token % 5 = 0").select("token", F.when(F.col("token") % 10 > 0, now + F.expr("INTERVAL 1 HOUR")).otherwise(now).alias("expires_at")).distinct()
    return feeds.not_revoked(rows, revoked, now).select("event_id")


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 5 DAY")
def stm03_retention(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts")
    return feeds.retained(rows, F.lit("2024-01-20").cast("timestamp_ntz"), 5).select("event_id")
