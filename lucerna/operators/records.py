"""Records of knowledge bases, runs and caches: filters, pages, joins, snapshots, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as n
from ..session import DEFAULTS
from .retrieval import dense_search

# ---- filters ----


def owned(rows: DataFrame, user: str, **keys: object) -> DataFrame:
    """FIL-01: rows of the keys, with access: ok or forbidden. No row is not found."""
    for column, value in keys.items():
        rows = rows.where(F.col(column) == F.lit(value))
    return rows.withColumn("access", F.when(F.col("user_id") == user, "ok").otherwise("forbidden"))


def not_in_or_null(column: Column, *values: str) -> Column:
    """FIL-04: neither null nor one of the values."""
    return column.isNotNull() & ~column.isin(*values)


def not_true(column: Column) -> Column:
    """FIL-06: false or missing."""
    return ~F.coalesce(column, F.lit(False))


def search(rows: DataFrame, term: str, *columns: str, **equal: str) -> DataFrame:
    """FIL-09/10: rows with the term in any of the columns, whatever the case, and equal values."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(term.lower()))
    for c, value in equal.items():
        hit = hit & (F.upper(F.col(c)) == value.upper())
    return rows.where(hit)


def evidence_source(url: Column, method: Column, evidence_id: Column) -> Column:
    """FIL-11: web or kb."""
    name = F.lower(F.coalesce(method, F.lit("")))
    web = (F.coalesce(url, F.lit("")) != "") | name.contains("web") | name.contains("mcp") | evidence_id.startswith("web_")
    return F.when(web, "web").otherwise("kb")


# ---- pages and lists ----


def page(rows: DataFrame, limit: int, skip: int = 0, largest: int = 200, order: str = "created_at", tie: str = "id") -> DataFrame:
    """TOP-07: newest first, ties by id; the limit is clamped."""
    return rows.orderBy(F.desc(order), tie).offset(max(0, skip)).limit(max(1, min(limit, largest)))


def clamp(value: Column, low: int, high: int) -> Column:
    """TOP-12."""
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def children(rows: DataFrame, key: str, order: str, *fields: str) -> DataFrame:
    """TOP-13/14: a key's rows as an array, oldest first. For one run's detail, whose size the run's caps bound."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *fields))).alias("rows"))


def user_claims(claims: DataFrame, analyses: DataFrame, user: str, most: int = 1000) -> DataFrame:
    """TOP-13: the user's claims; without any, those of the user's newest analyses."""
    own = claims.where(F.col("user_id") == user)
    runs = analyses.where(F.col("user_id") == user).orderBy(F.desc("created_at"), "analysis_id").limit(most).select("analysis_id")
    through = claims.join(runs, "analysis_id", "left_semi").join(own.limit(1).select(F.lit(1).alias("_any")), F.lit(True), "left_anti")
    return own.unionByName(through)


def timeline(runs: DataFrame, last: int, order: str = "created_at", tie: str = "id") -> DataFrame:
    """WIN-08: the newest runs, numbered from the oldest of them."""
    newest = runs.orderBy(F.desc(order), F.desc(tie)).limit(last)
    return newest.withColumn("label", F.concat(F.lit("#"), F.row_number().over(W.orderBy(order, tie)).cast("string")))  # at most `last` rows


def compact_events(events: DataFrame, run: str = "run_id") -> DataFrame:
    """WIN-04, STM-11: neighbouring events of one name as one row: first time, how many, longest message.

    events: run, ts, event_id, event, message.
    """
    order = W.partitionBy(run).orderBy("ts", "event_id")
    marked = events.withColumn("_new", (F.lag("event").over(order).isNull() | (F.lag("event").over(order) != F.col("event"))).cast("int"))
    numbered = marked.withColumn("island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    longest = F.max_by("message", F.struct(F.length("message"), -F.col("event_id")))
    return numbered.groupBy(run, "island", "event").agg(F.min("ts").alias("ts"), F.count(F.lit(1)).alias("events"), longest.alias("message"))


def conflicts(analyses: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """JOIN-05, SET-01: contradicted claims, then evidence that isn't verified, each with its run's question."""
    runs = analyses.select("analysis_id", "query")
    first = claims.where(F.col("state") == "CONTRADICTED").join(runs, "analysis_id").select(
        F.lit("claim").alias("kind"), "analysis_id", F.col("claim_id").cast("string").alias("id"), "query", "text", "created_at"
    )
    second = evidence.where(not_in_or_null(F.col("integrity_status"), "VERIFIED")).join(runs, "analysis_id").select(
        F.lit("evidence").alias("kind"), "analysis_id", F.col("evidence_id").cast("string").alias("id"), "query", "text", "created_at"
    )
    return first.unionByName(second)


def document_counts(bases: DataFrame, documents: DataFrame) -> DataFrame:
    """AGG-01, JOIN-06: every knowledge base with its documents' number, 0 without any."""
    counts = documents.groupBy("kb_id").agg(F.count(F.lit(1)).alias("doc_count"))
    return bases.join(counts, "kb_id", "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0).cast("long")))


# ---- writes as relations ----


def upsert(stored: DataFrame, fresh: DataFrame, key: str, order: str) -> DataFrame:
    """SNK-01/09: of each key the newest row; fresh rows win on equal age."""
    rows = stored.withColumn("_fresh", F.lit(0)).unionByName(fresh.withColumn("_fresh", F.lit(1)))
    newest = W.partitionBy(key).orderBy(F.desc(order), F.desc("_fresh"))
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "_fresh")


def replace_document(stored: DataFrame, fresh: DataFrame, key: str = "doc_id") -> DataFrame:
    """SNK-02: all rows of the documents in fresh give way to fresh."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def without_document(rows: DataFrame, removed: DataFrame, key: str = "doc_id") -> DataFrame:
    """FIL-18, KB-03."""
    return rows.join(removed.select(key).distinct(), key, "left_anti")


def add_documents(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """KB-04: rows of fresh whose content their knowledge base has not, one of each, as version 1.0."""
    first = W.partitionBy("kb_id", "content_hash").orderBy("doc_id")
    new = fresh.join(stored.select("kb_id", "content_hash").distinct(), ["kb_id", "content_hash"], "left_anti")
    new = new.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return new.withColumn("version", F.lit("1.0")).withColumn("is_snapshot", F.lit(False))


def snapshot_id(kb_id: Column, version: Column) -> Column:
    return F.substring(n.text_hash(F.concat_ws("/", kb_id.cast("string"), version)), 1, 24)


def snapshot_documents(documents: DataFrame, kb_id: str, version: str) -> DataFrame:
    """KB-01, FIL-06: the live documents of a knowledge base with new ids, and old_doc_id."""
    live = documents.where((F.col("kb_id") == kb_id) & not_true(F.col("is_snapshot")))
    new = F.substring(n.text_hash(F.concat_ws("/", F.col("doc_id").cast("string"), F.lit(version))), 1, 24)
    return live.select(
        *[c for c in documents.columns if c not in ("doc_id", "kb_id", "version", "is_snapshot")], F.col("doc_id").alias("old_doc_id"),
        new.alias("doc_id"), snapshot_id(F.lit(kb_id), F.lit(version)).alias("kb_id"), F.lit(version).alias("version"), F.lit(True).alias("is_snapshot"),
    )


def remap(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """JOIN-07, SNK-04: rows with the ids of ids (old, new); unknown ids stay."""
    joined = rows.join(ids.select(F.col("old").alias("_old"), F.col("new").alias("_new")), F.col(key) == F.col("_old"), "left")
    return joined.withColumn(key, F.coalesce("_new", key)).drop("_old", "_new")


def rollback_check(bases: DataFrame, points: DataFrame, live: str, snapshot: str) -> DataFrame:
    """KB-02's guards: verdict not_found, not_a_snapshot, other_parent, no_vectors or ok."""
    row = bases.where(F.col("kb_id") == snapshot).select("is_snapshot", "parent_kb_id")
    some = points.where(F.col("kb_id") == snapshot).agg((F.count(F.lit(1)) > 0).alias("_vectors"))
    found = some.join(row, F.lit(True), "left")
    return found.select(
        F.when(F.col("is_snapshot").isNull(), "not_found").when(~F.col("is_snapshot"), "not_a_snapshot")
        .when(~F.col("parent_kb_id").eqNullSafe(F.lit(live)), "other_parent").when(~F.col("_vectors"), "no_vectors").otherwise("ok").alias("verdict")
    )


def promote(rows: DataFrame, live: str, snapshot: str) -> DataFrame:
    """KB-02: the live base's rows go, the snapshot's become live and keep their id."""
    return rows.where(F.col("kb_id") != live).withColumn(
        "is_snapshot", F.when(F.col("kb_id") == snapshot, F.lit(False)).otherwise(F.col("is_snapshot"))
    )


# ---- caches ----


def cache_lookup(queries: DataFrame, cache: DataFrame, now: Column, similarity: float = DEFAULTS.cache_similarity, hours: int = DEFAULTS.cache_hours) -> DataFrame:
    """RET-11: query_id and the most similar live entry of the same base and model, if similar enough.

    queries: query_id, kb_id, model, query_vector; cache: entry_id, kb_id, model, vector, created_at. Similarities are rounded to nine places; of equal ones
    the smallest entry_id. Questions meet entries in blocks inside tasks; no pair is a row.
    """
    live = cache.where(F.col("created_at") > now - F.expr(f"INTERVAL {hours} HOURS"))
    found = dense_search(queries, live.select("entry_id", "vector", "kb_id", "model"), 1, "entry_id", similarity, ("kb_id", "model"))
    return found.select("query_id", "entry_id", F.col("dense_score").alias("similarity"))


def cache_admit(cache: DataFrame, fresh: DataFrame, most: int = DEFAULTS.cache_entries) -> DataFrame:
    """RET-11: passed answers without web search join; the newest entries stay."""
    good = fresh.where((F.col("verdict") == "PASS") & ~F.col("web_search")).select(*cache.columns)
    return cache.unionByName(good).orderBy(F.desc("created_at"), "entry_id").limit(most)


def cache_live(cache: DataFrame, now: Column, hours: int = DEFAULTS.cache_hours) -> DataFrame:
    """RET-12, STM-09: entries within their time."""
    return cache.where(F.col("created_at") > now - F.expr(f"INTERVAL {hours} HOURS"))


def cache_invalidate(cache: DataFrame, bases: DataFrame) -> DataFrame:
    """RET-12: without the entries of these knowledge bases."""
    return cache.join(bases.select("kb_id").distinct(), "kb_id", "left_anti")


def cache_misses(wanted: DataFrame, cached: DataFrame, key: str = "cache_key") -> DataFrame:
    """JOIN-14: keys that have to be computed."""
    return wanted.join(cached.select(key).distinct(), key, "left_anti")


# ---- exports ----


def dossier(analyses: DataFrame, claims: DataFrame, evidence: DataFrame, as_jsonld: bool = True) -> DataFrame:
    """SNK-06, JSN-03: analysis_id and its dossier as JSON text."""
    a = children(claims, "analysis_id", "claim_id", "text", "state").withColumnRenamed("rows", "claims")
    b = children(evidence, "analysis_id", "evidence_id", "text", "integrity_status").withColumnRenamed("rows", "evidence")
    rows = analyses.join(a, "analysis_id", "left").join(b, "analysis_id", "left")
    fields = [F.col("analysis_id").alias("@id" if as_jsonld else "id"), "query", "answer", "claims", "evidence"]
    context = [F.lit("https://schema.org").alias("@context"), F.lit("Report").alias("@type")] if as_jsonld else []
    return rows.select("analysis_id", F.to_json(F.struct(*context, *fields)).alias("dossier"))


def prometheus(counts: DataFrame, metric: str, label: str, value: str = "total") -> DataFrame:
    """SNK-07: a line of text exposition for each row."""
    safe = F.regexp_replace(F.regexp_replace(F.col(label).cast("string"), r"\\", r"\\\\"), '"', r'\\"')
    return counts.select(F.format_string(f'{metric}{{{label}="%s"}} %s', safe, F.col(value).cast("string")).alias("line"))


def page_image_ref(kb_id: Column, doc_id: Column, page_no: Column) -> Column:
    """SNK-05: a path-safe reference; null for ids that aren't 24 hexadecimal digits."""
    ok = kb_id.rlike("^[0-9a-fA-F]{24}$") & doc_id.rlike("^[0-9a-fA-F]{24}$") & (page_no > 0)
    return F.when(ok, F.concat(kb_id, F.lit("/"), doc_id, F.lit("/p"), page_no.cast("string"), F.lit(".png")))


def moved_image_ref(ref: Column, kb_id: Column, doc_id: Column) -> Column:
    """SNK-10: the reference under another base and document."""
    valid = ref.rlike(r"^[0-9a-fA-F]{24}/[0-9a-fA-F]{24}/p[0-9]+\.png$")
    return F.when(valid, F.concat(kb_id, F.lit("/"), doc_id, F.lit("/"), F.substring_index(ref, "/", -1)))


def kb_documents(documents: DataFrame, order: str = "created_at", tie: str = "id", kb: str = "kb_id") -> DataFrame:
    """KB-05: documents with their place in the list of their knowledge base, newest first, ties by id; rows without a time come last."""
    return documents.withColumn("place", F.row_number().over(W.partitionBy(kb).orderBy(F.desc_nulls_last(order), tie)))


# What is recorded of the configuration with every run.
SNAPSHOT_KEYS = [
    "config_version", "llm_provider", "llm_model", "embedding_model", "embedding_version", "embedding_dimensionality", "verification_provider", "verification_model",
    "reranker_enabled", "reranker_model", "fusion_method", "fusion_top_k", "max_fanout_sub_queries", "ocr_enabled", "ocr_store_page_images", "sparse_k1", "sparse_b",
    "sparse_avg_len_tokens", "max_context_chunks", "abstain_below", "max_recovery_attempts", "max_claim_retrievals",
]


def config_snapshot(config: dict[str, Column]) -> Column:
    """MAP-01: the recorded keys as a flat map of strings; what isn't configured is null, and so is the reranker's model without a reranker."""
    value = {key: config.get(key, F.lit(None)).cast("string") for key in SNAPSHOT_KEYS}
    value["reranker_model"] = F.when(value["reranker_enabled"] == "true", value["reranker_model"])
    return F.map_from_entries(F.array(*[F.struct(F.lit(key).alias("key"), value[key].alias("value")) for key in SNAPSHOT_KEYS]))
