"""A batch of questions through the whole engine: index, route, retrieve, answer, judge, recover.

Each step is a relation over all questions; the loop over recovery rounds is the driver's, over at most
`recovery_attempts` rounds. Between rounds the state is written to the shared checkpoint folder, so that a round's
plan doesn't repeat the earlier ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as n
from ..functions import text as t
from ..operators import evidence as e
from ..operators import retrieval as r
from ..operators.chunking import chunk_pages
from ..session import DEFAULTS, Defaults, kept


@dataclass
class Index:
    """IDX-01: what indexing gives: chunks with ids and hashes, postings and how many chunks have some, vectors."""

    chunks: DataFrame
    postings: DataFrame
    total: int
    vectors: DataFrame
    documents: DataFrame


def build_index(pages: DataFrame, documents: DataFrame, strategy: str = "sliding_window", d: Defaults = DEFAULTS, dim: int = 64) -> Index:
    """pages: doc_id, page, text; documents: doc_id, filename, version, effective_from, effective_until."""
    chunks = chunk_pages(pages.select("doc_id", "page", "text"), strategy, d.chunk_size, d.chunk_overlap)
    chunks = chunks.select(
        "*", F.xxhash64("doc_id", "chunk_index").alias("chunk_id"), n.text_hash(F.col("text")).alias("text_hash"),
        n.point_id(F.col("doc_id"), F.col("chunk_index")).alias("point_id"),
    )
    chunks = kept(chunks)
    postings = kept(r.postings(r.lexed(chunks), "chunk_id", d.bm25_k1, d.bm25_b, d.bm25_avg_len))
    named = chunks.join(documents.select("doc_id", "filename"), "doc_id", "left")
    prefixed = t.embedding_text(F.coalesce("filename", F.lit("unknown_doc")), F.col("zone"), F.col("text"))
    vectors = kept(named.select("chunk_id", "doc_id", r.hashed_embedding(prefixed, dim).alias("vector")))
    return Index(chunks, postings, postings.select("chunk_id").distinct().count(), vectors, documents)


def analyse(queries: DataFrame, index: Index, reference, d: Defaults = DEFAULTS, dim: int = 64, k: int = 20) -> DataFrame:
    """query_id, attempt, query_used, answer, counts, verdict, status, score and diagnosis: the last round of each question.

    queries: query_id, query. reference: a timestamp column or literal, the time at which documents must hold.
    """
    done = None
    open_queries = queries.select("query_id", "query").withColumn("query_used", F.col("query"))
    for attempt in range(d.recovery_attempts + 1):
        state = one_round(open_queries, index, reference, d, dim, k, attempt)
        state = kept(state)
        last = attempt == d.recovery_attempts
        closed = state if last else state.where("verdict = 'PASS'")
        done = closed if done is None else done.unionByName(closed)
        failed = state.where("verdict <> 'PASS'")
        if last or not failed.limit(1).count():
            break
        chosen = e.strategy(F.col("diagnosis"), F.lit(attempt))
        rewritten = t.sanitize_rewrite(F.concat_ws(" ", "query", "hints"))
        use = F.when((chosen == "query_rewrite") & (F.length(rewritten) >= 3), rewritten).otherwise(F.col("query"))
        open_queries = failed.select("query_id", "query", use.alias("query_used"))
        k = min(2 * k, d.max_context_chunks + 16)
    return done.drop("hints")


def one_round(queries: DataFrame, index: Index, reference, d: Defaults, dim: int, k: int, attempt: int) -> DataFrame:
    """A round of retrieval, answer and verdict."""
    routed = queries.withColumn("routed", r.route(F.col("query_used"), d.max_sub_queries))
    subs = routed.select(
        "query_id", "query_used", F.coalesce(F.col("routed.reference_time"), reference).alias("at"), F.posexplode("routed.sub_queries").alias("sub_query", "sub"),
    ).withColumn("branch", F.xxhash64("query_id", "sub_query"))
    asked = r.lexed(subs.select(F.col("branch").alias("query_id"), "sub"), "sub", is_query=True).withColumn("query_vector", r.hashed_embedding(F.col("sub"), dim))
    asked = kept(asked)
    dense = r.dense_search(asked, index.vectors, k)
    sparse = r.sparse_search(asked.select("query_id", "terms"), index.postings, k, total=index.total)
    fused = r.fuse(dense, sparse, d.rrf_k).join(index.chunks, "chunk_id").withColumnRenamed("query_id", "branch")
    fused = fused.join(subs.select("branch", "query_id", "sub_query", "query_used", "at"), "branch")
    valid = r.valid_at(fused, index.documents, F.col("at"))
    cut = r.adaptive_cut(r.best_per_chunk(valid), d.fusion_top_k, few=d.adaptive_k)
    best = r.rerank(cut.withColumn("query", F.col("query_used")).drop("fused_rank").withColumnRenamed("place", "fused_rank"), d.max_context_chunks)
    audited = e.verified_only(e.audit_integrity(best, index.chunks.select("doc_id", "chunk_index", "text_hash")))
    served = kept(e.segments(audited.withColumn("place", F.col("rerank_rank")), d.context_chars))
    answers = queries.join(e.extractive_answer(served), "query_id", "left").withColumn("answer", F.coalesce("answer", F.lit("ABSTAIN")))
    claims = e.decompose(answers.select("query_id", "answer"), d.max_claims)
    summary = e.claim_summary(e.judge(claims, served.select("query_id", "segment", "text")))
    hints = e.expand_query(queries.select("query_id", F.col("query_used").alias("query")), served).withColumnRenamed("query", "hints")
    joined = answers.join(summary, "query_id", "left").na.fill(0, ["supported", "contradicted", "neutral", "total"]).join(hints.select("query_id", "hints"), "query_id", "left")
    result = e.verdict(F.col("supported"), F.col("contradicted"), F.col("total"), F.col("answer"), d)
    return joined.select(
        "query_id", "query", "query_used", F.lit(attempt).alias("attempt"), "answer", "supported", "contradicted", "neutral", "total", result.alias("_v"), "hints"
    ).select("query_id", "query", "query_used", "attempt", "answer", "supported", "contradicted", "neutral", "total", "_v.*", "hints")
