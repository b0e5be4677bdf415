"""Integrity, context building, claims, verdicts and recovery."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as n
from ..functions import text as t
from ..functions.udfs import word_overlap
from ..session import DEFAULTS

# ---- integrity ----


def audit_integrity(chunks: DataFrame, references: DataFrame, bound: int | None = None) -> DataFrame:
    """VER-01, JOIN-04, FIL-05: chunks with integrity_status by the stored hash of (doc_id, chunk_index).

    Without doc_id: EXTERNAL_UNAUDITED. bound (TOP-11): only the first so many chunks of a question are looked at.
    chunks: doc_id, chunk_index, text, and query_id and place if bound is given.
    """
    if bound is not None:
        chunks = chunks.where(F.col("place") <= bound)
    known = references.select(F.col("doc_id").alias("_doc"), F.col("chunk_index").alias("_index"), F.col("text_hash").alias("_hash"))
    joined = chunks.join(known, (chunks["doc_id"] == known["_doc"]) & (chunks["chunk_index"] == known["_index"]), "left")
    status = (
        F.when(F.col("doc_id").isNull(), "EXTERNAL_UNAUDITED")
        .when(F.col("_hash") == n.text_hash(F.col("text")), "VERIFIED")
        .otherwise("CORRUPTED")
    )
    return joined.withColumn("integrity_status", status).drop("_doc", "_index", "_hash")


def verified_only(chunks: DataFrame) -> DataFrame:
    """FIL-08."""
    return chunks.where(F.col("integrity_status") == "VERIFIED")


def pin_check(points: DataFrame) -> DataFrame:
    """IDX-02: kb_id, how many embedding spaces it has, and whether it may be searched."""
    spaces = points.groupBy("kb_id").agg(F.count_distinct("embedding_model", "embedding_dim").alias("spaces"))
    return spaces.withColumn("pinned", F.col("spaces") <= 1)


def reindex_needed(points: DataFrame, chunks: DataFrame) -> DataFrame:
    """JOIN-15, RET-10: kb_id, both counts, and whether chunks have lost their points."""
    a = points.groupBy("kb_id").agg(F.count(F.lit(1)).alias("points"))
    b = chunks.groupBy("kb_id").agg(F.count(F.lit(1)).alias("chunks"))
    both = a.join(b, "kb_id", "full_outer").na.fill(0, ["points", "chunks"])
    return both.withColumn("reindex", (F.col("points") == 0) & (F.col("chunks") > 0))


# ---- context ----


def context_order() -> list[Column]:
    """TOP-08: best score first, then the text's start; the row's own place last."""
    score = F.coalesce("rrf_score", "rerank_score", "dense_score", F.lit(0.0))
    return [F.desc(score), F.asc(F.substring(F.lower(t.strip(F.col("text"))), 1, 120)), F.asc("place")]


def dedup_prefix(chunks: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """WIN-05: of chunks whose first words agree, the first in order. chunks: query_id, text, scores, place."""
    each = W.partitionBy("query_id", "_key").orderBy(*(order or context_order()))
    rows = chunks.where(t.strip(F.col("text")) != "").withColumn("_key", t.prefix_key(F.col("text")))
    return rows.withColumn("_n", F.row_number().over(each)).where("_n = 1").drop("_n", "_key")


def budget_cut(segments: DataFrame, length: Column, budget: int, order: list[Column]) -> DataFrame:
    """WIN-06: segments in order until the first that overflows; the first one always stays. Separators count two."""
    each = W.partitionBy("query_id").orderBy(*order)
    upto = each.rowsBetween(W.unboundedPreceding, 0)
    rows = segments.withColumn("segment", F.row_number().over(each))
    rows = rows.withColumn("_total", F.sum(length + F.when(F.col("segment") > 1, 2).otherwise(0)).over(upto))
    # Lengths are positive: what follows the first overflow overflows too.
    return rows.where((F.col("segment") == 1) | (F.col("_total") <= budget)).drop("_total")


def segments(chunks: DataFrame, budget: int = DEFAULTS.context_chars) -> DataFrame:
    """STR-24: query_id, segment, rendered and the chunk's columns, within the budget."""
    rows = dedup_prefix(chunks)
    number = F.row_number().over(W.partitionBy("query_id").orderBy(*context_order()))
    head = F.concat(
        F.lit("--- Segment "), number.cast("string"), F.lit(" [Source: "), t.label(F.coalesce("filename", F.lit("unknown_doc"))),
        F.lit(", Page "), F.coalesce("page", F.lit(1)).cast("string"), F.lit("] ---\n"),
    )
    rows = rows.withColumn("rendered", F.concat(head, t.prune_context(t.strip(F.col("text")))))
    return budget_cut(rows, F.length("rendered"), budget, context_order())


def render_context(served: DataFrame) -> DataFrame:
    """query_id, context (segments by number, blank lines between) and places (which candidate each segment is)."""
    rows = served.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("segment", "rendered", "place"))).alias("_all"))
    return rows.select("query_id", F.array_join(F.col("_all.rendered"), "\n\n").alias("context"), F.col("_all.place").alias("places"))


def cap_context(chunks: DataFrame, cap: int, external: int = 3) -> DataFrame:
    """TOP-09: the first `cap` audited chunks, then up to `external` from outside."""
    inside = W.partitionBy("query_id", "outside").orderBy("place")
    rows = chunks.withColumn("outside", F.col("integrity_status") == "EXTERNAL_UNAUDITED").withColumn("_n", F.row_number().over(inside))
    return rows.where(F.col("_n") <= F.when(F.col("outside"), external).otherwise(cap)).drop("_n")


def unseen(fresh: DataFrame, seen: DataFrame) -> DataFrame:
    """JOIN-08, SET-05: rows of fresh whose (doc_id, chunk_index, start of text) seen doesn't have."""
    key = lambda df, p: df.select("*", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(f"{p}d"), F.coalesce("chunk_index", F.lit(-1)).alias(f"{p}i"), F.substring("text", 1, 80).alias(f"{p}t"))
    a, b = key(fresh, "_"), key(seen, "_s").select("_sd", "_si", "_st").distinct()
    return a.join(b, (a["_d"] == b["_sd"]) & (a["_i"] == b["_si"]) & (a["_t"] == b["_st"]), "left_anti").drop("_d", "_i", "_t")


def reuse_evidence(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """JOIN-09: chunks with the evidence_id of the stored row with the same (analysis, document, text), or null."""
    known = stored.groupBy("analysis_id", "doc_id", "text").agg(F.min("evidence_id").alias("evidence_id"))
    return chunks.join(known, ["analysis_id", "doc_id", "text"], "left")


def claim_evidence(claims: DataFrame, served: DataFrame) -> DataFrame:
    """JOIN-10: claim_id and evidence_ids in the order of the segments that it names; unknown segments drop out.

    claims: query_id, claim_id, segments (array); served: query_id, segment, evidence_id.
    """
    named = claims.select("query_id", "claim_id", F.posexplode("segments").alias("_at", "segment"))
    found = named.join(served.select("query_id", "segment", "evidence_id"), ["query_id", "segment"])
    ids = found.groupBy("claim_id").agg(F.sort_array(F.collect_list(F.struct("_at", "evidence_id"))).alias("_all"))
    return claims.select("claim_id").join(ids, "claim_id", "left").select(
        "claim_id", F.coalesce(F.col("_all.evidence_id"), F.array().cast("array<string>")).alias("evidence_ids")
    )


# ---- claims and verdicts ----


def decompose(answers: DataFrame, cap: int = DEFAULTS.max_claims) -> DataFrame:
    """VER-02, TOP-10: query_id, claim_no and claim: long sentences that speak of the subject; else the whole answer."""
    long = F.filter(t.long_sentences(t.strip_citations(F.col("answer"))), lambda s: ~t.is_meta_claim(s))
    whole = F.array(t.strip(t.strip_citations(F.col("answer"))))
    claims = F.when(t.is_refusal(F.col("answer")), F.array().cast("array<string>")).otherwise(t.bound(long, lambda x: F.when(F.size(x) > 0, x).otherwise(whole)))
    rows = answers.select("query_id", F.posexplode(F.slice(claims, 1, cap)).alias("_at", "claim"))
    return rows.select("query_id", (F.col("_at") + 1).alias("claim_no"), "claim")


NEGATION = r"(?i)(?<![a-z])(not|no|never|none|without|cannot|n't)(?![a-z])"


def lexical_judge(claim: Column, segment: Column, support: float = 0.6) -> Column:
    """VER-03's offline stand-in, no model's quality: NEUTRAL below a share of the claim's words in the segment, else
    CONTRADICTED if just one of them is negated or a number of the claim is missing, else SUPPORTED."""
    found = word_overlap(claim, segment)
    return F.when(found["share"] < support, "NEUTRAL").when((claim.rlike(NEGATION) != segment.rlike(NEGATION)) | found["missing"], "CONTRADICTED").otherwise("SUPPORTED")


def judge(claims: DataFrame, served: DataFrame, judge_of: Callable[[Column, Column], Column] = lexical_judge) -> DataFrame:
    """query_id, claim_no, claim, state and supporting segments. Support wins over contradiction, that over neither."""
    pairs = claims.join(served.select("query_id", "segment", "text"), "query_id", "left")
    pairs = pairs.withColumn("state", F.coalesce(judge_of(F.col("claim"), F.col("text")), F.lit("NEUTRAL")))
    best = F.when(F.bool_or(F.col("state") == "SUPPORTED"), "SUPPORTED").when(F.bool_or(F.col("state") == "CONTRADICTED"), "CONTRADICTED").otherwise("NEUTRAL")
    named = F.sort_array(F.collect_list(F.when(F.col("state") != "NEUTRAL", F.col("segment"))))
    return pairs.groupBy("query_id", "claim_no", "claim").agg(best.alias("state"), named.alias("segments"))


def claim_summary(claims: DataFrame, key: str = "query_id", state: str = "state") -> DataFrame:
    """AGG-03: counts of states (unknown ones are neutral), coverage, contradiction rate and reliability."""
    name = F.upper(F.coalesce(F.col(state), F.lit("")))
    counts = claims.groupBy(key).agg(
        F.count_if(name == "SUPPORTED").alias("supported"), F.count_if(name == "CONTRADICTED").alias("contradicted"),
        F.count_if(~name.isin("SUPPORTED", "CONTRADICTED")).alias("neutral"), F.count(F.lit(1)).alias("total"),
    )
    counts = counts.withColumn("coverage", F.col("supported") / F.col("total")).withColumn("contradiction_rate", F.col("contradicted") / F.col("total"))
    return counts.withColumn("reliability", n.reliability(F.col("coverage"), F.col("contradiction_rate")))


def verdict(supported: Column, contradicted: Column, total: Column, answer: Column, d=DEFAULTS) -> Column:
    """VER-05, MAT-08/09: struct of verdict, status, score and diagnosis."""
    share = lambda x: F.when(total > 0, x / total).otherwise(0.0)
    coverage, contra = share(supported), share(contradicted)
    score = F.when(total > 0, n.reliability(coverage, contra)).otherwise(0.0)
    abstains = F.coalesce(answer == "ABSTAIN", F.lit(False))
    passes = F.when(total == 0, abstains).otherwise((coverage >= d.coverage_min) & (contra <= d.contradiction_max))
    status = (
        F.when(abstains, "ABSTAINED").when(total == 0, "FAILED").when(passes, "TRUSTED")
        .when(score >= d.abstain_below, "UNCERTAIN").otherwise("FAILED")
    )
    diagnosis = (
        F.when(total == 0, "RETRIEVAL_FAILURE").when(passes, "NONE")
        .when(contra > d.contradiction_max, "EVIDENCE_CONFLICT").otherwise("LOW_COVERAGE")
    )
    return F.struct(F.when(passes, "PASS").otherwise("FAIL").alias("verdict"), status.alias("status"), score.alias("score"), diagnosis.alias("diagnosis"))


def gate(answer: Column, chunks: Column, attempts: Column, d=DEFAULTS) -> Column:
    """VER-06: what happens before claims are looked at: no_evidence, refusal_final, refusal or verify."""
    refuses = t.is_refusal(answer)
    return (
        F.when(chunks == 0, "no_evidence").when(refuses & (attempts >= d.recovery_attempts), "refusal_final")
        .when(refuses, "refusal").otherwise("verify")
    )


def generation_guard(cached: Column, chunks: Column, outage: Column, refused_same: Column) -> Column:
    """GEN-03: reuse, keep_message, skip or generate."""
    return F.when(cached, "reuse").when(outage | (chunks == 0), "keep_message").when(refused_same, "skip").otherwise("generate")


def extractive_answer(served: DataFrame, most: int = 3) -> DataFrame:
    """GEN-01's offline default: the first sentence of the first segments, each cited; ABSTAIN without segments."""
    first = F.element_at(t.sentences(t.strip(F.col("text"))), 1)
    lines = served.where(F.col("segment") <= most).groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("segment", F.concat(first, F.lit(" [Segment "), F.col("segment").cast("string"), F.lit("]")).alias("line")))).alias("_all")
    )
    return lines.select("query_id", F.array_join(F.col("_all.line"), " ").alias("answer"))


def clean_answer(answer: Column, served: Column) -> Column:
    """GEN-01's cleaning: final section, reasoning, trailing ABSTAIN, citations of what wasn't served."""
    # Each step once: every one of them uses what it is given several times.
    for step in (t.final_answer, t.strip_think, t.strip_abstain):
        answer = t.bound(answer, step)
    return t.bound(answer, lambda x: t.strip_invalid_citations(x, served)["text"])


# ---- recovery ----

# The strategy for each diagnosis.
STRATEGIES = {"RETRIEVAL_FAILURE": "query_rewrite", "LOW_COVERAGE": "re_retrieve", "EVIDENCE_CONFLICT": "regenerate"}


def strategy(diagnosis: Column, attempt: Column, mode: str = "diagnosis") -> Column:
    """REC-01: by diagnosis, or in turns: rewrite, then retrieve again."""
    if mode == "round_robin":
        return F.when(attempt % 2 == 0, "query_rewrite").otherwise("re_retrieve")
    table = F.create_map(*[F.lit(x) for pair in STRATEGIES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, diagnosis), F.lit("query_rewrite"))


def downgrade(chosen: Column, chunks: Column, cap: Column) -> Column:
    """REC-05: with as many chunks as fit, retrieving more gives way to writing again."""
    return F.when((chosen == "re_retrieve") & (chunks >= cap), "regenerate").otherwise(chosen)


def goes_on(verdict_name: Column, attempts: Column, spent_tokens: Column, spent_ms: Column, calls: Column, d=DEFAULTS) -> Column:
    """REC-02/03: whether another round may start."""
    within = (spent_tokens < d.recovery_tokens) & (spent_ms < d.recovery_latency_ms) & (calls < d.model_calls)
    return (verdict_name != "PASS") & (attempts < d.recovery_attempts) & within


def expand_query(queries: DataFrame, served: DataFrame, add: int = 3) -> DataFrame:
    """REC-04's offline default: the question with the most frequent new words of what it was served."""
    words = served.select("query_id", F.explode(t.tokens(t.normalize(F.col("text")), True)).alias("term"))
    asked = queries.select("query_id", F.explode(t.tokens(t.normalize(F.col("query")), True)).alias("term"))
    counts = words.join(asked, ["query_id", "term"], "left_anti").groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("query_id").orderBy(F.desc("n"), "term")
    top = counts.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= add)
    extra = top.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "term"))), lambda x: x["term"]), " ").alias("_extra"))
    joined = queries.join(extra, "query_id", "left")
    return joined.withColumn("query", F.concat_ws(" ", "query", "_extra")).drop("_extra")


def neutral_claims(judged: DataFrame, per_run: int = DEFAULTS.claim_retrievals) -> DataFrame:
    """RET-09: the claims that get a retrieval of their own."""
    order = W.partitionBy("query_id").orderBy("claim_no")
    return judged.where("state = 'NEUTRAL'").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_run).drop("_n")


def latest_round(claims: DataFrame, key: str = "analysis_id") -> DataFrame:
    """WIN-02, STM-10: claims of the last attempt; where no row has an attempt, all."""
    last = F.max("attempt").over(W.partitionBy(key))
    return claims.withColumn("_last", last).where("_last IS NULL OR attempt = _last").drop("_last")


