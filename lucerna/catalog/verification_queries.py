"""Verification in stages, tolerant verdicts and targeted retrieval over conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as n
from ..operators import evidence as e
from ..operators import retrieval as r
from ..operators import verify as v
from ..operators.compress import compress
from ..plans.guard import BudgetSpent, guarded
from ..session import kept
from . import query, table
from .lexical_sql import SQL_STRIP
from .retrieval_queries import kept_index
from .text_queries import SQL_TIDY


def _answers(spark, d):
    """Assistant turns as answers, and the user's turns of their conversation as what they were served."""
    rows = table(spark, d, "conversations")
    answers = rows.where("role = 'assistant'").select(F.concat_ws("/", "conv_id", "turn").alias("query_id"), F.col("text").alias("answer"), "conv_id")
    said = rows.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("segment"), "text")
    served = answers.select("query_id", "conv_id").join(said, "conv_id").select("query_id", "segment", "text")
    return answers.drop("conv_id"), served


@query(
    """
    SELECT conv_id, turn, turn % 6 IN (3, 5) AS failed, CASE WHEN turn % 6 IN (0, 1, 2) THEN 1 ELSE 0 END AS verdicts,
        CASE turn % 6 WHEN 0 THEN (turn + 1)::VARCHAR || ' SUPPORTED 1,2' WHEN 1 THEN '3 CONTRADICTED 4' WHEN 2 THEN '2 NEUTRAL ' ELSE '' END AS said,
        sha256(CASE WHEN turn % 6 IN (0, 1, 2) THEN coalesce(text, '') ELSE '' END) AS explained FROM conversations
    """
)
def jsn02_batch_verdicts(spark, d):
    """Payloads as models write them, made from every turn: objects, strings that hold objects, bare numbers, wrappers, broken text."""
    k, turn = F.col("turn") % 6, F.col("turn")
    item = lambda claim, verdict, segments: F.to_json(F.struct(claim.alias("claim_id"), F.lit(verdict).alias("verdict"), segments.alias("supporting_segments"), F.col("text").alias("explanation")))
    first = item(turn + 1, "supported.", F.array(F.lit("1"), F.lit("segment 2")))
    second = F.to_json(F.struct(F.array(item(F.lit("claim 3"), "Refuted", F.lit("4"))).alias("verdicts")))
    third = item(F.lit(2), "perhaps", F.array().cast("array<int>"))
    payload = (
        F.when(k == 0, F.concat(F.lit('Here: {"verdicts": ['), first, F.lit(", 7]} done"))).when(k == 1, second)
        .when(k == 2, F.concat(F.lit('```json\n{"properties": {"verdicts": ['), third, F.lit(', "none"]}}\n```')))
        .when(k == 3, F.lit("no verdicts at all")).when(k == 4, F.lit('{"verdicts": [1, 2]}')).otherwise(F.concat(F.lit('{"verdicts": ['), first))
    )
    rows = table(spark, d, "conversations").select("conv_id", "turn", v.batch_verdicts(payload).alias("x"))
    text = lambda x: F.concat_ws(" ", x["claim_id"].cast("string"), x["verdict"], F.array_join(x["segments"].cast("array<string>"), ","))
    return rows.select(
        "conv_id", "turn", F.col("x").isNull().alias("failed"), F.coalesce(F.size("x"), F.lit(0)).alias("verdicts"),
        F.coalesce(F.array_join(F.transform("x", text), ";"), F.lit("")).alias("said"), n.text_hash(F.coalesce(F.array_join(F.transform("x", lambda x: x["explanation"]), ";"), F.lit(""))).alias("explained"),
    ).withColumn("verdicts", F.greatest("verdicts", F.lit(0)))


class SometimesFailing(v.LexicalJudge):
    """Calls fail by the answer's conversation and turn, as models fail: all kinds of failure in one table."""

    def fused(self, answers, served):
        return super().fused(answers, served).withColumn("payload", F.when(F.crc32(F.col("query_id").cast("binary")) % 2 == 0, F.col("payload")))

    def batch(self, claims, served, attempt):
        found = super().batch(claims, served, attempt)
        fails = F.crc32(F.col("query_id").cast("binary")) % 3 == (1 if attempt == 0 else 2)
        both = F.crc32(F.col("query_id").cast("binary")) % 11 == 0
        return found.withColumn("payload", F.when(~fails & ~both, F.col("payload")).otherwise('{"verdicts": [{"claim_id"'))

    def alone(self, claims, served):
        return super().alone(claims, served).withColumn("payload", F.when(F.crc32(F.concat("query_id", "claim_no").cast("binary")) % 4 != 0, F.col("payload")))


@query()
def ver04_stages(spark, d):
    """Every answer through all stages, with a judge that fails by rule."""
    claims, _ = v.verify(*_answers(spark, d), SometimesFailing(), max_claims=12)
    return claims.select("query_id", "claim_no", n.text_hash(F.col("claim")).alias("digest"), "state", "stage")


@query()
def ver04_calls(spark, d):
    """Calls and failures of each stage."""
    _, calls = v.verify(*_answers(spark, d), SometimesFailing(), max_claims=12)
    return calls.groupBy("stage").agg(F.sum("calls").alias("calls"), F.sum("failed").alias("failed"))


def searched(spark, d, index):
    """A search of documents for claims: BM25 over the kept index."""
    docs = table(spark, d, "documents").select("doc_id", F.lit(0).alias("chunk_index"), "text")

    def search(claims):
        asked = r.lexed(claims.select(F.xxhash64("query_id", "claim_no").alias("_q"), "query_id", "claim_no", "claim"), "claim", is_query=True)
        asked = kept(asked.select("_q", "query_id", "claim_no", "terms"))
        found = index.search(asked.select(F.col("_q").alias("query_id"), "terms"), 5).withColumnRenamed("query_id", "_q")
        return found.join(asked.drop("terms"), "_q").join(docs, "doc_id").select("query_id", "claim_no", F.col("sparse_rank").alias("rank"), "doc_id", "chunk_index", "text")

    return search


@query()
def ret09_claim_retrieval(spark, d):
    """Neutral claims of all answers, each with a search of its own over the documents; counts by difference."""
    answers, served = _answers(spark, d)
    judged = kept(e.judge(e.decompose(answers), served))
    docs = table(spark, d, "documents").select("doc_id", F.lit(0).alias("chunk_index"), n.text_hash(F.col("text")).alias("text_hash"))
    seen = served.select("query_id", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("chunk_index"), "text")
    half = lambda claim, text: e.lexical_judge(claim, text, 0.3)
    changes = kept(v.rejudged(judged, searched(spark, d, kept_index(spark, d)), seen, docs, half))
    return v.summary_by_delta(e.claim_summary(judged), changes).select("query_id", "supported", "contradicted", "neutral", "total", F.round("reliability", 9).alias("reliability"))


@query()
def gen02_compressed_context(spark, d):
    """Every benchmark question with the documents that BM25 finds for it, within 2000 characters."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    asked = r.lexed(items, "query", is_query=True).select("query_id", "terms")
    found = r.with_found(table(spark, d, "documents").select("doc_id", "text"), kept_index(spark, d).search(asked, 5), "doc_id")
    out = compress(items, found.select("query_id", F.col("sparse_rank").alias("segment"), "text"), 2000)
    return out.select("query_id", n.text_hash(F.col("context")).alias("digest"), F.length("context").alias("chars"), F.array_join(F.col("segments").cast("array<string>"), ",").alias("segments"), "covered")


@query(
    """
    WITH q AS (SELECT DISTINCT conv_id AS query_id FROM conversations), n AS (SELECT unnest(['retrieve', 'search', 'write', 'judge', 'count']) AS node, unnest(['outage', 'timeout', 'budget', 'failed', 'completed']) AS state)
    SELECT query_id, node, 'started' AS event, 'running' AS state, 0 AS attempt FROM q, n UNION ALL
    SELECT query_id, node, CASE state WHEN 'completed' THEN 'finished' ELSE 'failed' END, state, CASE state WHEN 'outage' THEN 2 WHEN 'completed' THEN 0 ELSE 1 END FROM q, n
    """
)
def rec06_guarded_stages(spark, d):
    """Every conversation through five stages, of which four fail, each in a way of its own."""
    rows = table(spark, d, "conversations")
    questions = kept(rows.select(F.col("conv_id").alias("query_id"), F.lit(0).alias("attempt")).distinct())

    def raises(error):
        def stage(_):
            raise error

        return stage

    counts = lambda q: q.join(rows.groupBy(F.col("conv_id").alias("query_id")).count(), "query_id")
    # A failure inside the executors is a stage's failure too.
    broken = lambda q: q.select("query_id", F.raise_error(F.lit("no verdict")).alias("x"))
    stages = {"retrieve": raises(r.RetrievalOutage("down")), "search": raises(TimeoutError("late")), "write": raises(BudgetSpent("spent")), "judge": broken, "count": counts}
    events = None
    for node, stage in stages.items():
        _, said = guarded(questions, node, stage)
        events = said if events is None else events.unionByName(said)
    return events


_said = "'<think>hm' || text || '</think>' || text || ' [Segment 9] [Segment 2] ABSTAIN.'"
_thought = rf"regexp_replace({SQL_STRIP.format(_said)}, '(?is)<\s*think\b[^>]*>.*?<\s*/\s*think\s*>', '', 'g')"
_kept = SQL_STRIP.format(rf"regexp_replace({SQL_STRIP.format(_thought)}, '(?:(?:^|\s+)ABSTAIN\.*)+$', '')")


@query(f"SELECT conv_id, turn, sha256({SQL_TIDY.format(f'''replace({_kept}, '[Segment 9]', '')''')}) AS digest FROM conversations")
def gen01_clean_answers(spark, d):
    """Every turn as a model's answer with its thoughts, a citation of what was not served, and a doubt at the end."""
    answer = F.concat(F.lit("<think>hm"), "text", F.lit("</think>"), "text", F.lit(" [Segment 9] [Segment 2] ABSTAIN."))
    return table(spark, d, "conversations").select("conv_id", "turn", n.text_hash(e.clean_answer(answer, F.lit(3))).alias("digest"))
