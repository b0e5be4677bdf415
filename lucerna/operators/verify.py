"""Claim verification in stages over many answers at once: tolerant verdicts, bounded fallbacks, targeted retrieval.

The relation of claims has a pending part, those without a verdict, which shrinks from stage to stage:

* fused: claims and verdicts of an answer in one call;
* batch: the claims of answers that fused left, in one call an answer, and once more for those whose call failed (retry);
* alone: at most `max_alone` claims an answer that still have none, one call each;
* left: all others, NEUTRAL.

A judge gives each stage's payloads as rows; a null payload, or one that doesn't parse, is a failed call. Every stage's result is written
to the shared folder, so a later stage calls no judge again, and a stage whose pending part is empty isn't planned. An answer's calls and
failures are counted in rows.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from ..session import DEFAULTS, kept
from .evidence import audit_integrity, decompose, judge, lexical_judge, neutral_claims, unseen

MAX_ALONE = 8
VERDICT = "struct<claim_id:bigint,verdict:string,segments:array<bigint>,explanation:string>"

# ---- payloads ----


def _objects(items: Column) -> Column:
    """Of an array of variants, the objects, and those that strings hold; all others drop out."""
    kind = lambda x: F.schema_of_variant(x)
    opened = F.transform(items, lambda x: F.when(kind(x) == "STRING", F.try_parse_json(F.try_variant_get(x, "$", "string"))).otherwise(x))
    return F.filter(opened, lambda x: F.coalesce(kind(x).startswith("OBJECT"), F.lit(False)))


def _list(payload: Column, name: str) -> Column:
    """The array under a name of the object in a model's text, or in its `properties`; null where there is none."""
    found = F.try_parse_json(t.json_substring(payload))
    own = F.try_variant_get(found, f"$.{name}", "array<variant>")
    return F.coalesce(own, F.try_variant_get(found, f"$.properties.{name}", "array<variant>"))


def _segments(item: Column) -> Column:
    """STR-19 for a list, a string or a number of segments."""
    several = F.try_variant_get(item, "$.supporting_segments", "array<string>")
    return t.segment_list(F.coalesce(several, F.array(F.try_variant_get(item, "$.supporting_segments", "string"))))


def batch_verdicts(payload: Column) -> Column:
    """JSN-02: the verdicts of a batch: claim_id, verdict, segments and explanation of each item that is an object.

    Null where the text holds no list of verdicts, or an item lacks its claim_id or verdict: then the call failed. A list without
    objects is empty.
    """
    items = _objects(_list(payload, "verdicts"))
    field = lambda x, name: F.try_variant_get(x, f"$.{name}", "string")
    whole = F.forall(items, lambda x: field(x, "claim_id").isNotNull() & field(x, "verdict").isNotNull())
    verdicts = F.transform(
        items,
        lambda x: F.struct(
            t.claim_id(field(x, "claim_id")).alias("claim_id"), t.verdict(field(x, "verdict")).alias("verdict"), _segments(x).alias("segments"),
            F.coalesce(field(x, "explanation"), F.lit("")).alias("explanation"),
        ),
    )
    return F.when(whole, verdicts)


def fused_items(payload: Column) -> Column:
    """The items of a fused call: claim, verdict and segments; null where it failed."""
    items = _objects(_list(payload, "items"))
    field = lambda x, name: F.try_variant_get(x, f"$.{name}", "string")
    whole = F.forall(items, lambda x: field(x, "claim").isNotNull() & field(x, "verdict").isNotNull())
    return F.when(whole, F.transform(items, lambda x: F.struct(field(x, "claim").alias("claim"), t.verdict(field(x, "verdict")).alias("verdict"), _segments(x).alias("segments"))))


# ---- judges ----


class Judge(Protocol):
    """VER-03: a model behind three calls; each returns the rows that it was given with a payload, null where the call failed."""

    def fused(self, answers: DataFrame, served: DataFrame) -> DataFrame:
        """query_id and payload for answers (query_id, answer)."""

    def batch(self, claims: DataFrame, served: DataFrame, attempt: int) -> DataFrame:
        """query_id and payload for claims (query_id, claim_no, claim); attempt: 0, or 1 for the retry."""

    def alone(self, claims: DataFrame, served: DataFrame) -> DataFrame:
        """query_id, claim_no and payload for claims (query_id, claim_no, claim)."""


class LexicalJudge:
    """The offline stand-in: evidence.judge, put into payloads."""

    def __init__(self, judge_of: Callable[[Column, Column], Column] = lexical_judge):
        self.judge_of = judge_of

    def fused(self, answers: DataFrame, served: DataFrame) -> DataFrame:
        found = judge(decompose(answers, 1 << 20), served, self.judge_of)
        item = F.struct("claim_no", "claim", F.col("state").alias("verdict"), F.col("segments").alias("supporting_segments"))
        return found.groupBy("query_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(item)).alias("items"))).alias("payload"))

    def batch(self, claims: DataFrame, served: DataFrame, attempt: int) -> DataFrame:
        found = judge(claims, served, self.judge_of)
        item = F.struct(F.col("claim_no").alias("claim_id"), F.col("state").alias("verdict"), F.col("segments").alias("supporting_segments"))
        return found.groupBy("query_id").agg(F.to_json(F.struct(F.collect_list(item).alias("verdicts"))).alias("payload"))

    def alone(self, claims: DataFrame, served: DataFrame) -> DataFrame:
        found = judge(claims, served, self.judge_of)
        item = F.struct(F.lit(1).alias("claim_id"), F.col("state").alias("verdict"), F.col("segments").alias("supporting_segments"))
        return found.select("query_id", "claim_no", F.to_json(F.struct(F.array(item).alias("verdicts"))).alias("payload"))


# ---- stages ----

STATES = "query_id {0}, claim_no int, claim string, state string, segments array<bigint>, stage string"


def verify(
    answers: DataFrame, served: DataFrame, model: Judge | None = None, attempt: int = 0, fuse: bool = True, max_claims: int = DEFAULTS.max_claims, max_alone: int = MAX_ALONE,
    contradiction_max: float = DEFAULTS.contradiction_max,
) -> tuple[DataFrame, DataFrame]:
    """VER-04: (claims, calls). claims: query_id, claim_no, claim, state, segments and stage; calls: query_id, stage, calls and failed.

    answers: query_id, answer; served: query_id, segment, text. A refusal or an answer without text has no claims. On a recovery
    attempt, and where contradictions are over their share already, no claim is judged alone.
    """
    model = model or LexicalJudge()
    spark, kind = answers.sparkSession, dict(answers.dtypes)["query_id"]
    done: list[DataFrame] = []
    calls: list[DataFrame] = []

    def counted(stage: str, asked: DataFrame, good: Column) -> None:
        calls.append(kept(asked.groupBy("query_id").agg(F.lit(stage).alias("stage"), F.count(F.lit(1)).alias("calls"), F.count_if(~F.coalesce(good, F.lit(False))).alias("failed"))))

    worth = answers.where((t.strip(F.coalesce("answer", F.lit(""))) != "") & ~t.is_refusal(F.col("answer")))
    rest = worth = kept(worth.select("query_id", "answer"))
    if fuse:
        able = kept(worth.join(served.select("query_id").distinct(), "query_id", "left_semi"))
        found = kept(able.select("query_id").join(model.fused(able, served).select("query_id", fused_items(F.col("payload")).alias("items")), "query_id", "left"))
        counted("fused", found, F.col("items").isNotNull())
        each = found.select("query_id", F.posexplode("items").alias("_at", "x")).where((t.strip(F.col("x.claim")) != "") & ~t.is_meta_claim(F.col("x.claim")))
        each = each.withColumn("claim_no", F.row_number().over(W.partitionBy("query_id").orderBy("_at"))).where(F.col("claim_no") <= max_claims)
        fused = kept(each.select("query_id", "claim_no", F.col("x.claim").alias("claim"), F.col("x.verdict").alias("state"), F.col("x.segments").alias("segments"), F.lit("fused").alias("stage")))
        done.append(fused)
        rest = kept(worth.join(fused.select("query_id").distinct(), "query_id", "left_anti"))
    pending = kept(decompose(rest, max_claims))
    judged = spark.createDataFrame([], STATES.format(kind))
    for number, stage in enumerate(("batch", "retry")):
        # Only answers whose call failed are asked again; a list that leaves claims out did not fail.
        open_ = pending if number == 0 else kept(pending.join(failed, "query_id", "left_semi"))
        if not open_.limit(1).count():
            break
        asked = open_.select("query_id").distinct()
        found = kept(asked.join(model.batch(open_, served, number).select("query_id", batch_verdicts(F.col("payload")).alias("verdicts")), "query_id", "left"))
        counted(stage, found, F.col("verdicts").isNotNull())
        failed = found.where("verdicts IS NULL").select("query_id")
        each = found.select("query_id", F.posexplode("verdicts").alias("_at", "x"))
        # Of several verdicts on one claim, the last.
        last = each.groupBy("query_id", F.col("x.claim_id").alias("claim_no")).agg(F.max_by("x", "_at").alias("x"))
        found = open_.join(last.withColumn("claim_no", F.col("claim_no").cast("int")), ["query_id", "claim_no"])
        judged = kept(judged.unionByName(found.select("query_id", "claim_no", "claim", F.col("x.verdict").alias("state"), F.col("x.segments").alias("segments"), F.lit(stage).alias("stage"))))
    done.append(judged)
    pending_all = pending
    pending = kept(pending.join(judged.select("query_id", "claim_no"), ["query_id", "claim_no"], "left_anti"))
    if pending.limit(1).count():
        sizes = pending_all.groupBy("query_id").agg(F.count(F.lit(1)).alias("_all"))
        refuted = judged.groupBy("query_id").agg(F.count_if(F.col("state") == "CONTRADICTED").alias("_refuted"))
        budget = F.when((F.lit(attempt) > 0) | (F.coalesce("_refuted", F.lit(0)) > F.lit(contradiction_max) * F.col("_all")), 0).otherwise(max_alone)
        placed = pending.join(sizes, "query_id").join(refuted, "query_id", "left").withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy("claim_no")))
        placed = kept(placed.withColumn("_alone", F.col("_n") <= budget).select("query_id", "claim_no", "claim", "_alone"))
        asked = placed.where("_alone").drop("_alone")
        if asked.limit(1).count():
            found = model.alone(asked, served).select("query_id", "claim_no", F.get(batch_verdicts(F.col("payload")), F.lit(0)).alias("x"))
            found = kept(asked.join(found, ["query_id", "claim_no"], "left"))
            counted("alone", found, F.col("x").isNotNull())
            none = F.array().cast("array<bigint>")
            done.append(found.select("query_id", "claim_no", "claim", F.coalesce("x.verdict", F.lit("NEUTRAL")).alias("state"), F.coalesce("x.segments", none).alias("segments"), F.lit("alone").alias("stage")))
        done.append(placed.where("NOT _alone").select("query_id", "claim_no", "claim", F.lit("NEUTRAL").alias("state"), F.array().cast("array<bigint>").alias("segments"), F.lit("left").alias("stage")))
    claims = spark.createDataFrame([], STATES.format(kind))
    for part in done:
        claims = claims.unionByName(part)
    said = spark.createDataFrame([], f"query_id {kind}, stage string, calls long, failed long")
    for part in calls:
        said = said.unionByName(part)
    return claims, said


# ---- targeted retrieval ----


def fresh_evidence(targets: DataFrame, found: DataFrame, seen: DataFrame, references: DataFrame) -> DataFrame:
    """JOIN-08 for claims: of what each claim's own search found, the chunks that its answer was not served and that no earlier claim took.

    targets: query_id, claim_no; found: query_id, claim_no, rank, doc_id, chunk_index, text; seen: query_id, doc_id, chunk_index, text. Only chunks
    whose text has the stored hash are served: query_id, claim_no, segment, doc_id, chunk_index and text.
    """
    own = found.join(targets.select("query_id", "claim_no"), ["query_id", "claim_no"])
    # unseen() compares within one answer: the answer's id goes into the compared document id.
    of = lambda df: df.withColumn("_doc", F.col("doc_id")).withColumn("doc_id", F.concat_ws("/", F.col("query_id").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    new = unseen(of(own), of(seen)).drop("doc_id").withColumnRenamed("_doc", "doc_id")
    first = W.partitionBy("query_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("chunk_index", F.lit(-1)), F.substring("text", 1, 80)).orderBy("claim_no", "rank")
    new = new.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    whole = audit_integrity(new, references).where("integrity_status = 'VERIFIED'").drop("integrity_status")
    number = F.row_number().over(W.partitionBy("query_id", "claim_no").orderBy("rank", "doc_id"))
    return whole.withColumn("segment", number)


def rejudged(
    judged: DataFrame, search: Callable[[DataFrame], DataFrame], seen: DataFrame, references: DataFrame, judge_of: Callable[[Column, Column], Column] = lexical_judge,
    per_run: int = DEFAULTS.claim_retrievals, top_k: int = DEFAULTS.claim_top_k,
) -> DataFrame:
    """RET-09: query_id, claim_no, state and evidence (doc_ids) of the neutral claims whose verdict changes by evidence of their own.

    At most per_run claims an answer are searched for, those that come first; search gives query_id, claim_no, rank, doc_id, chunk_index and text
    of claims (query_id, claim_no, claim), of which the first top_k count. Contradicted claims are not asked again. All other claims are untouched.
    """
    targets = kept(neutral_claims(judged, per_run).select("query_id", "claim_no", "claim"))
    fresh = kept(fresh_evidence(targets, search(targets).where(F.col("rank") <= top_k), seen, references))
    key = F.concat_ws("/", "query_id", "claim_no")
    each = judge(targets.select(key.alias("query_id"), "claim_no", "claim"), fresh.select(key.alias("query_id"), "segment", "text"), judge_of)
    turned = each.where("state <> 'NEUTRAL'").select(F.col("query_id").alias("_key"), "state", F.explode("segments").alias("segment"))
    rows = fresh.withColumn("_key", key).join(turned, ["_key", "segment"])
    return rows.groupBy("query_id", "claim_no").agg(F.first("state").alias("state"), F.transform(F.sort_array(F.collect_list(F.struct("segment", "doc_id"))), lambda x: x["doc_id"]).alias("evidence"))


def with_changes(judged: DataFrame, changes: DataFrame) -> DataFrame:
    """judged with the changed states; segments of a changed claim are none, since they count in its own evidence."""
    new = changes.select("query_id", "claim_no", F.col("state").alias("_state"), "evidence")
    rows = judged.join(new, ["query_id", "claim_no"], "left")
    none = F.array().cast(dict(judged.dtypes)["segments"])
    return rows.withColumn("segments", F.when(F.col("_state").isNotNull(), none).otherwise(F.col("segments"))).withColumn("state", F.coalesce("_state", "state")).drop("_state")


def summary_by_delta(summary: DataFrame, changes: DataFrame) -> DataFrame:
    """AGG-03 kept up to date: counts of answers whose claims changed get the difference, no claim is counted again."""
    moved = changes.groupBy("query_id").agg(F.count_if(F.col("state") == "SUPPORTED").alias("_s"), F.count_if(F.col("state") == "CONTRADICTED").alias("_c"))
    rows = summary.join(moved, "query_id", "left").na.fill(0, ["_s", "_c"])
    rows = rows.withColumn("supported", F.col("supported") + F.col("_s")).withColumn("contradicted", F.col("contradicted") + F.col("_c")).withColumn("neutral", F.col("neutral") - F.col("_s") - F.col("_c"))
    rows = rows.withColumn("coverage", F.col("supported") / F.col("total")).withColumn("contradiction_rate", F.col("contradicted") / F.col("total"))
    return rows.withColumn("reliability", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("coverage") * (1.0 - F.col("contradiction_rate"))))).drop("_s", "_c")


