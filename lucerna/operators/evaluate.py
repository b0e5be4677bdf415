"""Retrieval metrics, run aggregates, latencies and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import path_template, token_estimate


def ranking_metrics(retrieved: DataFrame, gold: DataFrame, k: int = 8) -> DataFrame:
    """MAT-10, SET-03: recall@k, hit@k, reciprocal rank and nDCG@k for each question with gold.

    retrieved: query_id, item, rank (from 1, distinct items); gold: query_id, item. All gold counts, found or not.
    """
    truth = gold.select("query_id", "item").distinct()
    rows = retrieved.select("query_id", "item", "rank")
    return _metrics(rows, rows.join(truth, ["query_id", "item"], "left_semi"), truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("gold")), k)


def class_ranking_metrics(retrieved: DataFrame, queries: DataFrame, items: DataFrame, k: int = 8) -> DataFrame:
    """ranking_metrics where the gold of a question are all items of its classes: gold is counted by class, its pairs are never made.

    queries: query_id, class; items: item, class. An item that shares several classes with a question counts once; only items of several classes
    meet questions one by one for that. Null classes have no items.
    """
    asked, held = (x.where(F.col("class").isNotNull()).distinct() for x in (queries.select("query_id", "class"), items.select("item", "class")))
    sizes = asked.join(held.groupBy("class").agg(F.count(F.lit(1)).alias("gold")), "class").groupBy("query_id").agg(F.sum("gold").alias("gold"))
    several = held.groupBy("item").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("item")
    shared = asked.join(held.join(several, "item", "left_semi"), "class").groupBy("query_id", "item").agg((F.count(F.lit(1)) - 1).alias("_again"))
    shared = shared.groupBy("query_id").agg(F.sum("_again").alias("_again"))
    sizes = sizes.join(shared, "query_id", "left").select("query_id", (F.col("gold") - F.coalesce("_again", F.lit(0))).alias("gold"))
    rows = retrieved.select("query_id", "item", "rank")
    found = rows.join(held, "item").join(asked, ["query_id", "class"], "left_semi").select(*rows.columns).distinct()
    return _metrics(rows, rows.join(found, rows.columns, "left_semi"), sizes, k)


def _metrics(rows: DataFrame, good: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """rows: query_id, item, rank; good: those of them that are gold; sizes: query_id and gold, how many there are."""
    depth = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("retrieved"))
    hits = good.groupBy("query_id").agg(
        F.count_if(F.col("rank") <= k).alias("found"),
        F.min("rank").alias("first"),
        F.sum(F.when(F.col("rank") <= k, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    joined = sizes.join(depth, "query_id", "left").join(hits, "query_id", "left")
    ideal_n = F.least("gold", F.least(F.coalesce("retrieved", F.lit(0)), F.lit(k))).cast("int")
    ideal = F.aggregate(
        F.when(ideal_n > 0, F.sequence(F.lit(1), F.greatest(ideal_n, F.lit(1)))).otherwise(F.array().cast("array<int>")),
        F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + F.lit(1.0)),
    )
    return joined.select(
        "query_id", (F.coalesce("found", F.lit(0)) / F.col("gold")).alias("recall"),
        (F.coalesce("found", F.lit(0)) > 0).cast("double").alias("hit"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
        F.when(ideal > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg"),
    )


def resolve_snippets(evidence: DataFrame, snippets: DataFrame) -> DataFrame:
    """JOIN-13: query_id, snippet and the place (from 0) of the first evidence text that holds it, or null.

    Snippets meet only their own question's evidence: an equi-join on query_id with the substring test on top.
    """
    pairs = snippets.join(evidence.select("query_id", "place", "text"), "query_id", "left")
    holds = F.contains(F.lower(F.col("text")), F.lower(F.col("snippet")))
    return pairs.groupBy("query_id", "snippet").agg(F.min(F.when(holds, F.col("place"))).alias("found_at"))


def snippet_metrics(resolved: DataFrame) -> DataFrame:
    """MAT-11."""
    return resolved.groupBy("query_id").agg(
        F.avg(F.col("found_at").isNotNull().cast("double")).alias("snippet_recall"),
        F.avg(F.coalesce(1.0 / (F.col("found_at") + 1), F.lit(0.0))).alias("snippet_mrr"),
    )


def citation_correctness(flags: Column) -> Column:
    """AGG-15: share of citations that support; null without citations."""
    return F.avg(flags.cast("double"))


def is_abstained(status: Column) -> Column:
    return F.lower(F.coalesce(status, F.lit(""))) == "abstained"


def query_scores(ranking: DataFrame, snippets: DataFrame, claims: DataFrame, runs: DataFrame) -> DataFrame:
    """MAT-12: one row a question. runs: query_id, query_class, status, expected_outcome, latency_ms, citation_correctness."""
    joined = runs.join(ranking, "query_id", "left").join(snippets, "query_id", "left").join(claims, "query_id", "left")
    counts = {c: 0 for c in ("recall", "hit", "rr", "ndcg", "snippet_recall", "snippet_mrr", "supported", "contradicted", "neutral", "total", "coverage", "contradiction_rate", "reliability")}
    joined = joined.na.fill(counts)
    return joined.withColumn("abstained", is_abstained(F.col("status"))).withColumn("outcome_match", F.lower("status") == F.lower("expected_outcome"))


def aggregate_scores(scores: DataFrame, *by: str) -> DataFrame:
    """AGG-06, AGG-14, AGG-16: means over questions, ratios weighted by claims, citations without nulls."""
    total = F.sum("total")
    ratio = lambda x: F.when(total > 0, F.sum(x) / total).otherwise(0.0)
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("queries"),
        *[F.avg(c).alias(c) for c in ("recall", "hit", "rr", "ndcg")],
        ratio("supported").alias("support_rate"), ratio("contradicted").alias("contradiction_rate"),
        F.avg("citation_correctness").alias("citation_correctness"),
        F.avg(F.col("abstained").cast("double")).alias("abstention_rate"),
        F.avg(F.col("outcome_match").cast("double")).alias("outcome_match_rate"),
    )


def class_histogram(scores: DataFrame, column: str = "query_class") -> DataFrame:
    return scores.groupBy(column).agg(F.count(F.lit(1)).alias("queries"))


def latency_summary(samples: DataFrame, value: str, *by: str) -> DataFrame:
    """AGG-07: count, least, exact interpolated percentiles, most."""
    return samples.groupBy(*by).agg(
        F.count(value).alias("count"), F.min(value).alias("min"), F.percentile(value, 0.5).alias("p50"),
        F.percentile(value, 0.95).alias("p95"), F.max(value).alias("max"),
    )


def trace_spans(events: DataFrame, run: str, ts: str) -> DataFrame:
    """AGG-08: milliseconds between a run's first and last stamps; null with fewer than two."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return events.groupBy(run).agg(F.when(F.count(ts) >= 2, (F.max(micros) - F.min(micros)) / 1000.0).alias("span_ms"))


def http_counters(requests: DataFrame) -> DataFrame:
    """AGG-11: method, templated path, status: requests and latency. requests: method, path, status, ms."""
    return requests.groupBy("method", path_template(F.col("path")).alias("path"), "status").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("ms").alias("latency_sum"), F.count("ms").alias("latency_count")
    )


def counters(rows: DataFrame, column: str, amount: str | None = None) -> DataFrame:
    """AGG-12, AGG-05: how many rows, or how much of amount, each value has."""
    total = F.sum(amount) if amount else F.count(F.lit(1))
    return rows.groupBy(column).agg(total.alias("total"))


def call_ledger(calls: DataFrame, cap: int) -> DataFrame:
    """AGG-13: calls and tokens for each run and model; estimates where the provider tells none, and whether the run's
    cap is reached. calls: run_id, model, input_tokens, output_tokens, prompt, answer."""
    rows = calls.select(
        "run_id", "model", F.coalesce("input_tokens", token_estimate(F.col("prompt"))).alias("tokens_in"),
        F.coalesce("output_tokens", token_estimate(F.col("answer"))).alias("tokens_out"),
    )
    models = rows.groupBy("run_id", "model").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    runs = models.groupBy("run_id").agg(F.sum("calls").alias("run_calls"))
    return models.join(runs, "run_id").withColumn("exhausted", F.col("run_calls") >= cap)


def hit_rate(lookups: DataFrame, *by: str) -> DataFrame:
    """AGG-18: lookups: hit (boolean)."""
    return lookups.groupBy(*by).agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("lookups"), F.avg(F.col("hit").cast("double")).alias("hit_rate"))


def dashboard(runs: DataFrame, claims: DataFrame, *by: str) -> DataFrame:
    """AGG-04: mean reliability of scored runs, claims and the share supported. Grouped, or over all."""
    left = runs.groupBy(*by).agg(F.avg("reliability").alias("mean_reliability"), F.count("reliability").alias("scored_runs"))
    right = claims.groupBy(*by).agg(F.count(F.lit(1)).alias("claims"), F.avg((F.upper("state") == "SUPPORTED").cast("double")).alias("supported_share"))
    return left.join(right, list(by), "full_outer") if by else left.crossJoin(right)  # one row each


def results_lines(scores: DataFrame, by: str, config: dict[str, str]) -> DataFrame:
    """SNK-08: an evaluation run as lines of JSON: kind `run` with its configuration, `class` with the aggregate of each class, `query` with each score row.

    Lines are written by as many tasks as have rows; a reader tells them apart by kind.
    """
    line = lambda kind, row: F.to_json(F.struct(F.lit(kind).alias("kind"), row), {"ignoreNullFields": "false"}).alias("line")
    of = lambda df, kind, name: df.select(line(kind, F.struct(*df.columns).alias(name)))
    run = scores.sparkSession.range(1).select(line("run", F.create_map(*[F.lit(x) for pair in sorted(config.items()) for x in pair]).alias("config")))
    return run.unionByName(of(aggregate_scores(scores, by), "class", "summary")).unionByName(of(scores, "query", "scores"))
