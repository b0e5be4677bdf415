"""Session factory and the defaults that operators take."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Defaults:
    """Tuning constants of the engine. Fixed values that results depend on."""

    chunk_size: int = 512
    chunk_overlap: int = 64
    dense_top_k: int = 20
    sparse_top_k: int = 0
    rrf_k: int = 60
    fusion_top_k: int = 20
    max_context_chunks: int = 8
    max_sub_queries: int = 3
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    bm25_avg_len: int = 128
    rerank_top_k: int = 20
    coverage_min: float = 0.80
    contradiction_max: float = 0.20
    abstain_below: float = 0.50
    recovery_attempts: int = 2
    recovery_tokens: int = 2000
    recovery_latency_ms: int = 180_000
    max_claims: int = 8
    claim_retrievals: int = 3
    claim_top_k: int = 5
    query_tokens: int = 400
    model_calls: int = 24
    adaptive_score: float = 0.02
    adaptive_k: int = 4
    cache_similarity: float = 0.94
    cache_entries: int = 500
    cache_hours: int = 24
    context_chars: int = 3000


DEFAULTS = Defaults()


def spark_session(app: str = "lucerna", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; LUCERNA_SHUFFLE_PARTITIONS overrides the partition count."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    if "LUCERNA_SHUFFLE_PARTITIONS" in os.environ:
        builder = builder.config("spark.sql.shuffle.partitions", os.environ["LUCERNA_SHUFFLE_PARTITIONS"])
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: what spark.checkpoint.dir names. On one machine without it, a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="lucerna-shared-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


def kept(df: DataFrame) -> DataFrame:
    """df worked out once, into the shared folder: executors can be lost afterwards without recomputing what came before."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
