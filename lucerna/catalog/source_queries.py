"""Files, uploads, recognised pages, evaluation sets and lists of documents, made from whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import numbers as n
from ..functions import text as t
from ..operators import evidence as e
from ..operators import records as rec
from ..session import shared_folder
from ..sources import files
from . import query, table
from .lexical_sql import SQL_STRIP


def _files(spark, d):
    """Every document as a file: plain texts in either case, a type that isn't taken, and a PDF that is none."""
    k = F.col("doc_id") % 4
    ext = F.when(k == 0, ".TXT").when(k == 1, ".md").when(k == 2, ".exe").otherwise(".pdf")
    path = F.concat(F.lit("kb/Doc ("), F.col("doc_id").cast("string"), F.lit(")"), ext)
    return table(spark, d, "documents").select(path.alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


@query(
    "SELECT 'kb/Doc (' || doc_id::VARCHAR || ')' || CASE doc_id % 4 WHEN 0 THEN '.TXT' WHEN 1 THEN '.md' WHEN 2 THEN '.exe' ELSE '.pdf' END AS path, CASE doc_id % 4 WHEN 2 THEN 'unsupported' WHEN 3 THEN 'bad_signature' ELSE 'ok' END AS status, "
    "CASE WHEN doc_id % 4 < 2 THEN 1 END::INT AS page, CASE WHEN doc_id % 4 < 2 THEN sha256(" + SQL_STRIP.format("coalesce(text, '')") + ") END AS digest FROM documents"
)
def src01_parsed_files(spark, d):
    rows = files.parse_files(_files(spark, d))
    return rows.select("path", "status", F.col("page").cast("int").alias("page"), n.text_hash(F.col("text")).alias("digest"))


@query(
    "SELECT 'Doc _' || doc_id::VARCHAR || '_' || CASE doc_id % 4 WHEN 0 THEN '.TXT' WHEN 1 THEN '.md' ELSE '.pdf' END AS filename, sha256(text) AS content_hash, octet_length(encode(text))::BIGINT AS file_size FROM documents WHERE doc_id % 4 <> 2 AND text <> ''"
)
def src13_uploads(spark, d):
    return files.upload(_files(spark, d), "kb", "user").select("filename", "content_hash", "file_size")


@query(
    """
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents),
    c AS (SELECT doc_id, x, list_filter(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN (i - 1) % 5 < 4 THEN (length(x[i]) % 9) / 8.0 END), lambda v: v IS NOT NULL) AS known FROM l)
    SELECT doc_id, round(list_avg(known)::DOUBLE, 9) AS confidence, sha256(CASE WHEN round(list_avg(known)::DOUBLE, 9) >= 0.5 THEN array_to_string(x, chr(10)) ELSE '' END) AS digest FROM c WHERE x IS NOT NULL
    """
)
def src08_recognised_pages(spark, d):
    """Every line of a text as a recognised one, with a confidence from its length; each fifth line has none."""
    line = lambda x, i: F.struct(x.alias("text"), F.when(i % 5 < 4, (F.length(x) % 9) / 8.0).alias("confidence"))
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", files.ocr_result(F.transform(F.split("text", "\n"), line)).alias("x"))
    return rows.select("doc_id", F.round("x.confidence", 9).alias("confidence"), n.text_hash(F.col("x.text")).alias("digest"))


@query("SELECT item_id::VARCHAR AS id, text AS query, 'fact' AS query_class, 2::INT AS gold FROM benchmark")
def src17_eval_set(spark, d):
    """The benchmark written as JSON lines, and read as an evaluation set."""
    place = f"{shared_folder(spark)}/eval-{uuid.uuid4().hex}"
    gold = F.array(*[F.struct(F.lit("d").alias("document"), F.col("text").alias("snippet"))] * 2)
    table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"), F.lit("fact").alias("query_class"), gold.alias("gold_evidence")).write.json(place)
    return files.read_eval_set(spark, place).select("id", "query", "query_class", F.size("gold_evidence").alias("gold"))


@query("SELECT source AS kb_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INT AS place FROM documents")
def kb05_documents(spark, d):
    """Each source as a knowledge base, its documents by their length as if that were their time."""
    return rec.kb_documents(table(spark, d, "documents"), "n_chars", "doc_id", "source").select(F.col("source").alias("kb_id"), "doc_id", "place")


@query("SELECT doc_id FROM documents WHERE doc_id % 10 > 0 AND doc_id % 7 > 0 AND doc_id % 4 <> 1")
def fil08_verified(spark, d):
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    stored = docs.where("doc_id % 4 <> 1").select("doc_id", F.lit(0).alias("chunk_index"), n.text_hash(F.col("text")).alias("text_hash"))
    text = F.when(k % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    served = docs.select(k.alias("id"), F.when(k % 10 != 0, k).alias("doc_id"), F.lit(0).alias("chunk_index"), text.alias("text"))
    return e.verified_only(e.audit_integrity(served, stored)).select(F.col("id").alias("doc_id"))


@query("SELECT conv_id, turn, sha256(coalesce(role, '') || coalesce(text, '')) AS digest FROM conversations")
def jsn04_flat_content(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", n.text_hash(t.flatten_content(F.array("role", F.lit(None), "text"))).alias("digest"))


@query(
    f"""
    SELECT conv_id, key, CASE key WHEN 'reranker_enabled' THEN (conv_id % 2 = 0)::VARCHAR WHEN 'reranker_model' THEN CASE WHEN conv_id % 2 = 0 THEN 'm' || (conv_id % 7)::VARCHAR END
        WHEN 'fusion_top_k' THEN (10 + conv_id % 5)::VARCHAR WHEN 'max_recovery_attempts' THEN '2' END AS value
    FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest({rec.SNAPSHOT_KEYS}) AS key)
    """
)
def map01_config_snapshots(spark, d):
    """A run for each conversation, with what its configuration was."""
    k = F.col("conv_id")
    config = {"reranker_enabled": k % 2 == 0, "reranker_model": F.concat(F.lit("m"), (k % 7).cast("string")), "fusion_top_k": 10 + k % 5, "max_recovery_attempts": F.lit(2), "unknown": F.lit("x")}
    runs = table(spark, d, "conversations").select("conv_id").distinct().withColumn("config", rec.config_snapshot(config))
    return runs.select("conv_id", F.explode("config").alias("key", "value"))
