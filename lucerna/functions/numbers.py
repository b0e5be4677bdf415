"""Dates, vectors, hashes and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import DEFAULTS


def effective_date(text: Column, edge: str) -> Column:
    """DAT-01: the date after `effective from:` or `effective until:` in the first 2000 characters; invalid is null."""
    found = F.regexp_extract(F.substring(text, 1, 2000), rf"(?i)effective\s+{edge}:\s*(\d{{4}}-\d{{2}}-\d{{2}})", 1)
    return F.try_to_timestamp(F.nullif(found, F.lit("")), F.lit("yyyy-MM-dd"))


def reference_time(query: Column) -> Column:
    """DAT-02: 1 July of the first year named in a question, else null."""
    year = F.nullif(F.regexp_extract(query, r"(?<![\p{L}\p{N}_])((?:19|20)\d{2})(?![\p{L}\p{N}_])", 1), F.lit(""))
    return F.try_to_timestamp(F.concat(year, F.lit("-07-01")), F.lit("yyyy-MM-dd"))


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """MAT-01: 0 for null, empty, zero or differently long vectors."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(F.lit(0.0))


def align(vector: Column, dim: int) -> Column:
    """MAT-02: cut and made unit length again, or filled with zeros."""
    head = F.slice(doubles(vector), 1, dim)
    length = norm(head)
    cut = F.when(length > 0, F.transform(head, lambda x: x / length)).otherwise(head)
    filled = F.concat(doubles(vector), F.array_repeat(F.lit(0.0), F.greatest(F.lit(dim) - F.size(vector), F.lit(0))))
    return F.when(F.size(vector) > dim, cut).otherwise(filled)


def tf_saturation(freq: Column, k1: float = DEFAULTS.bm25_k1) -> Column:
    """MAT-03."""
    return freq * (k1 + 1.0) / (freq + k1)


def length_norm(length: Column, b: float = DEFAULTS.bm25_b, avg: int = DEFAULTS.bm25_avg_len) -> Column:
    """MAT-04."""
    return (1.0 - b) + b * (length / avg) if avg > 0 else F.lit(1.0)


def idf(total: Column, df: Column) -> Column:
    """MAT-06: BM25's inverse document frequency."""
    return F.log(1 + (total - df + 0.5) / (df + 0.5))


def rrf(rank: Column, k: int = DEFAULTS.rrf_k) -> Column:
    """MAT-07: a leg's share; 0 where the leg has no rank."""
    return F.coalesce(1.0 / (F.lit(k) + rank), F.lit(0.0))


def reliability(coverage: Column, contradiction: Column) -> Column:
    """MAT-08."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), coverage * (1.0 - contradiction)))


def text_hash(text: Column) -> Column:
    """HSH-01."""
    return F.sha2(F.encode(text, "UTF-8"), 256)


def point_id(doc_id: Column, chunk_index: Column) -> Column:
    """HSH-02: a UUID from the first 16 bytes of a digest."""
    h = text_hash(F.concat(doc_id.cast("string"), F.lit("_"), chunk_index.cast("string")))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts])


def rerank_key(query: Column, text: Column) -> Column:
    """HSH-03."""
    return F.substring(text_hash(F.concat(query, F.lit("\0"), text)), 1, 32)


def cache_key(text: Column, model: str, mode: str = "document") -> Column:
    """SNK-09's key: mode, model and the text in lower case without outer white space."""
    return text_hash(F.concat(F.lit(f"{mode}:{model}:"), F.lower(F.trim(text))))
