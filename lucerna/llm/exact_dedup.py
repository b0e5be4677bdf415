"""Exact deduplication by progressive refinement: length, then a prefix's hash, then the whole text's hash.

Lengths that occur once rule out their rows, then pairs of length and prefix hash that occur once; what is left is told
apart by the digest of the whole text. The first two steps are counts, combined before the shuffle, whose repeated keys
come back to the rows as bitmaps (common.maybe_among), so no row is dealt out by a length or a prefix that many
share. Digests are grouped by an aggregate too: a text with any number of copies costs one row for each task.

`keep_first` takes digests of surviving rows alone. `exact_groups` returns the digest of every row, so there it is
taken in the scan that gives length and prefix; the refinement then saves what goes to the last exchange.

Defined results: a null text counts as empty, empty texts are equal to each other; rows that share doc_id and text
share their result (kept when that doc_id is the smallest of the group) and each counts in group_size; rows that share
a doc_id but not the text are decided each by its own text; a null doc_id comes after all others: such a row is kept where
no row of its group has an id (keep_id is null then); an empty table gives an empty result; columns other than doc_id
and text are not read, keep_first carries them along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, doc_texts, maybe_among, without_rows

WHITE = "[\\x20\\x09-\\x0D]+"
PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space replaced by one space."""
    return F.regexp_replace(text, WHITE, " ")


def digest(norm: Column) -> Column:
    return F.sha2(F.encode(norm, "UTF-8"), 256)


def shapes(docs: DataFrame, prefix_chars: int, *more: Column) -> DataFrame:
    """doc_id, normalised length and hash of a prefix (and more, of a column norm): fixed-width rows, from one scan."""
    plain = doc_texts(docs).select("doc_id", normalised(F.col("text")).alias("norm"))
    return plain.select("doc_id", F.octet_length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("head"), *more)


def survivors(rows: DataFrame) -> DataFrame:
    """Rows whose length, and then whose (length, prefix) others may share. rows: len and head, and any more."""
    for keys in (["len"], ["len", "head"]):
        repeated = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__times")).where("__times > 1").select(*keys)
        rows = maybe_among(rows, keys, cut(repeated), "__among").where("__among").drop("__among")
    return rows


def text_groups(rows: DataFrame) -> DataFrame:
    """text_sha256, keep_id and group_size of texts that several rows have. rows: doc_id, len, head, text_sha256."""
    groups = rows.groupBy("len", "head", "text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return groups.where("group_size > 1").select("text_sha256", "keep_id", "group_size")


def exact_groups(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and the digest of the normalised text, a row for each row of docs."""
    rows = cut(shapes(docs, prefix_chars, digest(F.col("norm")).alias("text_sha256")))
    groups = cut(text_groups(survivors(rows)))
    several = F.col("group_size").isNotNull()
    keep = F.when(several, F.col("keep_id")).otherwise(F.col("doc_id"))
    return rows.join(groups, "text_sha256", "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(keep == F.col("doc_id"), keep.isNull()).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The rows of docs, all columns, without those whose text a smaller doc_id has already."""
    rows = survivors(cut(shapes(docs, prefix_chars))).select(F.col("doc_id").alias("__id"))
    texts = maybe_among(doc_texts(docs).withColumn("__id", F.col("doc_id")), ["__id"], rows, "__among").where("__among")
    read = cut(shapes(texts, prefix_chars, digest(F.col("norm")).alias("text_sha256")))
    groups = cut(text_groups(read))
    dropped = read.join(groups, "text_sha256").where("keep_id IS NOT NULL AND NOT (doc_id <=> keep_id)")
    key = digest(normalised(F.coalesce(F.col("text"), F.lit(""))))
    return without_rows(docs, cut(dropped.select("doc_id", F.col("text_sha256").alias("key"))), lambda df, name: df.withColumn(name, key))
