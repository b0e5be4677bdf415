"""Contiguous shards of near-equal bytes from global prefix sums.

Law `bytes`: in doc_id order, shard = floor(bytes before the document * shards / all bytes). A shard
therefore differs from the target by less than its first and last documents. Three steps, none of which
moves texts: (1) fixed-width rows are range partitioned by doc_id and written with their partition's number,
so that a task that runs again finds the same partitions; (2) each partition's total is an aggregate, and a
running sum over those few totals gives every partition its start; (3) running sums within a partition give
each document its place.

Defined results: a null text has no bytes (size 1); rows with one doc_id are ordered by size and checksum,
and rows equal in all three have interchangeable slots; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut


def byte_shards(docs: DataFrame, shards: int = 16, partitions: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row of docs.

    partitions: of the range partitioning; None leaves it to spark.sql.shuffle.partitions.
    """
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    ranged = sized.repartitionByRange(partitions, "doc_id") if partitions else sized.repartitionByRange("doc_id")
    placed = cut(ranged.withColumn("part", F.spark_partition_id()))
    totals = placed.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"),
    )
    within = W.partitionBy("part").orderBy("doc_id", "size", "text_crc32")
    spread = placed.join(F.broadcast(starts), "part").select(
        "doc_id", "size", "text_crc32", "total",
        (F.col("bytes_before") + F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).alias("at"),
        (F.col("rows_before") + F.row_number().over(within) - 1).alias("row"),
    )
    spread = cut(
        spread.select(
            "doc_id", "size", "text_crc32", "row",
            F.least(F.lit(shards - 1), F.expr(f"(at * {shards}L) div total")).cast("int").alias("shard"),
        )
    )
    firsts = spread.groupBy("shard").agg(F.min("row").alias("first_row"))
    return spread.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first_row")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
