"""What the corpus operators share: reading tables, cutting lineage, filters of bounded size, dropping rows, components."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a bitmap: for each member, and at most.
BITS_EACH, MOST_BITS = 16, 1 << 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that further columns of the input can't clash; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it while the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the cluster's shared checkpoint folder and read from there.

    The folder is what spark.checkpoint.dir names. Only on one machine, where no one set it, a temporary one is
    made. Executors can be lost afterwards without recomputing what came before.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        configured = spark.conf.get("spark.checkpoint.dir", "")
        if not configured:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="lucerna-checkpoint-")
            atexit.register(shutil.rmtree, configured, ignore_errors=True)
        context.setCheckpointDir(configured)
    return df.checkpoint(eager=True)


def maybe_among(rows: DataFrame, keys: list[str], members: DataFrame, among: str) -> DataFrame:
    """rows with the boolean column `among`: false only where no row of members has the same keys.

    members (same key columns) become a bitmap by hash, BITS_EACH bits a member and MOST_BITS at most, which is what
    is broadcast. It says true wrongly for a few rows, and for more where members outnumber its bits: whoever uses it
    must decide again on what is true.
    """
    count = members.count()
    bits = 1 << int(math.ceil(math.log2(min(MOST_BITS, max(1 << 12, BITS_EACH * count)))))
    place = F.pmod(F.xxhash64(*keys), F.lit(bits))
    mask = F.expr("shiftleft(1L, cast(__place % 62 AS int))")
    table = members.select(place.alias("__place")).select(F.expr("__place div 62").alias("__word"), mask.alias("__mask"))
    table = table.groupBy("__word").agg(F.bit_or("__mask").alias("__bits"))
    marked = rows.withColumn("__place", place).withColumn("__word", F.expr("__place div 62"))
    found = F.coalesce(F.col("__bits").bitwiseAND(mask) != 0, F.lit(False))
    return marked.join(F.broadcast(table), "__word", "left").withColumn(among, found).drop("__word", "__place", "__bits")


def without_rows(docs: DataFrame, dropped: DataFrame, keyed: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """docs, all columns, without the rows whose doc_id and key are in dropped (doc_id, key).

    keyed(docs, name) adds a row's key under a name. Only rows that a bitmap over dropped lets through are keyed and
    exchanged; all others stay where they are.
    """
    ids = dropped.select("doc_id")
    among, key = fresh(docs, "__among"), fresh(docs, "__key")
    asked = maybe_among(docs.withColumn("__id", F.col("doc_id").cast("long")), ["__id"], ids.withColumnRenamed("doc_id", "__id"), among)
    sure = asked.where(~F.col(among)).select(*docs.columns)
    gone = dropped.select(F.col("doc_id").alias("__gone_id"), F.col("key").alias("__gone_key")).distinct()
    rest = keyed(asked.where(among), key)
    left = rest.join(gone, rest["__id"].eqNullSafe(gone["__gone_id"]) & (rest[key] == gone["__gone_key"]), "left_anti")
    return sure.unionByName(left.select(*docs.columns))


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node of the component.

    Alternating large-star and small-star rounds: every round is two grouped minima over the edges, so no
    component is ever gathered in one task and the number of rounds grows with the logarithm of the size.
    The minimum of a neighbourhood is a map-side combined aggregate, which a node with many edges doesn't skew.
    """
    pairs = cut(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    before = None
    for _ in range(max_rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        done = cut(small)
        now = done.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        pairs = done
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    found = pairs.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(found, nodes.node == found.u, "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
