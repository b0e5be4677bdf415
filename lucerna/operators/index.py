"""IDX-01: a sparse index that is kept on disk and grows: a base segment, delta segments, tombstones, compaction.

An index is a folder in storage that all executors share. Every change writes a new segment; what is written is never
changed. A segment has

* postings: term, keys, weights: a list for each term of a block of at most BLOCK entries, in the order of terms within a block. Lists are
  made inside the task that reads the block's texts, so that no posting is exchanged or sorted with others to write it; a search
  opens the lists of its own terms alone. In a row without a term are the block's keys with their numbers of terms;
* entries: key, n_terms: the keys that the segment adds;
* tombstones: key: keys of earlier segments that it replaces or takes away;
* frequencies: term, df: by how much the document frequency of each term changes, minus what its tombstones take away.

and one row in `segments`, written last: a segment without that row, left by a job that failed, doesn't exist. Number of entries
and document frequencies are sums over segments, so a search reads neither texts nor the postings of other
terms. `compact` writes all that is live as a new base; readers start from the latest base.

Defined results: rows of one key in a call are one entry, their terms counted together; a key without terms is an entry
without postings; it counts in no document frequency, nor in the number of entries that scoring uses, as in `sparse_search`;
rows without a key are left out; an empty call adds an empty segment. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from ..functions.text import zone_weight
from ..functions.udfs import counts_of
from ..session import DEFAULTS, kept
from .retrieval import counted, sparse_search

SEGMENTS = StructType([
    StructField("segment", IntegerType()), StructField("base", BooleanType()), StructField("added", LongType()), StructField("taken", LongType()), StructField("tombstones", LongType()),
])
SCHEMAS = {
    "postings": "term string, keys array<{kind}>, weights array<double>", "entries": "{key} {kind}, n_terms long", "tombstones": "{key} {kind}", "frequencies": "term string, df long",
}
BLOCK = 4096


def inverted(batches: Iterator[pa.RecordBatch], k1: float, b: float, avg_len: int) -> Iterator[pa.RecordBatch]:
    """Rows of key, boost and text, or counts (term, tf) in its place, as term, keys and weights (`posting_weight`): blocks' lists, and a row of their n_terms."""
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            keys, boosts, counts = batch.slice(at, BLOCK).columns
            counts = counts_of(counts) if pa.types.is_string(counts.type) else counts
            each = counts.flatten()
            terms, tf = pc.struct_field(each, 0), pc.struct_field(each, 1).to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(len(keys)), pc.fill_null(pc.list_value_length(counts), 0).to_numpy(zero_copy_only=False))
            sizes = np.bincount(rows, tf, len(keys)).astype(float)
            norms = (1.0 - b) + b * (sizes / avg_len) if avg_len > 0 else np.ones(len(keys))
            weights = boosts.to_numpy(zero_copy_only=False)[rows] * (tf * (k1 + 1.0) / (tf + k1)) / norms[rows]
            coded = terms.dictionary_encode()
            order = pc.sort_indices(coded.dictionary).to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            codes = place[coded.indices.to_numpy(zero_copy_only=False)]
            by_term = np.argsort(codes, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(order)))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (keys.take(pa.array(rows[by_term])), pa.array(weights[by_term]))]
            yield from pa.Table.from_arrays([coded.dictionary.take(pa.array(order)), *lists], names=["term", "keys", "weights"]).to_batches(max_chunksize=10_000)
            whole = pa.array([0, len(keys)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.ListArray.from_arrays(whole, keys), pa.ListArray.from_arrays(whole, pa.array(sizes))], names=["term", "keys", "weights"])


class KeptIndex:
    """An index at a path; key: the name of the column that identifies an entry, kind: its SQL type; buckets: how many lists a compacted index cuts a term into at least."""

    def __init__(
        self, spark: SparkSession, path: str, key: str = "chunk_id", kind: str = "long", buckets: int = 16,
        k1: float = DEFAULTS.bm25_k1, b: float = DEFAULTS.bm25_b, avg_len: int = DEFAULTS.bm25_avg_len,
    ):
        self.spark, self.path, self.key, self.kind, self.buckets = spark, path.rstrip("/"), key, kind, buckets
        self.k1, self.b, self.avg_len = k1, b, avg_len

    # ---- what is there ----

    def _there(self, path: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def segments(self) -> list:
        """Rows of the live segments, from the latest base on."""
        if not self._there(f"{self.path}/segments"):
            return []
        rows = sorted(self.spark.read.schema(SEGMENTS).parquet(f"{self.path}/segments").collect(), key=lambda r: r.segment)
        bases = [i for i, r in enumerate(rows) if r.base]
        return rows[bases[-1] :] if bases else rows

    def _table(self, name: str, live: list | None = None) -> DataFrame:
        """Rows of a table's live segments, with the number of their segment."""
        schema = SCHEMAS[name].format(key=self.key, kind=self.kind)
        live = self.segments() if live is None else live
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{r.segment}").withColumn("segment", F.lit(r.segment)) for r in live]
        if not parts:
            return self.spark.createDataFrame([], schema + ", segment int")
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _each(self, lists: DataFrame, value: str, *more: str) -> DataFrame:
        """Lists as rows of key and value."""
        return lists.select(*more, F.inline(F.arrays_zip("keys", "weights")).alias(self.key, value))

    def _postings(self, live: list, terms: DataFrame | None = None) -> DataFrame:
        """Of these terms (term, ...), if given, with their other columns: lists of others aren't opened."""
        lists = self._table("postings", live).where("term IS NOT NULL")
        more = [c for c in terms.columns if c != "term"] if terms is not None else []
        rows = self._each(lists if terms is None else lists.join(terms, "term"), "weight", "term", "segment", *more)
        return self._alive(rows, live).select(self.key, "term", "weight", *more)

    def _alive(self, rows: DataFrame, live: list) -> DataFrame:
        """rows without those whose key a later segment replaces or takes away."""
        if not any(r.tombstones for r in live):
            return rows
        last = self._table("tombstones", [r for r in live if r.tombstones]).groupBy(F.col(self.key).alias("_gone")).agg(F.max("segment").alias("_until"))
        return rows.join(last, (rows[self.key] == last["_gone"]) & (rows["segment"] < last["_until"]), "left_anti")

    def postings(self) -> DataFrame:
        """key, term and weight of all live entries."""
        return self._postings(self.segments())

    def entries(self) -> DataFrame:
        """key and n_terms of all live entries."""
        live = self.segments()
        return self._alive(self._table("entries", live), live).drop("segment")

    def frequencies(self) -> DataFrame:
        """AGG-10: term and df."""
        return self._table("frequencies").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def size(self) -> int:
        """Entries that have terms: N of the inverse document frequency."""
        return sum(r.added - r.taken for r in self.segments())

    # ---- changes ----

    def _write(self, number: int, lists: DataFrame, entries: DataFrame | None, gone: DataFrame | None, base: bool) -> None:
        """A segment: lists (term, keys, weights), entries (key, n_terms; None: those in the lists), gone (keys that earlier segments may hold; None: the segment's own)."""
        at = lambda name: f"{self.path}/{name}/{number}"
        read = lambda name: self.spark.read.schema(SCHEMAS[name].format(key=self.key, kind=self.kind)).parquet(at(name))
        lists.write.mode("overwrite").parquet(at("postings"))
        if entries is None:
            entries = self._each(read("postings").where("term IS NULL"), "n_terms").withColumn("n_terms", F.col("n_terms").cast("long"))
        entries.write.mode("overwrite").parquet(at("entries"))
        changes = read("postings").where("term IS NOT NULL").groupBy("term").agg(F.sum(F.size("keys").cast("long")).alias("df"))
        taken = tombstones = 0
        if not base:
            gone = read("entries").select(self.key) if gone is None else gone
            live = self.segments()
            held = kept(self._alive(self._table("entries", live), live).join(gone, self.key, "left_semi").select(self.key, "n_terms"))
            counted = held.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("n_terms") > 0).alias("some")).first()
            tombstones, taken = counted["all"], counted["some"]
            lost = self._postings(live).join(held.select(self.key), self.key, "left_semi")
            changes = changes.unionByName(lost.groupBy("term").agg((-F.count(F.lit(1))).alias("df"))).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
            held.select(self.key).write.mode("overwrite").parquet(at("tombstones"))
        changes.write.mode("overwrite").parquet(at("frequencies"))
        added = read("entries").where("n_terms > 0").count()
        row = self.spark.createDataFrame([(number, base, added, taken, tombstones)], SEGMENTS)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/segments")

    def _next(self) -> int:
        if not self._there(f"{self.path}/segments"):
            return 0
        return 1 + (self.spark.read.schema(SEGMENTS).parquet(f"{self.path}/segments").agg(F.max("segment")).first()[0] or 0)

    def put(self, rows: DataFrame, text: str = "text", zone: str | None = None) -> None:
        """Adds entries, and replaces those whose key is there. rows: key, text, and zone (its weight; body without it)."""
        rows = rows.where(F.col(self.key).isNotNull()).select(F.col(self.key).cast(self.kind).alias(self.key), F.col(text).alias("_text"), (F.col(zone) if zone else F.lit("body")).alias("_zone"))
        boost = zone_weight(F.col("_zone")).alias("_boost")
        again = rows.groupBy(self.key).agg(F.count(F.lit(1)).alias("_n"), F.max(boost).alias("_boost")).where("_n > 1").drop("_n")
        k1, b, avg_len = self.k1, self.b, self.avg_len
        invert = lambda found: found.mapInArrow(lambda batches: inverted(batches, k1, b, avg_len), SCHEMAS["postings"].format(kind=self.kind))
        if again.limit(1).count():
            same = counted(rows.join(again, self.key, "left_semi"), self.key, "_text").join(again, self.key).select(self.key, "_boost", "counts")
            lists = invert(rows.join(again, self.key, "left_anti").select(self.key, boost, "_text")).unionByName(invert(same))
        else:
            lists = invert(rows.select(self.key, boost, "_text"))
        number = self._next()
        self._write(number, lists, None, None, number == 0)

    def take(self, keys: DataFrame) -> None:
        """FIL-18: takes entries away. keys: key."""
        keys = kept(keys.where(F.col(self.key).isNotNull()).select(F.col(self.key).cast(self.kind).alias(self.key)).distinct())
        nothing = lambda name: self.spark.createDataFrame([], SCHEMAS[name].format(key=self.key, kind=self.kind))
        self._write(self._next(), nothing("postings"), nothing("entries"), keys, False)

    def compact(self) -> None:
        """All that is live as a new base segment. Earlier segments stay on disk for readers that are under way."""
        blocks = max(self.buckets, -(-self.size() // BLOCK))
        each = self.postings().groupBy("term", F.pmod(F.xxhash64(self.key), F.lit(blocks))).agg(F.collect_list(F.struct(self.key, "weight")).alias("x"))
        self._write(self._next(), each.select("term", F.col(f"x.{self.key}").alias("keys"), F.col("x.weight").alias("weights")), self.entries(), None, True)

    def drop(self) -> None:
        """SNK-03: takes the whole index away; nothing happens where there is none."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)

    # ---- search ----

    def search(self, queries: DataFrame, k: int = DEFAULTS.sparse_top_k) -> DataFrame:
        """RET-02 over the kept segments: query_id, key, sparse_score and sparse_rank. queries: query_id, terms."""
        live = self.segments()
        return sparse_search(queries, lambda terms: self._postings(live, terms), k, self.key, self.size(), self.frequencies())


def fingerprint(rows: DataFrame) -> str:
    """What tells whether a table's files are still those that an index was made from: paths, sizes and times; no column is read."""
    files = rows.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    found = files.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time")).alias("h")).first()
    return f"{found.n}_{(found.h or 0) & (1 << 64) - 1:016x}"
