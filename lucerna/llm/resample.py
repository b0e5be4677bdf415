"""Importance resampling towards a target distribution, by a dictionary of distinct n-gram strings.

Features are runs of one and two consecutive words. Steps:

1. Blocks. A task reads its documents in blocks of about BLOCK_BYTES, and finds each block's distinct feature strings
   and, for each, the documents that hold it and how often (postings): the per-document feature counts. A text longer
   than a block is cut between words; its parts add up.
2. Dictionary. Strings go to shards by hash, a compressed row a block and shard, with their postings. A shard holds every
   occurrence of its strings: it counts each distinct string over all documents and all target texts, hashes it once, and
   gives the postings the bucket in place of the string.
3. Gains. Buckets are summed over the dictionary (at most `buckets` rows) and give a gain each.
4. Join. Gains meet the per-document counts by bucket; a document's partial sums, one a shard, are added up.
5. Draw. Scores are range partitioned, each partition's rows counted, and ranks are a place in a partition plus the rows
   of the partitions before: no task sees all scores.

What very many documents of a block share (at most HEAVY strings a block) is counted in the dictionary like any string, but
its postings stay in one row of the block and meet their buckets there, so that no shard gathers a common word's documents.

Memory of a task: a block's arrays, or a shard of the dictionary, of which there are spark.sql.shuffle.partitions. The table
of documents must give its rows in the same order when a task runs again (a file or a checkpoint does).

Defined results: null, empty and wordless texts have no features and weight 0; a word longer than a block is one word;
repeated rows are documents of their own; a null doc_id counts as the text "null" in the draw's hash and comes after all
others; an empty table of documents gives an empty result, an empty target leaves the gains to the documents' counts alone; columns
other than doc_id and text are not read. Hash: unsigned crc32 of the UTF-8 string. A-Z alone are lower-cased.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, doc_texts
from .words import mix, run_hashes

BUCKETS, PERCENT, MIN_WORDS, SEED = 10_000, 25, 20, 7
#: Bytes of text in a block; documents in it, as bits of a key; strings of a block whose postings stay with it, at most.
BLOCK_BYTES, KEY_BITS, HEAVY = 6 << 20, 14, 4096
#: Fewest documents of a block that share a heavy string.
LEAST_HEAVY = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[:128] = False
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
POST, OWN, SUM, SHARED, TARGET = range(5)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed byte string; the first bytes of all numbers, then the second ones, which compresses better."""
    head = struct.pack(f"<{len(arrays)}q", *(a.nbytes for a in arrays))
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(planes))


def unpacked(data: bytes, *kinds) -> list[np.ndarray]:
    """The arrays of `packed`, by their types."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes = struct.unpack_from(f"<{len(kinds)}q", raw)
    ends = np.cumsum((8 * len(kinds), *sizes)).tolist()
    return [
        np.ascontiguousarray(np.frombuffer(raw, np.uint8, b - a, a).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
        for kind, a, b in zip(kinds, ends[:-1], ends[1:], strict=True)
    ]


def split_lines(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and bytes of strings that each end with a line feed."""
    ends = np.flatnonzero(letters == 10)
    return np.diff(ends, prepend=-1) - 1, letters[letters != 10]


def blocks_of(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """(first row, end row, bytes, offsets of the rows, whether the block goes on with a text).

    A block that goes on with a text starts with the last word of the block before, which it doesn't count by itself.
    """
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, row + (1 << KEY_BITS))
        low, high = int(offsets[row]), int(offsets[end])
        if end > row + 1 or high - low <= limit:
            yield row, end, data[low:high], offsets[row : end + 1] - low, False
        else:
            at, more = low, False
            while at < high:
                size = limit
                while True:
                    stop = min(high, at + size)
                    while stop < high and _WORD[data[stop]]:
                        stop += 1
                    solid = np.flatnonzero(_WORD[data[at:stop]])
                    back = at + int(solid[-1]) if len(solid) else stop
                    while back > at and back < stop and _WORD[data[back - 1]]:
                        back -= 1
                    # A block of one word would have to start there again.
                    if stop == high or back > at:
                        break
                    size *= 2
                yield row, end, data[at:stop], np.array([0, stop - at]), more
                more = more or back < stop
                at = high if stop == high else back
        row = end


def block_counts(data: np.ndarray, offsets: np.ndarray, goes_on: bool) -> dict:
    """The block's distinct features in order of their words, and of each the documents and counts; words per document."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = _WORD[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    starts = np.flatnonzero(solid[1:] & (~solid[:-1] | border))
    ends = np.flatnonzero(solid[:-1] & (~solid[1:] | border))
    rows = np.searchsorted(starts, offsets)
    words = np.diff(rows)
    if not len(starts):
        return {"words": words, "n": 0}
    places = np.concatenate(([0], np.cumsum(ends - starts)))
    bytes_ = _LOWER[data[solid[1:-1]]]
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(bytes_)]).dictionary_encode()
    known = column.dictionary
    order = pc.sort_indices(known)
    known = known.take(order)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    codes = rank[column.indices.to_numpy()]
    doc = np.repeat(np.arange(len(words)), words)
    base, docs = len(known) + 1, len(words)
    if base * base * docs >= 1 << 62:
        raise ValueError("a block holds too many distinct words; lower BLOCK_BYTES")
    single = codes * base
    same = doc[1:] == doc[:-1]
    double = (single[:-1] + codes[1:] + 1)[same]
    keys = np.concatenate(((single * docs + doc)[int(goes_on) :], double * docs + doc[1:][same]))
    if goes_on:
        words = words - 1
    if not len(keys):
        return {"words": words, "n": 0}
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.append(first, len(keys)))
    features, doc = np.divmod(keys[first], docs)
    start = np.flatnonzero(np.concatenate(([True], features[1:] != features[:-1])))
    one, two = np.divmod(features[start], base)
    return {
        "words": words, "n": len(start), "doc": doc.astype(np.uint16), "count": counts.astype(np.uint32), "start": start,
        "df": np.diff(np.append(start, len(doc))), "total": np.add.reduceat(counts, start), "one": one, "two": two - 1, "known": known,
    }


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1 ... of each range, in a row."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def dictionary_hashes(known: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(known.buffers()[1], np.int64)[known.offset : known.offset + len(known) + 1]
    data = np.frombuffer(known.buffers()[2] or b"", np.uint8).astype(np.uint64) + np.uint64(1)
    return run_hashes(data, offsets[:-1], offsets[1:])


ROWS = "shard int, kind int, block long, base long, data binary"


def emit_blocks(shards: int, block_bytes: int):
    """A function from (doc_id, text, target) to rows for the dictionary's shards and a row a block of its own."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, target = batch.column(0), len(batch) and batch.column(2)[0].as_py()
            home = 0
            for row, end, data, offsets, goes_on in blocks_of(batch.column(1), block_bytes):
                block = part << 26 | number
                number += 1
                home = home if goes_on else block << KEY_BITS
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(block_rows(block, home, ids.slice(row, end - row), data, offsets, goes_on, target, shards), _TYPES, strict=True)],
                    names=["shard", "kind", "block", "base", "data"],
                )

    return emit


_TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())


def block_rows(block: int, base: int, ids: pa.Array, data: np.ndarray, offsets: np.ndarray, goes_on: bool, target: bool, shards: int) -> list[list]:
    found = block_counts(data, offsets, goes_on)
    out: list[list] = [[], [], [], [], []]

    def put(shard: int, kind: int, payload: bytes) -> None:
        for column, value in zip(out, (shard, kind, block, base, payload), strict=True):
            column.append(value)

    shared = np.zeros(0, np.int64)
    if found["n"]:
        one, two, df, start, total, known = (found[k] for k in ("one", "two", "df", "start", "total", "known"))
        hashes = dictionary_hashes(known)
        shard = (mix(hashes[one] * np.uint64(3) + np.where(two >= 0, mix(hashes[two]), np.uint64(0))) % np.uint64(shards)).astype(np.int64)
        if not target:
            shared = np.flatnonzero(df > max(LEAST_HEAVY, len(found["doc"]) // HEAVY))
        # Ranks among the block's shared strings, plus one; zero for all others.
        rank = np.zeros(len(df), np.int64)
        rank[shared] = np.arange(1, len(shared) + 1)
        order = np.argsort(shard, kind="stable")
        strings = pc.binary_join_element_wise(known.take(pa.array(one[order])), known.take(pa.array(two[order], mask=two[order] < 0)), pa.scalar(b" ", pa.large_binary()), null_handling="skip")
        strings = pc.binary_join_element_wise(strings, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
        places = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
        letters = np.frombuffer(strings.buffers()[2], np.uint8)
        bounds = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(bounds)).tolist():
            a, b = bounds[s], bounds[s + 1]
            part = order[a:b]
            if target:
                put(s, TARGET, packed(letters[places[a] : places[b]], total[part]))
                continue
            mark = rank[part]
            light = part[mark == 0]
            at = ranges(start[light], df[light])
            put(s, POST, packed(
                letters[places[a] : places[b]], np.where(mark > 0, 0, df[part]).astype(np.uint16), found["doc"][at], found["count"][at],
                mark[mark > 0].astype(np.uint16), total[part[mark > 0]],
            ))
    if not target:
        at = ranges(found["start"][shared], found["df"][shared]) if len(shared) else shared
        put(block % shards, OWN, packed(
            ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), found["words"].astype(np.int64),
            found["df"][shared].astype(np.uint32) if len(shared) else np.zeros(0, np.uint32),
            found["doc"][at] if len(shared) else np.zeros(0, np.uint16), found["count"][at] if len(shared) else np.zeros(0, np.uint32),
        ))
    return out


OUT = "kind int, block long, base long, slot long, a long, b long, data binary"


def resolve_shard(buckets: int):
    """Counts and hashes a shard's distinct strings: bucket sums, and postings by bucket instead of by string."""

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = [], []
        for batch in batches:
            for kind, block, base, data in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                if kind == OWN:
                    own.append((OWN, block, base, None, None, None, data))
                elif kind == TARGET:
                    letters, totals = unpacked(data, np.uint8, np.int64)
                    lengths, letters = split_lines(letters)
                    held.append((block, base, lengths, letters, None, totals, None, None, None))
                else:
                    letters, df, docs, counts, marks, sums = unpacked(data, np.uint8, np.uint16, np.uint16, np.uint32, np.uint16, np.int64)
                    lengths, letters = split_lines(letters)
                    totals = np.zeros(len(df), np.int64)
                    some = df > 0
                    if some.any():
                        firsts = np.cumsum(df[some].astype(np.int64)) - df[some]
                        totals[some] = np.add.reduceat(counts.astype(np.int64), firsts)
                    totals[~some] = sums
                    held.append((block, base, lengths, letters, (df, marks), totals, None, docs, counts))
        if own:
            yield out_batch(own)
        if not held:
            return
        places = np.concatenate(([0], np.cumsum(np.concatenate([x[2] for x in held]), dtype=np.int64)))
        strings = pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(np.concatenate([x[3] for x in held]))])
        coded = strings.dictionary_encode()
        known, codes = coded.dictionary, coded.indices.to_numpy()
        del strings, coded
        distinct = len(known)
        # Each distinct string is hashed once.
        hashed = np.concatenate([
            np.fromiter(map(zlib.crc32, known.slice(i, 1 << 16).to_pylist()), np.int64, min(1 << 16, distinct - i)) for i in range(0, distinct, 1 << 16)
        ]) % buckets
        ends = np.cumsum([len(x[2]) for x in held]).tolist()
        sums = np.zeros((2, distinct))
        for (_, _, lengths, _, marks, totals, *_), end in zip(held, ends, strict=True):
            sums[int(marks is None)] += np.bincount(codes[end - len(lengths) : end], totals, distinct)
        s, t = (np.bincount(hashed, x, buckets).astype(np.int64) for x in sums)
        some = np.flatnonzero(s + t)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(some), SUM, np.int32)), *[pa.nulls(len(some), pa.int64())] * 2, pa.array(some), pa.array(s[some]), pa.array(t[some]), pa.nulls(len(some), pa.binary())],
            names=_OUT_NAMES,
        )
        kind = np.uint16 if buckets <= 1 << 16 else np.uint32
        for (block, base, lengths, _, marks, _, _, docs, counts), end in zip(held, ends, strict=True):
            if marks is None:
                continue
            df, ranks = marks
            found = hashed[codes[end - len(lengths) : end]]
            light = df > 0
            rows = [(POST, block, base, None, None, None, packed(found[light].astype(kind), df[light], docs, counts))]
            rows += [(SHARED, block, base, int(r), int(b), None, None) for r, b in zip(ranks, found[~light], strict=True)]
            yield out_batch(rows)

    return resolve


_OUT_NAMES = ["kind", "block", "base", "slot", "a", "b", "data"]
_OUT_TYPES = (pa.int32(), *[pa.int64()] * 5, pa.binary())


def out_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _OUT_TYPES, strict=True)], names=_OUT_NAMES)


def feature_dictionary(docs: DataFrame, targets: DataFrame, buckets: int = BUCKETS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of kinds SUM (bucket slot: a in documents, b in targets), POST and SHARED (postings by bucket) and OWN (documents)."""
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = doc_texts(docs).withColumn("target", F.lit(False)).unionByName(
        targets.select(F.lit(None).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("target"))
    )
    rows = texts.mapInArrow(emit_blocks(shards, block_bytes), ROWS)
    return cut(rows.repartitionById(shards, F.col("shard")).mapInArrow(resolve_shard(buckets), OUT))


def bucket_gains(dictionary: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket: a table of `buckets` numbers, whatever the corpus."""
    sums = dictionary.where(F.col("kind") == SUM).groupBy("slot").agg(F.sum("a").alias("s"), F.sum("b").alias("t")).collect()
    s, t = [0] * buckets, [0] * buckets
    for row in sums:
        s[row.slot], t[row.slot] = row.s, row.t
    all_s, all_t = sum(s), sum(t)
    return np.array([math.floor(1000 * math.log((y + 1) * (all_s + buckets) / ((x + 1) * (all_t + buckets)))) for x, y in zip(s, t, strict=True)], np.int64)


def document_sums(dictionary: DataFrame, gains: np.ndarray) -> DataFrame:
    """key, doc_id, n_words and total (the sum of the gains of all features) of every document."""
    kind = np.uint16 if len(gains) <= 1 << 16 else np.uint32
    schema, names, types = "base long, data binary, sums binary", ["base", "data", "sums"], (pa.int64(), pa.binary(), pa.binary())

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)

    def add_up(found: np.ndarray, df: np.ndarray, docs: np.ndarray, counts: np.ndarray, size: int) -> bytes:
        return packed(np.bincount(docs, np.repeat(gains[found], df) * counts, size).astype(np.int64))

    def light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows([
                (base, None, add_up(*unpacked(data, kind, np.uint16, np.uint16, np.uint32), 0))
                for base, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            ])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data, places in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ids, valid, words, df, docs, counts = unpacked(data, np.int64, np.bool_, np.int64, np.uint32, np.uint16, np.uint32)
                found = np.zeros(len(df), np.int64)
                for place in places or ():
                    found[place["slot"] - 1] = place["a"]
                yield rows([(base, packed(ids, valid, words), add_up(found, df, docs, counts, len(ids)))])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come block by block: the sums of all shards, and what the block says of its documents."""

        def row(base: int, ids: np.ndarray, valid: np.ndarray, words: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(base + np.arange(len(ids))), pa.array(ids, mask=~valid), pa.array(words), pa.array(sums)], names=["key", "doc_id", "n_words", "total"])

        base, ids, valid, words, sums = None, None, None, None, np.zeros(0, np.int64)
        for batch in batches:
            for at, data, added in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if at != base:
                    if base is not None:
                        yield row(base, ids, valid, words, sums)
                    base, ids, words, sums = at, None, None, np.zeros(0, np.int64)
                (added,) = unpacked(added, np.int64)
                if len(added) > len(sums):
                    sums = np.append(sums, np.zeros(len(added) - len(sums), np.int64))
                sums[: len(added)] += added
                if data is not None:
                    ids, valid, more = unpacked(data, np.int64, np.bool_, np.int64)
                    # Blocks that go on with a text have its first block's base.
                    words = more if words is None else words + more
        if base is not None:
            yield row(base, ids, valid, words, sums)

    parts = dictionary.where(F.col("kind") == POST).select("base", "data").mapInArrow(light, schema)
    places = dictionary.where(F.col("kind") == SHARED).groupBy("block").agg(F.collect_list(F.struct("slot", "a")).alias("places"))
    own = dictionary.where(F.col("kind") == OWN).select("block", "base", "data").join(places, "block", "left").select("base", "data", "places")
    both = parts.unionByName(own.mapInArrow(shared, schema))
    number = int(dictionary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(number, "base").sortWithinPartitions("base").mapInArrow(documents, "key long, doc_id long, n_words long, total long")


def drawn_ranks(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """scored (key, doc_id, n_words, score ...) with rank: 1, 2, 3 ... of the highest scores of what may be drawn, null for all others."""
    may = F.col("n_words") >= min_words
    ranged = scored.where(may).repartitionByRange(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "key")
    ordered = ranged.sortWithinPartitions(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "key")
    placed = cut(ordered.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    starts = sizes.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"), F.sum("rows").over(everything).alias("all"))
    place = F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    quota = F.expr(f"(all * {percent}L) div 100")
    ranked = placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.when(place <= quota, place)).drop("part", "start", "all", "at")
    return ranked.unionByName(scored.where(~may).withColumn("rank", F.lit(None).cast("long")))


def resampled(
    docs: DataFrame, targets: DataFrame, percent: int = PERCENT, buckets: int = BUCKETS, min_words: int = MIN_WORDS, seed: int = SEED, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every row of docs; targets needs text alone."""
    dictionary = feature_dictionary(docs, targets, buckets, block_bytes)
    sums = document_sums(dictionary, bucket_gains(dictionary, buckets))
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    features = F.greatest(F.col("n_words") * 2 - 1, F.lit(0)).cast("long")
    scored = sums.withColumn("n_features", features).withColumn(
        "weight", F.expr("CASE WHEN n_features = 0 THEN 0L ELSE (total - pmod(total, n_features)) div n_features END")
    )
    scored = scored.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((draw + 0.5) / 4294967296.0))))
    return drawn_ranks(cut(scored), percent, min_words).select("doc_id", "n_features", "weight", "score", "rank")
