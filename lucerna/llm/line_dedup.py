"""Substring deduplication by hashes of lines and sentences.

Units are lines, cut further at sentence ends, normalised to their lower-case words. Units of fewer than least_words
words are neutral: they neither match nor break a run. Besides, each window of min_words words gives one of its stretches of
(min_words + 1) / 2 words, the one with the least hash: a unit whose place the text itself decides, so that any passage of
min_words words shares one with its other occurrences, wherever sentences and lines end.

The digests of all units and stretches are grouped over the whole corpus; of each, the occurrence that ranks first (by
doc_id, then place) is kept. Repeated units that neighbour each other are a run, and so are stretches that touch; the ends
of a run of stretches are moved outward word by word as far as the kept occurrence of the stretch there reads the same. A
stretch that overlaps its own first occurrence doesn't count. Runs that touch are one. A run is removed if its units hold
min_words words, or if it has a stretch and is min_words words long; its offsets are those in the original text.

Exchanges carry three longs an occurrence: digest, doc_id, and a place that packs first word, words and kind. Digests are
grouped by a count and a minimum, combined before the shuffle; what repeats goes back to the occurrences by an equi-join
with a row a digest on one side, whose hot keys adaptive execution splits. Only texts of documents that have runs, or keep
what others repeat, are exchanged, once, by doc_id, for the words beside the runs' ends and their offsets.

A word next to a stretch is missed where it repeats another, later occurrence than the one kept of that stretch.

Defined results: null and empty texts have no units; a row that shares its doc_id with other rows, or has none, is a document
of its own by its doc_id and text, and ranks behind all others (row_id: a number from 2^62 on, where others have their doc_id); rows equal in both are one
document, so exact repeats of a row are not removed by each other; an empty table gives
an empty result; columns other than doc_id and text are not read, without_spans carries them along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, doc_texts, fresh, maybe_among
from .words import Words, mix, run_hashes, sequence_hashes, slices

LEAST_WORDS, MIN_WORDS = 3, 25
_STOP = np.zeros(256, bool)
_STOP[[ord("."), ord("!"), ord("?")]] = True
_STRETCH = np.uint64(0xD6E8FEB86659FD93)


def unit_bounds(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and end word of every unit of a slice."""
    n = len(words.starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    feeds = np.concatenate(([0], np.cumsum(words.data == 10)))
    last = _STOP[words.data[words.ends - 1]]
    last[:-1] |= feeds[words.starts[1:]] > feeds[words.ends[:-1]]
    last[words.rows[1:][words.rows[1:] > 0] - 1] = True
    ends = np.flatnonzero(last) + 1
    return np.concatenate(([0], ends[:-1])), ends


def stretches(words: Words, size: int) -> np.ndarray:
    """First words of the stretches of `size` words that windows of 2 * size - 1 words of a row give: the least hash, the last on ties."""
    n = len(words.starts) - 2 * size + 2
    if n < 1:
        return np.zeros(0, np.int64)
    at = np.arange(n + size - 1)
    hashes = run_hashes(words.hashes, at, at + size)
    row = np.searchsorted(words.rows, np.arange(len(words.starts)), "right")
    inside = np.flatnonzero(row[:n] == row[2 * size - 2 :])
    # The least of each window: minima over ever longer stretches of hashes, by halves.
    least, reach = at.copy(), 1
    while reach < size:
        step = min(reach, size - reach)
        later = least[step:]
        least = np.where(hashes[later] <= hashes[least[: len(later)]], later, least[: len(later)])
        reach += step
    return np.unique(least[inside])


def code_points(words: Words) -> np.ndarray:
    """Code points before each byte: bytes that don't continue a character."""
    return np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))


def identified(docs: DataFrame, name: str = "row_id") -> DataFrame:
    """docs with row_id: the doc_id where it is one row's alone, else a number from 2^62 on made of doc_id and text."""
    ids = docs.select(F.col("doc_id").cast("long").alias("_id"))
    several = cut(ids.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 OR _id IS NULL").select("_id"))
    own = F.col("doc_id").cast("long")
    if not several.limit(1).count():
        return docs.withColumn(name, own)
    made = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(own, F.coalesce("text", F.lit(""))), 2)
    joined = docs.withColumn("_own", own).join(several.withColumn("_shared", F.lit(True)), F.col("_own").eqNullSafe(F.col("_id")), "left")
    return joined.withColumn(name, F.when(F.col("_shared"), made).otherwise(F.col("_own"))).drop("_own", "_id", "_shared")


def text_units(docs: DataFrame, least_words: int = LEAST_WORDS, size: int = (MIN_WORDS + 1) // 2) -> DataFrame:
    """Every unit that counts and every stretch: digest, doc_id and place (first word, words, whether it is a stretch)."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for start, end, words in slices(pc.fill_null(batch.column(1), "")):
                first, stop = unit_bounds(words)
                keep = stop - first >= least_words
                first, stop = first[keep], stop[keep]
                found = stretches(words, size)
                sizes = stop - first
                inside = words.hashes[np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
                digests = np.concatenate((sequence_hashes(inside, sizes), mix(run_hashes(words.hashes, found, found + size) ^ _STRETCH)))
                at = np.concatenate((first, found))
                row = np.searchsorted(words.rows, at, "right") - 1
                kind = np.concatenate((stop - first << 1, np.full(len(found), size << 1 | 1, np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests.view(np.int64)), pa.array(ids[start:end][row]), pa.array((at - words.rows[row] << 32) | kind)],
                    names=["digest", "doc_id", "place"],
                )

    return doc_texts(docs).where("doc_id IS NOT NULL").mapInArrow(units, "digest long, doc_id long, place long")


def repeated_units(units: DataFrame) -> DataFrame:
    """Occurrences that aren't the first of their digest: doc_id, low and high (words), stretch, first_doc_id and first_word."""
    several = units.groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.count(F.lit(1)).alias("times")).where("times > 1")
    found = cut(units.join(cut(several.drop("times")), "digest"))
    firsts = cut(found.where("doc_id = first_doc_id").groupBy("digest").agg(F.min("place").alias("first_place")))
    again = found.join(firsts, "digest").where("doc_id <> first_doc_id OR place <> first_place")
    word = lambda c: F.shiftright(F.col(c), 32).cast("int")
    return again.select(
        "doc_id", word("place").alias("low"), (word("place") + F.expr("cast((place & 4294967295L) div 2 AS int)")).alias("high"),
        F.expr("place & 1L = 1").alias("stretch"), "first_doc_id", word("first_place").alias("first_word"),
    ).distinct()


def with_islands(spans: DataFrame, gap: int = 0) -> DataFrame:
    """Spans (doc_id, low, high) with the number of the island in their document: spans that overlap, touch or lie gap words apart."""
    order = W.partitionBy("doc_id").orderBy("low", "high")
    before = F.max("high").over(order.rowsBetween(W.unboundedPreceding, -1))
    return spans.withColumn("island", F.sum(F.when(F.col("low") <= before + gap, 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0)))


def runs_of(repeats: DataFrame, min_words: int, least_words: int, size: int) -> DataFrame:
    """Runs: doc_id, low, high, first_doc_id, counted (words of repeated units; null for stretches), head and tail (of
    stretches: the first and last one's first_doc_id and first_word). Runs of units that neither suffice nor are near a stretch are left out."""
    units = with_islands(repeats.where("NOT stretch"), least_words - 1).groupBy("doc_id", "island").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("first_doc_id").alias("first_doc_id"), F.sum(F.col("high") - F.col("low")).alias("counted")
    )
    clear = repeats.where("stretch").where((F.col("doc_id") != F.col("first_doc_id")) | (F.col("low") >= F.col("first_word") + size))
    edge = F.struct("low", "first_doc_id", "first_word")
    stretched = with_islands(clear).groupBy("doc_id", "island").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("first_doc_id").alias("first_doc_id"), F.min(edge).alias("head"), F.max(edge).alias("tail")
    )
    both = units.drop("island").unionByName(stretched.drop("island"), allowMissingColumns=True)
    near = with_islands(both, size - 1)
    whole = W.partitionBy("doc_id", "island")
    return near.withColumn("_use", (F.max("counted").over(whole) >= min_words) | F.bool_or(F.col("counted").isNull()).over(whole)).where("_use").drop("_use", "island")


def words_beside(docs: DataFrame, ends: DataFrame, reach: int) -> DataFrame:
    """Of each end (doc_id, word, ahead, far): the hashes of up to `reach` words (none unless far) from there on (ahead) or back,
    nearest first, and code points: where a span ends that takes none, one, two ... of them (ahead), or begins."""
    asked = cut(ends.groupBy(F.col("doc_id").alias("asked_id")).agg(F.collect_set(F.struct("word", "ahead", "far")).alias("asked")))
    texts = maybe_among(doc_texts(docs).withColumn("__id", F.col("doc_id")), ["__id"], asked.select(F.col("asked_id").alias("__id")), "__among").where("__among")
    rows = texts.join(asked, texts["doc_id"] == asked["asked_id"]).select("doc_id", "text", "asked")

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(2)
            for start, end, words in slices(batch.column(1)):
                chars, out = code_points(words), []
                hashes = words.hashes.view(np.int64)
                for i in range(start, end):
                    low, high = words.rows[i - start], words.rows[i - start + 1] if i - start + 1 < len(words.rows) else len(words.starts)
                    base = chars[words.offsets[i - start]]
                    for x in lists[i].as_py():
                        w, far = low + x["word"], reach * x["far"]
                        if not low <= w <= high or low == high:
                            continue  # another row of this doc_id
                        if x["ahead"]:
                            near = hashes[w : min(high, w + far)]
                            at = chars[words.ends[max(w - 1, low) : min(high, w + far)]] - base
                        else:
                            near = hashes[max(low, w - far) : w][::-1]
                            at = chars[words.starts[max(low, w - far) : min(w, high - 1) + 1][::-1]] - base
                        out.append((ids[i], x["word"], x["ahead"], x["far"], near.tolist(), at.tolist()))
                if out:
                    types = (pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "word", "ahead", "far", "near", "at"]
                    )

    found = rows.mapInArrow(beside, "doc_id long, word int, ahead boolean, far boolean, near array<long>, at array<int>")
    return found.groupBy("doc_id", "word", "ahead", "far").agg(F.min(F.struct("near", "at")).alias("_x")).select("doc_id", "word", "ahead", "far", "_x.*")


def located(docs: DataFrame, runs: DataFrame, size: int) -> DataFrame:
    """runs with low and high moved outward as far as the kept occurrence reads the same, and their offsets start and stop."""
    runs = cut(runs.withColumn("run", F.monotonically_increasing_id()))
    far = F.col("head").isNotNull()
    end = lambda ahead, word, kept, more: F.struct(
        F.lit(ahead).alias("ahead"), F.col(word).alias("word"), F.col(f"{kept}.first_doc_id").alias("kept_id"), (F.col(f"{kept}.first_word") + more).alias("kept_word")
    )
    ends = runs.select("doc_id", "run", far.alias("far"), F.explode(F.array(end(False, "low", "head", 0), end(True, "high", "tail", size))).alias("e"))
    ends = ends.select("doc_id", "run", "far", "e.*")
    kept = ends.where("far").select(F.col("kept_id").alias("doc_id"), F.col("kept_word").alias("word"), "ahead", "far")
    beside = cut(words_beside(docs, ends.select("doc_id", "word", "ahead", "far").unionByName(kept).distinct(), size - 1))
    other = beside.where("far").select(F.col("doc_id").alias("kept_id"), F.col("word").alias("kept_word"), "ahead", F.col("near").alias("kept_near"))
    both = ends.join(beside, ["doc_id", "word", "ahead", "far"]).join(other, ["kept_id", "kept_word", "ahead"], "left")
    differs = F.array_position(F.zip_with("near", "kept_near", lambda a, b: a.eqNullSafe(b)), False)
    same = F.when(F.col("kept_near").isNull(), 0).when(differs > 0, differs - 1).otherwise(F.size("near")).cast("int")
    moved = both.withColumn("more", same).withColumn("chars", F.get("at", F.col("more")))
    at = lambda ahead, value: F.max(F.when(F.col("ahead") == ahead, F.col(value)))
    sides = moved.groupBy("run").agg(
        at(False, "more").alias("back"), at(True, "more").alias("on"), at(False, "chars").alias("start"), at(True, "chars").alias("stop")
    )
    return runs.join(sides, "run").select(
        "doc_id", (F.col("low") - F.col("back")).alias("low"), (F.col("high") + F.col("on")).alias("high"), "start", "stop", "first_doc_id", "counted"
    )


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, start, stop (code points of the text as it was), words, first_doc_id and row_id of every span to remove."""
    size = (min_words + 1) // 2
    known = identified(docs.select("doc_id", "text"))
    rows = known.select(F.col("row_id").alias("doc_id"), "text")
    repeats = cut(repeated_units(text_units(rows, least_words, size)))
    runs = located(rows, runs_of(repeats, min_words, least_words, size), size)
    spans = with_islands(runs).groupBy("doc_id", "island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), (F.max("high") - F.min("low")).cast("long").alias("words"),
        F.min("first_doc_id").alias("first_doc_id"), F.max("counted").alias("counted"), F.bool_or(F.col("counted").isNull()).alias("matched"),
    )
    enough = (F.col("counted") >= min_words) | (F.col("matched") & (F.col("words") >= min_words))
    found = spans.where(enough).select(F.col("doc_id").alias("row_id"), "start", "stop", "words", F.col("first_doc_id").alias("first_row_id"))
    # Only made numbers need to be looked up again.
    made = known.where(F.col("row_id") >= 1 << 62).select("row_id", F.col("doc_id").cast("long").alias("doc_id")).distinct()
    named = found.join(made.withColumn("_made", F.lit(True)), "row_id", "left").withColumn("doc_id", F.when(F.col("_made"), F.col("doc_id")).otherwise(F.col("row_id"))).drop("_made")
    first = made.select(F.col("row_id").alias("first_row_id"), F.col("doc_id").alias("_first"), F.lit(True).alias("_made"))
    named = named.join(first, "first_row_id", "left").withColumn("first_doc_id", F.when(F.col("_made"), F.col("_first")).otherwise(F.col("first_row_id")))
    return named.select("doc_id", "start", "stop", "words", "first_doc_id", "row_id")


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the spans taken out of text, and removed (start, stop: offsets in the text as it was; with underscores behind
    its name where docs has such a column). Spans apply to the rows that they were found in; a null text stays null."""
    removed, key, row = fresh(docs, "removed"), fresh(docs, "span_row_id"), fresh(docs, "row_id")
    per_row = spans.groupBy(F.col("row_id").alias(key)).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(removed))
    known = identified(docs, row)
    joined = known.join(per_row, known[row] == per_row[key], "left").drop(key, row)
    stops = F.concat(F.array(F.lit(0)), F.transform(removed, lambda s: s["stop"]))
    begins = F.concat(F.transform(removed, lambda s: s["start"]), F.array(F.length("text")))
    parts = F.zip_with(stops, begins, lambda a, b: F.substring("text", a + 1, b - a))
    return joined.withColumn("text", F.when(F.col(removed).isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(parts, "")))
