"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide counts of linked id pairs.

Tokens of a text under the one (A) and the other tokenizer (B) are the two sides of a graph, with an edge (a link) where
their byte ranges overlap. The graph's connected components, found by union-find, are exactly the smallest groups that
start and end at a byte where both sides start and end. Steps:

1. Stretches. A text, with a space in front, is cut where a space follows what is no white space: neither tokenizer has a
   token across. Each distinct stretch is encoded once by both libraries while it stays in the cache; union-find runs over the
   links of all stretches that are new, at once, in arrays. A component's members expand to its links and its part of the text's groups.
2. Counts. Each part of the corpus (about PART_BYTES of text) keeps, for each of its documents, the distinct linked id pairs
   and how often they occur, as compressed arrays in one row, and counts its documents for each pair. Those counts are summed over
   the corpus by pair: distributed, and combined before the exchange.
3. Each part gets back the counts of its own pairs, and whether a pair has the highest count of its A id, by a join
   on the pair and a grouping by part; documents' sums are taken inside the part's row.

Memory of a task: about PART_BYTES of text, its pairs, and a cache of bounded size; a text longer than that is taken stretch by stretch.

Defined results: null and empty texts, and texts whose tokens don't give back their bytes (U+2581 in the text, which B
reads as a space), have no tokens, zeros and the empty string for groups_sha256; repeated rows are documents of their own and
count each; null doc_ids stay; an empty table gives an empty result; columns other than doc_id and text are not read. Strings of special
tokens inside a text are plain text.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, doc_texts
from .pieces import MARK, StretchCache, joined_stretches, read_model, safe_to_cut
from .resample import packed, ranges, unpacked

#: Bytes of text whose pairs a row holds, and that are handled at once; stretches of a long text handled at once.
PART_BYTES, STEP_BYTES, LONG = 16 << 20, 2 << 20, 1 << 16
#: Memory that the cache of stretches may take; an entry holds some hundred bytes besides its characters.
CACHE_BYTES, ENTRY_BYTES = 160 << 20, 400
#: Starts with the space; a space after white space belongs to the stretch.
STRETCH = re.compile(r"\s+[^ ]*(?:(?<=\s) [^ ]*)*")
BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component: union by the smaller root, paths halved until they are flat."""
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        open_ = a != b
        if not open_.any():
            return parent
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of tokens whose byte ranges overlap; each side's tokens lie one after the other from byte 0 on."""
    starts_a = np.concatenate(([0], ends_a[:-1]))
    starts_b = np.concatenate(([0], ends_b[:-1]))
    low = np.searchsorted(ends_b, starts_a, "right")
    high = np.searchsorted(starts_b, ends_a, "left")
    return np.repeat(np.arange(len(ends_a)), high - low), ranges(low, high - low)


class Aligner:
    """Both tokenizers, and what they give for stretches: counts, the groups as text, and the links as id pairs."""

    def __init__(self, byte_level_file: str, piece_file: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        if not safe_to_cut(read_model(piece_file)):
            raise ValueError("the pieces of this model may cross the boundaries of stretches")
        # A byte-level entry has one character for each byte.
        sizes = {i: len(token) for token, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.sizes_a = np.array([sizes.get(i, 0) for i in range(max(sizes) + 1)], np.int64)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = pa.array(
            [bytes([int(m[1], 16)]) if (m := BYTE.fullmatch(p)) and self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)], pa.large_binary()
        )
        self.sizes_b = np.array([len(x.as_py()) for x in self.bytes_b], np.int64)
        self.width = len(pieces)
        self.cache = StretchCache(self.entries, CACHE_BYTES, ENTRY_BYTES)

    def _ids(self, items: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[str]]:
        """Ids by A and B for runs of the stretches, and the stretches in that order; B's as they are in a text."""
        # White space at a stretch's end may go together with what follows: such stretches are encoded by themselves.
        alone = [x for x in items if x[-1].isspace()]
        runs = [*joined_stretches([x for x in items if not x[-1].isspace()]), *([x] for x in alone)]
        texts = ["".join(run) for run in runs]
        ids_a = [np.array(x.ids, np.int64) for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        ids_b = [np.array(x, np.int64) for x in self.b.encode([x[1:] for x in texts], num_threads=1)]
        # The library gives no token for no text; a space alone has its own.
        mark = np.array([self.b.piece_to_id(MARK)], np.int64)
        return ids_a, [x if len(x) else mark for x in ids_b], [x for run in runs for x in run]

    def _whole(self, ids_a: np.ndarray, ids_b: np.ndarray, text: bytes) -> bool:
        if self.sizes_a[ids_a].sum() != len(text) or self.sizes_b[ids_b].sum() != len(text):
            return False
        return self.bytes_b.take(pa.array(ids_b)).buffers()[2].to_pybytes()[: len(text)] == text

    def entries(self, missing: list[str]) -> list[tuple]:
        """(A tokens, B tokens, groups, links, groups as text, id pairs of links) of each stretch; None where B's bytes differ."""
        if not missing:
            return []
        ids_a, ids_b, order = self._ids(missing)
        a, b = np.concatenate(ids_a), np.concatenate(ids_b)
        data = [x.encode() for x in order]
        if not self._whole(a, b, b"".join(data)):
            if len(missing) == 1:
                return [None]
            # Some stretch differs: halves, until it stands alone.
            half = len(missing) // 2
            return [*self.entries(missing[:half]), *self.entries(missing[half:])]
        ends = np.cumsum([len(x) for x in data])
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        cut_a, cut_b = (np.searchsorted(x, ends) + 1 for x in (ends_a, ends_b))
        if (ends_a[cut_a - 1] != ends).any() or (ends_b[cut_b - 1] != ends).any():
            raise ValueError("a token crosses a boundary of stretches")
        u, v = overlaps(ends_a, ends_b)
        root = components(len(a) + len(b), u, v + len(a))
        stretch_links = np.searchsorted(u, cut_a)
        # Components in order of their first A token, A's members before B's; the mark behind each id says what comes next.
        token = np.lexsort((np.arange(len(root)), np.arange(len(root)) >= len(a), root))
        group = root[token]
        kind = token >= len(a)
        ids = np.concatenate((a, b))[token]
        last = np.append(group[1:] != group[:-1], True)
        marks = np.where(last, ";", np.where(np.append(kind[1:] != kind[:-1], False), "|", ","))
        texts = pc.binary_join_element_wise(pa.array(ids).cast(pa.string()), pa.array(marks), "").cast(pa.large_binary())
        places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        letters = texts.buffers()[2].to_pybytes()
        cut_all = np.concatenate(([0], cut_a + cut_b))
        groups = np.concatenate(([0], np.cumsum(last)))[cut_all]
        pairs = (a[u] * self.width + b[v]).tobytes()
        at = places[cut_all].tolist()
        links = np.concatenate(([0], stretch_links)).tolist()
        counts = [np.diff(np.concatenate(([0], x))).tolist() for x in (cut_a, cut_b)]
        found = {
            x: (na, nb, ng, k1 - k0, letters[t0:t1], pairs[8 * k0 : 8 * k1])
            for x, na, nb, ng, t0, t1, k0, k1 in zip(order, *counts, np.diff(groups).tolist(), at[:-1], at[1:], links[:-1], links[1:], strict=True)
        }
        return [found[x] for x in missing]

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, list[bytes], list[tuple[np.ndarray, np.ndarray]]]:
        """Of each text: A tokens, B tokens, groups and links; digest of the groups; distinct pairs and how often each occurs."""
        parts = [[] if not t or MARK in t else STRETCH.findall(" " + t) for t in texts]
        known = self.cache.learn(parts)
        numbers = {x: i for i, x in enumerate(set().union(*parts))}
        entries = [known(x) for x in numbers]
        bad = {x for x, e in zip(numbers, entries, strict=True) if e is None}
        if bad:
            parts = [[] if not bad.isdisjoint(part) else part for part in parts]
            entries = [e or (0, 0, 0, 0, b"", b"") for e in entries]
        counts = np.array([e[:4] for e in entries], np.int64).reshape(-1, 4)
        pairs = np.frombuffer(b"".join(e[5] for e in entries), np.int64)
        first = np.concatenate(([0], np.cumsum(counts[:, 3])))
        sizes = np.array([len(part) for part in parts])
        at = np.fromiter((numbers[x] for part in parts for x in part), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        totals = np.concatenate((np.zeros((1, 4), np.int64), np.cumsum(counts[at], axis=0)))
        sums = totals[ends] - totals[ends - sizes]
        groups = [e[4] for e in entries]
        digests = [hashlib.sha256(b"".join(map(groups.__getitem__, at[e - n : e].tolist()))[:-1]).hexdigest().encode() if n else b"" for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
        # Pairs by document: their numbers among the distinct pairs of these texts, sorted with the document in front.
        distinct, inverse = np.unique(pairs, return_inverse=True)
        width = max(1, len(distinct))
        doc = np.repeat(np.arange(len(parts)), sizes)
        keys = np.repeat(doc * width, counts[at, 3]) + inverse[ranges(first[at], counts[at, 3])]
        keys.sort()
        start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        times = np.diff(np.append(start, len(keys)))
        doc, pair = np.divmod(keys[start], width)
        bounds = np.searchsorted(doc, np.arange(len(parts) + 1))
        return sums, digests, [(distinct[pair[i:j]], times[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]

    def long_document(self, text: str) -> tuple[np.ndarray, bytes, tuple[np.ndarray, np.ndarray]]:
        """The same of one long text, a number of stretches at a time."""
        sums, digest, waiting = np.zeros(4, np.int64), hashlib.sha256(), b""
        pairs, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if MARK in text:
            return sums, b"", (pairs, times)
        for part in parts_of((m.group() for m in STRETCH.finditer(" " + text)), LONG):
            known = self.cache.learn([part])
            entries = [known(x) for x in part]
            if None in entries:
                return np.zeros(4, np.int64), b"", (pairs[:0], times[:0])
            sums += np.array([e[:4] for e in entries], np.int64).sum(0)
            digest.update(waiting)
            whole = b"".join(e[4] for e in entries)
            digest.update(whole[:-1])
            waiting = whole[-1:]
            new = np.frombuffer(b"".join(e[5] for e in entries), np.int64)
            pairs, inverse = np.unique(np.concatenate((pairs, new)), return_inverse=True)
            times = np.bincount(inverse, np.concatenate((times, np.ones(len(new), np.int64))), len(pairs)).astype(np.int64)
        return sums, digest.hexdigest().encode(), (pairs, times)


def parts_of(items: Iterable[str], size: int) -> Iterator[list[str]]:
    part: list[str] = []
    for item in items:
        part.append(item)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


@functools.lru_cache(maxsize=1)
def aligner(byte_level_file: str, piece_file: str) -> Aligner:
    """Kept by a Python worker, with its cache."""
    return Aligner(byte_level_file, piece_file)


class Part:
    """What a row of the corpus' parts holds: documents, their pairs, and in how many of them each pair is."""

    def __init__(self):
        self.bytes, self.ids, self.sums, self.digests, self.steps = 0, [], [], [], []
        self.pairs, self.docs = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: pa.Array, sums: np.ndarray, digests: list[bytes], found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.ids.append(ids)
        self.sums.append(sums)
        self.digests += digests
        pairs, times = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        sizes = np.array([len(x[0]) for x in found], np.uint32)
        # Differences inside a document are small and compress well.
        steps = np.diff(pairs, prepend=0)
        firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
        steps[firsts] = pairs[firsts]
        self.steps.append(packed(sizes, steps.astype(np.uint32), times.astype(np.uint32)))
        # A pair is in a document once.
        self.pairs, inverse = np.unique(np.concatenate((self.pairs, pairs)), return_inverse=True)
        self.docs = np.bincount(inverse, np.concatenate((self.docs, np.ones(len(pairs), np.int64))), len(self.pairs)).astype(np.int64)

    def row(self) -> pa.RecordBatch:
        ids = pa.concat_arrays(self.ids)
        columns = [
            packed(ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), np.concatenate(self.sums).ravel(), np.frombuffer(b"\n".join(self.digests), np.uint8)),
            self.steps, packed(self.pairs, self.docs),
        ]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, (pa.binary(), pa.list_(pa.binary()), pa.binary()), strict=True)], names=["docs", "steps", "pairs"])


def corpus_parts(docs: DataFrame, byte_level_file: str, piece_file: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """part, docs, steps and pairs: a row for about part_bytes of text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, part = aligner(byte_level_file, piece_file), Part()
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            start = 0
            while start < len(batch):
                end = max(start + 1, start + int(np.searchsorted(np.cumsum(sizes[start:]), STEP_BYTES, "right")))
                texts = batch.column(1).slice(start, end - start).to_pylist()
                if end == start + 1 and sizes[start] > STEP_BYTES:
                    sums, digest, found = both.long_document(texts[0])
                    part.add(batch.column(0).slice(start, 1), sums[None], [digest], [found])
                else:
                    part.add(batch.column(0).slice(start, end - start), *both.documents(texts))
                part.bytes += int(sizes[start:end].sum())
                if part.bytes >= part_bytes:
                    yield part.row()
                    part = Part()
                start = end
        if part.ids:
            yield part.row()

    rows = doc_texts(docs).mapInArrow(read, "docs binary, steps array<binary>, pairs binary")
    return cut(rows.withColumn("part", F.monotonically_increasing_id()))


def pair_documents(parts: DataFrame) -> DataFrame:
    """part, pair (A id times B's vocabulary, plus B id) and docs: in how many documents of the part the pair is linked."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pairs, docs = unpacked(data, np.int64, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), part)), pa.array(pairs), pa.array(docs)], names=["part", "pair", "docs"])

    return parts.select("part", "pairs").mapInArrow(read, "part long, pair long, docs long")


def pair_counts(found: DataFrame, width: int) -> DataFrame:
    """pair, count (documents of the corpus that hold it linked) and best (the highest count of its A id)."""
    counts = found.groupBy("pair").agg(F.sum("docs").alias("count"))
    of_a = W.partitionBy(F.expr(f"pair div {width}L"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(of_a))


def vocabulary_size(piece_file: str) -> int:
    return len(read_model(piece_file)["pieces"])


def linked_pairs(docs: DataFrame, byte_level_file: str, piece_file: str) -> DataFrame:
    """a_id, b_id, count and best of every pair that some document holds linked: the tokenizers' dictionary."""
    width = vocabulary_size(piece_file)
    counts = pair_counts(pair_documents(corpus_parts(docs, byte_level_file, piece_file)), width)
    return counts.select(F.expr(f"pair div {width}L").alias("a_id"), F.expr(f"pair % {width}L").alias("b_id"), "count", "best")


def aligned(docs: DataFrame, byte_level_file: str, piece_file: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs."""
    parts = corpus_parts(docs, byte_level_file, piece_file, part_bytes)
    found = pair_documents(parts)
    counts = pair_counts(found, vocabulary_size(piece_file))
    known = found.select("part", "pair").join(counts, "pair").groupBy("part").agg(F.sort_array(F.collect_list(F.struct("pair", "count", "best"))).alias("known"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, valid, sums, digests = unpacked(batch.column(0)[i].as_py(), np.int64, np.bool_, np.int64, np.uint8)
                known = batch.column(2)[i].values
                pairs, count, best = (x.to_numpy(zero_copy_only=False) for x in known.flatten()) if known is not None else [np.zeros(0, np.int64)] * 3
                each = []
                for data in batch.column(1)[i].as_py():
                    sizes, steps, times = unpacked(data, np.uint32, np.uint32, np.uint32)
                    total = np.cumsum(steps, dtype=np.int64)
                    ends = np.cumsum(sizes, dtype=np.int64)
                    before = np.concatenate(([0], total))[ends - sizes]
                    at = np.searchsorted(pairs, total - np.repeat(before, sizes))
                    gained = np.concatenate((np.zeros((1, 2), np.int64), np.cumsum(np.column_stack((best[at] * times, count[at] * times)).astype(np.int64), axis=0)))
                    each.append(gained[ends] - gained[ends - sizes])
                sums, each = sums.reshape(-1, 4), np.concatenate(each)
                columns = [pa.array(ids, mask=~valid), *(pa.array(sums[:, k]) for k in range(4)), pa.array(each[:, 0]), pa.array(each[:, 1]), pa.array(digests.tobytes().decode().split("\n"))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return parts.select("part", "docs", "steps").join(known, "part", "left").select("docs", "steps", "known").mapInArrow(
        score, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
