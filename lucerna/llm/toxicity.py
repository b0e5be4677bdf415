"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

Terms are words (runs of ASCII letters and digits and of other characters, letters A-Z and those of Latin-1 in lower case) of at
most LONGEST bytes, and the first 4 to 7 characters of longer words. Steps:

1. Examples: labelled rows outside the held-out fold, about max_rows of them by a hash of doc_id, which bounds all
   that the driver and the index hold. Of their terms the `vocabulary` best by the chi-squared statistic of term and label are
   kept, those that at least LEAST_DOCS examples have and that speak for label 1.
2. Vectors: one pass over all documents counts the vocabulary's terms. A term's weight is its count times its idf, from the counts over
   all documents; one more component, the same for all texts, stands for all other words, so that a single
   chance term is not a whole vector.
3. Index: for each term the examples that hold it with their weights, in blocks of examples with each block's highest weight.
   A query sums those maxima to a bound for every block, reads blocks from the highest bound on and stops when no block can
   reach its k-th best cosine: exact, since only what cannot be among the k is left out.
4. Votes: the k nearest vote with 1 / (distance + NEAR); examples that tie for the last places share them. A logistic curve
   fitted to the examples' own votes, each without itself, makes votes probabilities. The nearest examples are the evidence.

The vocabulary (hashes), the weights and the index are what is broadcast: at most max_rows vectors of at most `vocabulary` terms.

Defined results: null and empty texts have the common component alone and are scored like any text; repeated rows repeat their
result; labels of unknown documents are ignored, repeated labels of a document count as one, their mean; several rows of a labelled
doc_id are an example each; held_out of a null doc_id is false; without examples every score is 0, with one class alone it is that class; an
empty table gives an empty result; columns other than doc_id and text (doc_id and toxic) are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, doc_texts
from .resample import _WORD, blocks_of, ranges
from .words import mix, run_hashes

THRESHOLD, MAX_ROWS, VOCABULARY, NEIGHBOURS = 0.5, 10_000, 4096, 15
#: Fewest examples that hold a term; least chi-squared; weight of the common component; added to distances.
LEAST_DOCS, LEAST_CHI, COMMON, NEAR = 4, 15.0, 5.0, 0.01
PREFIXES, LONGEST, BLOCK, EVIDENCE, SAME = (4, 5, 6, 7), 64, 64, 3, 1e-9
_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[65:91] += 32


def held_out(doc_id="doc_id"):
    """Whether a row belongs to the fold that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def folded(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the capital letters of Latin-1 in lower case."""
    out = _LETTER[data]
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    out[capital] += 0x20
    return out


def term_hashes(data: np.ndarray, offsets: np.ndarray, goes_on: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of every word of a block of texts, then of every prefix of each length."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = _WORD[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    starts = np.flatnonzero(solid[1:] & (~solid[:-1] | border))
    ends = np.flatnonzero(solid[:-1] & (~solid[1:] | border))
    if goes_on:
        starts, ends = starts[1:], ends[1:]
    rows = np.searchsorted(offsets, starts, "right") - 1
    values = folded(data).astype(np.uint64) + np.uint64(1)
    first = (data & 0xC0) != 0x80
    chars = np.append(np.flatnonzero(first), len(data))
    before = np.concatenate(([0], np.cumsum(first)))
    short = ends - starts <= LONGEST
    yield rows[short], run_hashes(values, starts[short], ends[short])
    for length in PREFIXES:
        longer = np.flatnonzero(before[ends] - before[starts] > length)
        stop = chars[before[starts[longer]] + length]
        yield rows[longer], mix(run_hashes(values, starts[longer], stop) + np.uint64(length))


def example_terms(texts: DataFrame) -> DataFrame:
    """term, docs and positive (sum of labels) of every term in a batch of (doc_id, text, label), doc_id being ignored."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(2).to_numpy()
            found = [
                (np.unique(np.column_stack((r.astype(np.uint64) + np.uint64(row), h)), axis=0) if len(r) else np.zeros((0, 2), np.uint64))
                for row, _, data, offsets, goes_on in blocks_of(batch.column(1), 1 << 20) for r, h in term_hashes(data, offsets, goes_on)
            ]
            both = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.uint64)
            terms, inverse = np.unique(both[:, 1], return_inverse=True)
            docs, positive = np.bincount(inverse, minlength=len(terms)), np.bincount(inverse, label[both[:, 0].astype(np.int64)], len(terms))
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(docs), pa.array(positive)], names=["term", "docs", "positive"])

    return texts.mapInArrow(read, "term long, docs long, positive double")


def examples_of(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """doc_id, text and label of about max_rows labelled rows at most, outside the held-out fold."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("toxic").alias("label"))
    known = cut(known.where(~held_out()))
    total = known.count()
    if total > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(max_rows / total * (1 << 30)))
    # About max_rows rows of two numbers: the side that is broadcast is bounded.
    return doc_texts(docs).join(F.broadcast(known), "doc_id").select("doc_id", "text", "label")


def best_terms(examples: DataFrame, vocabulary: int) -> np.ndarray:
    """Sorted hashes of the terms that speak most clearly for label 1."""
    total = examples.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).first()
    n, p = float(total.n), float(total.p or 0)
    if not 0 < p < n:
        return np.zeros(0, np.uint64)
    counts = example_terms(examples).groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("positive").alias("a")).where(F.col("docs") >= LEAST_DOCS)
    b, c = F.col("docs") - F.col("a"), F.lit(p) - F.col("a")
    d = F.lit(n - p) - b
    chi = F.lit(n) * F.pow(F.col("a") * d - b * c, 2) / (F.col("docs") * (F.lit(n) - F.col("docs") + 1e-9) * p * (n - p))
    chosen = counts.where(F.col("a") * n > F.col("docs") * p).withColumn("chi", chi).where(F.col("chi") >= LEAST_CHI)
    rows = chosen.orderBy(F.round("chi", 6).desc(), "term").limit(vocabulary).select("term").collect()
    return np.sort(np.array([r.term for r in rows], np.int64).view(np.uint64))


def document_vectors(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """doc_id, and terms (places in the vocabulary) and counts of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        # Nearly all words are told apart by 16 bits of their hash.
        maybe = np.zeros(1 << 16, bool)
        maybe[(terms & np.uint64(0xFFFF)).astype(np.int64)] = True
        for batch in batches:
            keys = [np.zeros(0, np.int64)]
            for row, _, data, offsets, goes_on in blocks_of(batch.column(1), 1 << 20) if len(terms) else ():
                for rows, hashes in term_hashes(data, offsets, goes_on):
                    some = np.flatnonzero(maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
                    at = np.minimum(np.searchsorted(terms, hashes[some]), len(terms) - 1)
                    hit = terms[at] == hashes[some]
                    keys.append((rows[some[hit]] + row) * len(terms) + at[hit])
            keys, counts = np.unique(np.concatenate(keys), return_counts=True)
            rows, at = np.divmod(keys, max(1, len(terms)))
            ends = pa.array(np.searchsorted(rows, np.arange(len(batch) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (at, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["doc_id", "terms", "counts"])

    return doc_texts(docs).mapInArrow(read, "doc_id long, terms array<int>, counts array<int>")


@dataclass
class BlockMaxIndex:
    """Unit vectors of examples as postings by term, in blocks of BLOCK examples with the highest weight of each."""

    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    term_start: np.ndarray  # by term, into the blocks
    block: np.ndarray
    block_max: np.ndarray
    block_start: np.ndarray  # by block of a term, into the postings

    @classmethod
    def build(cls, idf: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]]) -> BlockMaxIndex:
        units = [unit_vector(idf, terms, counts) for terms, counts in vectors]
        # Examples whose strongest term is the same stand together, so that a block's maxima belong to few terms.
        strongest = np.array([t[np.argmax(w[:-1])] if len(t) > 1 else -1 for t, w in units], np.int64)
        order = np.lexsort((ids, strongest))
        units, ids, labels = [units[i] for i in order], ids[order], labels[order]
        sizes = np.array([len(t) for t, _ in units], np.int64)
        terms, weights = (np.concatenate([u[k] for u in units]) if units else np.zeros(0) for k in (0, 1))
        examples = np.repeat(np.arange(len(units)), sizes)
        by_term = np.lexsort((examples, terms))
        terms, weights, examples = terms[by_term].astype(np.int64), weights[by_term], examples[by_term]
        blocks = examples // BLOCK
        start = np.flatnonzero(np.concatenate(([True], (terms[1:] != terms[:-1]) | (blocks[1:] != blocks[:-1])))) if len(terms) else np.zeros(0, np.int64)
        return cls(
            idf, ids, labels, examples, weights, np.searchsorted(terms[start], np.arange(len(idf) + 2)), blocks[start],
            np.maximum.reduceat(weights, start) if len(start) else np.zeros(0), np.append(start, len(terms)),
        )

    def nearest(self, terms: np.ndarray, counts: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines of the k nearest, and of all that tie with the last of them; `without` is the doc_id of examples left out."""
        terms, weights = unit_vector(self.idf, terms, counts)
        sizes = self.term_start[terms + 1] - self.term_start[terms]
        lists = ranges(self.term_start[terms], sizes)
        weights = np.repeat(weights, sizes)
        blocks = self.block[lists]
        bounds = np.bincount(blocks, weights * self.block_max[lists])
        order = np.argsort(-bounds, kind="stable")
        found, cosines = np.zeros(0, np.int64), np.zeros(0)
        at, step, least = 0, 1 + k // BLOCK, -np.inf
        while at < len(order) and bounds[order[at]] >= least - SAME:
            chosen = order[at : at + step]
            chosen = chosen[bounds[chosen] >= least - SAME]
            wanted = np.zeros(len(bounds), bool)
            wanted[chosen] = True
            use = np.flatnonzero(wanted[blocks])
            entries = lists[use]
            counts_ = self.block_start[entries + 1] - self.block_start[entries]
            posts = ranges(self.block_start[entries], counts_)
            sums = np.bincount(self.example[posts], self.weight[posts] * np.repeat(weights[use], counts_))
            near = np.flatnonzero(sums > 0)
            if without is not None:
                near = near[self.ids[near] != without]
            found, cosines = np.concatenate((found, near)), np.concatenate((cosines, np.minimum(sums[near], 1.0)))
            if len(found) >= k:
                least = np.partition(cosines, len(cosines) - k)[len(cosines) - k]
                keep = cosines >= least - SAME
                found, cosines = found[keep], cosines[keep]
            at, step = at + step, step * 2
        return found, cosines

    def vote(self, terms: np.ndarray, counts: np.ndarray, k: int, without: int | None = None) -> tuple[float, list[int]]:
        """The weighted share of label 1 among the k nearest, and the doc_ids of the nearest of the label that has more weight."""
        found, cosines = self.nearest(terms, counts, k, without)
        if not len(found):
            return float(self.labels.mean()), []
        least = cosines.min()
        tied = cosines <= least + SAME
        # Those that tie with the last share the places that are left.
        places = min(k, len(found)) - int((~tied).sum())
        weight = np.where(tied, places / max(1, int(tied.sum())), 1.0) / (1 - cosines + NEAR)
        share = float((weight * self.labels[found]).sum() / weight.sum())
        order = np.lexsort((self.ids[found], -np.round(cosines, 9), (self.labels[found] >= 0.5) != (share >= 0.5)))
        return share, self.ids[found[order[:EVIDENCE]]].tolist()


def unit_vector(idf: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms with the common component behind them, and weights of length 1."""
    weights = np.append(counts * idf[terms], COMMON)
    return np.append(terms, len(idf)).astype(np.int64), weights / np.sqrt((weights**2).sum())


def logit(share: np.ndarray) -> np.ndarray:
    return np.log(np.clip(share, 0.001, 0.999) / (1 - np.clip(share, 0.001, 0.999)))


def fit_curve(shares: np.ndarray, labels: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """Slope and offset of the logistic curve from votes to probabilities, by Newton's method with a weak pull to slope 1."""
    x = np.column_stack((logit(shares), np.ones(len(shares))))
    # As Platt proposed, targets a little inside 0 and 1.
    positive = labels.sum()
    y = labels * (positive + 1) / (positive + 2) + (1 - labels) / (len(labels) - positive + 2)
    theta, pull = np.array([1.0, 0.0]), np.diag([1.0, 0.01])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (y - p) - pull @ (theta - [1.0, 0.0])
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + pull, gradient)
        theta = theta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS, vocabulary: int = VOCABULARY, neighbours: int = NEIGHBOURS,
) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (doc_ids of the nearest examples) of every row of docs."""
    examples = cut(examples_of(docs, labels, max_rows))
    terms = best_terms(examples, vocabulary)
    vectors = cut(document_vectors(docs, terms))
    sizes = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("docs")).collect()
    total, held = vectors.count(), np.zeros(len(terms))
    for row in sizes:
        held[row.term] = row.docs
    idf = np.log((total + 1) / (held + 1)) + 1
    known = document_vectors(examples, terms).withColumn("row", F.monotonically_increasing_id())
    known = cut(known.join(examples.select("doc_id", "label").distinct(), "doc_id"))
    rows = known.orderBy("doc_id", "row").toPandas()
    marks = rows["label"].to_numpy(np.float64)
    context = docs.sparkSession.sparkContext
    index = BlockMaxIndex.build(idf, rows["doc_id"].to_numpy(np.int64), marks, [tuple(np.asarray(x, np.int64) for x in pair) for pair in zip(rows["terms"], rows["counts"], strict=True)])
    shared = context.broadcast(index)

    def votes(curve: tuple[float, float] | None, own: bool):
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, done = shared.value, {}
            for batch in batches:
                ends, ids = batch.column(1).offsets.to_numpy(), batch.column(0).to_pylist()
                at, counts = (batch.column(k).values.to_numpy() for k in (1, 2))
                out = []
                for doc_id, a, b in zip(ids, ends[:-1], ends[1:], strict=True):
                    # Equal vectors have equal neighbours; the few that are kept are those with few terms.
                    key = None if own else (at[a:b].tobytes(), counts[a:b].tobytes())
                    if own or key not in done:
                        if len(done) > 1 << 14:
                            done.clear()
                        found = index.vote(at[a:b], counts[a:b], neighbours, doc_id if own else None)
                        if own:
                            out.append(found)
                            continue
                        done[key] = found
                    out.append(done[key])
                share = np.array([x[0] for x in out])
                if curve:
                    share = 1 / (1 + np.exp(-np.clip(curve[0] * logit(share) + curve[1], -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(share, pa.float64()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

        return read

    schema = "doc_id long, score double, evidence array<long>"
    if not len(marks):
        scored = vectors.select("doc_id", F.lit(0.0).alias("score"), F.lit(None).cast("array<long>").alias("evidence"))
    elif marks.min() == marks.max():
        scored = vectors.select("doc_id", F.lit(float(marks[0])).alias("score"), F.lit(None).cast("array<long>").alias("evidence"))
    else:
        own = known.select("doc_id", "terms", "counts", "label")
        tested = own.drop("label").mapInArrow(votes(None, True), schema).select("doc_id", "score").join(own.select("doc_id", "label").distinct(), "doc_id").orderBy("doc_id", "score").toPandas()
        curve = fit_curve(tested["score"].to_numpy(np.float64), tested["label"].to_numpy(np.float64))
        scored = vectors.mapInArrow(votes(curve, False), schema)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
