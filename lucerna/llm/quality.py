"""Quality classifier: a generalised additive model with pairwise interactions, learned by cyclic boosting.

Features are shares and averages over a text's bytes, words and lines, taken in vectorised passes. Each
feature is binned by quantiles. Training goes round the features again and again; each step fits a shallow
tree (at most `leaves` intervals of bins) to the gradients of one feature and adds it, times the learning rate,
to that feature's lookup table. Then the pairs of features whose joint bins explain most of what is left get
tables of their own, trained the same way over a coarse grid. A score is the sigmoid of the sum of table
entries, found by vectorised bin lookups.

Training rows: labelled rows, doc_id's checksum not in the held-out fold, at most max_rows of them by a hash
of doc_id: a bounded sample for the driver. Everything else covers all rows. Labels, lang, source and doc_id
are never features.

Defined results: null and empty texts have features of zero and are scored like any text; repeated rows
repeat their score; labels for unknown documents are ignored, repeated labels for a document count as one, their
mean; of several rows of a labelled doc_id the one with the least features is learned from; held_out of a null doc_id is false; without training rows, or with one class alone, every score is that class's share (0.5 without rows);
columns other than doc_id and text (doc_id and quality) are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, doc_texts, maybe_among
from .words import Words, slices

THRESHOLD, MAX_ROWS = 0.7, 20_000
FEATURES = (
    "log_words", "word_bytes", "upper", "digit", "stops", "rare_marks", "pipes", "spaces", "line_words", "repeated_lines",
    "distinct_words", "longest_word", "marks_per_word", "capital_words", "common_word",
)
_KIND = {
    "upper": range(65, 91), "digit": range(48, 58), "stops": b".,;:?", "rare_marks": b"!#$%&*+/<=>@[\\]^_`{}~", "pipes": b"|",
    "spaces": b" \t\n\r\x0b\x0c",
}
_CLASS = {name: np.isin(np.arange(256), list(codes)) for name, codes in _KIND.items()}


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags in each row's stretch."""
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])


def text_features(words: Words) -> np.ndarray:
    """A row of FEATURES for each row of a slice."""
    n = len(words.offsets) - 1
    size = np.maximum(np.diff(words.offsets), 1)
    count = np.diff(words.rows)
    some = np.maximum(count, 1)
    counts = {name: _per_row(flags[words.data], words.offsets) for name, flags in _CLASS.items()}
    lengths = words.ends - words.starts
    row = np.repeat(np.arange(n), count)
    longest = np.zeros(n)
    np.maximum.at(longest, row, lengths)
    capital = _per_row(_CLASS["upper"][words.data[words.starts]] & _CLASS["upper"][words.data[words.ends - 1]], words.rows)
    lines = _per_row(words.data == 10, words.offsets) + 1
    order = np.lexsort((words.hashes, row))
    hashes = words.hashes[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    distinct = _per_row(fresh, words.rows)
    spans = np.diff(np.append(np.flatnonzero(fresh), len(row)))
    common = np.zeros(n)
    np.maximum.at(common, row[fresh], spans)
    # Lines are known by their words' hashes; a line that occurs before in the text is repeated.
    feeds = np.concatenate(([0], np.cumsum(words.data == 10)))
    line = feeds[words.starts]
    begins = np.ones(len(row), bool)
    begins[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(begins)
    sums = np.add.reduceat(words.hashes, first) if len(first) else np.zeros(0, np.uint64)
    line_row, line_size = row[first], np.diff(np.append(first, len(row)))
    order = np.lexsort((sums, line_row))
    again = np.zeros(len(first), bool)
    again[order[1:]] = (sums[order][1:] == sums[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
    repeated = np.zeros(n)
    np.add.at(repeated, line_row[again], line_size[again])
    marks = counts["stops"] + counts["rare_marks"] + counts["pipes"]
    columns = [
        np.log1p(count), np.where(count, _per_row(np.ones(len(words.data), bool), words.offsets) / some, 0), counts["upper"] / size,
        counts["digit"] / size, counts["stops"] / size, counts["rare_marks"] / size, counts["pipes"] / size, counts["spaces"] / size,
        np.log1p(count / lines), repeated / some, distinct / some, np.log1p(longest), marks / some, capital / some, common / some,
    ]
    return np.column_stack(columns).astype(np.float64)


def feature_rows(docs: DataFrame) -> DataFrame:
    """doc_id and features of every row of docs."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, words in slices(pc.fill_null(batch.column(1), "")):
                flat = text_features(words).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(end - start + 1) * len(FEATURES), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), lists], names=["doc_id", "features"])

    return doc_texts(docs).mapInArrow(measure, "doc_id long, features array<double>")


@dataclass
class AdditiveModel:
    """Lookup tables: one for each feature, one for each chosen pair."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.pair_edges[i], x[:, i], "right"), np.searchsorted(self.pair_edges[j], x[:, j], "right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def shallow_tree(gradient: np.ndarray, weight: np.ndarray, leaves: int, smooth: float) -> np.ndarray:
    """Values per bin, constant on at most `leaves` intervals that greedy splits choose."""
    g, w = np.concatenate(([0.0], np.cumsum(gradient))), np.concatenate(([0.0], np.cumsum(weight)))

    def worth(a, b):
        return (g[b] - g[a]) ** 2 / (w[b] - w[a] + smooth)

    cuts = [0, len(gradient)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                at = np.arange(a + 1, b)
                gain = worth(a, at) + worth(at, b) - worth(a, b)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], int(at[k]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(gradient))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + smooth)
    return out


def quantile_edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def fit_additive(
    x: np.ndarray, y: np.ndarray, rounds: int = 150, bins: int = 64, leaves: int = 3, rate: float = 0.1,
    pairs: int = 5, pair_bins: int = 8, pair_rounds: int = 60, smooth: float = 1.0,
) -> AdditiveModel:
    """Cyclic boosting of feature tables, then of the tables of the best pairs."""
    model = AdditiveModel()
    if not len(y):
        return model
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    model.base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return model
    d = x.shape[1]
    model.edges = [quantile_edges(x[:, j], bins) for j in range(d)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    binned = [np.searchsorted(model.edges[j], x[:, j], "right") for j in range(d)]
    margin = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-margin))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(d):
            g, w = slopes()
            size = len(model.tables[j])
            step = rate * shallow_tree(np.bincount(binned[j], g, size), np.bincount(binned[j], w, size), leaves, smooth)
            model.tables[j] += step
            margin += step[binned[j]]
    model.pair_edges = [quantile_edges(x[:, j], pair_bins) for j in range(d)]
    coarse = [np.searchsorted(model.pair_edges[j], x[:, j], "right") for j in range(d)]
    sizes = [len(e) + 1 for e in model.pair_edges]
    g, w = slopes()
    gains = []
    for i in range(d):
        for j in range(i + 1, d):
            cell = coarse[i] * sizes[j] + coarse[j]
            gains.append((float((np.bincount(cell, g) ** 2 / (np.bincount(cell, w) + smooth)).sum()), i, j))
    chosen = [(i, j) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    tables = [np.zeros((sizes[i], sizes[j])) for i, j in chosen]
    for _ in range(pair_rounds):
        for (i, j), table in zip(chosen, tables, strict=True):
            g, w = slopes()
            cell = coarse[i] * sizes[j] + coarse[j]
            gs = np.bincount(cell, g, table.size).reshape(table.shape)
            ws = np.bincount(cell, w, table.size).reshape(table.shape)
            # A tree of depth two: a split of the one feature, then of the other on either side.
            split = shallow_tree(gs.sum(1), ws.sum(1), 2, smooth)
            step = np.zeros(table.shape)
            for side in np.unique(split):
                rows = split == side
                step[rows] = shallow_tree(gs[rows].sum(0), ws[rows].sum(0), 2, smooth)
            table += rate * step
            margin += rate * step.ravel()[cell]
    model.pairs = [(i, j, t) for (i, j), t in zip(chosen, tables, strict=True)]
    return model


def held_out(doc_id="doc_id"):
    """Whether a row belongs to the fold that training never sees."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def learnable(labels: DataFrame) -> DataFrame:
    """doc_id and label of what may be learned from."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("label"))
    return known.where(~held_out())


def train(features: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> AdditiveModel:
    """The model from at most about max_rows labelled rows outside the held-out fold."""
    rows = features.join(learnable(labels), "doc_id").groupBy("doc_id").agg(F.min("features").alias("features"), F.first("label").alias("label"))
    rows = cut(rows.select("doc_id", "features", "label"))
    total = rows.count()
    if total > max_rows:
        part = int(max_rows / total * (1 << 30))
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < part)
    sample = rows.orderBy("doc_id").toPandas()
    if not len(sample):
        return AdditiveModel()
    return fit_additive(np.vstack(sample["features"].to_numpy()), sample["label"].to_numpy(np.float64))


def score_rows(features: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of features."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return features.mapInArrow(score, "doc_id long, score double").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    features = cut(feature_rows(docs))
    return score_rows(features, train(features, labels), threshold)


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score at least threshold; each row is scored where it is."""
    # A bitmap tells the labelled rows apart where they are: only features are joined.
    some = maybe_among(doc_texts(docs), ["doc_id"], learnable(labels).select("doc_id"), "__among").where("__among")
    model = train(feature_rows(some), labels)

    @F.pandas_udf("double")
    def score(texts):
        out = [model.score(text_features(words)) for _, _, words in slices(pa.array(texts.fillna(""), pa.string()))]
        import pandas as pd

        return pd.Series(np.concatenate(out) if out else [])

    return docs.where(score(F.coalesce("text", F.lit(""))) >= threshold)
