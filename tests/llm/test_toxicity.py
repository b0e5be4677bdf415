"""Toxicity scores: the index against dense cosines, the whole against a plain version of the vote, held-out accuracy, awkward rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lucerna.llm import toxicity

DOCS = "doc_id long, text string, label double, score double, terms string"


def index_of(seed, n=300, terms=40):
    rng = np.random.default_rng(seed)
    vectors = [(np.sort(rng.choice(terms, rng.integers(0, 6), replace=False)), None) for _ in range(n)]
    vectors = [(t, rng.integers(1, 4, len(t))) for t, _ in vectors]
    idf, ids, labels = rng.uniform(1, 5, terms), rng.permutation(n), rng.integers(0, 2, n).astype(float)
    return toxicity.BlockMaxIndex.build(idf, ids, labels, vectors), idf, ids, labels, vectors


@pytest.mark.parametrize("seed", range(4))
def test_nearest_are_exact(seed):
    index, idf, ids, labels, vectors = index_of(seed)
    dense = np.zeros((len(vectors), len(idf) + 1))
    for i, (t, c) in enumerate(vectors):
        dense[i, t] = c * idf[t]
        dense[i, -1] = toxicity.COMMON
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    for q in range(0, len(vectors), 7):
        for k, without in ((1, None), (15, None), (15, ids[q]), (400, None)):
            cosines = dense @ dense[q]
            if without is not None:
                cosines[ids == without] = -1
            rows = np.flatnonzero(cosines > 0)
            least = np.sort(cosines[rows])[::-1][min(k, len(rows)) - 1]
            want = {int(ids[i]): round(cosines[i], 7) for i in rows if cosines[i] >= least - 1e-9}
            found, got = index.nearest(*vectors[q], k, without)
            assert {int(index.ids[i]): round(c, 7) for i, c in zip(found, got, strict=True)} == want


def test_vote_shares_tied_places():
    labels = np.array([1.0, 0.0, 0.0, 1.0])
    vectors = [(np.array([0]), np.array([1])), *[(np.array([1]), np.array([1]))] * 3]
    index = toxicity.BlockMaxIndex.build(np.array([2.0, 2.0]), np.arange(4), labels, vectors)
    share, nearest = index.vote(np.array([0]), np.array([1]), 2)
    # The example itself, and one place that the three others share.
    cosine = 25 / 29
    one, rest = 1 / toxicity.NEAR, 1 / (1 - cosine + toxicity.NEAR)
    assert share == pytest.approx((one + rest / 3) / (one + rest)) and nearest == [0, 3, 1]


def plain_terms(text):
    """Words and prefixes, as the docstring states them."""
    out, word = [], ""
    fold = {chr(c): chr(c).lower() for c in [*range(65, 91), *range(0xC0, 0xDF)] if c != 0xD7}
    for c in [*(text or ""), " "]:
        if ord(c) >= 128 or c.isalnum():
            word += fold.get(c, c)
            continue
        if word:
            out += [word] if len(word.encode()) <= 64 else []
            out += [(word[:k], k) for k in (4, 5, 6, 7) if len(word) > k]
        word = ""
    return out


def test_terms(spark):
    texts = ["Über ÜBER über, a4b!x", "", "ÉTÉ×÷ " + "y" * 70 + " longest wordsandmore", "日本語日本語 ok", "x " * 2000]
    want = [len(set(plain_terms(t))) for t in texts]
    rows, hashes = zip(*[(r + row, h) for row, _, d, o, g in toxicity.blocks_of(pa.array(texts), 1 << 20) for r, h in toxicity.term_hashes(d, o, g)], strict=True)
    rows, hashes = np.concatenate(rows), np.concatenate(hashes)
    assert [len(set(hashes[rows == i].tolist())) for i in range(len(texts))] == want
    cut = [h for _, _, d, o, g in toxicity.blocks_of(pa.array(texts[2:3]), 9) for _, h in toxicity.term_hashes(d, o, g)]
    assert sorted(np.concatenate(cut).tolist()) == sorted(hashes[rows == 2].tolist())


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.2)
        bad = ["vileness", "Grubby", "snarlers"] * toxic
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))] + [rng.choice(bad) for _ in range(3 * toxic)]
        rng.shuffle(text)
        rows.append((i, " ".join(text), toxic))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([(i, t, 0.5, 0.5, "x") for i, t, _ in rows], DOCS).repartition(4)
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(docs, labels)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    got = {r.doc_id: r for r in got.collect()}
    assert len(got) == 600 and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    held = [(got[i].predicted, t) for i, _, t in rows if got[i].held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    # A learned label never reaches the held-out fold: other labels there change nothing.
    flipped = spark.createDataFrame([(i, 1 - t if got[i].held_out else t) for i, _, t in rows], "doc_id long, toxic int")
    assert {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, flipped).collect()} == {i: r.score for i, r in got.items()}


def test_awkward_rows(spark):
    rows = corpus(120)
    more = [(None, "no id vileness grubby"), (None, None), (3, None), (3, ""), (500, "vileness " * 3000 + "q" * 20_000), (501, "Grubby vileness snarlers"), (501, "Grubby vileness snarlers")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in [*((i, t) for i, t, _ in rows), *more]], DOCS)
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(1, 1), (999, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == len(rows) + len(more) and all(r.score is not None and r.held_out is not None for r in got)
    assert [r.predicted for r in got if r.doc_id == 501] == [1, 1]
    none = toxicity.toxicity_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0} and len(none) == len(got)
    assert {r.score for r in toxicity.toxicity_scores(docs, labels.where("toxic = 1")).collect()} == {1.0}
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0
    # A bound on the examples is a bound on what is learned from, not on what is scored.
    assert toxicity.toxicity_scores(docs, labels, max_rows=30).count() == len(got)
