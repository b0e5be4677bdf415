"""Rows that share ids, budgets of windows, and words that must not share a hash."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lucerna.llm import chat_format, line_dedup, ngram_join, quality
from lucerna.llm.words import byte_hashes, find_words, sequence_hashes


def opposites(n):
    """A sequence of two kinds and its complement whose difference every odd base brings to zero modulo 2^64."""
    first = [bin(i).count("1") % 2 for i in range(n)]
    return first, [1 - x for x in first]


def test_words_of_two_letters_differ(spark):
    a, b = ("".join("ab"[x] for x in s) for s in opposites(1024))
    docs = spark.createDataFrame([(0, a), (1, b), (2, a.upper())], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()} == {0: 0, 1: 1, 2: 0}
    data = np.frombuffer((a + " " + b).encode(), np.uint8)
    assert len(set(find_words(data, np.array([0, len(data)])).hashes.tolist())) == 2


def test_lines_of_two_words_differ():
    words = np.array([11, 12], np.uint64)
    hashes = [sequence_hashes(words[np.array(s)], np.array([len(s)]))[0] for s in opposites(2048)]
    assert hashes[0] != hashes[1]
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    starts = np.sort(rng.choice(3900, 800, replace=False))
    ends = starts + rng.integers(1, 40, 800)
    found = byte_hashes(data, starts, ends)
    known = {}
    for s, e, h in zip(starts, ends, found.tolist()):
        assert known.setdefault(bytes(data[s:e]), h) == h
    assert len(set(known.values())) == len(known)


PASSAGE = " ".join(f"word{i} of" for i in range(30))


def test_spans_stay_with_their_row(spark):
    other = " ".join(f"other{i}" for i in range(100))
    rows = [(0, "start " + PASSAGE + " end"), (1, "a b " + PASSAGE), (1, other), (None, "x " + PASSAGE + " y"), (None, None), (2, other + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = line_dedup.repeated_spans(docs).cache()
    out = [r.text for r in line_dedup.without_spans(docs, spans).select("text").collect()]
    kept = [t for t in out if t]
    assert sum(t.count("word7 of") for t in kept) == 1 and sum("other50" in t for t in kept) == 1
    assert "start " + PASSAGE + " end" in kept and len(out) == len(rows)
    # The row of its own doc_id keeps the passage, since rows that share an id rank behind it.
    assert other + " more" in kept
    assert {r.first_doc_id for r in spans.collect()} == {0, 2} and spans.where(F.col("doc_id").isNull()).count() == 1


def test_windows_keep_their_budget(spark):
    turns = []
    for c in (1, 2, None):
        turns += [(c, 0, "system", "s" * 120)] + [(c, k, "user" if k % 2 else "assistant", f"{k}" * (37 * k % 700) + "<|x|>") for k in range(1, 60)]
    turns += [(3, 0, "user", "z" * 20_000), (3, 1, "assistant", "after"), (4, None, None, "no turn"), (4, None, None, "no turn"), (4, 1, "assistant", None)]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    windows = chat_format.chat_windows(df, 512, 64)
    back = {r.conv_id: r.n_turns for r in chat_format.read_back(windows).collect()}
    assert back == {1: 60, 2: 60, None: 60, 3: 2, 4: 3}
    cost = lambda w: sum(-(-len(t.split("\n", 1)[1].removesuffix("<|im_end|>\n").encode()) // 4) + 4 for t in w.split("<|im_start|>")[1:])
    sizes = [(r.conv_id, cost(r.formatted)) for r in windows.collect()]
    assert max(x for c, x in sizes if c != 3) <= 512 and sum(x > 512 for _, x in sizes) == 1
    # Windows aren't wasted either: fewer than three times as many as a perfect cut has.
    total = sum(-(-len(t.encode()) // 4) + 4 for c, _, _, t in turns if c == 1)
    assert sum(c == 1 for c, _ in sizes) <= 3 * (1 + total // (512 - 64 - 34))


def test_quality_learns_from_one_row_of_a_document(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i} " * (1 + i % 9)) for i in range(120)] + [(None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1)], "doc_id long, quality int")
    scores = [sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in quality.quality_scores(d, labels).collect()) for d in (docs, docs.orderBy(F.desc("text")).repartition(3))]
    assert scores[0] == scores[1] and len(scores[0]) == 121
    assert all(r.held_out is not None for r in quality.quality_scores(docs, labels).collect())
