"""Importance resampling against a plain version of its rule."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from lucerna.llm import resample

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
DOCS = "doc_id long, text string, rank long, n_words long, key long"


def features(text):
    words = WORD.findall((text or "").encode().translate(LOWER))
    return words, [*words, *(a + b" " + b for a, b in zip(words, words[1:]))]


def plain(docs, targets, percent=25, buckets=10_000, min_words=20):
    """Rows of doc_id, n_features, weight, score and rank."""
    found = [(i, *features(text)) for i, text in docs]
    s = Counter(zlib.crc32(f) % buckets for _, _, fs in found for f in fs)
    t = Counter(zlib.crc32(f) % buckets for text in targets for f in features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, words, fs in found:
        weight = sum(gain[zlib.crc32(f) % buckets] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    may = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def texts(n):
    words = ["the", "of", "Äther", "x1", "and", "Haus", "été", "zzz", "q", "9"]
    out = [" ".join(words[(i * 7 + k * k) % 10] + ("," if k % 3 else "\n") for k in range(i % 60)) for i in range(n)]
    return [*out, None, "", " .,;", "İX ß the THE", "word " * 4000, "a" * 20_000 + " b c " + "d" * 9000, "the of " * 30, "the of " * 30]


@pytest.mark.parametrize("block_bytes", [resample.BLOCK_BYTES, 700])
def test_equals_the_rule(spark, block_bytes):
    docs = list(enumerate(texts(200)))
    targets = ["the of and", None, "Äther x1 x1", "the of and"]
    df = spark.createDataFrame([(i, text, 1, 2, 3) for i, text in docs], DOCS).repartition(5)
    wanted = spark.createDataFrame([(t,) for t in targets], "text string")
    got = resample.resampled(df, wanted, block_bytes=block_bytes)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(docs, targets)


def test_awkward_tables(spark):
    wanted = spark.createDataFrame([("the of",)], "text string")
    long = " ".join(["one two three four five"] * 5)
    # Repeated ids, repeated rows and ids that are null stay rows of their own; ties in all they have draw as many as the quota.
    rows = [(1, long), (1, long), (1, "other"), (None, long), (None, long), (None, None)]
    got = resample.resampled(spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], DOCS), wanted, percent=50).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted((r[:4] for r in plain(rows, ["the of"], 50)), key=repr)
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2]
    empty = spark.createDataFrame([], DOCS)
    assert resample.resampled(empty, wanted).count() == 0
    no_target = resample.resampled(spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], DOCS), wanted.limit(0)).collect()
    assert sorted((tuple(r)[:4] for r in no_target), key=repr) == sorted((r[:4] for r in plain(rows, [])), key=repr)


def test_blocks_cut_between_words_and_add_up():
    import numpy as np
    import pyarrow as pa

    text = "ab cd " * 50 + "e" * 300 + " f, g" + "." * 100 + "h i"
    for limit in (1, 5, 7, 64, 10_000):
        found, words = Counter(), 0
        for _, _, data, offsets, goes_on in resample.blocks_of(pa.array([text]), limit):
            c = resample.block_counts(data, offsets, goes_on)
            words += int(c["words"].sum())
            if c["n"]:
                known = c["known"].to_pylist()
                for a, b, n in zip(c["one"], c["two"], c["total"], strict=True):
                    found[known[a] + (b" " + known[b] if b >= 0 else b"")] += int(n)
        assert found == Counter(features(text)[1]) and words == len(features(text)[0])
    assert np.array_equal(resample.ranges(np.array([3, 10]), np.array([2, 3])), [3, 4, 10, 11, 12])
