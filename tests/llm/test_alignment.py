"""Token alignment against a plain version: cut at shared ends, count pairs in a dictionary."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lucerna.llm import alignment

tokenizers = pytest.importorskip("public_tokenizers")
A_FILE, B_FILE = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, part long, count long, n_a long"


def byte_of():
    """The byte-level alphabet: printable bytes stand for themselves, all others for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    letters = byte_of()

    def bytes_b(i):
        piece = b.id_to_piece(i)
        found = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
        return bytes([int(found[1], 16)]) if found else piece.replace("▁", " ").encode()

    def spans(parts):
        at, out = 0, []
        for part in parts:
            out.append((at, at + len(part)))
            at += len(part)
        return out

    found, counts = [], Counter()
    for doc_id, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        parts_a, parts_b = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a], [bytes_b(i) for i in ids_b]
        if not text or b"".join(parts_a) != (" " + text).encode() or b"".join(parts_b) != (" " + text).encode():
            ids_a, ids_b, parts_a, parts_b = [], [], [], []
        spans_a, spans_b = spans(parts_a), spans(parts_b)
        links = []
        for x, (s, e) in zip(ids_a, spans_a):
            links += [(x, y) for y, (p, q) in zip(ids_b, spans_b) if p < e and s < q] if len(ids_a) < 3000 else []
        groups = []
        for end in sorted({e for _, e in spans_a} & {e for _, e in spans_b}):
            start = groups[-1][0] if groups else 0
            groups.append((end, ",".join(str(x) for x, (s, e) in zip(ids_a, spans_a) if start <= s and e <= end) + "|" + ",".join(str(x) for x, (s, e) in zip(ids_b, spans_b) if start <= s and e <= end)))
        counts.update(set(links))
        found.append((doc_id, len(ids_a), len(ids_b), [g for _, g in groups], links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return sorted(
        (
            (
                i, na, nb, len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links),
                hashlib.sha256(";".join(groups).encode()).hexdigest() if na else "",
            )
            for i, na, nb, groups, links in found
        ),
        key=repr,
    )


BITS = [
    "a", "the", " ", "  ", "\n", "\n ", "\t", "\r\n", "é", "ß", "</s>", "<0x0A>", "<|endoftext|>", "😀", "12", "\x00", "ing", ".", "'s", " ", "\x1c", "\x85", "　", "Straße", "ción",
]


def random_texts(n):
    rng = random.Random(5)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(1, 14))) for _ in range(n)]


def test_equals_the_rule(spark):
    texts = [None, "", " ", "\n\n", "▁", "a ▁ b", "same text", "same text", *random_texts(500)]
    rows = [*enumerate(texts), (3, "again"), (None, "no id"), (None, None)]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], DOCS)
    want = plain(rows)
    for part_bytes in (alignment.PART_BYTES, 300):
        got = alignment.aligned(df, A_FILE, B_FILE, part_bytes)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert alignment.aligned(spark.createDataFrame([], DOCS), A_FILE, B_FILE).count() == 0
    pairs = alignment.linked_pairs(df, A_FILE, B_FILE).collect()
    assert len({(r.a_id, r.b_id) for r in pairs}) == len(pairs) and max(r["count"] for r in pairs) <= len(rows)


def test_long_texts_are_taken_in_steps(monkeypatch):
    both = alignment.Aligner(A_FILE, B_FILE)
    text = "".join(random_texts(3000)) + "x" * 5000
    sums, digests, pairs = both.documents([text])
    monkeypatch.setattr(alignment, "LONG", 7)
    more, digest, other = both.long_document(text)
    assert np.array_equal(sums[0], more) and digests[0] == digest
    assert all(np.array_equal(x, y) for x, y in zip(pairs[0], other, strict=True))
    assert both.long_document("a ▁ b")[1] == b""


def test_components_are_the_least_groups():
    rng = np.random.default_rng(3)
    for _ in range(50):
        total = int(rng.integers(1, 60))
        ends = [np.unique(np.append(rng.integers(1, total + 1, rng.integers(1, 40)), total)) for _ in range(2)]
        u, v = alignment.overlaps(*ends)
        root = alignment.components(len(ends[0]) + len(ends[1]), u, v + len(ends[0]))
        shared = np.intersect1d(*ends)
        group = np.concatenate([np.searchsorted(shared, e) for e in ends])
        assert len(np.unique(root)) == len(shared)
        assert all(len(np.unique(group[root == r])) == 1 for r in np.unique(root))
    assert np.array_equal(alignment.components(3, np.zeros(0, int), np.zeros(0, int)), [0, 1, 2])
