"""The codec's unigram branch, on models written here as protobuf bytes, against the sentencepiece library."""

import random
import struct

import pytest

from lucerna.llm import piece_codec
from lucerna.llm.pieces import read_model, safe_to_cut

PIECES = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
WORDS = ["▁", "▁the", "▁t", "he", "▁cat", "▁c", "at", "a", "b", "c", "e", "h", "t", "s", "▁s", "at▁", "ing", "i", "n", "g", "▁▁", ".", "é"]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(int(value))


def model_bytes(byte_fallback, squeeze, prefix=True):
    pieces = list(PIECES)
    if byte_fallback:
        pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [(w, -1.0 - 0.37 * k % 7 - 0.01 * k, 1) for k, w in enumerate(WORDS)]
    out = b"".join(field(1, field(1, text.encode()) + field(2, score) + field(3, kind)) for text, score, kind in pieces)
    trainer = field(3, 1) + field(4, len(pieces)) + (field(35, 1) if byte_fallback else b"")
    return out + field(2, trainer) + field(3, field(1, b"identity") + field(3, prefix) + field(4, squeeze) + field(5, 1))


@pytest.mark.parametrize(("byte_fallback", "squeeze"), [(True, False), (False, False), (True, True)])
def test_unigram_equals_the_library(tmp_path, byte_fallback, squeeze):
    import sentencepiece

    path = tmp_path / "unigram.model"
    path.write_bytes(model_bytes(byte_fallback, squeeze))
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    codec = piece_codec.PieceCodec(str(path))
    assert read_model(str(path))["kind"] == 1 and not safe_to_cut(codec.model)
    rng = random.Random(3)
    bits = ["the", "cat", " ", "  ", "a", "tab", "sing", "é", ".", "hat", "\n"] + (["z", "😀"] if byte_fallback else [])
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    if not byte_fallback:
        texts = [t.replace("\n", "") or "a" for t in texts]
    want = library.encode(texts)
    same = [a == b for a, b in zip(codec.encode(texts), want, strict=True)]
    assert all(same), [(t, a, b) for t, a, b in zip(texts, codec.encode(texts), want, strict=True) if a != b][:3]
    assert codec.decode(want) == [library.decode(ids) for ids in want]
