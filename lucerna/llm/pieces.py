"""Safe boundaries in texts for SentencePiece models.

A model whose pieces hold the space marker at their start only, and no line feed inside a longer piece, can
not join characters across (non-space, space) or before a line feed. Texts are cut there, so that long texts
cost no more for each byte than short ones and each distinct stretch is encoded once while it stays in the
cache. `safe_to_cut` checks the model's pieces; without that property a text is one stretch.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np

MARK = "▁"
STRETCH = re.compile(r"\n[^ \n]*| +[^ \n]*")
#: Bytes of text handled at once; memory that the cache of stretches may take, and what an entry costs besides its characters.
SLICE_BYTES, CACHE_BYTES, ENTRY_BYTES = 1 << 20, 32 << 20, 240
#: A stretch without spaces longer than this is not kept.
LONGEST_KEPT = 64


def proto_fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message: ints, floats and byte strings."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
        elif wire == 5:
            yield number, struct.unpack_from("<f", data, at)[0]
            at += 4
        elif wire == 1:
            yield number, struct.unpack_from("<d", data, at)[0]
            at += 8
        elif wire == 2:
            size = varint()
            yield number, data[at : at + size]
            at += size
        else:
            raise ValueError(f"unknown wire type {wire}")


def read_model(path: str) -> dict:
    """Pieces (text, score, kind), model kind, and what the normaliser does."""
    with open(path, "rb") as file:
        data = file.read()
    model = {"pieces": [], "kind": 1, "byte_fallback": False, "charsmap": b"", "dummy_prefix": True, "squeeze": True, "escape": True, "unk_id": 0}
    for number, value in proto_fields(data):
        if number == 1:
            piece = dict(proto_fields(value))
            model["pieces"].append((piece[1].decode("utf-8"), piece.get(2, 0.0), piece.get(3, 1)))
        elif number == 2:
            spec = dict(proto_fields(value))
            model["kind"] = spec.get(3, 1)
            model["byte_fallback"] = bool(spec.get(35, 0))
            model["unk_id"] = spec.get(40, 0)
            model["suffix"] = bool(spec.get(24, 0))
        elif number == 3:
            spec = dict(proto_fields(value))
            model["charsmap"] = spec.get(2, b"")
            model["dummy_prefix"], model["squeeze"], model["escape"] = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    return model


def safe_to_cut(model: dict) -> bool:
    """Whether the boundaries of STRETCH hold for this model: identity normaliser, marker in front, no line feed."""
    return (
        not model["charsmap"] and model["dummy_prefix"] and not model["squeeze"] and model["escape"]
        and not model.get("suffix") and model["byte_fallback"]
        and not any(MARK in text.lstrip(MARK) or "\n" in text for text, _, kind in model["pieces"] if kind != 6)
        and not any(kind == 4 for _, _, kind in model["pieces"])
    )


def stretches(text: str) -> list[str]:
    """Stretches of the text with the dummy prefix in front; their concatenation is that text."""
    return STRETCH.findall(" " + text.replace(MARK, " ")) if text else []


def piece_bytes(model: dict) -> np.ndarray:
    """Bytes of text that each piece stands for, by id."""
    return np.array([1 if kind == 6 else len(text.replace(MARK, " ").encode()) for text, _, kind in model["pieces"]], np.int64)


def joined_stretches(items: list[str], limit: int = 8192) -> Iterator[list[str]]:
    """Runs of stretches with about limit characters together."""
    run: list[str] = []
    total = 0
    for item in items:
        run.append(item)
        total += len(item)
        if total >= limit:
            yield run
            run, total = [], 0
    if run:
        yield run


def stretch_ends(sizes: np.ndarray, ids: np.ndarray, run: list[str]) -> np.ndarray:
    """How many of the ids lie before each stretch's start, and all: ids encode a marked `a`, then the run."""
    reached = np.cumsum(sizes[ids])
    ends = 2 + np.concatenate(([0], np.cumsum([len(x.encode("utf-8", "surrogatepass")) for x in run])))
    at = np.searchsorted(reached, ends)
    if reached[-1] != ends[-1] or (reached[at] != ends).any():
        raise ValueError("a piece crosses a boundary that the model's pieces rule out")
    return at + 1


class StretchCache:
    """What a function gives for stretches. Two generations: when the newer has half of the memory bound, the older is forgotten."""

    def __init__(self, encode: Callable[[list[str]], Iterable], cache_bytes: int = CACHE_BYTES, entry_bytes: int = ENTRY_BYTES):
        self.encode, self.now, self.old, self.size, self.once = encode, {}, {}, 0, []
        self.cache_bytes, self.entry_bytes = cache_bytes, entry_bytes

    def learn(self, lists: list[list[str]]) -> Callable[[str], object]:
        """What finds any stretch of the lists, until the next call."""
        for stretch in self.once:
            self.now.pop(stretch, None)
        if self.size > self.cache_bytes // 2:
            self.now, self.old, self.size = {}, self.now, 0
        wanted = set().union(*lists).difference(self.now)
        known = wanted.intersection(self.old) if self.old else set()
        self.now.update((x, self.old[x]) for x in known)
        missing = list(wanted - known)
        self.now.update(zip(missing, self.encode(missing), strict=True))
        self.once = [x for x in missing if len(x) > LONGEST_KEPT]
        self.size += 2 * sum(map(len, wanted)) + self.entry_bytes * len(wanted)
        return self.now.__getitem__


def byte_slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about limit bytes each, one row at least."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
