"""SentencePiece encoding and decoding with the tokenizers library as the backend.

The model's protobuf is read here (see pieces.read_model) and rebuilt as a tokenizers pipeline: the
normaliser (precompiled character map, white space squeeze, dummy prefix, space marker), the model (unigram
scores, or merges in the order of the merged pieces' scores for a BPE model), byte fallback, and the decoder
that undoes all of it. Batches go through encode_batch, whose threads the library manages; a task may set
RAYON_NUM_THREADS. Where the model allows it, texts are cut at safe boundaries and distinct stretches are
encoded once (pieces.StretchCache). Every newly met stretch is also encoded by the sentencepiece library when
`verify` is set, and a text with a stretch on which the two differ has parity false.

Defined results: null and empty texts have no ids and decode to the empty text; U+2581 in a text is a space to
the model and decodes as one, so round_trip compares with that; repeated rows repeat their result; an empty
table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import doc_texts
from .pieces import MARK, StretchCache, byte_slices, joined_stretches, piece_bytes, read_model, safe_to_cut, stretch_ends, stretches

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def merges_by_score(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Every pair of pieces that join to a piece, best score first; among pairs with one score, by ids."""
    ids = {text: i for i, (text, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
    found = [
        (-score, ids[text[:k]], ids[text[k:]], text[:k], text[k:])
        for text, score, kind in pieces
        if kind in (NORMAL, USER)
        for k in range(1, len(text))
        if text[:k] in ids and text[k:] in ids
    ]
    return [(a, b) for *_, a, b in sorted(found)]


def build_tokenizer(model: dict):
    """The tokenizers pipeline that encodes and decodes as the model does."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    pieces = model["pieces"]
    if model["kind"] == 1:
        core = models.Unigram([(text, score) for text, score, _ in pieces], model["unk_id"], model["byte_fallback"])
    elif model["kind"] == 2:
        vocab = {text: i for i, (text, _, _) in enumerate(pieces)}
        core = models.BPE(
            vocab, merges_by_score(pieces), unk_token=pieces[model["unk_id"]][0],
            fuse_unk=True, byte_fallback=model["byte_fallback"],
        )
    else:
        raise ValueError(f"model kind {model['kind']} is neither unigram nor BPE")
    tokenizer = Tokenizer(core)
    steps = []
    if model["charsmap"]:
        steps.append(normalizers.Precompiled(model["charsmap"]))
    if model["squeeze"]:
        # Spaces alone: other white space stays.
        steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model["dummy_prefix"]:
        steps.append(normalizers.Prepend(MARK))
    if model["escape"]:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        tokenizer.normalizer = normalizers.Sequence(steps)
    back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(back + [decoders.Strip(" ", 1, 0)] * model["dummy_prefix"])
    return tokenizer


class PieceCodec:
    """Encoder and decoder of a model file, kept by a Python worker."""

    def __init__(self, path: str, verify: bool = True):
        self.model = read_model(path)
        self.tokenizer = build_tokenizer(self.model)
        self.safe = safe_to_cut(self.model)
        self.cache = StretchCache(self._encode_stretches)
        self.differ: set[str] = set()
        self.library = None
        if verify:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = [text for text, _, _ in self.model["pieces"]]
        plain = [
            bytes([int(text[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else text.replace(MARK, " ").encode()
            for text, (_, _, kind) in zip(texts, self.model["pieces"], strict=True)
        ]
        self.bytes_of = pa.array(plain, pa.large_binary())
        self.sizes = piece_bytes(self.model)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def _encode_stretches(self, missing: list[str]) -> list[bytes]:
        # Joined as in token_count: a letter in front takes the dummy prefix, spaces alone go one by one.
        mark = self.tokenizer.token_to_id(MARK)
        blank = [x for x in missing if not x.strip(" ")]
        found = {x: ids or [mark] for x, ids in zip(blank, self.encode([x[1:] for x in blank]), strict=True)}
        if self.library:
            self.differ.update(x for x in blank if found[x] != (self.library.encode(x[1:]) or [mark]))
        found = {x: np.array(ids, np.int32).tobytes() for x, ids in found.items()}
        several = [x for x in missing if x not in found]
        runs = list(joined_stretches(several))
        texts = ["a" + "".join(run) for run in runs]
        coded = self.encode(texts)
        theirs = self.library.encode(texts, num_threads=1) if self.library else coded
        for run, ids, other in zip(runs, coded, theirs, strict=True):
            ids = np.array(ids, np.int32)
            ends = stretch_ends(self.sizes, ids, run).tolist()
            parts = [ids[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
            found.update(zip(run, parts, strict=True))
            if not np.array_equal(ids, other):
                other = np.array(other, np.int32)
                ends = stretch_ends(self.sizes, other, run).tolist()
                self.differ.update(x for x, part, i, j in zip(run, parts, ends[:-1], ends[1:], strict=True) if part != other[i:j].tobytes())
        return [found[x] for x in missing]

    def encode_texts(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """The ids of each text as int32 bytes, and whether the sentencepiece library gives the same."""
        if not self.safe:
            found = self.encode(texts)
            same = [a == b for a, b in zip(found, self.library.encode(texts), strict=True)] if self.library else [True] * len(texts)
            return [np.array(ids, np.int32).tobytes() for ids in found], same
        parts = [stretches(text) for text in texts]
        known = self.cache.learn(parts)
        same = [self.differ.isdisjoint(part) for part in parts] if self.differ else [True] * len(parts)
        return [b"".join(map(known, part)) for part in parts], same

    def decoded_bytes(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The text of each stretch of ids: the pieces' bytes in a row, less the dummy prefix."""
        joined = self.bytes_of.take(pa.array(ids))
        reached = np.concatenate(([0], np.frombuffer(joined.buffers()[1], np.int64)[1 : len(ids) + 1]))[np.concatenate(([0], ends))]
        data = memoryview(joined.buffers()[2] or b"")
        skip = int(self.model["dummy_prefix"])
        return [bytes(data[min(a + skip, b) : b]) for a, b in zip(reached[:-1], reached[1:], strict=True)]


def encode_documents(docs: DataFrame, model_path: str, verify: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids, parity (equal to the sentencepiece library's ids) and round_trip for every row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model_path, verify)
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_pylist()
            for start, end in byte_slices(sizes):
                texts = batch.column(1).slice(start, end - start).to_pylist()
                coded, parity = codec.encode_texts(texts)
                ends = np.cumsum([len(x) // 4 for x in coded])
                ids = np.frombuffer(b"".join(coded), np.int32)
                decoded = codec.decoded_bytes(ids, ends)
                whole = [a == b.replace(MARK, " ").encode() for a, b in zip(decoded, texts, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, end - start),
                        pa.array(np.diff(ends, prepend=0), pa.int64()), lists, pa.array(parity), pa.array(whole),
                    ],
                    names=["doc_id", "n_tokens", "ids", "parity", "round_trip"],
                )

    return doc_texts(docs).mapInArrow(
        encode, "doc_id long, n_tokens long, ids array<int>, parity boolean, round_trip boolean"
    )


def decode_documents(coded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text for rows of doc_id and ids; null ids decode to the empty text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model_path, verify=False)
        for batch in batches:
            # Slices of rows with about as many ids as SLICE_BYTES has bytes, one row at least.
            for start, end in byte_slices(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_pylist()):
                rows = [x or [] for x in batch.column(1).slice(start, end - start).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.array(codec.decode(rows), pa.string())], names=["doc_id", "text"])

    return coded.selectExpr("cast(doc_id as long) doc_id", "ids").mapInArrow(decode, "doc_id long, text string")
