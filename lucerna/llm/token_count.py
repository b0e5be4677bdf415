"""Token counts: batch encoding inside an Arrow function that returns lengths alone.

Rows are taken in slices of about equal bytes, texts are cut at safe boundaries (see pieces), and each
distinct stretch is encoded once by the sentencepiece library; a text's count is the sum over its stretches.
No token ids leave the function. Memory per task: a slice, its stretches and a cache of bounded size.

Defined results: null and empty texts have no tokens; rows are independent, so repeated rows repeat their
result; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame

from .common import doc_texts
from .pieces import StretchCache, byte_slices, joined_stretches, piece_bytes, read_model, safe_to_cut, stretch_ends, stretches

LIMIT = 4096


def stretch_counter(path: str):
    """A function from texts to token counts, with the library's defaults and no special tokens added."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    model = read_model(path)
    if not safe_to_cut(model):
        return lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)]

    sizes = piece_bytes(model)

    def encode(missing: list[str]) -> list[int]:
        # Stretches are encoded joined, since a call costs more than a short text; where each one's pieces end
        # follows from the pieces' bytes. A letter in front takes the prefix that the library adds.
        # Spaces alone, which others' spaces would join, go one by one.
        found = {x: len(processor.encode(x[1:])) or 1 for x in missing if not x.strip(" ")}
        several = [x for x in missing if x not in found]
        joined = list(joined_stretches(several))
        counts: list[int] = []
        for part, ids in zip(joined, processor.encode(["a" + "".join(x) for x in joined], num_threads=1), strict=True):
            counts.extend(np.diff(stretch_ends(sizes, np.asarray(ids), part)).tolist())
        found.update(zip(several, counts, strict=True))
        return [found[x] for x in missing]

    cache = StretchCache(encode)

    def count(texts: list[str]) -> list[int]:
        parts = [stretches(text) for text in texts]
        known = cache.learn(parts)
        return [sum(map(known, part)) for part in parts]

    return count


def token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row of docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = stretch_counter(model_path)
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1)).to_pylist()
            for start, end in byte_slices(sizes):
                counts = counter(batch.column(1).slice(start, end - start).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, end - start),
                        pa.array(sizes[start:end], pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array([n > limit for n in counts], pa.bool_()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return doc_texts(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
