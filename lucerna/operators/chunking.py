"""Chunkers. Boundaries that depend on the chunk before are found per page in Python; fixed steps stay columns.

A page is the unit: its chunks are an array that an Arrow function gives for SLICE pages at a time, so no rows of a document are gathered,
a long document costs its own length only, and a task's Python holds a batch of texts and the chunks of one slice. Chunk numbers run over a document's pages by a prefix sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.text import normalize, strip, zone
from ..session import DEFAULTS

PIECES = "array<struct<start:int,text:string,zone:string>>"
LOOKBACK = 64
SLICE = 64
Piece = tuple[int, str, str | None]


def _piece(text: str, start: int, end: int, kind: str | None = None) -> list[Piece]:
    """The stretch without outer white space, at its first solid character."""
    part = text[start:end]
    solid = part.strip()
    return [(start + len(part) - len(part.lstrip()), solid, kind)] if solid else []


def _word_start(text: str, start: int, covered: int) -> int:
    """Past the rest of a word that the window before holds whole."""
    at = start
    while at < covered and not text[at].isspace():
        at += 1
    return at + 1 if at < len(text) and text[at].isspace() and at > start else start


def _word_end(text: str, start: int, end: int, reach: int) -> int:
    """Back to the last white space within reach, or where it was."""
    spaces = [i for i in range(max(start, end - reach), end) if text[i].isspace()]
    return spaces[-1] if spaces and not text[end].isspace() else end


def sliding(text: str, size: int, overlap: int) -> list[Piece]:
    """CHK-01: windows whose edges keep to words where the overlap allows it."""
    out: list[Piece] = []
    step = size - overlap if size > overlap else max(1, size)
    start, covered = 0, None
    while start < len(text):
        if covered is not None and start < covered:
            start = _word_start(text, start, covered)
        if start >= len(text):
            break
        end = min(start + size, len(text))
        if end < len(text):
            end = _word_end(text, start, end, min(LOOKBACK, overlap))
        out += _piece(text, start, end)
        if end >= len(text):
            break
        covered = end
        start += step
    return out


def progressive(text: str, size: int, overlap: int) -> list[Piece]:
    """CHK-03: windows that grow from half the size to the whole, over the page."""
    out: list[Piece] = []
    start = 0
    while start < len(text):
        window = int(size * (0.5 + 0.5 * start / len(text)))
        end = min(start + window, len(text))
        out += _piece(text, start, end)
        if end >= len(text):
            break
        start += window - overlap if window > overlap else max(1, window)
    return out


def _sections(text: str) -> list[tuple[int, int]]:
    """Stretches that begin at a heading line: one with a # in front, or short and all upper case."""
    cuts, at, filled = [0], 0, False
    for line in text.split("\n"):
        head = line.strip()
        if (head.startswith("#") or (len(head) < 100 and head.isupper())) and filled:
            cuts.append(at)
        filled = True
        at += len(line) + 1
    return list(zip(cuts, [*(c - 1 for c in cuts[1:]), len(text)], strict=True))


def semantic(text: str, size: int, overlap: int) -> list[Piece]:
    """CHK-02: sections, each through the sliding chunker."""
    return [(a + start, piece, kind) for a, b in _sections(text) for start, piece, kind in _inner(text[a:b], size, overlap)]


def _inner(part: str, size: int, overlap: int) -> list[Piece]:
    # A part is normalised again before it is cut, which takes its outer white space: offsets count from there.
    return sliding(part.strip(), size, overlap)


def layout(text: str, size: int, overlap: int) -> list[Piece]:
    """CHK-04: runs of lines of one kind (see line_blocks), each through the sliding chunker; blank lines join the run before."""
    runs: list[list] = []
    at = 0
    for line in text.split("\n"):
        end, solid = at + len(line), line.strip()
        columns = "|" in solid or (len(solid) > 20 and solid.count(" ") > 3)
        if runs and (not solid or runs[-1][0] == columns):
            runs[-1][2] = end
        elif solid:
            runs.append([columns, at, end])
        at = end + 1
    return [(a + start, piece, "table" if columns else None) for columns, a, b in runs for start, piece, _ in _inner(text[a:b], size, overlap)]


STRATEGIES: dict[str, Callable[[str, int, int], list[Piece]]] = {
    "sliding_window": sliding, "semantic": semantic, "progressive": progressive, "layout_aware": layout,
}


def register_strategy(name: str, strategy: Callable[[str, int, int], list[Piece]]) -> None:
    """UDF-01: any function of (text, size, overlap)."""
    STRATEGIES[name] = strategy


def chunk_pages(
    pages: DataFrame, strategy: str = "sliding_window", size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap
) -> DataFrame:
    """CHK-05: doc_id, page, chunk_index, character_offset, zone and text, with the page's other columns.

    An unknown strategy is the sliding window.
    """
    cut = STRATEGIES.get(strategy, sliding)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                *others, texts = batch.slice(at, SLICE).columns
                found = [cut(text, size, overlap) for text in texts.to_pylist()]
                parts = [piece for some in found for piece in some]
                each = [pa.array([x[i] for x in parts], kind) for i, kind in enumerate((pa.int32(), pa.string(), pa.string()))]
                ends = pa.array([0, *accumulate(map(len, found))], pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(each, names=["start", "text", "zone"]))
                yield pa.RecordBatch.from_arrays([*others, lists], names=[*batch.schema.names[:-1], "_pieces"])

    kept = [c for c in pages.columns if c not in ("doc_id", "page", "text")]
    held = pages.select("doc_id", "page", *kept)
    cutup = pages.select("doc_id", "page", *kept, normalize(F.col("text")).alias("_text"))
    cutup = cutup.mapInArrow(pieces, T.StructType([*held.schema.fields, T.StructField("_pieces", T.DataType.fromDDL(PIECES))]))
    before = W.partitionBy("doc_id").orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    cutup = cutup.withColumn("_before", F.coalesce(F.sum(F.size("_pieces")).over(before), F.lit(0)))
    rows = cutup.select("doc_id", "page", *kept, "_before", F.posexplode("_pieces").alias("_at", "_piece"))
    return rows.select(
        "doc_id", "page", (F.col("_before") + F.col("_at")).cast("int").alias("chunk_index"),
        F.col("_piece.start").alias("character_offset"),
        F.coalesce(F.col("_piece.zone"), zone(F.col("_piece.text"), F.col("page"))).alias("zone"),
        F.col("_piece.text").alias("text"), *kept,
    )


def register_chunker(spark: SparkSession, name: str, strategy: Callable[[str, int, int], list[Piece]]) -> None:
    """UDF-01: a strategy as a table function, for SQL: `SELECT ... FROM pages, LATERAL name(text, 512, 64)`.

    Its rows are chunk_no (from 0), character_offset, zone (null where the strategy names none) and text. Size and overlap must be
    constants, size above zero: the query is refused otherwise before it runs. A null text has no chunks.
    """
    result = T.StructType().add("chunk_no", T.IntegerType()).add("character_offset", T.IntegerType()).add("zone", T.StringType()).add("text", T.StringType())

    class Chunker:
        @staticmethod
        def analyze(text: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
            if not isinstance(text.dataType, T.StringType):
                raise ValueError(f"{name}: text must be a string")
            for label, argument, least in (("size", size, 1), ("overlap", overlap, 0)):
                if not argument.isConstantExpression or not isinstance(argument.value, int) or argument.value < least:
                    raise ValueError(f"{name}: {label} must be a constant of {least} or more")
            return AnalyzeResult(schema=result)

        def eval(self, text, size, overlap):
            for number, (start, piece, zone_name) in enumerate(strategy(text, size, overlap) if text is not None else ()):
                yield number, start, zone_name, piece

    spark.udtf.register(name, F.udtf(Chunker))


def fixed_chunks(docs: DataFrame, text: Column, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap) -> DataFrame:
    """CHK-01b: windows at fixed steps, without regard to words: columns alone."""
    step = size - overlap if size > overlap else max(1, size)
    last = F.greatest(F.floor((F.length("_text") - overlap - 1) / step), F.lit(0)) * step
    rows = docs.withColumn("_text", text).where(F.length("_text") > 0)
    rows = rows.select("*", F.posexplode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"), F.lit(step).cast("bigint"))).alias("chunk_index", "_start"))
    piece = F.substring(F.col("_text"), (F.col("_start") + 1).cast("int"), F.lit(size))
    return rows.withColumn("chunk", piece).withColumn("character_offset", F.col("_start").cast("int")).drop("_text", "_start")


def line_blocks(docs: DataFrame) -> DataFrame:
    """CHK-04's blocks as gaps and islands over lines: doc_id, block, kind, first_line, lines."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "said"))
    solid = strip(F.col("said"))
    spaces = F.length(solid) - F.length(F.replace(solid, F.lit(" "), F.lit("")))
    kind = F.when(F.col("said").contains("|") | ((F.length(solid) > 20) & (spaces > 3)), "table").otherwise("text")
    solid_lines = lines.where(solid != "").withColumn("kind", kind)
    order = W.partitionBy("doc_id").orderBy("line")
    begins = solid_lines.withColumn("begins", (F.lag("kind").over(order).isNull() | (F.lag("kind").over(order) != F.col("kind"))).cast("int"))
    numbered = begins.withColumn("block", F.sum("begins").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "block", "kind").agg(F.min("line").alias("first_line"), F.count(F.lit(1)).alias("lines"))
