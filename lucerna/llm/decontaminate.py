"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may occur with up to k = floor(m * error_rate) edits. It is cut into k + 1 pieces; an
occurrence with at most k edits leaves one piece untouched, so exact hits of pieces (one Aho-Corasick
automaton over all items) give every candidate place. Hits that point to the same place are merged, and
Myers' bit-parallel distance of the item against the window around it decides, and gives the end of the best
occurrence. Text is compared in lower case with each white-space character as a space; offsets are those of
the original text.

The benchmark does not grow with the corpus, yet its size is checked: items are taken in blocks of at most
block_chars characters, each block being one pass over the documents. Documents are scanned where they are;
nothing but matches leaves a task.

Defined results: null and empty documents and items match nothing; an item is cut into fewer pieces than
k + 1 only by lowering k so that pieces keep least_piece characters; repeated rows repeat their matches; empty
tables give an empty result; columns other than doc_id and text (item_id and text) are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_texts

ERROR_RATE, LEAST_PIECE, BLOCK_CHARS = 0.07, 8, 4_000_000


def lowered(text: str) -> str:
    """Lower case with white space as spaces, character for character."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for white in "\n\t\r\x0b\x0c":
        if white in low:
            low = low.replace(white, " ")
    return low


class Item:
    """An item's pattern and the masks that Myers' algorithm needs."""

    def __init__(self, item_id: int, text: str, error_rate: float, least_piece: int):
        self.id, self.text = item_id, " ".join(lowered(text).split())
        size = len(self.text)
        self.budget = max(0, min(int(size * error_rate), size // least_piece - 1))
        cuts = [size * i // (self.budget + 1) for i in range(self.budget + 2)]
        self.pieces = [(a, self.text[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.masks: dict[str, int] = {}
        for i, c in enumerate(self.text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i


def best_end(masks: dict[str, int], size: int, window: str) -> tuple[int, int]:
    """(least distance of the pattern to a substring of window, first end where it is reached)."""
    ones, top = (1 << size) - 1, 1 << (size - 1)
    up, down, distance = ones, 0, size
    best, at = size, 0
    for i, c in enumerate(window, 1):
        eq = masks.get(c, 0)
        cross = (((eq & up) + up) ^ up) | eq | down
        gain = down | (~(cross | up) & ones)
        loss = up & cross
        if gain & top:
            distance += 1
        elif loss & top:
            distance -= 1
        gain, loss = (gain << 1) & ones, (loss << 1) & ones
        vertical = eq | down
        up = loss | (~(vertical | gain) & ones)
        down = gain & vertical
        if distance < best:
            best, at = distance, i
    return best, at


class Matcher:
    """Finds the items of a block in texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, least_piece: int):
        import ahocorasick

        self.items = [x for x in (Item(i, t, error_rate, least_piece) for i, t in items if t) if x.text]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(self.items):
            for at, piece in item.pieces:
                places.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, distance) of the best occurrence of each item that occurs within its budget."""
        if not self.items or not text:
            return []
        low = lowered(text)
        spots: dict[int, set[int]] = {}
        for end, (size, found) in self.automaton.iter(low):
            for n, at in found:
                spots.setdefault(n, set()).add(end + 1 - size - at)
        out = []
        for n, starts in spots.items():
            item = self.items[n]
            size, slack = len(item.text), item.budget
            best = None
            reach = -1
            for start in sorted(starts):
                if best and best[2] == 0 or start + slack <= reach:
                    continue
                # One window serves all starts within the budget of its first.
                reach = start + 2 * slack
                low_end, high_end = max(0, start - slack), start + size + 3 * slack + 1
                distance, stop = best_end(item.masks, size, low[low_end:high_end])
                if distance <= slack and (best is None or distance < best[2]):
                    best = (low_end, low_end + stop, distance)
            if best:
                low_end, stop, distance = best
                # The start: the same search backwards from the end.
                back = low[max(0, stop - size - slack) : stop][::-1]
                masks: dict[str, int] = {}
                for i, c in enumerate(reversed(item.text)):
                    masks[c] = masks.get(c, 0) | 1 << i
                _, length = best_end(masks, size, back)
                out.append((item.id, stop - length, stop, distance))
        return sorted(out)


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of about block_chars characters, by item_id; one block is on the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("text <> ''")
    block: list[tuple[int, str]] = []
    chars = 0
    for row in items.orderBy("item_id").toLocalIterator():
        block.append((row.item_id, row.text))
        chars += len(row.text)
        if chars >= block_chars:
            yield block
            block, chars = [], 0
    if block:
        yield block


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, least_piece: int = LEAST_PIECE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """doc_id, item_id, start, end and distance of each item's best occurrence in each document."""
    texts = doc_texts(docs)
    found = None
    for items in item_blocks(benchmark, block_chars):

        def match(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, error_rate, least_piece)
            for batch in batches:
                rows = [
                    (doc_id.as_py(), *hit)
                    for doc_id, text in zip(batch.column(0), batch.column(1), strict=True)
                    for hit in matcher.find(text.as_py())
                ]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()], strict=True)],
                    names=["doc_id", "item_id", "start", "end", "distance"],
                )

        schema = "doc_id long, item_id long, start int, `end` int, distance int"
        part = texts.mapInArrow(match, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start int, `end` int, distance int")
    return found


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, least_piece: int = LEAST_PIECE) -> DataFrame:
    """The rows of docs, all columns, that hold no item; decided on each row's own text, so no row moves."""
    for items in item_blocks(benchmark):

        @F.pandas_udf("boolean")
        def clean(texts, items=items):
            key = (hash(tuple(items)), error_rate, least_piece)
            if key not in _matchers:
                _matchers.clear()
                _matchers[key] = Matcher(items, error_rate, least_piece)
            find = _matchers[key].find
            return texts.map(lambda t: not find(t or ""))

        docs = docs.where(clean(F.coalesce("text", F.lit(""))))
    return docs


_matchers: dict[tuple, Matcher] = {}
