"""Near-duplicate join on word shingles: Jaccard similarity, exact, with count-vector R-trees.

Two documents link when 100 * |A and B| >= percent * |A or B|, A and B their sets of distinct five-word
shingles. The result is every document's component under these links. Steps:

1. Sets. One pass gives each document its set's size and a 128-bit digest of the set. Documents with equal
   sets are one class; its smallest doc_id stands for it, so copies cost an aggregate.
2. Prefixes. Linked sets share one of the first |A| - ceil(t |A|) + 1 shingles of any fixed order. The order
   is by hash, but shingles that very many documents share come last, the commoner the later, so that
   boilerplate and common passages don't bring documents together. Which are common is found in step 1: each slice reports what it
   saw often; what reaches the share SHARE of all shingles in sum counts as common, which at most 1/SHARE
   shingles do. The order decides the cost, never the result.
3. Candidates. Classes that share a prefix shingle form a block. Shingles are hashed into groups, the more the
   larger the set, and a set's counts per group are a point. The overlap of two sets is at most the sum over groups of the smaller
   count. Each block is searched through an R-tree over its points, whose nodes carry per-group maxima, so the
   same sum bounds the overlap of whole subtrees. Blocks with one and the same membership are searched once.
   What passes the bound gives the edges of a spanning forest of candidates; the members of a block too large
   for one task all become candidates of one another, by a star.
4. Verification. Components of candidates bring the texts of their classes together, in tiles of bounded
   size; inside a tile an R-tree over the same points proposes pairs and the sets decide. Pairs already
   connected aren't compared, so near copies in thousands cost about a comparison each. Between tiles of one
   candidate component, members outside its largest verified component are compared with every tile of sizes that fit.
5. Components of the verified links are the result.

Every pair that could link is either compared or already connected, so no link between components is lost.

Defined results: a document without words, or null, has size 0 and is its own component; with one to four
words its whole sequence is its only shingle; repeated rows stay one row each; rows that share a doc_id but not
the text get each their own text's size and component; a null doc_id comes after all others (a component of such rows alone has a null
component_id); an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, doc_texts, maybe_among, without_rows
from .words import mix, shingle_hashes, slices

SIZE, PERCENT = 5, 75
#: Groups that a tree stands over; the largest count that travels; the largest set that FULL in every group still bounds.
GROUPS, FULL, FITS = 64, 255, 65_535
#: A shingle with this share of all shingles is common; a slice reports a shingle that it met so often, at least.
SHARE, LEAST_REPORT, LEAST_COMMON = 1e-5, 3, 200
#: Shingle hashes in a tile of verification.
TILE = 1 << 20
#: Members of a block that one task searches.
BLOCK = 4096
LEAF, FANOUT, WIDEST = 32, 8, 4096
#: Ratio of the sizes at the ends of a bucket of sizes.
STEP = 1.1


def distinct_per_row(texts: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row of a slice)."""
    for start, end, words in slices(pc.fill_null(texts, "")):
        hashes, rows = shingle_hashes(words, size)
        at = np.searchsorted(rows, np.arange(end - start + 1))
        yield start, [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def digest_of(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over the set, as signed numbers."""
    low = mix(hashes).sum(dtype=np.uint64)
    high = mix(hashes ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(low.astype(np.int64)), int(high.astype(np.int64))


def counts_of(hashes: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """How many of the set's shingles fall into each group; groups is a power of two, fewer groups are sums of more."""
    return np.bincount(((hashes >> np.uint64(17)) & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.int32)


def folded(points: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Points over `groups` groups from points over a multiple of that."""
    return points.reshape(len(points), -1, groups).sum(1, dtype=np.int32)


def needed(a, b, percent: int):
    """The least overlap of linked sets of sizes a and b; none is asked for where neither's counts are kept exactly."""
    return np.where(np.minimum(a, b) > FITS, 0, -(-(a + b) * percent // (100 + percent)))


def width(n: float, each: int = 4) -> int:
    """Groups for sets of about n shingles: `each` shingles a group, so that the bound tells apart sets of any size."""
    return int(np.clip(1 << int(np.ceil(np.log2(max(1.0, n / each)))), GROUPS, WIDEST))


def packed(hashes: np.ndarray) -> bytes:
    """A point in 8-bit counts, eight shingles a group: what travels with every block that a set is in.

    A set whose counts don't fit counts as having every group full, which no bound rules out.
    """
    counts = counts_of(hashes, width(len(hashes), 8))
    return (counts if counts.max(initial=0) <= FULL else np.full(len(counts), FULL)).astype(np.uint8).tobytes()


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


class CountTree:
    """R-tree over count vectors: leaves of LEAF points, nodes with per-group maxima and the range of sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, cluster: np.ndarray | None = None):
        # Packed by what brings alike points together (such as a set's least hash), else by size, so that leaves
        # are tight. The tree stands over GROUPS groups; finer points sharpen the bound of what it finds.
        order = np.argsort(sizes, kind="stable")
        if cluster is not None:
            order = order[np.argsort(cluster[order], kind="stable")]
        self.fine = points[order] if points.shape[1] > GROUPS else None
        points = folded(points) if points.shape[1] > GROUPS else points
        self.order = order
        self.points, self.sizes = points[order], sizes[order]
        self.levels = []
        top, low, high = self.points, self.sizes, self.sizes
        width = LEAF
        while len(top) > 1:
            at = np.arange(0, len(top), width)
            top = np.maximum.reduceat(top, at)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((width, top, low, high))
            width = FANOUT

    def near(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Indices of the points whose overlap with this one may suffice."""
        fine = point
        point = folded(point[None])[0] if len(point) > GROUPS else point
        live = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            width, top, low, high = self.levels[level]
            bound = np.minimum(top[live], point).sum(1)
            # The least overlap that any size in the node's range asks for.
            live = live[(bound >= needed(size, low[live], percent)) & (high[live] * 100 >= size * percent)]
            below = len(self.levels[level - 1][1]) if level else len(self.points)
            live = (live[:, None] * width + np.arange(width)).ravel()
            live = live[live < below]
        bound = np.minimum(self.points[live], point).sum(1)
        live = live[bound >= needed(size, self.sizes[live], percent)]
        if self.fine is not None and len(live):
            bound = np.minimum(self.fine[live], fine).sum(1)
            live = live[bound >= needed(size, self.sizes[live], percent)]
        return self.order[live]


def linked_pairs(
    points: np.ndarray, sizes: np.ndarray, percent: int, same: Callable[[int, int], bool], labels: np.ndarray, asks: np.ndarray,
    homes: np.ndarray, cluster: np.ndarray | None = None,
) -> list[tuple[int, int]]:
    """Edges that connect what `same` connects: of each point that asks, with all points at home of other labels.

    A pair whose ends are connected already is not compared; what isn't compared can't add a connection.
    """
    n = len(sizes)
    if n == 2:
        meet = labels[0] != labels[1] and ((asks[0] and homes[1]) or (asks[1] and homes[0]))
        if not meet or np.minimum(points[0], points[1]).sum() < needed(sizes[0], sizes[1], percent):
            return []
        return [(0, 1)] if same(0, 1) else []
    home = np.flatnonzero(homes)
    if not len(home):
        return []
    tree = CountTree(points[home], sizes[home], None if cluster is None else cluster[home])
    of = np.unique(labels, return_inverse=True)[1]
    edges = []
    for i in np.flatnonzero(asks).tolist():
        near = home[tree.near(points[i], int(sizes[i]), percent)]
        # Of two points at home that both ask, the later one asks the earlier.
        near = near[(of[near] != of[i]) & ((near < i) | ~asks[near] | ~homes[i])]
        at = 0
        while at < len(near):
            j = int(near[at])
            at += 1
            if same(i, j):
                edges.append((i, j))
                of[of == of[j]] = of[i]
                near, at = near[at:][of[near[at:]] != of[i]], 0
    return edges


def document_sets(docs: DataFrame, size: int) -> DataFrame:
    """Rows of two kinds: doc_id, n, d1, d2 and counts of each document; n = -1: common shingle d1, met d2 times."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start, sets in distinct_per_row(batch.column(1), size):
                digests = [digest_of(s) for s in sets]
                rows = [
                    ids[start : start + len(sets)], [len(s) for s in sets], [d[0] for d in digests], [d[1] for d in digests],
                    [packed(s) for s in sets],
                ]
                every = np.sort(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
                if len(every):
                    at = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
                    times = np.diff(np.append(at, len(every)))
                    often = np.flatnonzero(times >= max(LEAST_REPORT, SHARE * len(every)))
                    rows = [
                        rows[0] + [-1] * len(often), rows[1] + [-1] * len(often), rows[2] + every[at[often]].view(np.int64).tolist(),
                        rows[3] + times[often].tolist(), rows[4] + [None] * len(often),
                    ]
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["doc_id", "n", "d1", "d2", "counts"])

    return doc_texts(docs).mapInArrow(read, "doc_id long, n long, d1 long, d2 long, counts binary")


def prefix_rows(docs: DataFrame, common: np.ndarray, times: np.ndarray, size: int, percent: int) -> DataFrame:
    """shingle, node (its set's digest) and whether the shingle is common, for each document's prefix."""
    shared = docs.sparkSession.sparkContext.broadcast((common, times))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, times = shared.value
        for batch in batches:
            for _, sets in distinct_per_row(batch.column(1), size):
                keys, nodes, often = [], [], []
                for s in sets:
                    if not len(s):
                        continue
                    length = prefix_length(len(s), percent)
                    many = 0
                    s_first = s[:length]
                    if len(common):
                        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                        found = common[at] == s
                        rare = s[~found]
                        many = max(0, length - len(rare))
                        late = s[found][np.argsort(times[at[found]], kind="stable")]
                        s_first = np.concatenate((rare[:length], late[:many]))
                    keys.append(s_first)
                    nodes.append(np.full(length, digest_of(s)[0], np.int64))
                    often.append(np.arange(length) >= length - many)
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(often))],
                        names=["shingle", "node", "common"],
                    )

    return doc_texts(docs).mapInArrow(emit, "shingle long, node long, common boolean")


def memberships(rows: DataFrame) -> DataFrame:
    """block and node of the blocks with two nodes or more, one block for each distinct membership of a partition.

    A block's number is a hash over its members, so blocks that other partitions found too fall together.
    """

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        keys, nodes = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
        keys, nodes = keys[fresh], nodes[fresh]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(first, len(keys)))
        blocks = mix(np.add.reduceat(mix(nodes.view(np.uint64)), first) + sizes.astype(np.uint64)).view(np.int64)
        _, at = np.unique(blocks, return_index=True)
        at = at[sizes[at] > 1]
        size = sizes[at]
        take = np.repeat(first[at] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        for a in range(0, len(take), 1 << 16):
            part = take[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(blocks[at], size)[a : a + (1 << 16)]), pa.array(nodes[part])], names=["block", "node"]
            )

    return rows.mapInArrow(group, "block long, node long")


def spread(df: DataFrame) -> int:
    """Partitions for steps whose work is not in their bytes: a fixed number, which adaptive execution doesn't merge."""
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def key_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of a partition that share the first column, which the partition is sorted by."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and held[0].column(0)[0].as_py() != keys[a].item():
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def candidate_edges(blocks: DataFrame, percent: int) -> DataFrame:
    """a and b: edges of a spanning forest of what passes the count bound within each block (block, node, n, counts)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for rows in key_groups(batches):
            nodes, at = np.unique(rows.column(1).to_numpy(), return_index=True)
            if len(nodes) < 2:
                continue
            sizes = rows.column(2).to_numpy()[at]
            packs = [np.frombuffer(x, np.uint8) for x in rows.column(3).take(pa.array(at)).to_pylist()]
            widths = np.array([len(x) for x in packs])
            # Sets that can link have equal or neighbouring widths: each width asks itself and the next.
            for w in np.unique(widths).tolist():
                part = np.flatnonzero((widths == w) | (widths == 2 * w))
                if len(part) < 2:
                    continue
                points = np.vstack([folded(packs[i][None], w) for i in part])
                found = linked_pairs(
                    points, sizes[part], percent, lambda i, j: True, np.arange(len(part)), widths[part] == w, np.ones(len(part), bool)
                )
                out.extend((int(nodes[part[i]]), int(nodes[part[j]])) for i, j in found)
            if len(out) > 1 << 15:
                yield edge_batch(out)
                out = []
        yield edge_batch(out)

    return blocks.repartition(spread(blocks), "block").sortWithinPartitions("block").select("block", "node", "n", "counts").mapInArrow(search, "a long, b long")


def edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])


def verified_edges(members: DataFrame, size: int, percent: int) -> DataFrame:
    """a and b: edges that connect what links inside each tile (tile, doc_id, d1, label, asks, home, text)."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in key_groups(batches):
            if rows.num_rows < 2:
                continue
            rows = rows.combine_chunks()
            texts = rows.column(6).chunk(0)
            sets = [s for _, part in distinct_per_row(texts, size) for s in part]
            # A doc_id that has several texts brings them all; the one with the class's digest counts, repeats are one.
            node = rows.column(2).to_pylist()
            at = list({d: i for i, (s, d) in enumerate(zip(sets, node, strict=True)) if len(s) and digest_of(s)[0] == d}.values())
            if len(at) < 2:
                continue
            rows, sets = rows.take(pa.array(at)), [sets[i] for i in at]
            ids = rows.column(2).to_pylist()
            sizes = np.array([len(s) for s in sets], np.int64)
            groups = width(sizes.mean())
            points = np.vstack([counts_of(s, groups) for s in sets])

            def same(i: int, j: int, sets=sets, sizes=sizes) -> bool:
                both = np.concatenate((sets[i], sets[j]))
                both.sort()
                overlap = int((both[1:] == both[:-1]).sum())
                return 100 * overlap >= percent * int(sizes[i] + sizes[j] - overlap)

            labels = rows.column(3).to_numpy()
            asks, homes = (rows.column(k).to_numpy() for k in (4, 5))
            found = linked_pairs(points, sizes, percent, same, labels, asks, homes, np.array([s[0] for s in sets]))
            yield edge_batch([(ids[i], ids[j]) for i, j in found])

    ready = members.repartition(spread(members), "tile").sortWithinPartitions("tile").select("tile", "doc_id", "d1", "label", "asks", "home", "text")
    return ready.mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (smallest doc_id with an equal set) and digest of the set, for every row of docs."""
    read = cut(document_sets(docs, size))
    sets = read.where("n >= 0")
    reports = read.where("n = -1")
    total = sets.agg(F.sum("n")).first()[0] or 0
    # At most 1 / SHARE shingles reach this share of all: the list that is broadcast has a bound.
    often = reports.groupBy("d1").agg(F.sum("d2").alias("times")).where(F.col("times") >= max(LEAST_COMMON, SHARE * total))
    rows = often.collect()
    common, times = np.array([r.d1 for r in rows], np.int64).view(np.uint64), np.array([r.times for r in rows], np.float64)
    order = np.argsort(common)
    # The commoner, the later; by powers of two, and by hash within one.
    common, times = common[order], np.log2(np.maximum(times[order], 1)).astype(np.int64)
    classes = sets.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("class_id"), F.first("counts").alias("counts"))
    classes = cut(classes)

    prefixes = prefix_rows(docs, common, times, size, percent)
    late = cut(prefixes.where("common").select("shingle", "node"))
    crowded = late.groupBy("shingle").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > BLOCK).select("shingle")
    rare = prefixes.where("not common").select("shingle", "node").unionByName(late.join(crowded, "shingle", "left_anti"))
    blocks = memberships(rare.repartition("shingle")).distinct()
    points = classes.select(F.col("d1").alias("node"), "n", "counts")
    by_bound = candidate_edges(blocks.join(points, "node").select("block", "node", "n", "counts"), percent)
    # The members of a block too large for one task meet through a node that stands for its shingle.
    star = late.join(crowded, "shingle", "left_semi").select(F.col("node").alias("a"), F.xxhash64("shingle", F.lit("hub")).alias("b")).distinct()
    found = connected_components(by_bound.union(star))

    members = found.join(classes, found["node"] == classes["d1"]).select("component", F.col("class_id").alias("doc_id"), "d1", "n")
    groups = members.groupBy("component").agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("several")).where("several > 1")
    # A large component's tiles are ranges of sizes, since sets of very different sizes can't link.
    members = members.withColumn("bucket", F.floor(F.log("n") / np.log(STEP)).cast("int"))
    weights = members.groupBy("component", "bucket").agg(F.ceil(F.sum("n") / TILE).alias("parts"))
    slot = F.when(F.col("weight") > TILE, F.col("bucket") * 1_000_000 + F.pmod(F.xxhash64("doc_id"), F.col("parts")) + 1).otherwise(0)
    members = cut(
        members.join(groups, "component").join(weights, ["component", "bucket"]).select("component", "doc_id", "d1", "bucket", slot.alias("slot"))
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("text_id"), F.col("text").alias("text"))

    def with_texts(rows: DataFrame) -> DataFrame:
        # Texts of other documents are told apart by a bitmap before the exchange.
        wanted = cut(rows.select(F.col("doc_id").alias("text_id")).distinct())
        some = maybe_among(texts, ["text_id"], wanted, "__among").where("__among").select("text_id", "text")
        return rows.join(some, rows["doc_id"].eqNullSafe(some["text_id"])).drop("text_id")

    inside = members.select(
        F.xxhash64("component", "slot").alias("tile"), "doc_id", "d1", F.col("d1").alias("label"), F.lit(True).alias("asks"), F.lit(True).alias("home")
    )
    edges = cut(verified_edges(with_texts(inside), size, percent))
    large = members.where("slot > 0")
    if large.limit(1).count():
        edges = edges.union(cut(across_tiles(large, edges, with_texts, size, percent)))
    found = cut(connected_components(edges))
    linked = found.join(classes, found["node"] == classes["d1"])
    lowest = linked.groupBy(F.col("component").alias("of")).agg(F.min("class_id").alias("component_id"))
    named = found.join(lowest, found["component"] == lowest["of"]).select("node", "component_id")
    class_rows = classes.join(named, classes["d1"] == named["node"], "left").select(
        F.col("d1").alias("c1"), F.col("d2").alias("c2"), F.col("n").alias("cn"), "class_id",
        F.coalesce("component_id", "class_id").alias("component_id"),
    )
    same_set = (sets["d1"] == class_rows["c1"]) & (sets["d2"] == class_rows["c2"]) & (sets["n"] == class_rows["cn"])
    return sets.join(class_rows, same_set, "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"),
        F.col("d1").alias("digest"),
    )


def keep_first_of_near(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, without those whose component has a smaller doc_id.

    Decided for each row by its own text: rows that share a doc_id may differ. Rows without a doc_id go where their
    component has a row with one.
    """

    @F.pandas_udf("long")
    def digests(texts):
        arrow = pa.array(texts, pa.string())
        return pd.Series([digest_of(s)[0] for _, sets in distinct_per_row(arrow, size) for s in sets], dtype="int64")

    later = near_duplicates(docs, size, percent).where("component_id IS NOT NULL AND NOT (doc_id <=> component_id)")
    dropped = cut(later.select("doc_id", F.col("digest").alias("key")))
    return without_rows(docs, dropped, lambda df, name: df.withColumn(name, digests(F.coalesce("text", F.lit("")))))


def across_tiles(members: DataFrame, edges: DataFrame, with_texts, size: int, percent: int) -> DataFrame:
    """Edges between tiles of one candidate component.

    Members of its largest verified component are connected to each other; all others go to every tile
    whose sizes fit theirs and are compared there with what they aren't connected to.
    """
    done = connected_components(edges).withColumnRenamed("component", "label")
    labelled = members.join(done, members["d1"] == done["node"], "left").select(
        "component", "doc_id", "d1", "slot", "bucket", F.coalesce("label", "d1").alias("label")
    )
    labelled = cut(labelled)
    counts = labelled.groupBy("component", "label").agg(F.count(F.lit(1)).alias("size"))
    main = counts.groupBy("component").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
    open_rows = labelled.join(main.where("labels > 1"), "component")
    here = open_rows.select("component", "slot", "doc_id", "d1", "label", (F.col("label") != F.col("main")).alias("asks"), F.lit(True).alias("home"))
    reach = int(np.log(100 / percent) / np.log(STEP)) + 1
    slots = labelled.select("component", "bucket", "slot").distinct()
    there = (
        open_rows.where("label <> main")
        .select("component", "doc_id", "d1", "label", F.explode(F.sequence(F.col("bucket") - reach, F.col("bucket") + reach)).alias("bucket"))
        .join(slots, ["component", "bucket"])
        .select("component", "slot", "doc_id", "d1", "label", F.lit(True).alias("asks"), F.lit(False).alias("home"))
    )
    tiles = here.union(there).groupBy("component", "slot", "doc_id", "d1", "label").agg(F.bool_or("asks").alias("asks"), F.bool_or("home").alias("home"))
    return verified_edges(
        with_texts(tiles.select(F.xxhash64("component", "slot").alias("tile"), "doc_id", "d1", "label", "asks", "home")), size, percent
    )
