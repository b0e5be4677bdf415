"""Context compression against enumeration and a plain greedy; chunkers as table functions against chunk_pages."""

import itertools
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lucerna.functions import text as t
from lucerna.operators import chunking
from lucerna.operators.chunking import STRATEGIES, chunk_pages, register_chunker
from lucerna.operators.compress import compress

WORDS = ["alpha", "beta", "gamma", "delta", "kappa", "sigma", "omega", "theta"]


def cases(seed, n):
    rng = random.Random(seed)
    out = {}
    for q in range(n):
        sentences = [[" ".join([rng.choice(WORDS + ["filler", "noise", "words"]).capitalize() for _ in range(rng.randint(1, 7))]) + "." for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 3))]
        out[q] = (" ".join(rng.sample(WORDS, rng.randint(0, 6))), sentences, rng.choice([30, 80, 120, 200]))
    return out


def plain(query, sentences, budget):
    items = [(f"[Segment {s}] {x}", set(query.split()) & {w.strip(".").lower() for w in x.split()}) for s, part in enumerate(sentences, 1) for x in part]
    cost = lambda x: len(x[0]) + 1
    if sum(map(cost, items)) <= budget:
        return items, items
    left, taken, covered, used = list(range(len(items))), [], set(), 0
    while True:
        left = [i for i in left if used + cost(items[i]) <= budget and items[i][1] - covered]
        if not left:
            break
        best = max(left, key=lambda i: (len(items[i][1] - covered) / cost(items[i]), -i))
        taken, covered, used = [*taken, best], covered | items[best][1], used + cost(items[best])
        left.remove(best)
    fits = [i for i in range(len(items)) if cost(items[i]) <= budget]
    if not covered:
        out, used = [], 0
        for x in items:
            if used + cost(x) > budget:
                break
            out, used = [*out, x], used + cost(x)
        return out, items
    single = max(fits, key=lambda i: (len(items[i][1]), -i))
    if len(items[single][1]) > len(covered):
        return [items[single]], items
    return [items[i] for i in sorted(taken)], items


@pytest.mark.parametrize("seed", [1, 2])
def test_compression(spark, seed):
    asked, stopped = cases(seed, 60), set(t.stopwords(True))
    assert not stopped & set(WORDS)
    for budget in (30, 80, 120, 200):
        some = {q: x for q, x in asked.items() if x[2] == budget}
        questions = spark.createDataFrame([(q, query) for q, (query, _, _) in some.items()], "query_id long, query string")
        served = spark.createDataFrame([(q, s, " ".join(part)) for q, (_, parts, _) in some.items() for s, part in enumerate(parts, 1)] + [(1000, 1, None)], "query_id long, segment int, text string")
        got = {r.query_id: r for r in compress(questions, served, budget).collect()}
        assert set(got) == set(some)
        for q, (query, sentences, _) in some.items():
            want, items = plain(query, sentences, budget)
            lines = got[q].context.split("\n") if got[q].context else []
            assert lines == [x for x, _ in want] and sum(len(x) + 1 for x in lines) <= max(budget, 0)
            assert got[q].segments == sorted({int(x.split("]")[0].split()[1]) for x in lines})
            reached = len(set().union(*(w for _, w in want))) if want else 0
            assert got[q].covered == reached
            best = max(
                (len(set().union(*(w for _, w in part))) for k in range(1, len(items) + 1) for part in itertools.combinations(items, k) if sum(len(x) + 1 for x, _ in part) <= budget), default=0
            )
            assert 2 * reached >= best


def test_chunkers_in_sql(spark):
    rows = [(1, "# Head\nSome words of the first part. " * 9), (2, "a | b | c\n1 | 2 | 3\nplain prose line that is quite long indeed\n" * 6), (3, ""), (4, None), (5, "x" * 500)]
    pages = spark.createDataFrame([(i, 1, x) for i, x in rows], "doc_id long, page int, text string")
    for name, strategy in STRATEGIES.items():
        register_chunker(spark, f"cut_{name}", strategy)
        pages.select("doc_id", t.normalize(pages["text"]).alias("text")).createOrReplaceTempView("pages_to_cut")
        got = spark.sql(f"SELECT p.doc_id, c.chunk_no, c.character_offset, c.text FROM pages_to_cut p, LATERAL cut_{name}(p.text, 120, 20) c")
        want = chunk_pages(pages, name, 120, 20).select("doc_id", "chunk_index", "character_offset", "text")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 5


def test_a_strategy_of_ones_own(spark):
    register_chunker(spark, "by_letter", lambda text, size, overlap: [(i, c, "letter") for i, c in enumerate(text) if i % size == overlap])
    got = spark.sql("SELECT c.* FROM VALUES ('abcdef'), (NULL) AS v(text), LATERAL by_letter(v.text, 3, 1) c").collect()
    assert [tuple(r) for r in got] == [(0, 1, "letter", "b"), (1, 4, "letter", "e")]
    for call in ("by_letter(v.text, 0, 1)", "by_letter(v.text, v.n, 1)", "by_letter(v.n, 3, 1)"):
        with pytest.raises(PySparkException):
            spark.sql(f"SELECT c.* FROM VALUES ('abc', 3) AS v(text, n), LATERAL {call} c").collect()


def test_chunks_of_more_pages_than_a_slice(spark):
    """Pages go through Python a slice at a time, not a batch of 10,000 rows at once; other columns, empty and null texts stay with their pages."""
    texts = ["" if i % 7 == 0 else None if i % 11 == 0 else f"line {i} | x\n\n" + "so it goes on and on there " * (i % 40) for i in range(150)]
    pages = spark.createDataFrame([(i // 3, i % 3, t, f"o{i}") for i, t in enumerate(texts)], "doc_id long, page int, text string, own string").coalesce(1)
    found = chunking.chunk_pages(pages, "layout_aware")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "EvalPython" not in plan and chunking.SLICE < 150
    got = [(x.own, x.character_offset, x.text) for x in found.orderBy("doc_id", "chunk_index").collect()]
    normal = [(x.own, x.t) for x in pages.select("own", chunking.normalize(F.col("text")).alias("t")).collect()]
    assert got == [(own, start, piece) for own, t in normal for start, piece, _ in chunking.layout(t, 512, 64)]
