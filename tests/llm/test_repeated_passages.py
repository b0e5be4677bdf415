"""Passages of substring deduplication that sentence and line ends don't mark."""

import random

from lucerna.llm import line_dedup


def test_passages_without_marks_at_their_ends(spark):
    rng = random.Random(5)
    said = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)]
    plain, lines, least = said(60), said(60), said(25)
    cases = [" ".join(plain), "\n".join(lines), " ".join(least)]
    texts = [" ".join(said(9)) + " " + x + " " + " ".join(said(14)) for x in cases * 2]
    texts.append(" ".join(said(5) + plain[:24] + said(5)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (texts[r.doc_id][r.start : r.stop], r.words, r.first_doc_id) for r in line_dedup.repeated_spans(docs).collect()}
    assert got == {3: (cases[0], 60, 0), 4: (cases[1], 60, 1), 5: (cases[2], 25, 2)}
