"""Expected values of single operators, and awkward rows."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from lucerna.functions import numbers as n
from lucerna.functions import text as t
from lucerna.functions.udfs import porter_stem
from lucerna.operators import evaluate as ev
from lucerna.operators import evidence as e
from lucerna.operators import records as rec
from lucerna.operators import retrieval as r
from lucerna.operators.chunking import chunk_pages, layout, progressive, sliding
from lucerna.sources import files, urls


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_normalize(spark):
    assert value(spark, t.normalize(F.lit("Title here\n\nBody text  with   spaces"))) == "title here\n\nbody text with spaces"
    assert value(spark, t.normalize(F.lit("a\n\n\n\nb"))) == "a\n\nb"
    assert value(spark, t.normalize(F.lit(None).cast("string"))) == ""
    assert value(spark, t.normalize(F.lit("docu-\n ment can't"))) == "document can not"


@pytest.mark.parametrize("word,stem", [("indexing", "index"), ("retrieval", "retriev"), ("structures", "structur"), ("summarization", "summar"), ("categories", "categori"), ("caresses", "caress"), ("hopping", "hop"), ("is", "is")])
def test_stems(word, stem):
    assert porter_stem(word) == stem


def test_bigrams(spark):
    assert value(spark, t.ngrams(F.array(*map(F.lit, ["data", "structur", "index"])))) == ["data_structur", "structur_index"]
    assert value(spark, t.ngrams(F.array(F.lit("one")))) == []


def test_weights(spark):
    got = [value(spark, n.tf_saturation(F.lit(f))) for f in (1, 2, 10)]
    assert got == pytest.approx([1.0, 1.375, 1.9642857])
    rows = spark.createDataFrame([(1, ["refund", "process", "refund", "window"], "body")], "chunk_id int, terms array<string>, zone string")
    best = r.postings(rows).agg(F.max("weight")).first()[0]
    assert best == pytest.approx(1.375 / (0.25 + 0.75 * 4 / 128))


def test_rank_fusion(spark):
    dense = spark.createDataFrame([(1, "p1", 0.9, 1)], "query_id int, chunk_id string, dense_score double, dense_rank int")
    sparse = spark.createDataFrame([(1, "p1", 3.0, 1), (1, "p2", 2.0, 2)], "query_id int, chunk_id string, sparse_score double, sparse_rank int")
    rows = r.fuse(dense, sparse).orderBy("fused_rank").collect()
    assert [(x.chunk_id, x.rrf_score) for x in rows] == [("p1", pytest.approx(2 / 61)), ("p2", pytest.approx(1 / 62))]
    assert r.dense_search(spark.createDataFrame([(1, [1.0])], "query_id int, query_vector array<float>"), spark.createDataFrame([(1, [1.0])], "chunk_id int, vector array<float>"), 0).count() == 0


def test_validity(spark):
    docs = spark.createDataFrame(
        [(1, "2026-01-01", None), (2, "2025-01-01", "2025-12-31"), (3, "2027-01-01", None), (4, "2026-08-01", "2026-08-01")], "doc_id int, a string, b string"
    ).select("doc_id", F.to_timestamp("a").alias("effective_from"), F.to_timestamp("b").alias("effective_until"), F.lit("2").alias("version"), F.lit("f").alias("filename"))
    rows = spark.createDataFrame([(1,), (2,), (3,), (4,), (9,), (None,)], "doc_id int")
    kept = r.valid_at(rows, docs, F.lit("2026-08-01").cast("timestamp")).collect()
    assert {x.doc_id for x in kept} == {1, 4, None}


@pytest.mark.parametrize(
    "query,route,subs",
    [("Compare A1 and B1", "comparison", ["A1", "B1"]), ("Pro vs Team plan?", "comparison", ["Pro", "Team plan"]), ("price in 2025", "temporal", ["price in 2025"]), ("is it still valid", "temporal", ["is it still valid"]),
     ("One? Two? Three? Four?", "complex", ["One", "Two", "Three"]), ("plain", "simple", ["plain"]), ("compare this", "simple", ["compare this"])],
)
def test_routes(spark, query, route, subs):
    got = value(spark, r.route(F.lit(query)))
    assert (got.route, got.sub_queries) == (route, subs)
    assert (got.reference_time is not None) == ("2025" in query)


def test_adaptive_cut(spark):
    rows = spark.createDataFrame([(q, i, 0.03 if (q, i) == (1, 0) else 0.01) for q in (1, 2) for i in range(8)], "query_id int, chunk_id int, rrf_score double")
    counts = {x.query_id: x["count"] for x in r.adaptive_cut(rows, 8).groupBy("query_id").count().collect()}
    assert counts == {1: 4, 2: 8}


def test_cosine(spark):
    vec = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert value(spark, n.cosine(vec(1, 2), vec(1, 2))) == pytest.approx(1)
    assert value(spark, n.cosine(vec(1, 0), vec(0, 1))) == 0 == value(spark, n.cosine(vec(0, 0), vec(1, 1))) == value(spark, n.cosine(vec(1), vec(1, 1)))


def test_citations(spark):
    answer = F.lit("See [Segment 2]. And [Segment 1]. Segment 3 says [Segment x].")
    assert value(spark, t.citations(answer)) == [2, 1]
    got = value(spark, t.strip_invalid_citations(F.lit("a [Segment 1] b [Segment 9]."), F.lit(2)))
    assert (got.text, got.dropped) == ("a [Segment 1] b.", [9])


@pytest.mark.parametrize("said,verdict", [("TRUE", "SUPPORTED"), ("false", "CONTRADICTED"), ("REFUTED", "CONTRADICTED"), ("UNKNOWN", "NEUTRAL"), ("garbage", "NEUTRAL"), ("S", "SUPPORTED"), ("SUPPORTED.", "SUPPORTED"), ("C", "CONTRADICTED"), ("N", "NEUTRAL")])
def test_verdict_names(spark, said, verdict):
    assert value(spark, t.verdict(F.lit(said))) == verdict


def test_triples(spark):
    got = [tuple(value(spark, t.claim_triple(F.lit(x)))) for x in ("The plan allows refunds.", "alpha beta gamma delta", "word", "", "is it")]
    assert got == [("The plan", "allows", "refunds"), ("alpha beta", "gamma", "delta"), ("word", None, None), (None, None, None), ("is", None, None)]


def test_verdict_table(spark):
    row = lambda s, c, total, a: tuple(value(spark, e.verdict(F.lit(s), F.lit(c), F.lit(total), F.lit(a))))
    assert row(0, 0, 0, "ABSTAIN") == ("PASS", "ABSTAINED", 0.0, "RETRIEVAL_FAILURE")
    assert row(0, 0, 0, "x") == ("FAIL", "FAILED", 0.0, "RETRIEVAL_FAILURE")
    assert row(4, 1, 5, "x")[:2] == ("PASS", "TRUSTED")
    assert row(7, 3, 10, "x")[1:] == ("FAILED", pytest.approx(0.49), "EVIDENCE_CONFLICT")
    assert row(5, 0, 10, "x")[1:] == ("UNCERTAIN", 0.5, "LOW_COVERAGE")


def test_claim_summary(spark):
    rows = spark.createDataFrame([(1, s) for s in ("SUPPORTED", "supported", "NEUTRAL", "CONTRADICTED", "bogus")], "query_id int, state string")
    x = e.claim_summary(rows).first()
    assert (x.supported, x.contradicted, x.neutral, x.coverage, x.contradiction_rate, x.reliability) == (2, 1, 2, 0.4, 0.2, pytest.approx(0.32))


def test_metrics(spark):
    got = spark.createDataFrame([(1, "a", 1), (1, "x", 2)], "query_id int, item string, rank int")
    gold = spark.createDataFrame([(1, "a"), (1, "b")], "query_id int, item string")
    x = ev.ranking_metrics(got, gold, 2).first()
    assert (x.recall, x.hit, x.rr, x.ndcg) == (0.5, 1.0, 1.0, pytest.approx(0.613147, abs=1e-5))
    none = ev.ranking_metrics(got.limit(0), gold).first()
    assert (none.recall, none.hit, none.rr, none.ndcg) == (0.0, 0.0, 0.0, 0.0)
    s = ev.latency_summary(spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "v double"), "v").first()
    assert (s.p50, s.p95) == (2.5, pytest.approx(3.85))
    resolved = spark.createDataFrame([(1, "a", 0), (1, "b", 2), (1, "c", None)], "query_id int, snippet string, found_at int")
    m = ev.snippet_metrics(resolved).first()
    assert m.snippet_recall == pytest.approx(2 / 3) and m.snippet_mrr == pytest.approx((1 + 1 / 3) / 3)


def test_integrity(spark):
    refs = spark.createDataFrame([(1, 0, "ok"), (2, 0, "other")], "doc_id int, chunk_index int, s string").select("doc_id", "chunk_index", n.text_hash(F.col("s")).alias("text_hash"))
    chunks = spark.createDataFrame([(1, 0, "ok"), (2, 0, "ok"), (3, 0, "ok"), (None, 0, "ok")], "doc_id int, chunk_index int, text string")
    got = {x.doc_id: x.integrity_status for x in e.audit_integrity(chunks, refs).collect()}
    assert got == {1: "VERIFIED", 2: "CORRUPTED", 3: "CORRUPTED", None: "EXTERNAL_UNAUDITED"}


def test_chunks(spark):
    text = " ".join(f"word{i}" for i in range(300))
    found = sliding(text, 200, 40)
    assert {w for _, p, _ in found for w in p.split()} == set(text.split()) and all(text[s : s + len(p)] == p for s, p, _ in found)
    assert sliding("a" * 300, 100, 10)[0] == (0, "a" * 100, None) and sliding("", 10, 2) == [] == sliding("   ", 10, 2)
    assert "".join(p for _, p, _ in progressive("x" * 90, 40, 0)) == "x" * 90
    blocks = layout("intro\n| a | b |\n| 1 | 2 |\n| 3 | 4 |\nclosing", 500, 20)
    assert [(p, z) for _, p, z in blocks] == [("intro", None), ("| a | b |\n| 1 | 2 |\n| 3 | 4 |", "table"), ("closing", None)]
    pages = spark.createDataFrame([(1, 1, "first page " * 100, True), (1, 2, None, False), (1, 3, "third", False)], "doc_id int, page int, text string, ocr_used boolean")
    rows = chunk_pages(pages, "unknown").orderBy("chunk_index").collect()
    assert [x.chunk_index for x in rows] == list(range(len(rows))) and rows[-1].page == 3 and rows[0].ocr_used


def test_context_budget(spark):
    rows = [(1, f"text {i} " * 20, 1.0 - i / 10, i) for i in range(6)] + [(1, "text 0 " * 20 + "!", 0.05, 7)]
    df = spark.createDataFrame(rows, "query_id int, text string, rrf_score double, place int").withColumns(
        {"rerank_score": F.lit(None).cast("double"), "dense_score": F.lit(None).cast("double"), "filename": F.lit("a\nb"), "page": F.lit(None).cast("int")}
    )
    served = e.segments(df, 600).orderBy("segment").collect()
    assert [x.segment for x in served] == [1, 2, 3] and served[0].rendered.startswith("--- Segment 1 [Source: ab, Page 1] ---\ntext 0")
    assert sum(len(x.rendered) for x in served) + 4 <= 600
    assert [x.segment for x in e.segments(df, 10).collect()] == [1]


def test_files(spark):
    rows = [
        ("/x/a.csv", b"Name,Age\n Ann ,3\n,,\nBob,4,extra\n"), ("/x/b.json", b'{"k": "\xc3\xa9"}'), ("/x/c.html", b"<p>Hi<script>no</script> there</p><meta><div>x</div>"),
        ("/x/d.txt", b" plain "), ("/x/e.pdf", b"nope"), ("/x/f.exe", b"MZ"), ("/x/g.txt", files.TEST_STRING.encode()), ("/x/h.json", b"{broken"),
        ("/x/i.md", b"Effective from: 2026-02-30 effective until: 2026-03-01"),
    ]
    got = {r["path"].split("/")[-1]: r for r in files.parse_files(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.csv"].text == "Name: Ann | Age: 3\nName: Bob | Age: 4 | Col3: extra"
    assert got["b.json"].text == '{\n  "k": "é"\n}' and got["c.html"].text == "Hi there \n x" and got["d.txt"].text == "plain"
    assert (got["e.pdf"].status, got["f.exe"].status, got["g.txt"].status) == ("bad_signature", "unsupported", "malware")
    assert got["h.json"].status.startswith("failed") and got["i.md"].effective_from is None and got["i.md"].effective_until is not None


@pytest.mark.parametrize(
    "page,said",
    [("<h1>A &amp; B</h1>a &lt;b&gt; c", "A & B a <b> c"), ("x<script>if (a < b) {}", "x"), ("1 < 2 <b>y</b>", "1 < 2 y"), ("<p>\u00a0&nbsp;</p>z", "z"), ("<style>p{}</style><!-- <p> -->q", "q"), ("", ""), (None, None)],
)
def test_html(spark, page, said):
    assert value(spark, files.html_columns(F.lit(page).cast("string"), entities=True)) == said


def test_csv(spark):
    rows = [(0, ""), (1, "A, B\n"), (2, 'A\n"x\ny"\n\n , \n'), (3, None), (4, "\n1,2"), (5, "A,A\r\n1,\r\n")]
    got = {r.k: r.v for r in spark.createDataFrame(rows, "k int, t string").withColumn("c", files.csv_cells(F.col("t"))).select("k", files.csv_document(F.col("c.cells")).alias("v")).collect()}
    assert got == {0: "", 1: "A | B", 2: "A: x\ny", 3: "", 4: "Col1: 1 | Col2: 2", 5: "A: 1 | A:"}


@pytest.mark.parametrize("ext,head,ok", [(".pdf", b"%PDF-1.7", True), (".pdf", b"%PD", False), (".png", b"\x89PNG\r\n\x1a\nrest", True), (".docx", b"PK\x05\x06", True), (".gif", b"GIF88a", False), (".txt", b"", True)])
def test_signatures(spark, ext, head, ok):
    assert value(spark, files.magic_ok(F.lit(ext), F.lit(head))) is ok


def test_abstaining_is_one_exact_word(spark):
    status = lambda said: value(spark, e.verdict(F.lit(0), F.lit(0), F.lit(0), F.lit(said).cast("string"))).status
    assert [status(x) for x in ("ABSTAIN", " ABSTAIN ", "", None)] == ["ABSTAINED", "FAILED", "FAILED", "FAILED"]


@pytest.mark.parametrize("url,ok", [("https://a.example/x", True), ("http://localhost/", False), ("ftp://a.example", False), ("http://192.168.1.2/", False), ("https://x.internal", False), ("http://[::1]/", False), (None, False)])
def test_urls(spark, url, ok):
    assert (value(spark, urls.sanitize_url(F.lit(url).cast("string"))) != "") is ok


def test_refusals(spark):
    for said, refuses in [("ABSTAIN", True), ("I could not verify it", True), ("There is insufficient evidence.", True), ("Refunds take 5 days.", False), (None, False)]:
        assert value(spark, t.is_refusal(F.lit(said).cast("string"))) is refuses
    assert math.isclose(value(spark, n.rrf(F.lit(1))), 1 / 61)


def test_gold_by_class_makes_no_pairs(spark):
    """Equal to gold as pairs, also where items and questions have several classes."""
    queries = spark.createDataFrame([(q, c) for q in range(12) for c in {q % 3, q % 4}] + [(50, None), (51, 9), (0, 0)], "query_id long, class int")
    items = spark.createDataFrame([(i, i % 3) for i in range(60)] + [(i, i % 4) for i in range(0, 60, 7)] + [(3, 0), (60, None)], "item long, class int")
    got = spark.createDataFrame([(q, (q * 5 + 7 * r) % 63, r) for q in [*range(12), 50, 51] for r in range(1, 10)], "query_id long, item long, rank int")
    want = ev.ranking_metrics(got, queries.join(items, "class").select("query_id", "item"))
    rounded = lambda df: sorted(tuple(round(x, 12) for x in row) for row in df.collect())
    assert rounded(ev.class_ranking_metrics(got, queries, items)) == rounded(want)


def test_cache_lookup_within_bases(spark):
    at = dt.datetime(2026, 1, 2)
    cache = spark.createDataFrame([(i, f"b{i % 3}", "m" if i % 5 else None, [1.0, float(i % 4), 0.5], at) for i in range(90)], "entry_id long, kb_id string, model string, vector array<double>, created_at timestamp")
    asked = spark.createDataFrame([(q, f"b{q % 4}", "m", [1.0, float(q % 5), 0.5]) for q in range(20)], "query_id long, kb_id string, model string, query_vector array<double>")
    found = rec.cache_lookup(asked, cache, F.lit(at), 0.99, 24)
    assert "similarity" in found.columns and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # questions meet entries inside tasks
    cosine = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 9)
    want = {}
    for q in asked.collect():
        close = sorted((-s, c.entry_id) for c in cache.collect() if c.kb_id == q.kb_id and c.model == q.model and (s := cosine(q.query_vector, c.vector)) >= 0.99)
        if close:
            want[q.query_id] = close[0][1]
    assert {x.query_id: x.entry_id for x in found.collect()} == want and want
