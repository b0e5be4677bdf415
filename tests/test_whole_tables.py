"""Registered queries over whole small tables, against plain versions in Python."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lucerna import catalog
from lucerna.catalog import retrieval_queries
from lucerna.functions import text as t
from lucerna.functions import words as w
from lucerna.functions.udfs import decomposed, porter_stem, text_words

DOCS = [
    (1, "The bank lends money to the small town."), (2, "Le café de la ville prête de l'argent à la banque."), (3, None), (4, ""),
    (5, "Die Straße führt über die Brücke zur Bank."), (6, "bank bank money, naïve money"), (7, "日本 bank"), (8, "river town 7 state-of-the-art"),
]
ITEMS = [(1, "Where does the bank lend money?"), (2, "café de la ville"), (3, "Brücke zur Bank"), (4, None)]
TURNS = [(1, 0, "user", "Wie heißt die Straße, bitte, in dieser Stadt?"), (1, 1, "assistant", "The street is called Main Street here."), (2, 0, "user", None), (2, 1, "assistant", "")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    catalog.load_all()
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


def rows(spark, folder, name):
    return [tuple(r) for r in catalog.QUERIES[name](spark, folder).collect()]


def plain_words(text, is_query=False):
    low = unicodedata.normalize("NFKD", text or "").lower()
    for short, long in w.CONTRACTIONS:
        low = low.replace(short, long)
    found = re.findall(r"(?<!\w)[a-z0-9]+(?:-[a-z0-9]+)*(?!\w)", low)
    return [x for x in found if x not in set(t.stopwords(is_query)) and (len(x) > 1 or x.isdigit())]


def plain_tokens(text, is_query=False):
    return [porter_stem(x) for x in plain_words(text, is_query)]


def digest(items):
    return hashlib.sha256(" ".join(items).encode()).hexdigest()


def plain_counts():
    return {(i, x): c for i, text in DOCS for x, c in Counter(plain_tokens(text)).items()}


def plain_weights():
    size = {i: len(plain_tokens(text)) for i, text in DOCS}
    return {(i, x): c * 2.2 / (c + 1.2) / (0.25 + 0.75 * size[i] / 128) for (i, x), c in plain_counts().items()}


def plain_bm25(asked=plain_tokens):
    weights, out = plain_weights(), {}
    df = Counter(x for _, x in weights)
    total = len({i for i, _ in weights})
    for item, text in ITEMS:
        scores = Counter()
        for x, c in Counter(asked(text, True)).items():
            for i, _ in DOCS:
                if (i, x) in weights:
                    scores[i] += c * 2.2 / (c + 1.2) * math.log(1 + (total - df[x] + 0.5) / (df[x] + 0.5)) * weights[i, x]
        for rank, (i, score) in enumerate(sorted(scores.items(), key=lambda p: (-round(p[1], 9), p[0]))[:20], 1):
            out[item, i] = (score, rank)
    return out


def test_terms_of_all_documents(spark, folder):
    assert sorted(rows(spark, folder, "str02_lex_tokens")) == sorted((i, len(plain_tokens(x)), digest(plain_tokens(x))) for i, x in DOCS)
    bigrams = {i: ["_".join(p) for p in zip(plain_tokens(x), plain_tokens(x)[1:], strict=False)] for i, x in ITEMS}
    assert sorted(rows(spark, folder, "str04_bigrams")) == sorted((i, len(x), digest(x)) for i, x in bigrams.items())
    counts = plain_counts()
    assert {(i, x): c for i, x, c in rows(spark, folder, "agg09_term_counts")} == counts and (2, porter_stem("cafe")) in counts and (6, "monei") in counts
    assert dict(rows(spark, folder, "agg10_document_frequencies")) == Counter(x for _, x in counts)
    assert {(i, x): v for i, x, v in rows(spark, folder, "mat05_sparse_weights")} == pytest.approx(plain_weights(), abs=1e-8)


def test_bm25_over_all_rows(spark, folder):
    got, want = {(q, i): (s, k) for q, i, s, k in rows(spark, folder, "ret02_bm25")}, plain_bm25()
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()} and (2, 2) in got and (3, 5) in got
    assert all(got[k][0] == pytest.approx(want[k][0], abs=1e-8) for k in want)
    texts, items = dict(DOCS), dict(ITEMS)
    share = lambda q, i: len(set(plain_words(items[q], True)) & set(plain_words(texts[i]))) / len(set(plain_words(items[q], True)))
    assert {(q, i): s for q, i, s, _ in rows(spark, folder, "ret07_rerank")} == pytest.approx({k: share(*k) for k in want}, abs=1e-6)


def test_final_answers_of_all_turns(spark, folder):
    got = {(c, k): x for c, k, x in rows(spark, folder, "str12_final_answer")}
    assert set(got) == {(c, k) for c, k, _, _ in TURNS} and got[2, 0] is None
    assert got[1, 0].startswith(TURNS[0][3]) and got[1, 1] == TURNS[1][3]


LONG = "so it goes on " * 12
WHOLE_TURNS = [
    (1, 0, "user", "Compare the basic plan and the family plan"), (1, 1, "assistant", LONG), (2, 0, "user", "The long clause at the very end of this contract covers all damage."),
    (2, 1, "assistant", "unquestionably so it is in the end"), (3, 0, "user", "What held in 2025 for us?"), (3, 1, "assistant", "no idea"),
]


def test_whole_texts(spark, tmp_path):
    catalog.load_all()
    folder = str(tmp_path)
    spark.createDataFrame(WHOLE_TURNS, "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([(100, "x" * 60), (101, " short "), (102, None)], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    assert {(c, k) for c, k, x in rows(spark, folder, "fil16_instruction_echo") if x} == {(1, 1)}
    # Fewer than twelve words make no claim; fewer than five are a stub.
    assert {(c, k) for c, k, x in rows(spark, folder, "fil17_stubs") if x} == {(3, 1)}
    triples = {(c, k): x for c, k, *x in rows(spark, folder, "str17_triples")}
    assert triples[2, 0] == ["The long clause at the very end of this contract", "covers", "all damage"]
    assert dict(rows(spark, folder, "src08_ocr_gate")) == {100: False, 101: True, 102: True}
    routes = {(c, k): x for c, k, *x in rows(spark, folder, "ret05_routes")}
    assert routes[1, 0][:2] == ["comparison", "the basic plan|the family plan"] and routes[3, 0][0] == "temporal" and routes[3, 0][2].year == 2025
    assert set(routes) == {(c, k) for c, k, _, _ in WHOLE_TURNS}


def plain_ranks():
    """Dense ranks of all documents for each question."""

    def vector(words):
        out = [0.0] * 64
        for x in words:
            code = zlib.crc32(x.encode())
            out[code % 64] += 1 if code // 64 % 2 == 0 else -1
        size = math.sqrt(sum(v * v for v in out))
        return [v / size for v in out] if size else out

    ranks, vectors = {}, {i: vector(plain_words(x)) for i, x in DOCS}
    for q, text in ITEMS:
        own = vector(plain_words(text))
        order = sorted(vectors, key=lambda i: (-round(sum(a * b for a, b in zip(own, vectors[i], strict=True)), 9), i))
        ranks |= {(q, i): k for k, i in enumerate(order, 1)}
    return ranks


def test_fusion_of_both_legs(spark, folder):
    dense, sparse = plain_ranks(), plain_bm25()
    want = {k: 1 / (60 + r) + (1 / (60 + sparse[k][1]) if k in sparse else 0) for k, r in dense.items()}
    assert {(q, i): x for q, i, x, _ in rows(spark, folder, "ret03_rank_fusion")} == pytest.approx(want, abs=1e-8)
    best = {}
    for q, _ in ITEMS:
        order = sorted((i for i, _ in DOCS), key=lambda i: (-want[q, i], i))
        best |= {(q, i): k for k, i in enumerate(order[: 4 if max(want[q, j] for j in order) >= 0.02 else 10], 1)}
    assert {(q, i): k for q, i, k in rows(spark, folder, "ret04_hybrid")} == best == {(q, i): k for q, i, k in rows(spark, folder, "top04_adaptive_cut")}
    assert {(q, i) for q, _, i, _ in rows(spark, folder, "win03_fanout_merge")} == set(want)


def test_terms_are_counted_before_they_are_exchanged(spark, tmp_path):
    """Rows that share their key or have none are one document, and no word goes through an exchange for each time that it is there."""
    catalog.load_all()
    texts = [(1, "bank banks money"), (1, "banking, monies"), (2, None), (None, "river"), (None, "rivers bank"), (3, ""), (4, "Straße café " * 50)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter((i, x) for i, text in texts for x in plain_tokens(text))
    got = {(i, x): c for i, x, c in rows(spark, tmp_path, "agg09_term_counts")}
    assert got == want
    size = {i: sum(c for (j, _), c in want.items() if j == i) for i in {1, 4, None}}
    weights = {(i, x): v for i, x, v in rows(spark, tmp_path, "mat05_sparse_weights")}
    assert weights == pytest.approx({(i, x): c * 2.2 / (c + 1.2) / (0.25 + 0.75 * size[i] / 128) for (i, x), c in want.items()}, abs=1e-8)
    total = Counter(x for _, text in texts for x in plain_tokens(text))
    assert dict(rows(spark, tmp_path, "str03_stem_vocabulary")) == total
    assert sum(c for _, c in rows(spark, tmp_path, "mat05_hashed_terms")) == len(total)
    spark.createDataFrame(texts[-1:], "doc_id long, text string").write.parquet(f"{tmp_path}/one/documents.parquet")
    plan = catalog.QUERIES["agg09_term_counts"](spark, f"{tmp_path}/one")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


ODD = [
    "a-\nb-\nc d", "x-  \n\n y e\u0301-\n\u00df", "\u0130stanbul KELVIN \u212a \ufb01\ufb01n", "cannotx can't won't 'll cant", "abc-def\u00f8 \u00f8-abc a--b -a- 5 a 7\u00e9",
    "x\u2022y\uff21z\u25aab", "snake_case a_b 12-34", "\u00e9tat-\r\n\x0bmajor", "\u03a3\u0391\u03a3 abc\u03a3", "\U0001d400bc \U0001d7d9", "a\u00a0b c\u0085-\nd", "", "  ", None, "n't n't-\n's",
]


def test_words_of_one_pass_are_those_of_the_columns(spark, tmp_path):
    rows = spark.createDataFrame([(x,) for x in ODD], "text string")
    for asked in (False, True):
        both = rows.select(t.tokens(t.normalize(decomposed(F.col("text"))), asked).alias("a"), text_words(F.col("text"), asked).alias("b"))
        assert [x.b for x in both.collect()] == [x.a for x in both.collect()]
    # Documents' vectors take one pass of Python, none of the JVM's expressions.
    rows.withColumn("doc_id", F.monotonically_increasing_id()).write.parquet(f"{tmp_path}/documents.parquet")
    text = retrieval_queries._document_vectors(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in text and text.count("ArrowEvalPython") == 1


def test_texts_of_other_documents_are_not_exchanged(spark, folder):
    """What was found is broadcast to the documents: an exchange above their scan would carry every text."""
    for name in ("ret07_rerank", "gen02_compressed_context"):
        plan = catalog.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        lines = plan.split("\n")
        scan = next(i for i, line in enumerate(lines) if "documents.parquet" in line and "FileScan" in line)
        join = max(i for i, line in enumerate(lines[:scan]) if "Join" in line)
        assert "BroadcastHashJoin" in lines[join] and not any("Exchange hashpartitioning" in x for x in lines[join:scan]), plan
