"""The corpus pipeline's stages on small tables, against plain versions and on awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

from lucerna.llm.exact_dedup import keep_first
from lucerna.llm.ngram_join import keep_first_of_near, near_duplicates

public_tokenizers = pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = "doc_id long, text string, lang string, source string, dropped_id long, component_id long, digest long"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 2, 3) for i, t in rows], COLUMNS)


def kept(df):
    assert df.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def words(seed, n=60):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10_000)}" for _ in range(n)]


def test_stages_decide_each_row_by_its_own_text(spark):
    base, other = words(1), words(2)
    near = [*base[:-1], "end"]
    rows = [(0, " ".join(base)), (1, " ".join(near)), (1, " ".join(other)), (2, None), (2, None), (None, " ".join(words(3))), (None, " ".join([*other, "x"])), (3, "a b")]
    left = [r for r in rows if r not in (rows[1], rows[6])]
    assert kept(keep_first_of_near(rows_of(spark, rows))) == sorted(left, key=str)
    ids = {(r.doc_id, r.n_shingles): r.component_id for r in near_duplicates(rows_of(spark, rows[:3])).collect()}
    assert sorted(r.component_id for r in near_duplicates(rows_of(spark, rows[:3])).collect()) == [0, 0, 1], ids

    rows = [(1, "dup"), (2, "dup"), (2, "only  here"), (None, "dup"), (None, "no id"), (5, None), (6, ""), (3, "only here")]
    assert kept(keep_first(rows_of(spark, rows))) == sorted([rows[0], rows[2], rows[4], rows[5]], key=str)


def test_stages_of_nothing(spark):
    empty = rows_of(spark, [(1, "x")]).limit(0)
    assert keep_first(empty).count() == 0 == keep_first_of_near(empty).count()


def near(a, b):
    a, b = ({tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} for x in (a.lower().split(), b.lower().split()))
    return bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)


def test_run_against_plain_versions(spark, tmp_path):
    """Each stage's rows against a plain version of its rule; quality against its own query's decision."""
    import sentencepiece

    from lucerna.llm.quality import quality_scores

    rng = random.Random(4)
    docs, labels = [], []
    for i in range(120):
        good = i % 3 > 0
        text = " ".join(" ".join(words(1000 * i + k, 12)) + "." for k in range(6)) if good else " ".join(rng.choice(["buy", "NOW", "$$$", "!!!"]) for _ in range(40))
        docs.append([i, text])
        labels.append((i, int(good)))
    item = " ".join(words(77, 20))
    docs[4][1] += " " + item[:30] + "#" + item[31:]
    docs[7][1] = docs[5][1].replace(" ", "  ")
    docs[10][1] = docs[8][1] + " more words"
    docs.append([120, None])
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    source = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").schema
    write([tuple(d) for d in docs], "doc_id long, text string", "documents")
    spark.createDataFrame(labels, "doc_id long, quality int").select(
        *[F.col(f.name).cast(f.dataType) if f.name in ("doc_id", "quality") else F.lit(None).cast(f.dataType).alias(f.name) for f in source]
    ).write.parquet(f"{tmp_path}/labels.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(1)
    bench.select(*[F.lit(item).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in bench.schema]).write.parquet(f"{tmp_path}/benchmark.parquet")

    tables = [spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels")]
    want = {r.doc_id for r in quality_scores(*tables).where("predicted = 1").collect()}
    assert 120 not in want and len(want) > 60
    text = {i: t or "" for i, t in docs}
    first: dict[str, int] = {}
    for i in sorted(want):
        first.setdefault(" ".join(text[i].split()), i)
    want = sorted(first.values())
    want = {i for i in want if not any(j < i and near(text[i], text[j]) for j in want)}
    want.discard(4)
    assert {5, 8} <= want and not {7, 10} & want

    got = {r.doc_id: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == want
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = next(c for c, t in pipeline.run(spark, str(tmp_path)).dtypes if t.startswith("array<"))
    assert all(list(r[ids]) == model.encode(text[i]) for i, r in got.items())
