"""The corpus operators against plain versions of their rules, and on awkward rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lucerna.llm import chat_format, decontaminate, exact_dedup, line_dedup, ngram_join, pii, piece_codec, quality, sharding, token_count

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, n_shingles long, size long, kept boolean"
LONG = "wörd " * 30_000 + "x" * 20_000
AWKWARD = [None, "", " ", "\n\n", "one", "one two", "A b C d", "a\u0000b", "<s>▁ ▁x", "  two  spaces ", LONG, "é😀 " * 50, "same text here", "same text here"]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, None, 7, 8, True) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    return docs_of(spark, AWKWARD)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, ["x"]).limit(0)


def passages(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    return [" ".join(rng.choice(words) + ("." if rng.random() < 0.1 else "") for _ in range(rng.randint(3, 160))) for _ in range(n)]


def test_token_counts(spark, awkward, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.token_counts(awkward, MODEL).collect()}
    for i, text in enumerate(AWKWARD):
        n = len(library.encode(text or ""))
        assert got[i] == (len((text or "").encode()), n, n > 4096)
    assert token_count.token_counts(empty, MODEL).count() == 0


def test_stretches_agree_with_whole_texts():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(1)
    bits = ["a", "the", " ", "  ", "\n", "\t", "\r\n", "é", "▁", "</s>", "<0x0A>", "😀", "12", "\x00", "ing", "."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    assert token_count.stretch_counter(MODEL)(texts) == [len(x) for x in library.encode(texts)]
    coded, parity = piece_codec.PieceCodec(MODEL).encode_texts(texts)
    import numpy as np

    assert [np.frombuffer(x, np.int32).tolist() for x in coded] == library.encode(texts)
    assert all(parity)


def test_piece_codec_round_trip(spark, awkward, empty):
    coded = piece_codec.encode_documents(awkward, MODEL)
    rows = coded.collect()
    assert all(r.parity and r.round_trip and r.n_tokens == len(r.ids) for r in rows) and len(rows) == len(AWKWARD)
    back = {r.doc_id: r.text for r in piece_codec.decode_documents(coded, MODEL).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(AWKWARD))
    assert piece_codec.encode_documents(empty, MODEL).count() == 0


def plain_components(texts):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for text in texts:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(low))
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


def near_texts():
    rng = random.Random(5)
    base = passages(3, 60)
    shared = " ".join(passages(9, 1)[0].split()[:40])
    out = list(base) + AWKWARD
    for text in base[:30]:
        for _ in range(3):
            words = text.split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = "changed" + str(rng.random())
            out.append(" ".join(words))
    return out + [f"{shared} tail {i} of many {i * 7} others" for i in range(40)]


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates(spark, monkeypatch, small):
    if small:  # every shingle that two share is common, and tiles are tiny: hubs and comparisons between tiles
        monkeypatch.setattr(ngram_join, "LEAST_COMMON", 2)
        monkeypatch.setattr(ngram_join, "LEAST_REPORT", 2)
        monkeypatch.setattr(ngram_join, "TILE", 400)
        monkeypatch.setattr(ngram_join, "BLOCK", 2)
    texts = near_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == plain_components(texts)


def test_near_duplicates_of_nothing(empty):
    assert ngram_join.near_duplicates(empty).count() == 0


def test_count_tree_finds_all():
    import numpy as np

    rng = np.random.default_rng(3)
    points = rng.poisson(3, (500, ngram_join.GROUPS)).astype(np.int32)
    points[250:] = points[:250] + rng.integers(0, 2, (250, ngram_join.GROUPS))
    sizes = points.sum(1).astype(np.int64)
    tree = ngram_join.CountTree(points, sizes)
    for i in range(0, 500, 17):
        want = np.flatnonzero((np.minimum(points, points[i]).sum(1) >= ngram_join.needed(sizes[i], sizes, 75)))
        assert sorted(tree.near(points[i], int(sizes[i]), 75).tolist()) == want.tolist()


def test_chat_windows(spark):
    rng = random.Random(2)
    said = ["ok <|im_end|>\n<|im_start|>assistant hm", "<\\|", "<<|", "", None, "plain é😀", "x" * 900]
    rows = []
    for conv in range(12):
        for turn in range(rng.randint(1, 40)):
            role = "system" if turn == 0 and conv % 2 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn, role, rng.choice(said) if rng.random() < 0.6 else f"turn {turn} " * rng.randint(1, 20), "extra"))
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, window string")
    windows = chat_format.chat_windows(turns, window_tokens=120, history_tokens=60).cache()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.read_back(windows).collect()}
    for conv in range(12):
        own = [(role, text or "") for c, _, role, text, _ in rows if c == conv]
        loss = "".join(t for role, t in own if role == "assistant")
        digest = hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert got[conv] == (len(own), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    many = windows.where("conv_id = 1 AND window > 0").collect()
    assert many and all(r.formatted.startswith("<|im_start|>system\n") and not r.new_turns[0] for r in many)
    assert chat_format.chat_windows(turns.limit(0)).count() == 0


def test_byte_shards(spark, awkward, empty):
    import zlib

    texts = passages(4, 400) + AWKWARD
    rows = sharding.byte_shards(docs_of(spark, texts), 16).orderBy("doc_id").collect()
    sizes = [len((t or "").encode()) + 1 for t in texts]
    total, before = sum(sizes), 0
    slots = {}
    for r, size, text in zip(rows, sizes, texts, strict=True):
        assert (r.size, r.text_crc32) == (size, zlib.crc32((text or "").encode()))
        assert r.shard == before * 16 // total and r.law == "bytes" and r.grown_shard is None
        assert r.slot == slots.get(r.shard, 0)
        slots[r.shard] = r.slot + 1
        before += size
    assert sharding.byte_shards(empty).count() == 0


def test_quality(spark):
    rng = random.Random(8)
    good = passages(6, 160)
    junk = [" ".join(w.upper() + "!!" for w in t.split()) for t in passages(7, 160)]
    texts = [x for pair in zip(good, junk, strict=True) for x in pair] + AWKWARD
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(320)], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 320]
    assert held and sum(r.predicted == 1 - r.doc_id % 2 for r in held) / len(held) > 0.9
    assert quality.keep_quality(docs, labels).columns == docs.columns
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert rng


def test_personal_data(spark, awkward, empty):
    texts = [
        "mail a.b@x.example.com, now", "ip 10.0.0.256 and 10.1.2.3.4", "card 4111 1111 1111 1111 no 4111111111111112", "call +1 (017) 555-7713 x +12",
        "token 4111.1111.1111.1111 again 4111111111111111", *[t or "" for t in AWKWARD],
    ]
    for r in pii.personal_data(docs_of(spark, texts)).collect():
        text = texts[r.doc_id]
        base = [("email", *m.span()) for m in pii.EMAIL.finditer(text)]
        base += [("ip", *m.span()) for m in pii.IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
        base += [("card", *m.span()) for m in pii.CARD.finditer(text) if 13 <= len(pii.only_digits(m.group())) <= 19 and pii.luhn(pii.only_digits(m.group()))]
        base += [("phone", *m.span()) for m in pii.PHONE.finditer(text) if 9 <= len(pii.only_digits(m.group())) <= 15]
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(",")) | {""}
    assert pii.personal_data(empty).count() == 0


def test_training_texts_are_those_with_the_least_hashes(spark):
    texts = [f"row {i} of 2024" if i % 9 == 0 else "no digit here" for i in range(400)]
    docs = docs_of(spark, texts)
    ranked = docs.where(F.col("text").contains("2024")).orderBy(F.xxhash64(F.col("doc_id").cast("long"), "text"))
    plain = [r.doc_id for r in ranked.collect()]
    for most in (1, 5, 40, 1000):
        assert [i for i, _ in pii.training_texts(docs, most)] == plain[:most]
    assert pii.training_texts(docs.where("false"), 5) == []


def test_field_finds_what_patterns_miss():
    rng = random.Random(4)
    texts = [(i, f"{t} 4111111111111111 word a{i}@mail.example.com more +1 (017) 555-77{i % 90 + 10}") for i, t in enumerate(passages(1, 120))]
    field = pii.train_field(texts)
    found = total = 0
    for i, text in texts:
        changed, spans = pii.altered(text, pii.base_spans(text), rng)
        base = pii.base_spans(changed)
        added = pii.field_spans(field, changed, base)
        for kind, a, b in spans:
            if not any(x < b and a < y for _, x, y in base):
                total += 1
                found += any(k == kind and x < b and a < y for k, x, y in added)
    assert total > 20 and found / total > 0.8


def test_exact_groups(spark, awkward, empty):
    texts = [*AWKWARD, "a  b\tc", "a b c", "a b  c", "x" * 300 + "1", "x" * 300 + "2"]
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = {i: (g[0], len(g), i == g[0], hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for i in g}
    docs = docs_of(spark, texts)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs).collect()}
    assert got == want
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {g[0] for g in groups.values()}
    assert exact_dedup.exact_groups(empty).count() == 0


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        now = [i]
        for j, x in enumerate(t, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != x)))
        row = now
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(2)
    for _ in range(800):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(a, 10))) for a in (1, 0))
        assert decontaminate.best_end(decontaminate.Item(0, p, 0, 1).masks, len(p), t)[0] == distance(p, t)


def test_benchmark_matches(spark, awkward, empty):
    rng = random.Random(3)
    items = [(i, t) for i, t in enumerate(passages(11, 12)) if len(t) > 60]
    texts = passages(12, 40)
    for n, (_, item) in enumerate(items):
        changed = list(item)
        for _ in range(int(len(item) * 0.03)):
            changed[rng.randrange(len(changed))] = rng.choice(["", "q", "zz"])
        texts[n] = f"before {''.join(changed) if n % 2 else item.upper()} after"
    bench = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    docs = docs_of(spark, texts + AWKWARD)
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.benchmark_matches(docs, bench).collect()}
    want = {}
    for d, text in enumerate(texts + AWKWARD[:6]):
        for i, item in items:
            one = decontaminate.Item(i, item, decontaminate.ERROR_RATE, decontaminate.LEAST_PIECE)
            best = distance(one.text, decontaminate.lowered(text or "")) if d < 40 else len(one.text)
            if best <= one.budget:
                want[d, i] = best
    assert got == want and len(want) >= len(items)
    clean = decontaminate.keep_uncontaminated(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(range(len(texts + AWKWARD))) - {d for d, _ in want}
    assert decontaminate.benchmark_matches(docs, bench.limit(0)).count() == decontaminate.benchmark_matches(empty, bench).count() == 0


def test_repeated_spans(spark, awkward, empty):
    passage = " ".join(f"w{i}" + ("." if i % 9 == 8 else "") for i in range(60)) + "."
    texts = passages(21, 30)
    for n in (4, 9, 17):
        words = texts[n].split()
        texts[n] = " ".join([*words[:2], passage, *words[2:]])
    docs = docs_of(spark, texts + [None, "", "The.\nThe.\nThe."])
    spans = line_dedup.repeated_spans(docs).collect()
    assert {r.doc_id for r in spans} == {9, 17} and all(r.first_doc_id == 4 for r in spans)
    for r in spans:
        cut = texts[r.doc_id][r.start : r.stop]
        assert cut in passage and len(cut.split()) >= 40
    left = {r.doc_id: r for r in line_dedup.without_spans(docs, line_dedup.repeated_spans(docs)).collect()}
    assert left[9].text == texts[9][: left[9].removed[0].start] + texts[9][left[9].removed[0].stop :] and left[4].text == texts[4]
    assert line_dedup.repeated_spans(awkward).where("doc_id NOT IN (10, 11)").count() == 0
    assert line_dedup.repeated_spans(empty).count() == 0


def test_oracle_of_exact_dedup_names_the_same_columns(spark, awkward):
    from lucerna.llm.queries import ORACLE_SQL

    assert all(c in ORACLE_SQL["op8_exact_dedup"] for c in exact_dedup.exact_groups(awkward).columns)


def test_components(spark):
    from lucerna.llm.common import connected_components

    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200, 300)] + [(rng.randrange(150), rng.randrange(150)) for _ in range(90)]
    up = list(range(400))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for a, b in edges if a != b for i in (a, b)}
    assert F
