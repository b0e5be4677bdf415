"""Text, dates, hashes, predicates and sources over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as n
from ..functions import text as t
from ..functions import words as w
from ..functions.udfs import decomposed as with_marks_apart
from ..functions.udfs import xxh32
from ..operators.chunking import chunk_pages, fixed_chunks, line_blocks, register_chunker
from ..operators import retrieval as r
from ..operators.retrieval import lexed, route, word_counts
from ..sources import files, urls
from . import query, table
from .lexical_sql import SQL_NORM, SQL_STRIP, decomposed, stems, words_of
from .lexical_sql import sql_list as _sql_list


def _sql_any(column: str, items: list[str]) -> str:
    return f"len(list_filter({_sql_list(items)}, lambda m: contains({column}, m))) > 0"


def _sql_starts(column: str, items: list[str]) -> str:
    return f"len(list_filter({_sql_list(items)}, lambda m: starts_with({column}, m))) > 0"


@query(f"SELECT doc_id, sha256({SQL_NORM}) AS digest, length({SQL_NORM}) AS chars FROM (SELECT doc_id, {decomposed('text')} AS text FROM documents)")
def str01_normalize(spark, d):
    norm = t.normalize(with_marks_apart(F.col("text")))
    return table(spark, d, "documents").select("doc_id", n.text_hash(norm).alias("digest"), F.length(norm).cast("long").alias("chars"))


@query(
    f"WITH {words_of('documents', 'doc_id')}, {stems('w')}, l AS (SELECT row_no, list(stem ORDER BY place) AS tk FROM w JOIN stems USING (word) GROUP BY 1) "
    "SELECT doc_id, coalesce(len(tk), 0) AS tokens, sha256(coalesce(array_to_string(tk, ' '), '')) AS digest FROM w_list LEFT JOIN l USING (row_no)"
)
def str02_lex_tokens(spark, d):
    rows = lexed(table(spark, d, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.size("terms").cast("long").alias("tokens"), n.text_hash(F.array_join("terms", " ")).alias("digest"))


@query(f"WITH {words_of('documents', 'doc_id')}, {stems('w')} SELECT stem AS term, count(*) AS n FROM w JOIN stems USING (word) GROUP BY 1")
def str03_stem_vocabulary(spark, d):
    """Decomposition, lexing and stems over all languages; the stemmer sees each distinct word of a batch once, words are counted before they are exchanged."""
    return vocabulary(spark, d).groupBy("term").agg(F.sum("tf").alias("n"))


def vocabulary(spark, d):
    """term and tf: the stems of every document's words, each once a document."""
    return table(spark, d, "documents").select(F.inline(word_counts(F.col("text"))))


@query(
    f"WITH {words_of('benchmark', 'item_id')}, {stems('w')}, l AS (SELECT row_no, list(stem ORDER BY place) AS tk FROM w JOIN stems USING (word) GROUP BY 1), "
    "b AS (SELECT item_id, CASE WHEN coalesce(len(tk), 0) < 2 THEN [] ELSE list_transform(range(1, len(tk)), lambda i: tk[i] || '_' || tk[i + 1]) END AS bg FROM w_list LEFT JOIN l USING (row_no)) "
    "SELECT item_id, len(bg) AS bigrams, sha256(array_to_string(bg, ' ')) AS digest FROM b"
)
def str04_bigrams(spark, d):
    rows = lexed(table(spark, d, "benchmark").select("item_id", "text")).select("item_id", t.ngrams(F.col("terms")).alias("bg"))
    return rows.select("item_id", F.size("bg").cast("long").alias("bigrams"), n.text_hash(F.array_join("bg", " ")).alias("digest"))


_first = SQL_STRIP.format(f"array_to_string(string_split({SQL_STRIP.format('text')}, chr(10))[1:3], ' ')")
SQL_ZONE = (
    rf"CASE WHEN {SQL_STRIP.format('text')} = '' THEN 'body' WHEN {_sql_any(f'upper({_first})', w.TITLE_MARKS)} THEN 'title' "
    rf"WHEN {_sql_starts(f'lower({_first})', w.METADATA_PREFIXES)} THEN 'metadata' WHEN {_sql_starts(f'lower({_first})', w.SUMMARY_PREFIXES)} THEN 'summary' "
    rf"WHEN regexp_matches({SQL_STRIP.format('text')}, '^(?:#+\s+|[A-Z0-9\s:\-]{{4,50}}\n)') THEN 'header' ELSE 'body' END"
)


@query(
    f"SELECT doc_id, z AS zone, CASE z WHEN 'title' THEN 2.0 WHEN 'header' THEN 1.5 WHEN 'summary' THEN 1.3 WHEN 'metadata' THEN 0.8 ELSE 1.0 END::DOUBLE AS weight "
    f"FROM (SELECT doc_id, {SQL_ZONE} AS z FROM (SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'Chapter 1' || chr(10) WHEN 2 THEN 'ISBN: 1 ' WHEN 3 THEN 'Summary: ' ELSE '' END || text AS text FROM documents))"
)
def str05_zones(spark, d):
    lead = F.when(F.col("doc_id") % 5 == 1, "Chapter 1\n").when(F.col("doc_id") % 5 == 2, "ISBN: 1 ").when(F.col("doc_id") % 5 == 3, "Summary: ").otherwise("")
    rows = table(spark, d, "documents").select("doc_id", t.zone(F.concat(lead, F.col("text")), F.lit(1)).alias("zone"))
    return rows.withColumn("weight", t.zone_weight(F.col("zone")))


_cited = "text || ' Seen [Segment ' || (doc_id % 7)::VARCHAR || '] , and [Segment 2].'"


def _with_marks(spark, d):
    marks = F.concat(F.lit(" Seen [Segment "), (F.col("doc_id") % 7).cast("string"), F.lit("] , and [Segment 2]."))
    return table(spark, d, "documents").select("doc_id", F.concat("text", marks).alias("answer"))


@query(rf"SELECT doc_id, array_to_string(regexp_extract_all({_cited}, '\[Segment\s+(\d+)\]', 1), ',') AS cited FROM documents")
def str07_citations(spark, d):
    return _with_marks(spark, d).select("doc_id", F.array_join(t.citations(F.col("answer")).cast("array<string>"), ",").alias("cited"))


SQL_TIDY = r"regexp_replace(regexp_replace({0}, '[ \t]{{2,}}', ' ', 'g'), ' ([.,;:!?])', '\1', 'g')"


@query(
    "SELECT doc_id, CASE WHEN k BETWEEN 1 AND 3 THEN '' ELSE k::VARCHAR END AS dropped, sha256(CASE WHEN k BETWEEN 1 AND 3 THEN a ELSE "
    + SQL_TIDY.format(r"replace(a, '[Segment ' || k::VARCHAR || ']', '')")
    + f" END) AS digest FROM (SELECT doc_id, doc_id % 7 AS k, {_cited} AS a FROM documents)"
)
def str08_invalid_citations(spark, d):
    rows = _with_marks(spark, d).select("doc_id", t.strip_invalid_citations(F.col("answer"), F.lit(3)).alias("r"))
    return rows.select("doc_id", F.array_join(F.col("r.dropped").cast("array<string>"), ",").alias("dropped"), n.text_hash(F.col("r.text")).alias("digest"))


@query("SELECT doc_id, sha256(" + SQL_TIDY.format(rf"regexp_replace({_cited}, '\[Segment\s+(\d+)\]', '', 'g')") + ") AS digest FROM documents")
def str09_strip_citations(spark, d):
    return _with_marks(spark, d).select("doc_id", n.text_hash(t.strip_citations(F.col("answer"))).alias("digest"))


@query(
    r"SELECT doc_id, sha256(regexp_replace(regexp_replace(a, '(?is)<\s*think\b[^>]*>.*?<\s*/\s*think\s*>', '', 'g'), '(?is)<\s*think\b[^>]*>.*$', '')) AS digest "
    "FROM (SELECT doc_id, '<think>hm' || text || '</Think >' || text || CASE WHEN doc_id % 3 = 0 THEN '< think x=1>cut' ELSE '' END AS a FROM documents)"
)
def str10_think_blocks(spark, d):
    tail = F.when(F.col("doc_id") % 3 == 0, "< think x=1>cut").otherwise("")
    answer = F.concat(F.lit("<think>hm"), "text", F.lit("</Think >"), "text", tail)
    return table(spark, d, "documents").select("doc_id", n.text_hash(t.strip_think(answer)).alias("digest"))


@query(
    "SELECT conv_id, turn, CASE WHEN length(x) < 20 THEN 'ABSTAIN' ELSE x END AS answer FROM (SELECT conv_id, turn, "
    + SQL_STRIP.format(rf"regexp_replace({SQL_STRIP.format('a')}, '(?:(?:^|\s+)ABSTAIN\.*)+$', '')")
    + " AS x FROM (SELECT conv_id, turn, text || CASE turn % 3 WHEN 0 THEN ' ABSTAIN.' WHEN 1 THEN chr(10) || 'ABSTAIN ABSTAIN' ELSE '' END AS a FROM conversations))"
)
def str11_strip_abstain(spark, d):
    tail = F.when(F.col("turn") % 3 == 0, " ABSTAIN.").when(F.col("turn") % 3 == 1, "\nABSTAIN ABSTAIN").otherwise("")
    return table(spark, d, "conversations").select("conv_id", "turn", t.strip_abstain(F.concat("text", tail)).alias("answer"))


@query(
    "SELECT conv_id, turn, CASE WHEN length(x) < 20 THEN " + SQL_STRIP.format("'[CONTEXT] c [ANSWER] Answer: ' || text || ' [REASONING] r'")
    + " ELSE x END AS answer FROM (SELECT conv_id, turn, text, " + SQL_STRIP.format("text") + " AS x FROM conversations)"
)
def str12_final_answer(spark, d):
    answer = F.concat(F.lit("[CONTEXT] c [ANSWER] Answer: "), "text", F.lit(" [REASONING] r"))
    return table(spark, d, "conversations").select("conv_id", "turn", t.final_answer(answer).alias("answer"))


@query(r"SELECT page_id, left(regexp_replace(url || chr(10) || chr(9) || html, '[\p{C}\p{Zl}\p{Zp}]|[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]', '', 'g'), 80) AS label FROM pages")
def str13_labels(spark, d):
    return table(spark, d, "pages").select("page_id", t.label(F.concat("url", F.lit("\n\t"), "html")).alias("label"))


SQL_PREFIX = r"array_to_string(string_split_regex(" + SQL_STRIP.format(r"regexp_replace(lower(text), '[^a-z0-9\s]', '', 'g')") + r", '\s+')[1:20], ' ')"


@query(f"SELECT doc_id, {SQL_PREFIX} AS prefix FROM documents")
def str14_prefix_key(spark, d):
    return table(spark, d, "documents").select("doc_id", t.prefix_key(F.col("text")).alias("prefix"))


@query()
def str15_prune_context(spark, d):
    pruned = t.prune_context(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(pruned).alias("chars"), n.text_hash(pruned).alias("digest"))


SQL_SENTENCES = r"list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: " + SQL_STRIP.format("s") + ")"


@query(f"SELECT doc_id, len(s) AS sentences, sha256(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, list_filter({SQL_SENTENCES}, lambda s: length(s) > 40) AS s FROM documents)")
def str16_sentences(spark, d):
    rows = table(spark, d, "documents").select("doc_id", t.long_sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("sentences"), n.text_hash(F.array_join("s", "|")).alias("digest"))


_verbs = _sql_list(w.PREDICATES)


@query(
    rf"""
    WITH c AS (SELECT conv_id, turn, text FROM conversations),
    p AS (SELECT conv_id, turn, list_filter(string_split_regex(regexp_replace({SQL_STRIP.format('text')}, '\.+$', ''), '\s+'), lambda x: x <> '') AS v FROM c),
    q AS (SELECT *, list_filter(list_transform({_verbs}, lambda p: coalesce(list_position(list_transform(v[2:len(v) - 1], lambda x: lower(x)), p), 0)), lambda i: i > 0)[1] + 1 AS i FROM p)
    SELECT conv_id, turn, CASE WHEN len(v) = 0 THEN NULL WHEN i IS NOT NULL THEN array_to_string(v[1:i - 1], ' ') WHEN len(v) >= 4 THEN array_to_string(v[1:2], ' ') ELSE v[1] END AS subject,
        CASE WHEN i IS NOT NULL THEN v[i] WHEN len(v) >= 4 THEN v[3] END AS predicate,
        CASE WHEN i IS NOT NULL THEN array_to_string(v[i + 1:], ' ') WHEN len(v) >= 4 THEN array_to_string(v[4:], ' ') END AS object FROM q
    """
)
def str17_triples(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", t.claim_triple(F.col("text")).alias("t")).select("conv_id", "turn", "t.*")


_names = [x for v in w.VERDICT_NAMES.values() for x in v] + ["maybe", "s", "Supported.", "n/a;", " refuted "]


@query(
    "WITH x AS (SELECT event_id, " + _sql_list(_names) + f"[(event_id % {len(_names)}) + 1] AS said FROM events), y AS (SELECT event_id, regexp_replace(upper(trim(said)), '[.:;!,]+$', '') AS k FROM x) "
    f"SELECT event_id, CASE WHEN k IN {tuple(w.VERDICT_NAMES['SUPPORTED'])} THEN 'SUPPORTED' WHEN k IN {tuple(w.VERDICT_NAMES['CONTRADICTED'])} THEN 'CONTRADICTED' ELSE 'NEUTRAL' END AS verdict FROM y"
)
def str18_verdict_names(spark, d):
    said = F.element_at(F.array(*[F.lit(x) for x in _names]), (F.col("event_id") % len(_names) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", t.verdict(said).alias("verdict"))


@query(r"SELECT event_id, array_to_string(list_distinct_keep, ',') AS segments FROM (SELECT event_id, list_transform(list_filter(list_transform(range(1, len(x) + 1), lambda i: {'v': x[i], 'i': i}), lambda s: list_position(x, s.v) = s.i), lambda s: s.v) AS list_distinct_keep FROM (SELECT event_id, list_transform(regexp_extract_all(props || ' Segment ' || event_type || ' 2 and ' || props, '-?\d+'), lambda v: v::BIGINT::VARCHAR) AS x FROM events))")
def str19_segment_lists(spark, d):
    items = F.array("props", F.concat(F.lit("Segment "), "event_type", F.lit(" 2 and ")), "props")
    return table(spark, d, "events").select("event_id", F.array_join(t.segment_list(items).cast("array<string>"), ",").alias("segments"))


@query(r"SELECT event_id, coalesce(try_cast(regexp_extract(props, '-?\d+', 0) AS BIGINT), 0) AS claim_id FROM events")
def str20_claim_ids(spark, d):
    return table(spark, d, "events").select("event_id", t.claim_id(F.col("props")).alias("claim_id"))


_q = r"regexp_replace({0}, '^[\x22\x27`]+|[\x22\x27`]+$', '', 'g')"
_low = "lower(r)"
_echo = f"({_sql_any(_low, w.ECHO_MARKS)} OR {_sql_starts(_low, w.ECHO_PREFIXES)} OR len(list_filter(string_split_regex(r, '\\s+'), lambda x: x <> '')) > 20)"


@query(
    f"WITH a AS (SELECT conv_id, turn, {SQL_STRIP.format('text')} AS b FROM conversations), b AS (SELECT conv_id, turn, "
    + SQL_STRIP.format(r"regexp_replace(" + _q.format(SQL_STRIP.format(_q.format("b"))) + r", '\s+', ' ', 'g')")
    + f" AS r FROM a) SELECT conv_id, turn, CASE WHEN r <> '' AND {_echo} THEN '' ELSE r END AS rewritten FROM b"
)
def str21_rewrites(spark, d):
    raw = F.concat(F.lit('"Search query: '), t.strip(F.col("text")), F.lit('"'))
    return table(spark, d, "conversations").select("conv_id", "turn", t.sanitize_rewrite(raw).alias("rewritten"))


@query(r"SELECT page_id, CASE WHEN x = '' THEN '/' ELSE x END AS path FROM (SELECT page_id, regexp_replace(regexp_replace('/api/' || page_id::VARCHAR || '/' || md5(url)[1:24] || '/d', '/[0-9a-fA-F]{24}(/|$)', '/:id\1', 'g'), '/\d+(/|$)', '/:id\1', 'g') AS x FROM pages)")
def str22_path_templates(spark, d):
    path = F.concat(F.lit("/api/"), F.col("page_id").cast("string"), F.lit("/"), F.substring(F.md5(F.encode("url", "UTF-8")), 1, 24), F.lit("/d"))
    return table(spark, d, "pages").select("page_id", t.path_template(path).alias("path"))


_red = "text || ' key sk-' || sha256(text)[1:24] || ' Bearer ' || md5(text)"
for _p in w.SECRETS:
    _red = f"regexp_replace({_red}, '{_p}', '[REDACTED]', 'g')"


@query(f"SELECT doc_id, sha256({_red}) AS digest FROM documents")
def str23_secrets(spark, d):
    raw = F.concat("text", F.lit(" key sk-"), F.substring(n.text_hash(F.col("text")), 1, 24), F.lit(" Bearer "), F.md5(F.encode("text", "UTF-8")))
    return table(spark, d, "documents").select("doc_id", n.text_hash(t.redact_secrets(raw)).alias("digest"))


@query("SELECT doc_id, sha256('[' || source || ' | ' || upper(lang) || '] ' || text) AS digest FROM documents")
def str25_embedding_text(spark, d):
    return table(spark, d, "documents").select("doc_id", n.text_hash(t.embedding_text(F.col("source"), F.col("lang"), F.col("text"))).alias("digest"))


@query("SELECT doc_id, least(greatest(greatest(1, length(text) // 4) + 600 + 512, 1024), 8192)::BIGINT AS num_ctx FROM documents")
def str26_context_window(spark, d):
    return table(spark, d, "documents").select("doc_id", t.context_window(t.token_estimate(F.col("text")), F.lit(600), 8192).cast("long").alias("num_ctx"))


@query(
    "WITH x AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_name || '!pass' WHEN 2 THEN 'short1!A' ELSE c_name || ' ' || c_name || c_name || c_name || c_name || '!' END AS p FROM customer) "
    r"SELECT c_custkey, length(p) >= 12 AND octet_length(encode(p)) <= 72 AND regexp_matches(p, '[A-Z]') AND regexp_matches(p, '[a-z]') AND regexp_matches(p, '\d') AND regexp_matches(p, '[!@#$%^&*()_+\-=\[\]{};'':\x22\\|,.<>/?]') AS ok FROM x"
)
def str27_passwords(spark, d):
    name = F.col("c_name")
    p = F.when(F.col("c_custkey") % 4 == 0, name).when(F.col("c_custkey") % 4 == 1, F.concat(name, F.lit("!pass"))).when(F.col("c_custkey") % 4 == 2, "short1!A")
    p = p.otherwise(F.concat(name, F.lit(" "), name, name, name, name, F.lit("!")))
    return table(spark, d, "customer").select("c_custkey", t.password_ok(p).alias("ok"))


@query("SELECT conv_id, turn, greatest(1, length(text) // 4)::INT AS tokens, greatest(1, length(text) // 4) > 400 AS rejected FROM conversations")
def fil12_token_budget(spark, d):
    tokens = t.token_estimate(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", tokens.alias("tokens"), (tokens > 400).alias("rejected"))


_meta = "CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN text || ' segment 2 says' WHEN 2 THEN '[Segment 3] ' || text ELSE 'The user asks for ' || text END"


@query(
    f"SELECT conv_id, turn, starts_with(l, '#') OR {_sql_any('l', w.META_MARKS + w.META_PHRASES)} OR regexp_matches(l, '(?:^|[^\\[a-z0-9_])segments?\\s+\\d') OR regexp_matches(l, '\\bpage\\s+\\d') "
    f"OR regexp_matches(l, '\\bpath\\s+[a-c0-9]\\b') AS is_meta FROM (SELECT conv_id, turn, {SQL_STRIP.format(f'lower({_meta})')} AS l FROM conversations)"
)
def fil13_meta_claims(spark, d):
    k, text = F.col("turn") % 4, F.col("text")
    said = F.when(k == 0, text).when(k == 1, F.concat(text, F.lit(" segment 2 says"))).when(k == 2, F.concat(F.lit("[Segment 3] "), text)).otherwise(F.concat(F.lit("The user asks for "), text))
    return table(spark, d, "conversations").select("conv_id", "turn", t.is_meta_claim(said).alias("is_meta"))


_refusals = "|".join(w.REFUSALS).replace("'", "''")


@query(f"SELECT conv_id, turn, {SQL_STRIP.format('a')} = 'ABSTAIN' OR regexp_matches(lower(a), '{_refusals}') AS refuses FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN 'There is Insufficient evidence. ' || text ELSE ' ABSTAIN ' END AS a FROM conversations)")
def fil14_refusals(spark, d):
    k = F.col("turn") % 3
    answer = F.when(k == 0, F.col("text")).when(k == 1, F.concat(F.lit("There is Insufficient evidence. "), "text")).otherwise(" ABSTAIN ")
    return table(spark, d, "conversations").select("conv_id", "turn", t.is_refusal(answer).alias("refuses"))


@query(
    rf"""
    WITH s AS (SELECT doc_id, unnest(list_transform(string_split(replace(lower(text), chr(10), ' '), '. '), lambda x: {SQL_STRIP.format('x')})) AS s FROM documents),
    r AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, s FROM s WHERE length(s) >= 40 GROUP BY 1, 2 HAVING count(*) >= 3))
    SELECT d.doc_id, {_sql_any('lower(d.text)', w.SCAFFOLD_MARKS)} OR r.doc_id IS NOT NULL AS loops FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id
    """
)
def fil15_scaffold_echo(spark, d):
    return table(spark, d, "documents").select("doc_id", t.is_scaffold_echo(F.col("text")).alias("loops"))


@query(f"SELECT conv_id, turn, r <> '' AND {_echo} AS echoes FROM (SELECT conv_id, turn, text AS r FROM conversations)")
def fil16_instruction_echo(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", t.is_instruction_echo(F.col("text")).alias("echoes"))


@query(
    "SELECT conv_id, turn, status = 'FAILED' AND claims = 0 AND NOT regexp_full_match(text, '\\s*ABSTAIN\\s*') AND words < 5 AS stub FROM (SELECT conv_id, turn, text, words, words // 12 AS claims, "
    "CASE WHEN words < 12 THEN 'FAILED' ELSE 'TRUSTED' END AS status FROM (SELECT conv_id, turn, text, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS words FROM conversations))"
)
def fil17_stubs(spark, d):
    """Claims as many as dozens of words, the status failed without any: stubs are the turns of under five words."""
    claims = F.floor(t.word_count(F.col("text")) / 12)
    status = F.when(claims == 0, "FAILED").otherwise("TRUSTED")
    return table(spark, d, "conversations").select("conv_id", "turn", t.is_degenerate_stub(status, claims, F.col("text")).alias("stub"))


# ---- dates, hashes, content checks ----

_dated = "CASE doc_id % 3 WHEN 0 THEN 'Effective From:  2024-0' || (doc_id % 9 + 1)::VARCHAR || '-1' || (doc_id % 10)::VARCHAR || chr(10) WHEN 1 THEN 'effective from: 2026-02-30 effective until: 2027-12-31 ' ELSE '' END || text"


@query(
    rf"SELECT doc_id, try_cast(nullif(regexp_extract(left({_dated}, 2000), '(?i)effective\s+from:\s*(\d{{4}}-\d{{2}}-\d{{2}})', 1), '') AS TIMESTAMP) AS effective_from, "
    rf"try_cast(nullif(regexp_extract(left({_dated}, 2000), '(?i)effective\s+until:\s*(\d{{4}}-\d{{2}}-\d{{2}})', 1), '') AS TIMESTAMP) AS effective_until FROM documents"
)
def dat01_effective_dates(spark, d):
    k = F.col("doc_id")
    lead = F.when(k % 3 == 0, F.concat(F.lit("Effective From:  2024-0"), (k % 9 + 1).cast("string"), F.lit("-1"), (k % 10).cast("string"), F.lit("\n")))
    text = F.concat(lead.when(k % 3 == 1, "effective from: 2026-02-30 effective until: 2027-12-31 ").otherwise(""), F.col("text"))
    rows = table(spark, d, "documents").select("doc_id", *[n.effective_date(text, e).cast("timestamp_ntz").alias(f"effective_{e}") for e in ("from", "until")])
    return rows


@query(r"SELECT conv_id, turn, try_cast(nullif(regexp_extract(text || ' in ' || (1890 + conv_id % 150)::VARCHAR || ' ?', '\b((?:19|20)\d{2})\b', 1), '') || '-07-01' AS TIMESTAMP) AS reference_time FROM conversations")
def dat02_reference_time(spark, d):
    text = F.concat("text", F.lit(" in "), (1890 + F.col("conv_id") % 150).cast("string"), F.lit(" ?"))
    return table(spark, d, "conversations").select("conv_id", "turn", n.reference_time(text).cast("timestamp_ntz").alias("reference_time"))


@query("SELECT doc_id, sha256(text) AS text_hash, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS point_id, sha256(source || chr(0) || text)[1:32] AS rerank_key, sha256('document:m1:' || lower(trim(text))) AS cache_key FROM (SELECT *, sha256(doc_id::VARCHAR || '_' || '3') AS h FROM documents)")
def hsh02_ids(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", n.text_hash(F.col("text")).alias("text_hash"), n.point_id(F.col("doc_id"), F.lit(3)).alias("point_id"),
        n.rerank_key(F.col("source"), F.col("text")).alias("rerank_key"), n.cache_key(F.col("text"), "m1").alias("cache_key"),
    )


@query()
def mat05_hashed_terms(spark, d):
    """The hashed vocabulary: each stem's index modulo a million, and how many stems share it."""
    stems_ = vocabulary(spark, d).select("term").distinct()
    return stems_.select((xxh32("term") % 1_000_000).alias("idx")).groupBy("idx").agg(F.count(F.lit(1)).alias("terms"))


@query("SELECT doc_id, length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) < 50 AS needs_ocr FROM documents")
def src08_ocr_gate(spark, d):
    return table(spark, d, "documents").select("doc_id", files.needs_ocr(F.col("text")).alias("needs_ocr"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN starts_with(c, '%PDF') WHEN 1 THEN starts_with(c, 'GIF87a') OR starts_with(c, 'GIF89a') ELSE true END AS ok FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '%PDF' WHEN doc_id % 5 = 0 THEN 'GIF89a' ELSE '' END || text AS c FROM documents)")
def src10_magic_bytes(spark, d):
    k = F.col("doc_id")
    content = F.encode(F.concat(F.when(k % 2 == 0, "%PDF").when(k % 5 == 0, "GIF89a").otherwise(""), F.col("text")), "UTF-8")
    ext = F.when(k % 3 == 0, ".pdf").when(k % 3 == 1, ".gif").otherwise(".txt")
    return table(spark, d, "documents").select("doc_id", files.magic_ok(ext, content).alias("ok"))


@query("SELECT doc_id, n_chars * 1000 > 268435456 OR (doc_id % 50 > 0 AND n_chars * 1000 / (doc_id % 50) > CASE doc_id % 2 WHEN 0 THEN 50 ELSE 100 END) AS bomb FROM documents")
def src11_bombs(spark, d):
    k = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", files.bomb(F.when(k % 2 == 0, ".pdf").otherwise(".docx"), k % 50, F.col("n_chars") * 1000).alias("bomb"))


@query(f"SELECT doc_id, contains(CASE WHEN doc_id % 9 = 0 THEN text || '{files.TEST_STRING}' ELSE text END, '{files.TEST_STRING}') AS malware FROM documents")
def src12_malware(spark, d):
    text = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(files.TEST_STRING))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", files.has_test_string(F.encode(text, "UTF-8")).alias("malware"))


@query()
def src05_html_text(spark, d):
    """General HTML, entities and all."""
    return table(spark, d, "pages").select("page_id", n.text_hash(files.html_columns(F.col("html"), entities=True)).alias("digest"))


SQL_HTML = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', chr(1), 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', chr(1), 'g'), "
    r"'(?s)<!--.*?-->|<![^>]*>', chr(1), 'g'), '(?i)<(?:p|br|div|h1|h2|h3|h4|li|tr)(?:[\s/][^>]*)?>', chr(1) || chr(2) || chr(1), 'g'), '<[^>]*>', chr(1), 'g')"
)


@query(
    "SELECT page_id, sha256(" + SQL_STRIP.format(r"regexp_replace(replace(array_to_string(x, ' '), chr(2), chr(10)), '\n\s*\n+', chr(10) || chr(10), 'g')") + ") AS digest FROM (SELECT page_id, list_filter(list_transform(string_split("
    + SQL_HTML + ", chr(1)), lambda s: " + SQL_STRIP.format("s") + "), lambda s: s <> '') AS x FROM pages)"
)
def src05_html_columns(spark, d):
    return table(spark, d, "pages").select("page_id", n.text_hash(files.html_columns(F.col("html"))).alias("digest"))


_url = "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'http://127.0.0.1/x' WHEN 2 THEN 'javascript:alert(1)' WHEN 3 THEN 'https://10.0.0.8:80/' ELSE ' https://Data.Internal/y ' END"


@query(
    rf"SELECT page_id, CASE WHEN s IN ('http', 'https') AND h <> '' AND NOT (h IN {tuple(urls.BLOCKED_HOSTS)} OR h LIKE '%.internal' OR h LIKE '%.local' OR (regexp_matches(h, '{urls.QUAD}') AND regexp_matches(h, '{urls.PRIVATE}')) OR regexp_matches(h, '^\[(?:::1?|f[cd]|fe[89ab])')) THEN trim(u) ELSE '' END AS url "
    rf"FROM (SELECT page_id, u, lower(regexp_extract(trim(u), '(?i)^([a-z][a-z0-9+.-]*)://', 1)) AS s, lower(regexp_extract(trim(u), '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#\s]*)', 1)) AS h FROM (SELECT page_id, {_url} AS u FROM pages))"
)
def src15_sanitize_url(spark, d):
    k = F.col("page_id") % 5
    url = F.when(k == 0, F.col("url")).when(k == 1, "http://127.0.0.1/x").when(k == 2, "javascript:alert(1)").when(k == 3, "https://10.0.0.8:80/").otherwise(" https://Data.Internal/y ")
    return table(spark, d, "pages").select("page_id", urls.sanitize_url(url).alias("url"))


@query("SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'origin is not allowed' WHEN 2 THEN 'scheme is not allowed' WHEN 3 THEN '' WHEN 4 THEN 'origin is not allowed' ELSE 'url is required' END AS reason FROM pages")
def src14_ingestion_urls(spark, d):
    k = F.col("page_id") % 5
    url = F.when(k == 1, "https://other.example/x").when(k == 2, "ftp://docs.example/x").when(k == 3, "https://docs.example:443/x").when(k == 4, "http://docs.example/x").otherwise(" ")
    return table(spark, d, "pages").select("page_id", urls.ingestion_check(url, ["https://docs.example"]).alias("reason"))


@query("SELECT doc_id, greatest(0.5, 0.9 - 0.08 * (doc_id % 10))::DOUBLE AS score FROM documents")
def src16_rank_scores(spark, d):
    from ..operators.retrieval import rank_score

    return table(spark, d, "documents").select("doc_id", F.round(rank_score((F.col("doc_id") % 10).cast("double")), 10).alias("score"))


@query("SELECT doc_id, 'Id: ' || doc_id::VARCHAR || ' | Lang: ' || lang || ' | Col3: ' || source AS line FROM documents")
def src03_csv_lines(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("position"), F.array(F.col("doc_id").cast("string"), F.concat(F.lit(" "), "lang"), "source").alias("values"))
    return files.csv_lines(rows, ["Id", " Lang"]).withColumnRenamed("position", "doc_id")


# ---- routes, chunks ----

_trimmed = "list_filter(list_transform({0}, lambda p: " + SQL_STRIP.format("regexp_replace(" + SQL_STRIP.format("p") + r", '^[?.!]+|[?.!]+$', '', 'g')") + "), lambda p: length(p) >= 2)"
_pair = lambda p: _trimmed.format(f"[regexp_extract(x, '{p}', 1), regexp_extract(x, '{p}', 2)]")


@query(
    f"""
    WITH a AS (SELECT conv_id, turn, text, {SQL_STRIP.format("coalesce(text, '')")} AS x FROM conversations),
    b AS (SELECT *, (CASE WHEN regexp_matches(x, '{r.DIFFERENCE}') THEN {_pair(r.DIFFERENCE)} WHEN regexp_matches(x, '{r.COMPARE}') THEN {_pair(r.COMPARE)}
        WHEN regexp_matches(x, '(?i)\\bvs\\.?\\b') THEN {_trimmed.format("string_split_regex(x, '(?i)\\bvs\\.?\\b')")} ELSE {_trimmed.format("string_split_regex(x, '(?i)\\bversus\\b')")} END)[1:3] AS sides,
        {_trimmed.format("string_split(x, '?')")}[1:3] AS asked, regexp_extract(x, '{r.YEAR}', 1) AS year FROM a),
    c AS (SELECT *, CASE WHEN x = '' THEN 'simple' WHEN regexp_matches(x, '{r.COMPARISON}') THEN CASE WHEN len(sides) >= 2 THEN 'comparison' ELSE 'simple' END
        WHEN year <> '' OR regexp_matches(x, '{r.TEMPORAL}') THEN 'temporal' WHEN len(asked) >= 2 THEN 'complex' ELSE 'simple' END AS route FROM b)
    SELECT conv_id, turn, route, coalesce(array_to_string(CASE route WHEN 'comparison' THEN sides WHEN 'complex' THEN asked ELSE [text] END, '|'), '') AS subs,
        CASE WHEN route = 'temporal' AND year <> '' THEN (year || '-07-01')::TIMESTAMP END AS reference_time FROM c
    """
)
def ret05_routes(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", route(F.col("text")).alias("x"))
    return rows.select("conv_id", "turn", "x.route", F.array_join("x.sub_queries", "|").alias("subs"), F.col("x.reference_time").cast("timestamp_ntz").alias("reference_time"))


@query("SELECT doc_id, (s // 448)::INT AS chunk_index, s::INT AS character_offset, sha256(substring(text, s + 1, 512)) AS digest FROM (SELECT doc_id, text, unnest(range(0, greatest((length(text) - 65) // 448, 0) * 448 + 1, 448)) AS s FROM documents WHERE length(text) > 0)")
def chk01b_fixed_chunks(spark, d):
    rows = fixed_chunks(table(spark, d, "documents").select("doc_id", "text"), F.col("text"))
    return rows.select("doc_id", "chunk_index", "character_offset", n.text_hash(F.col("chunk")).alias("digest"))


def even_steps(text: str, size: int, overlap: int) -> list:
    """A caller's own strategy: windows at fixed steps."""
    step = max(1, size - overlap)
    last = max((len(text) - overlap - 1) // step, 0) * step
    return [(at, text[at : at + size], None) for at in range(0, last + 1, step)] if text else []


@query("SELECT doc_id, (s // 448)::INT AS chunk_no, s::INT AS character_offset, sha256(substring(text, s + 1, 512)) AS digest FROM (SELECT doc_id, text, unnest(range(0, greatest((length(text) - 65) // 448, 0) * 448 + 1, 448)) AS s FROM documents WHERE length(text) > 0)")
def udf01_table_function(spark, d):
    """A strategy of the caller's own, registered by name and called from SQL."""
    register_chunker(spark, "even_steps", even_steps)
    table(spark, d, "documents").createOrReplaceTempView("chunked_documents")
    return spark.sql("SELECT d.doc_id, c.chunk_no, c.character_offset, sha2(c.text, 256) AS digest FROM chunked_documents d, LATERAL even_steps(d.text, 512, 64) c")


def _chunked(name: str, strategy: str):
    def run(spark, d):
        pages = table(spark, d, "documents").select("doc_id", F.lit(1).alias("page"), "text")
        rows = chunk_pages(pages, strategy)
        return rows.select("doc_id", "chunk_index", "character_offset", "zone", n.text_hash(F.col("text")).alias("digest"))

    run.__name__ = name
    query()(run)


for _name, _strategy in (("chk01_sliding", "sliding_window"), ("chk02_semantic", "semantic"), ("chk03_progressive", "progressive"), ("chk04_layout", "layout_aware")):
    _chunked(_name, _strategy)


@query(
    rf"""
    WITH l AS (SELECT doc_id, unnest(range(0, len(x))) AS line, unnest(x) AS said FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
    s AS (SELECT doc_id, line, CASE WHEN contains(said, '|') OR (length(b) > 20 AND length(b) - length(replace(b, ' ', '')) > 3) THEN 'table' ELSE 'text' END AS kind FROM (SELECT *, {SQL_STRIP.format('said')} AS b FROM l) WHERE b <> ''),
    g AS (SELECT *, CASE WHEN lag(kind) OVER w IS NULL OR lag(kind) OVER w <> kind THEN 1 ELSE 0 END AS fresh FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
    b AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line) AS block FROM g)
    SELECT doc_id, block::BIGINT AS block, kind, min(line)::INT AS first_line, count(*) AS lines FROM b GROUP BY ALL
    """
)
def chk04_layout_blocks(spark, d):
    return line_blocks(table(spark, d, "documents"))


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '{\"a\": ' || turn::VARCHAR || '}' WHEN 1 THEN '[1, {\"b\": 2}]' WHEN 2 THEN '{\"c\": [3]}' ELSE 'none ' || turn::VARCHAR END AS payload FROM conversations")
def jsn01_json_substring(spark, d):
    k = F.col("turn") % 4
    c = F.col("turn").cast("string")
    raw = (
        F.when(k == 0, F.concat(F.lit('Sure ```json\n{"a": '), c, F.lit("}\n``` done"))).when(k == 1, 'list: [1, {"b": 2}] end').when(k == 2, 'so {"c": [3]} ok').otherwise(F.concat(F.lit(" none "), c))
    )
    return table(spark, d, "conversations").select("conv_id", "turn", t.json_substring(raw).alias("payload"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'credentials' WHEN 1 THEN 'quota' WHEN 2 THEN 'server' WHEN 3 THEN 'credentials' ELSE NULL END AS failure FROM events")
def obs01_provider_failures(spark, d):
    k = F.col("event_id") % 5
    status = F.when(k == 0, 401).when(k == 1, 429)
    said = F.when(k == 2, "Service Unavailable").when(k == 3, "PermissionDenied: no").otherwise("could not parse")
    return table(spark, d, "events").select("event_id", t.provider_failure(status, said).alias("failure"))
