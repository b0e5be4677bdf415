"""Text functions as column expressions.

Everything here stays in the JVM. The two steps that Spark has no function for, compatibility decomposition and
stemming, are Arrow UDFs in `lucerna.functions.udfs`; ASCII text needs the former not at all.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as w

TOKEN = r"(?<![\p{L}\p{N}_])[a-z0-9]+(?:-[a-z0-9]+)*(?![\p{L}\p{N}_])"
CITATION = r"\[Segment\s+(\d+)\]"


def contains_any(text: Column, marks: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(m) for m in marks])


def starts_with_any(text: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.startswith(p) for p in prefixes])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize(text: Column) -> Column:
    """STR-01 after decomposition: glyphs out, line-break hyphens joined, lower case, contractions, white space."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\uF000-\uFFFF\u2022\u2023\u25CF\u25CB\u25AA\u25AB]", " ")
    out = F.regexp_replace(out, r"([\p{L}\p{N}_]+)-\s*\n\s*([\p{L}\p{N}_]+)", "$1$2")
    out = F.lower(out)
    for short, long in w.CONTRACTIONS:
        out = F.replace(out, F.lit(short), F.lit(long))
    out = F.regexp_replace(out, r"[ \t\r\f\x0B]+", " ")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def stopwords(is_query: bool = False) -> list[str]:
    """SET-04: the lists united for questions."""
    return sorted({*w.CORE_STOPWORDS, *w.QUERY_STOPWORDS}) if is_query else sorted(w.CORE_STOPWORDS)


def tokens(normalized: Column, is_query: bool = False) -> Column:
    """STR-02 without stemming: words of normalised text, less stop words and single letters."""
    # Stop words that hold an apostrophe never equal a token, so the list that travels is short.
    stop = [x for x in stopwords(is_query) if "'" not in x]
    found = F.regexp_extract_all(normalized, F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(stop) & ((F.length(t) > 1) | t.rlike("^[0-9]$")))


def ngrams(items: Column, n: int = 2) -> Column:
    """STR-04: runs of n neighbours joined by underscores; empty if there are fewer."""
    count = F.size(items) - (n - 1)
    return F.when(
        count >= 1,
        F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(items, i, n), "_")),
    ).otherwise(F.array().cast("array<string>"))


def zone(text: Column, page: Column) -> Column:
    """STR-05: title, metadata, summary, header or body, the first that fits."""
    body = strip(text)
    first = strip(F.array_join(F.slice(F.split(body, "\n"), 1, 3), " "))
    low = F.lower(first)
    return (
        F.when(body == "", "body")
        .when((page == 1) & contains_any(F.upper(first), w.TITLE_MARKS), "title")
        .when(starts_with_any(low, w.METADATA_PREFIXES), "metadata")
        .when(starts_with_any(low, w.SUMMARY_PREFIXES), "summary")
        .when(body.rlike(r"^(?:#+\s+|[A-Z0-9\s:\-]{4,50}\n)"), "header")
        .otherwise("body")
    )


def zone_weight(zone_name: Column) -> Column:
    """STR-06."""
    table = F.create_map(*[F.lit(x) for pair in w.ZONE_WEIGHTS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, zone_name), F.lit(1.0))


def citations(answer: Column) -> Column:
    """STR-07: segment numbers in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(CITATION), F.lit(1)), lambda x: x.try_cast("int"))


def _tidy(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r" ([.,;:!?])", "$1")


def strip_citations(answer: Column) -> Column:
    """STR-09: without any marker; spaces are tidied only where one went."""
    cleaned = F.regexp_replace(answer, CITATION, "")
    return F.when(cleaned == answer, answer).otherwise(_tidy(cleaned))


def strip_invalid_citations(answer: Column, served: Column) -> Column:
    """STR-08: (text, dropped): markers outside 1..served go. Splitting at markers keeps it in the JVM."""
    numbers = citations(answer)
    parts = F.split(answer, CITATION)
    marks = F.regexp_extract_all(answer, F.lit(CITATION), F.lit(0))
    valid = lambda n: (n >= 1) & (n <= served)
    tail = F.zip_with(
        F.zip_with(marks, numbers, lambda m, n: F.when(valid(n), m).otherwise("")),
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda m, t: F.concat(F.coalesce(m, F.lit("")), F.coalesce(t, F.lit(""))),
    )
    joined = F.concat(F.element_at(parts, 1), F.array_join(tail, ""))
    dropped = F.filter(numbers, lambda n: ~valid(n))
    return F.struct(F.when(F.size(dropped) > 0, _tidy(joined)).otherwise(answer).alias("text"), dropped.alias("dropped"))


def strip_think(answer: Column) -> Column:
    """STR-10: closed reasoning blocks, then what follows an unclosed opener."""
    names = "(think|thinking|thought|reasoning)"
    closed = F.regexp_replace(answer, rf"(?is)<\s*{names}\b[^>]*>.*?<\s*/\s*\1\s*>", "")
    return F.regexp_replace(closed, rf"(?is)<\s*{names}\b[^>]*>.*$", "")


def strip_abstain(answer: Column) -> Column:
    """STR-11: a trailing ABSTAIN goes; fewer than 20 characters left are ABSTAIN."""
    text = F.regexp_replace(strip(answer), r"(?:(?:^|\s+)ABSTAIN\.*)+$", "")
    text = strip(text)
    return F.when(F.coalesce(answer, F.lit("")) == "", answer).when(F.length(text) < 20, "ABSTAIN").otherwise(text)


def final_answer(answer: Column) -> Column:
    """STR-12: what follows the last section marker, up to the first scaffold block; short results keep the original."""
    text = F.when(
        answer.contains(w.ANSWER_MARKS[0]), F.substring_index(answer, w.ANSWER_MARKS[0], -1)
    ).when(answer.contains(w.ANSWER_MARKS[1]), F.substring_index(answer, w.ANSWER_MARKS[1], -1)).otherwise(answer)
    # ASCII letters alone: the capital form of others can be longer, which would move the place.
    upper = F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    cut = F.least(*[F.when(F.locate(m, upper) > 0, F.locate(m, upper) - 1).otherwise(F.length(text)) for m in w.SCAFFOLD_BLOCKS])
    out = strip(F.substring(text, F.lit(1), cut))
    out = F.when(F.lower(out).startswith("answer:"), strip(F.substring(out, F.lit(8), F.length(out)))).otherwise(out)
    return F.when(F.length(out) < 20, strip(answer)).otherwise(out)


def label(value: Column, longest: int = 80) -> Column:
    """STR-13: printable characters alone, cut. Spaces other than the plain one don't print."""
    return F.substring(F.regexp_replace(value, r"[\p{C}\p{Zl}\p{Zp}]|(?! )\p{Zs}", ""), 1, longest)


def prefix_key(text: Column, words: int = 20) -> Column:
    """STR-14: the first words, lower case, letters and digits alone."""
    plain = strip(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", ""))
    return F.array_join(F.slice(F.split(plain, r"\s+"), 1, words), " ")


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def long_sentences(text: Column, longer_than: int = 40) -> Column:
    """STR-16."""
    return F.filter(F.transform(sentences(text), strip), lambda s: F.length(s) > longer_than)


def prune_context(text: Column, max_chars: int = 6000) -> Column:
    """STR-15: rules out, white space collapsed, repeated sentences out, cut at a sentence's end."""
    flat = F.regexp_replace(F.regexp_replace(text, r"[-=_*]{3,}", ""), r"[ \t]+", " ")
    flat = strip(F.regexp_replace(flat, r"\n{3,}", "\n\n"))
    parts = F.filter(F.transform(sentences(flat), strip), lambda s: s != "")
    key = lambda s: strip(
        F.regexp_replace(F.lower(strip(F.regexp_replace(s, r"^[^\p{L}\p{N}_]*", ""))), r"^segment \d+.*?\n", "")
    )
    # Sorted by key and place, a sentence is repeated if the one before has its key.
    marked = F.array_sort(F.transform(parts, lambda s, i: F.struct(key(s).alias("k"), i.alias("i"), s.alias("s"))))
    none = F.lit(None).cast("struct<k:string,i:int,s:string>")
    kept = bound(
        marked,
        lambda m: F.filter(
            F.zip_with(m, F.concat(F.array(none), m), lambda x, before: F.struct(x.alias("x"), before["k"].alias("before"))),
            lambda z: z["x"].isNotNull() & ((F.length(z["x"]["k"]) <= 20) | ~z["before"].eqNullSafe(z["x"]["k"])),
        ),
    )
    ordered = F.array_sort(F.transform(kept, lambda z: F.struct(z["x"]["i"].alias("i"), z["x"]["s"].alias("s"))))

    def cut(pruned: Column) -> Column:
        head = F.substring(pruned, 1, max_chars)
        stop = F.length(F.regexp_extract(head, r"(?s)^(.*[.!?])", 1))
        bounded = F.when(stop - 1 > int(max_chars * 0.75), F.substring(head, F.lit(1), stop)).otherwise(F.concat(head, F.lit("...")))
        return F.when(F.length(pruned) > max_chars, bounded).otherwise(pruned)

    return F.when(F.length(text) <= 40, text).otherwise(bound(F.array_join(F.transform(ordered, lambda x: x["s"]), " "), cut))


def is_meta_claim(text: Column) -> Column:
    """FIL-13."""
    # Lambdas work out an expression as often as it is used in them.
    return bound(strip(F.lower(text)), lambda low: low.startswith("#") | contains_any(low, w.META_MARKS + w.META_PHRASES) | low.rlike("|".join(w.META_PATTERNS)))


def is_refusal(answer: Column) -> Column:
    """FIL-14."""
    text = F.coalesce(answer, F.lit(""))
    return (strip(text) == "ABSTAIN") | F.lower(text).rlike("|".join(w.REFUSALS))


def is_scaffold_echo(answer: Column) -> Column:
    """FIL-15: a scaffold mark, or a sentence of 40 characters at least that occurs three times."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    parts = F.filter(F.transform(F.split(F.replace(low, F.lit("\n"), F.lit(" ")), r"\. "), strip), lambda s: F.length(s) >= 40)
    ordered = F.array_sort(parts)
    # In sorted order, an element that equals the one two before it occurs three times.
    thrice = F.exists(
        F.zip_with(ordered, F.slice(ordered, 3, F.greatest(F.size(ordered), F.lit(1))), lambda a, b: F.coalesce(a == b, F.lit(False))),
        lambda x: x,
    )
    return contains_any(low, w.SCAFFOLD_MARKS) | thrice


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))


def is_instruction_echo(text: Column) -> Column:
    """FIL-16."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (low != "") & (contains_any(low, w.ECHO_MARKS) | starts_with_any(low, w.ECHO_PREFIXES) | (word_count(low) > 20))


def is_degenerate_stub(status: Column, claims: Column, answer: Column) -> Column:
    """FIL-17: failed, without claims, not ABSTAIN and fewer than five words."""
    return (status == "FAILED") & (claims == 0) & (strip(answer) != "ABSTAIN") & (word_count(answer) < 5)


def sanitize_rewrite(raw: Column) -> Column:
    """STR-21: a rewritten question without quotes and known prefixes; an echoed instruction is empty."""
    quotes = r"^[\"'`]+|[\"'`]+$"
    text = F.regexp_replace(strip(F.coalesce(raw, F.lit(""))), quotes, "")
    for prefix in w.REWRITE_PREFIXES:
        rest = F.regexp_replace(strip(F.substring(text, F.lit(len(prefix) + 1), F.length(text))), quotes, "")
        text = F.when(F.lower(text).startswith(prefix), rest).otherwise(text)
    text = strip(F.regexp_replace(text, r"\s+", " "))
    return F.when(is_instruction_echo(text), "").otherwise(text)


def verdict(value: Column) -> Column:
    """STR-18: SUPPORTED, CONTRADICTED or NEUTRAL; unknown names are NEUTRAL."""
    name = F.regexp_replace(F.upper(strip(value)), r"[.:;!,]+$", "")
    out = F.lit("NEUTRAL")
    for verdict_name in ("CONTRADICTED", "SUPPORTED"):
        out = F.when(name.isin(w.VERDICT_NAMES[verdict_name]), verdict_name).otherwise(out)
    return F.when(value.isNull(), F.lit(None)).otherwise(out)


def segment_list(items: Column) -> Column:
    """STR-19: the integers in an array of strings, in order, each once."""
    found = F.flatten(
        F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda s: F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(r"-?\d+"), F.lit(0)))
    )
    return F.array_distinct(F.filter(F.transform(found, lambda x: x.try_cast("bigint")), lambda n: n.isNotNull()))


def claim_id(value: Column) -> Column:
    """STR-20: the first integer, else 0."""
    return F.coalesce(F.regexp_extract(value, r"-?\d+", 0).try_cast("bigint"), F.lit(0).cast("bigint"))


def claim_triple(text: Column) -> Column:
    """STR-17: subject, predicate, object by the first predicate of the list inside the claim."""
    items = F.filter(F.split(F.regexp_replace(strip(text), r"\.+$", ""), r"\s+"), lambda x: x != "")
    low = F.transform(items, F.lower)
    n = F.size(items)
    inner = F.slice(low, F.lit(2), F.greatest(n - 2, F.lit(0)))
    at = F.coalesce(
        *[F.when(F.array_contains(inner, p), F.array_position(inner, p) + 1) for p in w.PREDICATES], F.lit(0).cast("bigint")
    ).cast("int")

    def triple(subject, predicate, obj):
        return F.struct(subject.alias("subject"), predicate.alias("predicate"), obj.alias("object"))

    none = F.lit(None).cast("string")
    return (
        F.when(F.coalesce(strip(text), F.lit("")) == "", triple(none, none, none))
        .when(
            at > 0,
            triple(F.array_join(F.slice(items, F.lit(1), at - 1), " "), F.try_element_at(items, at), F.array_join(F.slice(items, at + 1, n), " ")),
        )
        .when(n >= 4, triple(F.array_join(F.slice(items, 1, 2), " "), F.try_element_at(items, F.lit(3)), F.array_join(F.slice(items, F.lit(4), n), " ")))
        .otherwise(triple(F.try_element_at(items, F.lit(1)), none, none))
    )


def path_template(path: Column) -> Column:
    """STR-22: ids in paths as :id."""
    out = F.regexp_replace(F.regexp_replace(path, r"/[0-9a-fA-F]{24}(?=/|$)", "/:id"), r"/\d+(?=/|$)", "/:id")
    return F.when(out == "", "/").otherwise(out)


def redact_secrets(text: Column) -> Column:
    """STR-23."""
    for pattern in w.SECRETS:
        text = F.regexp_replace(text, pattern, "[REDACTED]")
    return text


def embedding_text(filename: Column, zone_name: Column, text: Column) -> Column:
    """STR-25: the contextual prefix of the dense leg."""
    return F.concat(F.lit("["), filename, F.lit(" | "), F.upper(zone_name), F.lit("] "), text)


def token_estimate(text: Column) -> Column:
    """FIL-12 and STR-26's fallback: a token for every four characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("int")


def context_window(input_tokens: Column, output_tokens: Column, largest: int, margin: int = 512) -> Column:
    """STR-26: tokens that a call needs, between 1024 and the model's largest window."""
    return F.least(F.greatest(input_tokens + output_tokens + margin, F.lit(1024)), F.lit(largest))


def password_ok(password: Column) -> Column:
    """STR-27."""
    rules = [r"[A-Z]", r"[a-z]", r"\d", r"[!@#$%^&*()_+\-=\[\]{};':\"\\|,.<>\/?]"]
    return reduce(lambda a, b: a & b, [password.rlike(x) for x in rules], (F.length(password) >= 12) & (F.octet_length(password) <= 72))


def json_substring(text: Column) -> Column:
    """JSN-01: the fenced block, then the outermost braces or brackets."""
    cleaned = strip(text)
    fence = r"(?i)```(?:json)?\s*([\s\S]*?)\s*```"
    cleaned = F.when(cleaned.rlike(fence), strip(F.regexp_extract(cleaned, fence, 1))).otherwise(cleaned)
    brace, bracket = F.locate("{", cleaned), F.locate("[", cleaned)
    braces, brackets = F.regexp_extract(cleaned, r"(?s)(\{.*\})", 1), F.regexp_extract(cleaned, r"(?s)(\[.*\])", 1)
    first_brace = (brace > 0) & ((bracket == 0) | (brace < bracket))
    return (
        F.when(first_brace & (braces != ""), braces)
        .when(~first_brace & (bracket > 0) & (brackets != ""), brackets)
        .otherwise(cleaned)
    )


def flatten_content(parts: Column) -> Column:
    """JSN-04: parts joined; null is empty."""
    return F.coalesce(F.array_join(parts, ""), F.lit(""))


def provider_failure(status: Column, message: Column) -> Column:
    """OBS-01: credentials, quota, server, or null."""
    low = F.lower(F.coalesce(message, F.lit("")))
    code = F.coalesce(status, F.lit(0))
    return (
        F.when(code.isin(401, 403) | contains_any(low, w.CREDENTIAL_MARKS), "credentials")
        .when((code == 429) | contains_any(low, w.QUOTA_MARKS), "quota")
        .when(code.between(500, 599) | contains_any(low, w.SERVER_MARKS), "server")
    )


def pattern_of(words: list[str]) -> str:
    """An alternation of literal words for patterns in SQL."""
    return "|".join(re.escape(x) for x in words)
