"""The text steps that Spark lacks, or has at many times the cost, as Arrow UDFs: compatibility decomposition, words of whole texts, stems, 32-bit xxHash."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from . import words as w

#: Rows that a task's Python turns into words, stems or counts at once: a bound of memory, none of results.
SLICE = 512

# The suffix rules of the published algorithm, tried from the longest on.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent sion tion ou ism ate iti ous ive ize".split()
STEP_4 = {x: x[0] if x in ("sion", "tion") else "" for x in STEP_4}


class Shapes(dict):
    """By code point: v for a vowel, y for itself, c for any other."""

    def __missing__(self, point: int) -> str:
        return "c"


SHAPES = Shapes({ord(x): "v" for x in "aeiou"} | {ord("y"): "y"})


def _shape(word: str) -> str:
    """c for each consonant, v for each vowel; y is a vowel after a consonant."""
    shape = word.translate(SHAPES)
    at = shape.find("y")
    while at >= 0:
        shape = f"{shape[:at]}{'v' if at and shape[at - 1] == 'c' else 'c'}{shape[at + 1:]}"
        at = shape.find("y")
    return shape


def _measure(stem: str) -> int:
    """How often a consonant follows a vowel."""
    return _shape(stem).count("vc")


def _short(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, table: dict[str, str]) -> str:
    """The longest suffix of the table that ends the word; empty if there is none."""
    for size in (7, 6, 5, 4, 3, 2):
        if word[-size:] in table and len(word) >= size:
            return word[-size:]
    return ""


def _by_table(word: str, table: dict[str, str]) -> str:
    suffix = _longest(word, table)
    stem = word[: -len(suffix)]
    return stem + table[suffix] if suffix and _measure(stem) > 0 else word


@lru_cache(maxsize=1 << 17)
def porter_stem(word: str) -> str:
    """STR-03: Porter's stem; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    for suffix, put in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: -len(suffix)] + put
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            stem = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in _shape(stem):
                if stem.endswith(("at", "bl", "iz")):
                    stem += "e"
                elif len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c" and stem[-1] not in "lsz":
                    stem = stem[:-1]
                elif _measure(stem) == 1 and _short(stem):
                    stem += "e"
                word = stem
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _by_table(_by_table(word, STEP_2), STEP_3)
    suffix = _longest(word, STEP_4)
    if suffix:
        stem = word[: -len(suffix)] + STEP_4[suffix]
        word = stem if _measure(stem) > 1 else word
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short(stem)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(StringType())
def decompose(text: pd.Series) -> pd.Series:
    """NFKD."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


@F.pandas_udf(StringType())
def stem(word: pd.Series) -> pd.Series:
    return word.map(lambda x: None if x is None else porter_stem(x))


@F.pandas_udf(LongType())
def xxh32(text: pd.Series) -> pd.Series:
    import xxhash

    return text.map(lambda t: None if t is None else xxhash.xxh32(t.encode()).intdigest())


def by_slices(rows: pa.Array, use: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """use(rows), of SLICE rows at a time."""
    return pa.concat_arrays([use(rows.slice(at, SLICE)) for at in range(0, max(1, len(rows)), SLICE)])


GLYPHS = re.compile("[\uf000-\uffff\u2022\u2023\u25cf\u25cb\u25aa\u25ab]")
BROKEN = re.compile(r"-[ \t\n\x0b\f\r]*\n")
JOINED = re.compile(r"(\w)-[ \t\n\x0b\f\r]*\n[ \t\n\x0b\f\r]*(\w+)")
FIGURES = re.compile("[0-9]+")
WORD = re.compile(r"\b[a-z0-9]+(?:-[a-z0-9]+)*\b")


def words_in(text: str, stop: frozenset[str], decomposes: bool = True) -> list[str]:
    """What `text.tokens(text.normalize(...))` finds; white space isn't tidied up, as no word holds any."""
    if not text.isascii():
        text = GLYPHS.sub(" ", unicodedata.normalize("NFKD", text) if decomposes else text)
    if BROKEN.search(text):
        text = JOINED.sub(r"\1\2", text)
    text = text.lower()
    if "'" in text or "cannot" in text:
        for short, long in w.CONTRACTIONS:
            text = text.replace(short, long)
    return [x for x in WORD.findall(text) if x not in stop and (len(x) > 1 or x.isdigit())]


def words_of(texts: pa.Array, is_query: bool = False) -> pa.Array:
    """`text_words` inside a task."""
    stop = frozenset(w.CORE_STOPWORDS) | frozenset(w.QUERY_STOPWORDS if is_query else ())
    return by_slices(texts, lambda some: pa.array([words_in(x or "", stop) for x in some.to_pylist()], pa.list_(pa.string())))


def text_words(text: Column, is_query: bool = False) -> Column:
    """STR-01 and STR-02 without stems in one pass over a text: words of the decomposed, normalised text, less stop words and single letters; of a null text none.

    The same words as `text.tokens(text.normalize(decomposed(...)))`, but for letters that Unicode got after version 13, which Java 17 doesn't know as such.
    """

    @F.arrow_udf(ArrayType(StringType()))
    def lex(texts: pa.Array) -> pa.Array:
        return words_of(texts, is_query)

    return lex(text)


SHARED = StructType([StructField("share", DoubleType()), StructField("missing", BooleanType())])


@F.arrow_udf(SHARED)
def word_overlap(claims: pa.Array, texts: pa.Array) -> pa.Array:
    """Of each claim's distinct words, `text.tokens(text.normalize(...))`, the share that the text has, 0 without words; and whether it lacks one that is a number.

    A text's words are found once, however many claims of a batch are held against it, and a claim's.
    """
    stop = frozenset(w.CORE_STOPWORDS)
    words = lru_cache(SLICE)(lambda x: frozenset(words_in(x or "", stop, False)))
    shares, missing = [], []
    for claim, text in zip(claims, texts, strict=True):
        said, has = words(claim.as_py()), words(text.as_py())
        lacks = said - has
        shares.append((len(said) - len(lacks)) / len(said) if said else 0.0)
        missing.append(any(FIGURES.fullmatch(x) for x in lacks))
    return pa.StructArray.from_arrays([pa.array(shares, pa.float64()), pa.array(missing, pa.bool_())], names=["share", "missing"])


@F.arrow_udf(ArrayType(StringType()))
def stem_all(terms: pa.Array) -> pa.Array:
    """Stems of rows of words; each distinct word of some rows is stemmed once."""
    return by_slices(terms, _stem_all)


def _stem_all(terms: pa.Array) -> pa.Array:
    at, codes, stems = _stemmed(terms)
    return pa.ListArray.from_arrays(at, stems.take(pa.array(codes)), mask=terms.is_null() if terms.null_count else None)


COUNTED = ArrayType(StructType([StructField("term", StringType()), StructField("tf", LongType())]))


@F.arrow_udf(COUNTED)
def stem_counts(terms: pa.Array) -> pa.Array:
    """Of each row's words the distinct stems, in order, and how often each is there."""
    return by_slices(terms, _stem_counts)


def _stem_counts(terms: pa.Array) -> pa.Array:
    at, codes, stems = _stemmed(terms)
    order = pc.sort_indices(stems).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    rows = np.repeat(np.arange(len(terms), dtype=np.int64), np.diff(at.to_numpy()))
    pairs, counts = np.unique(rows * max(1, len(order)) + place[codes], return_counts=True)
    rows, codes = np.divmod(pairs, max(1, len(order)))
    ends = pa.array(np.searchsorted(rows, np.arange(len(terms) + 1)).astype(np.int32))
    each = pa.StructArray.from_arrays([stems.take(pa.array(order[codes] if len(order) else codes)), pa.array(counts, pa.int64())], names=["term", "tf"])
    return pa.ListArray.from_arrays(ends, each, mask=terms.is_null() if terms.null_count else None)


def _stemmed(terms: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Offsets of rows, codes of their words' stems and the distinct stems that codes stand for."""
    words = terms.flatten().dictionary_encode()
    found = pa.array([None if x is None else porter_stem(x) for x in words.dictionary.to_pylist()], pa.string()).dictionary_encode()
    codes = found.indices.to_numpy(zero_copy_only=False)[words.indices.to_numpy(zero_copy_only=False)]
    sizes = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), codes, found.dictionary


def counts_of(texts: pa.Array) -> pa.Array:
    """`stem_counts` of `text_words` inside a task."""
    return by_slices(texts, lambda some: _stem_counts(words_of(some)))


def decomposed(text: Column) -> Column:
    """The text decomposed; ASCII texts don't leave the JVM: the function gets nulls in their place."""
    return F.coalesce(decompose(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def with_decomposed(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, decomposed(F.col(column)))


def stem_terms(terms: DataFrame, column: str = "term") -> DataFrame:
    """Terms replaced by stems: the distinct vocabulary goes through the UDF, then is joined back."""
    vocabulary = terms.select(F.col(column).alias("_word")).distinct().withColumn("_stem", stem("_word"))
    return terms.join(vocabulary, terms[column] == vocabulary["_word"]).drop(column, "_word").withColumnRenamed("_stem", column)
