"""The lexical analysis as DuckDB SQL: decomposition, normal form, words, stems. For oracles alone."""

from __future__ import annotations

import unicodedata

from ..functions import text as t
from ..functions import words as w
from ..functions.udfs import STEP_2, STEP_3, STEP_4


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(items: list[str]) -> str:
    return "[" + ", ".join(map(quoted, items)) + "]"


SQL_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"

#: Letters with marks of the Latin alphabets, as letter and marks: what compatibility decomposition does to them.
MARKED = {chr(c): d for c in range(0xA0, 0x250) if (d := unicodedata.normalize("NFKD", chr(c))) != chr(c)}


def decomposed(column: str) -> str:
    out = f"coalesce({column}, '')"
    for letter, parts in MARKED.items():
        out = f"replace({out}, '{letter}', '{parts}')"
    # Most texts have none of them.
    return f"CASE WHEN regexp_matches(coalesce({column}, ''), '[^\\x00-\\x7F]') THEN {out} ELSE coalesce({column}, '') END"


_replaced = "lower(regexp_replace(regexp_replace(coalesce(text, ''), '[\\x{F000}-\\x{FFFF}\\x{2022}\\x{2023}\\x{25CF}\\x{25CB}\\x{25AA}\\x{25AB}]', ' ', 'g'), '([\\p{L}\\p{N}_]+)-\\s*\\n\\s*([\\p{L}\\p{N}_]+)', '\\1\\2', 'g'))"
for _short, _long in w.CONTRACTIONS:
    _replaced = f"replace({_replaced}, {quoted(_short)}, {quoted(_long)})"
#: Normalised text, as SQL over a column `text` that is decomposed already.
SQL_NORM = SQL_STRIP.format(rf"regexp_replace(regexp_replace({_replaced}, '[ \t\r\f\x0B]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def tokens(is_query: bool = False) -> str:
    """Words of a normalised text in column `norm`: no look-around here, so runs that hold an underscore or a letter outside a-z are taken out first."""
    stop = sql_list([x for x in t.stopwords(is_query) if "'" not in x])
    clean = r"regexp_replace(norm, '[\p{L}\p{N}_]*(?:_|[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{N}])[\p{L}\p{N}_]*', ' ', 'g')"
    return rf"list_filter(regexp_extract_all({clean}, '[a-z0-9]+(?:-[a-z0-9]+)*'), lambda x: NOT list_contains({stop}, x) AND (length(x) > 1 OR regexp_full_match(x, '[0-9]')))"


def words_of(table: str, key: str, is_query: bool = False, name: str = "w") -> str:
    """CTE {name}: key, place and word of every word of the table's texts; {name}_rows: key of every row."""
    return f"""
    {name}_text AS MATERIALIZED (SELECT {key}, row_number() OVER () AS row_no, {decomposed('text')} AS text FROM {table}),
    {name}_norm AS MATERIALIZED (SELECT {key}, row_no, {SQL_NORM} AS norm FROM {name}_text),
    {name}_list AS MATERIALIZED (SELECT {key}, row_no, {tokens(is_query)} AS words FROM {name}_norm),
    {name} AS MATERIALIZED (SELECT {key}, row_no, unnest(range(1, len(words) + 1)) AS place, unnest(words) AS word FROM {name}_list)"""


# ---- stems ----

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
SOME, ONE, MORE = f"^(?:{_C})?{_V}{_C}", f"^(?:{_C})?{_V}{_C}(?:{_V})?$", f"^(?:{_C})?{_V}{_C}{_V}{_C}"
VOWEL, SHORT = f"^(?:{_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"


def _is(stem: str, shape: str) -> str:
    return f"regexp_matches({stem}, '{shape}')"


def _less(n: int) -> str:
    return f"left(s, length(s) - {n})"


def _by_table(table: dict[str, str]) -> str:
    cases = [f"WHEN ends_with(s, '{x}') THEN CASE WHEN {_is(_less(len(x)), SOME)} THEN {_less(len(x))} || '{table[x]}' ELSE s END" for x in sorted(table, key=len, reverse=True)]
    return f"CASE {' '.join(cases)} ELSE s END"


def stems(words: str, name: str = "stems") -> str:
    """CTE {name}: word and stem of the distinct words of the relation `words` (word). A first y counts as a consonant: it is Y meanwhile."""
    steps = [
        r"CASE WHEN ends_with(s, 'sses') OR ends_with(s, 'ies') THEN left(s, length(s) - 2) WHEN ends_with(s, 'ss') THEN s WHEN ends_with(s, 's') THEN left(s, length(s) - 1) ELSE s END",
        f"CASE WHEN ends_with(s, 'eed') THEN CASE WHEN {_is(_less(3), SOME)} THEN {_less(1)} ELSE s END "
        f"WHEN ends_with(s, 'ed') AND {_is(_less(2), VOWEL)} THEN {_less(2)} || '~' WHEN ends_with(s, 'ing') AND {_is(_less(3), VOWEL)} THEN {_less(3)} || '~' ELSE s END",
        # The mark says that an ending went: then the stem is mended.
        f"CASE WHEN NOT ends_with(s, '~') THEN s WHEN regexp_matches(s, '(?:at|bl|iz)~$') THEN {_less(1)} || 'e' "
        f"WHEN length(s) > 2 AND left(right(s, 2), 1) = left(right(s, 3), 1) AND left(right(s, 2), 1) NOT IN ('a', 'e', 'i', 'o', 'u', 'y', 'l', 's', 'z') OR regexp_matches(s, '[^aeiouy]yy~$') THEN {_less(2)} "
        f"WHEN {_is(_less(1), ONE)} AND {_is(_less(1), SHORT)} THEN {_less(1)} || 'e' ELSE {_less(1)} END",
        f"CASE WHEN ends_with(s, 'y') AND {_is(_less(1), VOWEL)} THEN {_less(1)} || 'i' ELSE s END",
        _by_table(STEP_2),
        _by_table(STEP_3),
        "CASE " + " ".join(
            f"WHEN ends_with(s, '{x}') THEN CASE WHEN {_is(f'{_less(len(x))} || {quoted(x[0])}' if x in ('sion', 'tion') else _less(len(x)), MORE)} THEN "
            f"{_less(len(x) - 1) if x in ('sion', 'tion') else _less(len(x))} ELSE s END" for x in sorted(STEP_4, key=len, reverse=True)
        ) + " ELSE s END",
        f"CASE WHEN ends_with(s, 'e') AND ({_is(_less(1), MORE)} OR ({_is(_less(1), ONE)} AND NOT {_is(_less(1), SHORT)})) THEN {_less(1)} ELSE s END",
        f"CASE WHEN ends_with(s, 'll') AND {_is(_less(1), MORE)} THEN {_less(1)} ELSE s END",
    ]
    out = f"{name}_0 AS (SELECT word, regexp_replace(word, '^y', 'Y') AS s FROM (SELECT DISTINCT word FROM {words}))"
    for i, step in enumerate(steps, 1):
        out += f",\n    {name}_{i} AS (SELECT word, {step} AS s FROM {name}_{i - 1})"
    return out + f",\n    {name} AS MATERIALIZED (SELECT word, CASE WHEN length(word) <= 2 THEN word ELSE lower(s) END AS stem FROM {name}_{len(steps)})"
