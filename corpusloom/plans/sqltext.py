"""DuckDB expressions that mirror functions/text.py."""

from __future__ import annotations

from corpusloom.functions.text import STOPWORDS, SUSPICIOUS, WORD

STOPS = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{WORD}')"


def stem(t: str) -> str:
    long = f"length({t}) > 4 AND NOT suffix({t}, 'ss')"
    return (
        f"CASE WHEN {long} AND suffix({t}, 'ies') THEN {t}[:-4] || 'y' WHEN {long} AND suffix({t}, 'es') THEN {t}[:-3] "
        f"WHEN {long} AND suffix({t}, 's') THEN {t}[:-2] ELSE {t} END"
    )


def content_terms(x: str) -> str:
    return f"list_transform(list_filter({tokens(x)}, lambda t: NOT list_contains({STOPS}, t)), lambda t: {stem('t')})"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def filled(x: str) -> str:
    return f"list_filter(list_transform({x}, lambda p: {strip('p')}), lambda p: p <> '')"


def sentences(x: str) -> str:
    marked = "regexp_replace(l, '([.!?])\\s+([A-Z0-9\"''(\\[])', '\\1' || chr(30) || '\\2', 'g')"
    lines = filled(f"string_split({x}, chr(10))")
    return filled(f"flatten(list_transform({lines}, lambda l: string_split({marked}, chr(30))))")


def jaccard(a: str, b: str) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE CAST(len(list_intersect(list_distinct({a}), list_distinct({b}))) AS DOUBLE) / {union} END"


def suspicious(x: str) -> str:
    return f"regexp_matches({x}, '(?i){'|'.join(SUSPICIOUS)}')"


def normalized(x: str) -> str:
    """As sources/parsers.py, but for compatibility signs: SQL composes canonically only. tests/test_layout.py has those."""
    out = f"replace(nfc_normalize({x}), chr(173), '')"
    for pattern, by in (("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "' '"), ("[ \\t\\x{a0}]+", "' '"), (" *\\n *", "chr(10)"), ("\\n{3,}", "chr(10) || chr(10)")):
        out = f"regexp_replace({out}, '{pattern}', {by}, 'g')"
    return strip(out)
