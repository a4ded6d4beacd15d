"""DuckDB fragments for the statements that say what the queries compute."""

from __future__ import annotations

from veriframe.functions.text import MORE_STOP_WORDS, STOP_WORDS

SPACE = r"[\t-\r \x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def words_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SPACE}+', ' ', 'g'))"


def name(x: str) -> str:
    return f"trim(regexp_replace(lower({clean(x)}), '[^a-z0-9]+', ' ', 'g'))"


def alnum(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]', '', 'g')"


def words(x: str) -> str:
    return rf"regexp_extract_all(lower({clean(x)}), '\b[a-z0-9]+\b')"


def token_set(x: str) -> str:
    return f"list_filter(list_distinct({words(x)}), lambda w: NOT list_contains({words_list(STOP_WORDS)}, w))"


def semantic_tokens(x: str) -> str:
    return f"list_filter({words(x)}, lambda w: length(w) > 2 AND NOT list_contains({words_list(MORE_STOP_WORDS)}, w))"


def overlap(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END"


def edit(a: str, b: str) -> str:
    return (
        f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.9 "
        f"ELSE 1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END"
    )


def half_up(x: str, digits: int) -> str:
    return f"round({x}, {digits})"
