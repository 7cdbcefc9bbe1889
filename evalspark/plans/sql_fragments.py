"""DuckDB SQL spellings of the library's column functions, for oracle queries."""

from __future__ import annotations


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def lstrip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+', '')"


def strip_artifacts(ctx: str, act: str) -> str:
    cleaned = strip_ws(f"regexp_replace({ctx}, '\\[[^\\]]+\\]\\s*', '', 'g')")
    a = f"coalesce({act}, '')"
    rest = f"regexp_replace(substr({cleaned}, length({a}) + 1), '^[ :\\-]+', '')"
    return (f"CASE WHEN length({a}) > 0 AND starts_with(lower({cleaned}), lower({a})) "
            f"THEN {rest} ELSE {cleaned} END")


def continuation(e: str) -> str:
    return f"(' ' || {lstrip_ws(e)})"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '\\s+'), lambda w: w <> '')"


def word_count(x: str) -> str:
    return f"len({words(x)})"


def md5_u32(x: str) -> str:
    return f"CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT)"


def normalise_answer(x: str) -> str:
    return lstrip_ws(f"regexp_replace(lower({x}), '[!-/:-@\\[-`{{-~]', '', 'g')")
