"""DuckDB SQL text for the oracle side of every query.

These builders write plain SQL strings (lists, regexes, CASE); they are the
independent statement of each query that the driver runs in DuckDB.
"""

from __future__ import annotations

from ..functions.text import WS_CLASS, WS_CODEPOINTS
from ..functions.tokenize import INTL_REGEX, V13A_PLAIN, V13A_REGEX, ZH_CLASS

WS_SQL = "(" + " || ".join(f"chr({c})" for c in WS_CODEPOINTS) + ")"


def q(s: str) -> str:
    """A SQL string literal; newlines and tabs go through chr()."""
    parts = []
    buf = ""
    for ch in s:
        if ch in "\n\t\r":
            if buf:
                parts.append("'" + buf.replace("'", "''") + "'")
                buf = ""
            parts.append(f"chr({ord(ch)})")
        else:
            buf += ch
    if buf or not parts:
        parts.append("'" + buf.replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def strip_ws(x: str) -> str:
    return f"trim({x}, {WS_SQL})"


def split_ws(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{WS_CLASS}]+'), lambda t: t <> '')"


def split_space(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def strip_masks(x: str, m1: str, m2: str) -> str:
    pre, suf = m1 + " ", " " + m2
    lp, ls = len(pre), len(suf)
    return (
        f"(CASE WHEN starts_with({x}, {q(pre)}) AND suffix({x}, {q(suf)}) "
        f"THEN substr({x}, {lp + 1}, greatest(length({x}) - {lp + ls}, 0)) "
        f"WHEN starts_with({x}, {q(pre)}) THEN substr({x}, {lp + 1}, greatest(length({x}) - {lp}, 0)) "
        f"WHEN suffix({x}, {q(suf)}) THEN substr({x}, 1, greatest(length({x}) - {ls}, 0)) "
        f"ELSE {x} END)"
    )


def _java_to_re2(rep: str) -> str:
    return rep.replace("$1", "\\1").replace("$2", "\\2")


def _regex_chain(x: str, rules) -> str:
    for pat, rep in rules:
        x = f"regexp_replace({x}, {q(pat)}, {q(_java_to_re2(rep))}, 'g')"
    return x


def v13a(x: str) -> str:
    for old, new in V13A_PLAIN:
        x = f"replace({x}, {q(old)}, {q(new)})"
    return _regex_chain(f"(' ' || {x} || ' ')", V13A_REGEX)


def tokenize(x: str, method: str = "13a", lowercase: bool = False) -> str:
    if lowercase:
        x = f"lower({x})"
    if method in ("none", "whitespace"):
        return split_ws(x)
    if method == "13a":
        return split_ws(v13a(x))
    if method == "intl":
        return split_ws(_regex_chain(x, INTL_REGEX))
    if method == "char":
        return f"regexp_extract_all({x}, '([^{WS_CLASS}])', 1)"
    if method == "zh":
        return split_ws(_regex_chain(f"regexp_replace({x}, '([{ZH_CLASS}])', ' \\1 ', 'g')", V13A_REGEX))
    raise ValueError(method)


def ngram_list(t: str, n: int) -> str:
    """List of space-joined n-grams of list ``t``."""
    if n == 1:
        return t
    return (f"list_transform(range(0, greatest(len({t}) - {n - 1}, 0)), "
            f"lambda i: array_to_string({t}[i + 1:i + {n}], ' '))")


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"
