"""Scalar text functions as native column expressions (no Python in the row path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts, i.e. what str.strip()
# and str.split() treat as whitespace (29 code points):
# 09-0D, 1C-1F, 20, 85, A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000
WS_CODEPOINTS = (
    list(range(0x09, 0x0E)) + list(range(0x1C, 0x20)) + [0x20, 0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B)) + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
WS_CHARS = "".join(chr(c) for c in WS_CODEPOINTS)
# The same set as a regex character class body (Java and RE2 both read \x{...}).
WS_CLASS = "".join(f"\\x{{{c:X}}}" for c in WS_CODEPOINTS)
WS_RUN = f"[{WS_CLASS}]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.btrim(_col(c), F.lit(WS_CHARS))


def split_ws(c) -> Column:
    """Python ``str.split()``: split on runs of Unicode whitespace, no empty tokens.

    Every whitespace character is first mapped to a space (``translate`` is a
    plain character map, much cheaper than a 29-member regex class). The input
    is referenced once: after the trim the only possible empty piece is the one
    an empty string gives, and ``array_remove`` drops it."""
    s = F.btrim(F.translate(_col(c), WS_CHARS, " " * len(WS_CHARS)), F.lit(" "))
    return F.array_remove(F.split(s, " +", -1), F.lit(""))


def split_space(c) -> Column:
    """Split on the single space character, dropping empty pieces."""
    return F.filter(F.split(_col(c), " ", -1), lambda t: t != F.lit(""))


def strip_masks(c, mask1: str | None, mask2: str | None) -> Column:
    """Remove ``mask1 + ' '`` at the start and/or ``' ' + mask2`` at the end.

    Only active when both masks are set (non-empty). Exact prefix/suffix match,
    four cases as in the evaluation code; an overlapping ``m1 m2`` yields ''.
    """
    x = _col(c)
    if not (mask1 and mask2):
        return x
    pre = mask1 + " "
    suf = " " + mask2
    lp, ls = len(pre), len(suf)
    n = F.char_length(x)
    both = x.startswith(pre) & x.endswith(suf)
    return (
        F.when(both, x.substr(F.lit(lp + 1), F.greatest(n - lp - ls, F.lit(0))))
        .when(x.startswith(pre), x.substr(F.lit(lp + 1), F.greatest(n - lp, F.lit(0))))
        .when(x.endswith(suf), x.substr(F.lit(1), F.greatest(n - ls, F.lit(0))))
        .otherwise(x)
    )


def clean_prediction(c, mask1: str | None = None, mask2: str | None = None) -> Column:
    """Mask strip first, then whitespace strip (the order matters)."""
    return strip_ws(strip_masks(c, mask1, mask2))


def prompt_source(c, prefix: str | None, target_prefix: str | None,
                  mask1: str | None, mask2: str | None) -> Column:
    """Source-side prompt template. The configuration is fixed for a run, so the
    branch is chosen here and one ``concat`` goes into the plan."""
    x = F.coalesce(_col(c), F.lit(""))
    masks = bool(mask1 and mask2)
    if prefix and target_prefix:
        tail = f" {target_prefix} {mask1}" if masks else f" {target_prefix}"
        return F.concat(F.lit(prefix + " "), x, F.lit(tail))
    if masks:
        return F.concat(x, F.lit(" " + mask1))
    return x


def prompt_target(c, prefix: str | None, target_prefix: str | None,
                  mask1: str | None, mask2: str | None) -> Column:
    """Target-side template: wrapped in the two masks when both are set."""
    x = F.coalesce(_col(c), F.lit(""))
    if mask1 and mask2:
        return F.concat(F.lit(mask1 + " "), x, F.lit(" " + mask2))
    return x


def ngram_pattern(n: int) -> str:
    """Regex whose group 1 is every n-gram of a single-space-joined token string:
    a zero-width match at each token start with the next n tokens in a lookahead."""
    return r"(?<![^ ])(?=([^ ]+" + r"(?: [^ ]+)" * (n - 1) + "))"


def ngrams(tokens, n: int) -> Column:
    """Array of space-joined n-grams of a token array (empty if too short).

    One native ``regexp_extract_all`` over the joined tokens; tokens must hold no
    space (true for every tokeniser here). Pass a column reference, not a large
    expression: the tokens are used twice.
    """
    t = _col(tokens)
    if n == 1:
        return t
    return F.regexp_extract_all(F.array_join(t, " "), F.lit(ngram_pattern(n)), 1)


def drop_token(tokens, token: str = "▁") -> Column:
    """Drop every token equal to ``token`` (exact match)."""
    return F.filter(_col(tokens), lambda t: t != F.lit(token))
