"""Fixture tables as DuckDB common table expressions (see FIXTURES.md)."""

from __future__ import annotations

from ..fixtures import LANGUAGE_FAMILIES, MASK1, MASK2
from .sqltext import q, split_space, strip_masks, strip_ws

_BLANK = "' ' || chr(9) || chr(13)"

CTES: dict[str, str] = {}
DEPS: dict[str, list[str]] = {}


def cte(name: str, deps: list[str], body: str) -> None:
    CTES[name] = body
    DEPS[name] = deps


cte("lp_lines", [], """
  SELECT doc_id, lang, lines, unnest(range(len(lines) - 1)) AS i
  FROM (SELECT doc_id, lang, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
""")
cte("lang_pairs", ["lp_lines"], f"""
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, line_pos) - 1 AS pos,
         row_number() OVER (PARTITION BY lang, split ORDER BY doc_id, line_pos) - 1 AS split_pos
  FROM (
    SELECT doc_id || ':' || i AS pair_id, lang, doc_id, i AS line_pos, lines[i + 1] AS context, lines[i + 2] AS response,
           CASE WHEN doc_id % 10 < 4 THEN 'test' WHEN doc_id % 10 = 4 THEN 'validation' ELSE 'train' END AS split
    FROM lp_lines
    WHERE trim(lines[i + 1], {_BLANK}) <> '' AND trim(lines[i + 2], {_BLANK}) <> ''
  )
""")
cte("dialogue_pairs", [], """
  SELECT u.conv_id || ':' || u.turn AS pair_id, u.conv_id, u.turn,
         coalesce(u.text, '') AS context, coalesce(a.text, '') AS response
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'
""")
cte("lp_sizes", ["lang_pairs"], "SELECT lang, count(*) AS n FROM lang_pairs GROUP BY lang")
cte("lp_tok", ["lang_pairs"], f"SELECT lang, pos, context, response, {split_space('response')} AS t FROM lang_pairs")
cte("predictions", ["lang_pairs", "lp_sizes", "lp_tok"], f"""
  SELECT a.lang, 'fs' AS system, a.pos, b.response AS prediction
  FROM lang_pairs a JOIN lp_sizes s ON s.lang = a.lang
  JOIN lang_pairs b ON b.lang = a.lang AND b.pos = (a.pos + 1) % s.n
  UNION ALL
  SELECT lang, 'fs_prompt', pos,
         {q(MASK1 + ' ')} || array_to_string(t[1:CAST(ceil(len(t) / 2) AS BIGINT)], ' ') || {q(' ' + MASK2)}
  FROM lp_tok
  UNION ALL
  SELECT lang, 'mtl', pos, context FROM lp_tok
  UNION ALL
  SELECT lang, 'mtl_prompt', pos,
         CASE WHEN pos % 2 = 0 THEN {q(MASK1 + ' ')} ELSE '' END
         || array_to_string(list_filter(t, lambda x, i: i % 5 <> 0), ' ')
  FROM lp_tok
""")
cte("prc", ["predictions"], f"""
  SELECT lang, system, pos, {strip_ws(strip_masks('prediction', MASK1, MASK2))} AS prediction FROM predictions
""")
cte("languages", [], "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in LANGUAGE_FAMILIES)
    + ") AS v(lang, family)")


def with_ctes(body: str, *names: str) -> str:
    """``WITH`` clause holding ``names`` and everything they depend on, in order."""
    seen: list[str] = []

    def visit(n: str) -> None:
        for d in DEPS[n]:
            visit(d)
        if n not in seen:
            seen.append(n)

    for n in names:
        visit(n)
    if not seen:
        return body
    head = "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in seen)
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return head + ",\n" + stripped[5:]
    return head + "\n" + body


def add_cte(name: str, deps: list[str], body: str) -> None:
    cte(name, deps, body)
