"""Spelling variant grouping by finite-state composition.

The vocabulary's minimised acceptor is composed with a transducer that makes one
edit, and with the acceptor again; the pairs that the composition accepts are the
words one edit apart. No task holds the whole acceptor: a word of ``c`` letters and
a near one of ``c`` or ``c + 1`` agree before their first difference and after the
edit, so they meet in the part of the composition whose initial state is reached by
the letters before the interval ``[lo, hi)`` of that first difference, and whose
words end in the same letters. The first intervals are the two halves of a word; a
part of more than PART_WORDS words is split into the halves of its interval, so a
hot prefix or ending spreads too. Parts that lie in one task share one register of
states.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Words have at least so many letters and occurrences; a form has RATIO times its word's.
LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
#: A run whose hash this number divides loses a letter.
SLIP = 199
#: Words of one part of the composition; states and words of a task's register.
PART_WORDS, REGISTER_STATES, RUN_ROWS = 4096, 1 << 20, 1 << 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Acceptor:
    """Minimised acyclic acceptor with an initial state for each set of words it is given."""

    def __init__(self):
        self.register: dict[tuple, int] = {}
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []

    def _state(self, final: bool, arcs: dict[str, int]) -> int:
        """The state with these arcs, one for each right language."""
        key = (final, *arcs.items())
        at = self.register.get(key)
        if at is None:
            at = self.register[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return at

    def add(self, words: list[str]) -> int:
        """The initial state of ``words`` (sorted, distinct)."""
        path: list[tuple[bool, dict[str, int]]] = [(False, {})]  # open states of the last word
        last = ""
        for word in [*words, None]:
            same = 0
            if word is not None:
                most = min(len(word), len(last))
                while same < most and word[same] == last[same]:
                    same += 1
            while len(path) > same + 1:  # states that no later word passes are final
                done = self._state(*path.pop())
                path[-1][1][last[len(path) - 1]] = done
            if word is None:
                break
            path += [(False, {}) for _ in range(len(word) - same)]
            path[-1] = (True, path[-1][1])
            last = word
        return self._state(*path[0])

    def _shared(self, r: int, s: int, size: int, but: str | None = None) -> Iterator[str]:
        """Words of ``size`` letters accepted from ``r`` and from ``s``, not beginning with ``but``."""
        todo = [(r, s, "")]
        while todo:
            r, s, text = todo.pop()
            if len(text) == size:
                if self.final[r] and self.final[s]:
                    yield text
                continue
            a, b = sorted((self.arcs[r], self.arcs[s]), key=len)
            first = None if text else but
            todo += [(x, b[c], text + c) for c, x in a.items() if c in b and c != first]

    def near_pairs(self, start: int, size: int, positions: int) -> Iterator[tuple[str, str]]:
        """Pairs one edit apart whose first difference is before ``positions``: the first
        word has ``size`` letters, the second as many or one more. Each pair comes once."""
        todo = [(start, "")]
        while todo:
            q, text = todo.pop()
            arcs = list(self.arcs[q].items())
            left = size - len(text)
            for i, (c, r) in enumerate(arcs):
                if left > 0:
                    for d, s in arcs[i + 1:]:
                        for rest in self._shared(r, s, left - 1):
                            yield f"{text}{c}{rest}", f"{text}{d}{rest}"
                for rest in self._shared(q, r, left, but=c):
                    yield f"{text}{rest}", f"{text}{c}{rest}"
            if len(text) + 1 < positions and left > 0:
                todo += [(r, text + c) for c, r in arcs]


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, slip: int = SLIP) -> DataFrame:
    """(word, n) of the runs of letters in ``docs`` (doc_id, text; others are ignored).

    Only A-Z are lower-cased. A run whose crc32 with its doc_id ``slip`` divides loses
    the letter that the hash points at. Null texts have no runs; a null id reads as empty.
    """
    run = F.explode(F.regexp_extract_all("text", F.lit(f"([A-Za-zÀ-ÿ]{{{least_letters},}})"), F.lit(1)))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), run.alias("run"))
    plain = F.octet_length("run") == F.char_length("run")
    found = found.select("doc", F.when(plain, F.lower("run")).otherwise(F.translate("run", _UPPER, _LOWER)).alias("run"))
    found = found.select("run", F.crc32(F.concat_ws(":", "doc", "run")).alias("h"))
    at = F.pmod("h", F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = found.select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= least_letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _placed(parts: DataFrame) -> DataFrame:
    """(word, n, c, lo, hi, key, middle): the part of each row, and the letters between those its words share."""
    ending = F.greatest(F.col("c") - F.col("hi"), F.lit(0))
    inner = F.char_length("word") - F.col("lo") - ending
    return parts.select("*", F.concat_ws(" ", "c", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")), F.right("word", ending)).alias("key"),
                        F.substring("word", F.col("lo") + 1, inner).alias("middle"))


def _halves(lo, middle, hi):
    return F.explode(F.array(F.struct(lo.alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), hi.alias("hi")))).alias("span")


def _parts(words: DataFrame, scratch: Scratch, least_letters: int, part_words: int) -> list[DataFrame]:
    """Rows of ``_placed``, no part above ``part_words`` words unless its interval is a single letter."""
    size = F.char_length("word")
    classes = words.select("word", "n", F.explode(F.filter(F.array(size, size - 1), lambda c: c >= least_letters)).alias("c"))
    c = F.col("c")
    rows = _placed(classes.select("word", "n", "c", _halves(F.lit(0), F.floor(c / 2).cast("int"), c + 1)).select("word", "n", "c", "span.*"))
    ready = []
    while True:
        sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.max(F.col("hi") - F.col("lo")).alias("width"))
        big = scratch.stored(sizes.where((F.col("size") > part_words) & (F.col("width") > 1)).select("key", "size"), "spelling-big-parts")
        most = big.agg(F.max("size")).first()[0]
        if most is None:
            return [*ready, rows]
        # the rows of one big part are dealt to tasks of about part_words rows
        salts = max(1, min(1024, most // part_words))
        marks = big.select("key", F.lit(True).alias("big"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        marked = rows.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(salts)).cast("int")).join(marks, ["key", "salt"], "left").drop("salt")
        marked = scratch.stored(marked, "spelling-parts")
        ready.append(marked.where("big is null").drop("big"))
        lo, hi = F.col("lo"), F.col("hi")
        wide = marked.where("big").select("word", "n", "c", _halves(lo, F.floor((lo + hi) / 2).cast("int"), hi))
        rows = _placed(wide.select("word", "n", "c", "span.*"))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near, near_n), both ways, of the parts in sorted rows; a part may go on in the next batch."""
    acceptor = Acceptor()

    def enumerated(rows: list[tuple]) -> pa.RecordBatch:
        out: list[tuple[str, str, int]] = []
        nonlocal acceptor
        if len(acceptor.arcs) > REGISTER_STATES:
            acceptor = Acceptor()
        i = 0
        while i < len(rows):
            key = rows[i][0]
            j = i + 1
            while j < len(rows) and rows[j][0] == key:
                j += 1
            if j - i > 1:
                _, _, word, _, c, lo, hi = rows[i]
                by_middle = {r[1]: (r[2], r[3]) for r in rows[i:j]}
                start = acceptor.add(list(by_middle))
                for a, b in acceptor.near_pairs(start, c - max(c - hi, 0) - lo, hi - lo):
                    (word, n), (near, near_n) = by_middle[a], by_middle[b]
                    out += ((word, near, near_n), (near, word, n))
            i = j
        columns = zip(*out, strict=True) if out else ([], [], [])
        kinds = (pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["word", "near", "near_n"])

    held: list[tuple] = []
    for batch in batches:
        held += zip(*(batch.column(x).to_pylist() for x in ("key", "middle", "word", "n", "c", "lo", "hi")), strict=True)
        if len(held) >= RUN_ROWS:
            last = held[-1][0]
            cut = len(held)
            while cut and held[cut - 1][0] == last:
                cut -= 1
            if cut:
                yield enumerated(held[:cut])
                held = held[cut:]
    yield enumerated(held)


def near_words(words: DataFrame, scratch: Scratch, least_letters: int = LEAST_LETTERS, part_words: int = PART_WORDS) -> DataFrame:
    """(word, near, near_n): the words of ``words`` (word, n) one edit apart, a row for each way."""
    found = None
    for rows in _parts(words, scratch, least_letters, part_words):
        dealt = rows.select("key", "middle", "word", "n", "c", "lo", "hi").repartition("key").sortWithinPartitions("key", "middle")
        pairs = dealt.mapInArrow(_pairs, "word string, near string, near_n long")
        found = pairs if found is None else found.unionByName(pairs)
    return found


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) by pointer doubling; a form occurs ``ratio`` times as often, so paths are short and end."""
    roots = scratch.stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        after = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = scratch.stored(roots.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        roots = step.select("word", "root")
        if step.where("moved").isEmpty():
            return roots


#: The same rows in DuckDB: crc32 by its byte table, near words by their one-letter deletions.
ORACLE = r"""
WITH RECURSIVE bits AS (SELECT i, list_reduce(range(0, 8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i) AS v FROM range(0, 256) t(i)),
crc AS (SELECT list(v ORDER BY i) AS tab FROM bits),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]{6,}')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY ALL),
bytes AS (SELECT run, k, list_transform(string_split(regexp_replace(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '(..)', '\1 ', 'g'), ' ')[:-2], lambda x: ('0x' || x)::BIGINT) AS b FROM counted),
hashed AS (SELECT run, k, xor(list_reduce(b, lambda a, x: xor(a // 256, tab[xor(a % 256, x) + 1]), 4294967295), 4294967295) AS h FROM bytes, crc),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
gaps AS (SELECT word, n, unnest(range(0, length(word))) AS i FROM words),
less AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM gaps),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT w.word, l.word, l.n FROM words w JOIN less l ON w.word = l.rest UNION SELECT l.word, w.word, w.n FROM words w JOIN less l ON w.word = l.rest),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS form_n, arg_min(near, (-near_n, near)) AS near FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN near END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)),
paths AS (SELECT word, word AS last, 0 AS step FROM forms UNION ALL SELECT p.word, f.form, step + 1 FROM paths p JOIN forms f ON f.word = p.last WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(last, step) AS root FROM paths GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""


def spelling_variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT,
                      ratio: int = RATIO, slip: int = SLIP, part_words: int = PART_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs`` (doc_id, text; others are ignored).

    ``form`` is the near word of most occurrences (ties: the first in code-point order)
    where these are at least ``ratio`` times the word's, else null; ``root`` follows
    forms to the last. Repeated rows count again. Runs of any length are words; null
    and empty texts have none, and an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    words = scratch.stored(vocabulary(docs, least_letters, least_count, slip), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
    near = near_words(words, scratch, least_letters, part_words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "best")
    often = -F.col("best.minus") >= ratio * F.col("n")
    placed = scratch.stored(joined.select("word", "n", "n_near", F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.minus")).alias("form_n")), "spelling-forms")
    roots = _roots(placed.where("form is not null"), scratch)
    return placed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
