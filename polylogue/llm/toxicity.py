"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon is learned: words that stand in many different places of texts
labelled toxic and hardly in others. Equal texts teach once, and places are counted,
not texts, so that copies neither make nor unmake a term. Its trie is intersected with Levenshtein
automata into deterministic tables that accept each term and, from FUZZY_FROM
letters on, each word one edit away; a whole batch of words runs through a table
one letter at a time, and nearly all words leave after two or three letters.
A hit counts as quotation when it stands in quotation marks, in a line marked as
quoted, or next to a word of reporting, unless its window also addresses the
reader; otherwise it counts as abuse. A logistic regression over the counts of
abusive, misspelled and quoted hits gives the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, flagged_spans, held_out, text_lists

#: The model is fitted on about so many labelled rows at most, chosen by a hash of doc_id.
TRAIN_ROWS = 60_000
#: A term stands in at least MIN_CONTEXTS different places (words before and after it)
#: of toxic texts and is ODDS times likelier there, with evidence that no candidate is
#: expected to reach by chance.
MIN_CONTEXTS, ODDS = 3, 20.0
#: Terms of one table; one in EARLY clean texts is read before the others.
TABLE_TERMS, EARLY = 150, 16
#: Letters from which a term may have one edit; words of a hit's window on either side.
FUZZY_FROM, WINDOW = 5, 8
#: Weight of misspelled hits before any evidence, as a share of that of exact ones.
MISSPELLED = 0.8
#: Documents with at least this score are toxic.
THRESHOLD = 0.3
#: Characters of text expanded at once.
CHUNK_CHARS = 1 << 19

#: Words of reporting and of address.
REPORTING = frozenset("said says wrote writes quoted quote quotes called term word insult slur zitat sagte schrieb wort dit écrit mot cité dijo escribió palabra".split())
ADDRESS = frozenset("you your youre yours u ur du dich dir dein tu toi te ton vous tú ti usted".split())
_OPEN, _CLOSE = "“«„", "”»"


class Automaton:
    """Table of a trie of terms intersected with Levenshtein automata: state, symbol -> state (0: dead)."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        children: list[dict[str, int]] = [{}]
        final: dict[int, int] = {}
        for t, term in enumerate(terms):
            node = 0
            for c in term:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                node = children[node][c]
            final[node] = t
        self.symbols = {c: i + 1 for i, c in enumerate(sorted(set("".join(terms))))}
        letters = list(self.symbols)
        # only nodes on the way to a term that allows an edit may spend one
        edits = [False] * len(children)
        for node in range(len(children) - 1, -1, -1):
            edits[node] = (node in final and len(terms[final[node]]) >= FUZZY_FROM) or any(edits[x] for x in children[node].values())

        def closed(at: set[tuple[int, int]]) -> frozenset:
            at = at | {(x, 1) for node, e in at if e == 0 for x in children[node].values() if edits[x]}
            return frozenset((node, e) for node, e in at if e == 0 or (node, 0) not in at)

        def step(state: frozenset, c: str) -> set[tuple[int, int]]:
            out = set()
            for node, e in state:
                if c in children[node]:
                    out.add((children[node][c], e))
                if e == 0 and edits[node]:
                    out.add((node, 1))
                    out.update((x, 1) for x in children[node].values() if edits[x])
            return out

        states = {frozenset(): 0}
        start = closed({(0, 0)})
        states[start] = 1
        todo, table = [start], [[0] * (len(letters) + 1), None]
        while todo:
            state = todo.pop()
            row = []
            for c in ["", *letters]:
                new = closed(step(state, c))
                if new not in states:
                    states[new] = len(states)
                    table.append(None)
                    todo.append(new)
                row.append(states[new])
            table[states[state]] = row
        self.table = np.array(table, np.int32)
        #: 0: no term; t + 1: term t; -(t + 1): term t with an edit.
        self.accepts = np.zeros(len(table), np.int32)
        for state, i in states.items():
            for node, e in sorted(state, key=lambda x: -x[1]):
                if node in final and (e == 0 or len(terms[final[node]]) >= FUZZY_FROM):
                    self.accepts[i] = (final[node] + 1) * (1 if e == 0 else -1)

    def run(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """What the automaton accepts for each span of code points (see ``accepts``)."""
        symbol = np.zeros(0x110000, np.uint16 if len(self.symbols) < 1 << 16 else np.int32)
        for c, i in self.symbols.items():
            symbol[ord(c)] = i
        symbols = symbol[codes]
        state, size = np.ones(len(starts), np.int32), ends - starts
        live, k = np.arange(len(starts)), 0
        while len(live):
            state[live] = now = self.table[state[live], symbols[starts[live] + k]]
            k += 1
            live = live[(now > 0) & (size[live] > k)]
        return self.accepts[state]


_WORD_FLAGS: list[np.ndarray] = []


def _is_word() -> np.ndarray:
    if not _WORD_FLAGS:
        flags = np.zeros(0x110000, bool)
        flags[[i for i in range(0x30000) if chr(i).isalnum() or i == 0x5F]] = True
        _WORD_FLAGS.append(flags)
    return _WORD_FLAGS[0]


def _word_runs(texts: list[str]) -> Iterator[tuple[int, list[str], str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, lower-case texts, joined, code points, starts, ends, rows) of runs of about CHUNK_CHARS characters."""
    lo = 0
    while lo < len(texts):
        hi, n = lo, 0
        while hi < len(texts) and (hi == lo or n + len(texts[hi]) <= CHUNK_CHARS):
            n += len(texts[hi])
            hi += 1
        low = [t.lower() for t in texts[lo:hi]]
        whole = "".join(low)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        offs = np.concatenate(([0], np.cumsum([len(t) for t in low]))).astype(np.int64)
        starts, ends, rows = flagged_spans(_is_word()[codes], offs)
        yield lo, low, whole, codes, starts, ends, rows
        lo = hi


@dataclass
class ToxicityModel:
    """Learned terms as automata, variants that clean texts use, and the weights of the counts."""

    automata: list[Automaton]
    clean_variants: frozenset
    weights: np.ndarray

    def score(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_features(counts) @ self.weights, -30, 30)))


def _features(counts: np.ndarray) -> np.ndarray:
    """Steps of the counts (abuse, misspelled, quoted) and a constant."""
    a, m, q = counts.T
    return np.stack([np.ones(len(counts)), a >= 1, a >= 2, a >= 4, m >= 1, m >= 2, m >= 4, q >= 1, q >= 2], 1).astype(float)


_SPACES = np.array([i for i in range(0x3001) if chr(i).isspace()], np.uint32)


def _quoted(codes: np.ndarray, bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of the spans stand in quotation marks or in a line marked as quoted, by the places of the marks in the joined texts, which end at ``bounds``."""
    def places(chars: str) -> np.ndarray:
        return np.flatnonzero(np.isin(codes, np.array([ord(c) for c in chars], np.uint32)))

    def last_before(of: np.ndarray, at: np.ndarray) -> np.ndarray:
        k = np.searchsorted(of, at)
        return np.where(k > 0, of[np.maximum(k - 1, 0)], -1) if len(of) else np.full(len(at), -1)

    def between(of: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return np.searchsorted(of, hi) - np.searchsorted(of, lo)

    # a line begins after a line break or where a text does, and ends before the next of either
    breaks = places("\n")
    begins, stops = np.union1d(breaks + 1, np.concatenate(([0], bounds))), np.union1d(breaks, bounds)
    line, stop = begins[np.searchsorted(begins, starts, "right") - 1], stops[np.searchsorted(stops, ends)]
    marks, closing = places('"'), places(_CLOSE + "“")
    paired = (between(marks, line, starts) % 2 == 1) & (between(marks, ends, stop) > 0)
    opened, closed = last_before(places(_OPEN), starts), last_before(places(_CLOSE), starts)
    inside = (opened >= line) & (opened > closed) & (between(closing, ends, stop) > 0)
    arrows = places(">")
    k = np.searchsorted(arrows, line)
    first = np.append(arrows, len(codes))[k]  # the first arrow from the line's begin, with nothing but white space before it
    ink = np.append(np.flatnonzero(~np.isin(codes, _SPACES)), len(codes))
    marked = (first < starts) & (ink[np.searchsorted(ink, line)] == first)
    return paired | inside | marked


def _hits(model: ToxicityModel, texts: list[str]) -> Iterator[tuple[int, int, int, str, bool, bool]]:
    """(row, start, end, term, misspelled, quoted) of the terms in ``texts``; offsets are into the lower-case text."""
    for lo, low, whole, codes, starts, ends, rows in _word_runs(texts):
        bases = np.cumsum([0, *map(len, low)])
        found = [(i, automaton.terms[abs(a) - 1], a < 0) for automaton in model.automata
                 for got in [automaton.run(codes, starts, ends)] for i, a in zip(np.flatnonzero(got).tolist(), got[got != 0].tolist(), strict=True)]
        found = [(i, term, edited) for i, term, edited in found if not (edited and whole[starts[i]:ends[i]] in model.clean_variants)]
        if len(model.automata) > 1:  # one hit a word: the term itself, else the first of those it may be
            found = list({i: (i, term, edited) for i, term, edited in sorted(found, key=lambda x: (x[2], x[1]), reverse=True)}.values())
        if not found:
            continue
        at = np.array([i for i, _, _ in found])
        # the words of all windows, each looked up once
        first = np.maximum(np.searchsorted(rows, rows[at]), at - WINDOW)
        last = np.minimum(np.searchsorted(rows, rows[at], "right"), at + WINDOW + 1)
        near = np.zeros(len(starts) + 1, np.int64)
        np.add.at(near, first, 1)
        np.add.at(near, last, -1)
        address, reporting = np.zeros(len(starts) + 1, np.int64), np.zeros(len(starts) + 1, np.int64)
        for i in np.flatnonzero(np.cumsum(near)[:-1] > 0).tolist():
            word = whole[starts[i]:ends[i]]
            address[i + 1], reporting[i + 1] = word in ADDRESS, word in REPORTING
        address, reporting = np.cumsum(address), np.cumsum(reporting)
        quoted = (address[last] == address[first]) & ((reporting[last] > reporting[first]) | _quoted(codes, bases[1:], starts[at], ends[at]))
        for (i, term, edited), q in zip(found, quoted.tolist(), strict=True):
            row = int(rows[i])
            yield lo + row, int(starts[i] - bases[row]), int(ends[i] - bases[row]), term, edited, q


def _counts(model: ToxicityModel, texts: list[str]) -> np.ndarray:
    counts = np.zeros((len(texts), 3), np.int64)
    for row, _, _, _, misspelled, quoted in _hits(model, texts):
        counts[row, 2 if quoted else int(misspelled)] += 1
    return counts


def _places(width: int, wanted=None):
    """(word, first of its places in a text: ``width`` words on either side) of each distinct word of each text, or of the wanted ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = wanted.value if wanted is not None else None
        for batch in batches:
            for _, texts in text_lists(batch, "text"):
                words, places = [], []
                for text in texts:
                    all_words = re.findall(r"\w+", text.lower())
                    first: dict[str, int] = {}
                    for i, w in enumerate(all_words):
                        if only is None or w in only:
                            first.setdefault(w, i)
                    words += first
                    places += [f"{' '.join(all_words[max(0, i - width):i])}|{' '.join(all_words[i + 1:i + 1 + width])}" for i in first.values()]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(places, pa.string())], ["word", "place"])

    return run


def _variants(automata):
    """Distinct words of a batch that are one edit from a term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[str] = set()
            for _, texts in text_lists(batch, "text"):
                for _, _, whole, codes, starts, ends, _ in _word_runs(texts):
                    for a in automata.value:
                        found.update(whole[starts[i]:ends[i]] for i in np.flatnonzero(a.run(codes, starts, ends) < 0))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["word"])

    return run


def _evidence(bad: int, good: int, share: float) -> float:
    """Log likelihood ratio of a word's own share of toxic texts against the share of all."""
    own = bad / (bad + good)
    return bad * np.log(own / share) + (good * np.log((1 - own) / (1 - share)) if good else 0.0)


def _fit(counts: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Logistic regression over cells of equal counts. Misspelled hits are taken to weigh
    MISSPELLED times what exact hits do, until texts that hold some show otherwise."""
    x = _features(counts)
    w = _newton(x, toxic, n, np.zeros(x.shape[1]))
    prior = np.zeros(x.shape[1])
    prior[4:7] = MISSPELLED * np.maximum(w[1:4], 0)
    return _newton(x, toxic, n, prior)


def _newton(x: np.ndarray, toxic: np.ndarray, n: np.ndarray, prior: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = prior.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - toxic)) + ridge * (w - prior)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit lexicon and weights on labelled rows outside the held-out fold.

    ``train_rows`` bounds the labelled rows: beyond it a hash of doc_id picks the
    share. Null labels, ids or texts teach nothing; an id labelled twice counts as
    toxic if either label says so. Copies of a text with equal labels teach as one text.
    Without toxic rows the lexicon is empty.
    """
    spark = docs.sparkSession
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    share = min(1.0, train_rows / max(1, usable.count()))
    marks = (usable.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(7)), F.lit(1 << 20)) < round(share * (1 << 20)))
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")))
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(marks), "doc_id")
    train = train.select("doc_id", F.sha2("text", 256).alias("text_key"), (F.col("toxic") == 1).cast("int").alias("toxic"), "text")
    scratch = Scratch(spark)
    train = scratch.stored(train.dropDuplicates(["text_key", "toxic"]), "toxicity-training")
    half = F.pmod(F.xxhash64("text_key", F.lit(3)), F.lit(2))
    toxic, clean = train.where("toxic = 1").select("text"), train.where("toxic <> 1").select("text")
    kind = "word string, place string"
    candidates = scratch.stored(toxic.mapInArrow(_places(1), kind).select("word", F.xxhash64("place").alias("place")).distinct()
                                .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_CONTEXTS), "toxicity-candidates")
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    n_candidates = candidates.count()
    needed = np.log(max(1, n_candidates)) + 2
    # what a word in no clean text could show at most settles most candidates
    likely = candidates.where(F.col("n") * float(_evidence(1, 0, bad / max(1, bad + good))) >= float(needed)) if bad and good else candidates
    seen = likely.orderBy(F.desc("n"), "word").toPandas()
    terms = list(zip(seen["word"], seen["n"], strict=True))
    send = spark.sparkContext.broadcast
    # places in clean texts only speak against a word, so common words are settled by a part of these texts
    for texts in (clean.where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(EARLY)) == 0), clean):
        there = (texts.mapInArrow(_places(2, send(frozenset(w for w, _ in terms))), kind).select("word", F.xxhash64("place").alias("place")).distinct()
                 .groupBy("word").agg(F.count("*").alias("n")).toPandas())
        in_clean = dict(zip(there["word"], there["n"], strict=True))
        terms = [(w, n) for w, n in terms if (n + 0.5) / (bad + 1) >= ODDS * (in_clean.get(w, 0) + 0.5) / (good + 1)
                 and _evidence(n, in_clean.get(w, 0), bad / (bad + good)) >= needed]
    terms = [w for w, _ in terms]
    automata = [Automaton(terms[i:i + TABLE_TERMS]) for i in range(0, len(terms), TABLE_TERMS)]
    # variants found in one half of the clean texts are left out when the weights are fitted on the other
    # half, so that unseen words near a term weigh what they weigh in texts not read yet
    halves = {h: frozenset(clean_half.mapInArrow(_variants(send(automata)), "word string").distinct().toPandas()["word"]) - frozenset(terms)
              for h in (0, 1) for clean_half in [train.where((half == h) & (F.col("toxic") != 1)).select("text")]}
    model = ToxicityModel(automata, halves[0], np.zeros(9))
    # the weights come from counts of equal cells; steps beyond four hits are alike
    cells = (_counted(train.where(half == 1), model, "toxic").select("toxic", *(F.least(F.col(c), F.lit(4)).alias(c) for c in ("abuse", "misspelled", "quoted")))
             .groupBy("toxic", "abuse", "misspelled", "quoted").agg(F.count("*").alias("n")).toPandas())
    model.clean_variants = halves[0] | halves[1]
    if len(cells):
        model.weights = _fit(cells[["abuse", "misspelled", "quoted"]].to_numpy(), (cells["toxic"] == 1).to_numpy(float), cells["n"].to_numpy(float))
    scratch.drop()
    return model


def _counted(docs: DataFrame, model: ToxicityModel, *extra: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in text_lists(batch, "text"):
                counts = _counts(sent.value, texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(lo, len(texts)) for c in ("doc_id", *extra)] + [pa.array(c) for c in counts.T] + [pa.array(sent.value.score(counts))],
                    ["doc_id", *extra, "abuse", "misspelled", "quoted", "score"])

    kinds = "".join(f"{c} {dict(docs.dtypes)[c]}, " for c in extra)
    return docs.select("doc_id", *extra, "text").mapInArrow(run, f"doc_id long, {kinds}abuse long, misspelled long, quoted long, score double")


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, abuse, misspelled, quoted, score) of every row of ``docs`` (doc_id, text; others are ignored).

    Null and empty texts have no hits and get the score of that. Repeated rows are
    scored alike; an empty table gives an empty result. Texts of any length are read whole. A word
    that is one edit from several terms is one hit; a term itself is never a misspelling of another.
    """
    return _counted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)


def term_spans(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, start, end, term, misspelled, quoted): a row per hit; offsets are into the lower-case text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            found = [(ids[lo + h[0]], *h[1:]) for lo, texts in text_lists(batch, "text") for h in _hits(sent.value, texts)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
            columns = zip(*found, strict=True) if found else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             ["doc_id", "start", "end", "term", "misspelled", "quoted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, start long, end long, term string, misspelled boolean, quoted boolean")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a score of THRESHOLD or more go."""
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in text_lists(batch, "text"):
                scores = sent.value.score(_counts(sent.value, texts))
                yield batch.slice(lo, len(texts)).filter(pa.array(scores < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
