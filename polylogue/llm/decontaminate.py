"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Of each test item the words that stand in the fewest documents are kept, and a seed is
QUORUM of these near each other, in any order and with gaps (a skip-gram of rare words). The cover is
proven: an alignment worth ``least`` of an item of L words matches at least
ceil(least * L) of them, so of any L - ceil(least * L) + q words of the item it holds
q, and it is at most L * (1 + (1 - least) * MATCH / -GAP) words wide. So every passage
that scores enough has a seed, whatever words are changed, put in or left out, while
words that many documents or items share are no seeds as long as rarer ones
do. Of the words around a document's seeds, those go on to alignment where
ceil(least * L) words of the item stand within the width of an alignment, a bound that loses nothing. Local
alignment of the words scores how much of an item a passage holds, with edits, gaps
and changed words. Documents are read in place and nothing of them moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flagged_spans, span_hashes, text_chunks, text_runs

#: Rare words that make a seed, and least words of an item; words of one block of items, which is what a pass over the corpus broadcasts.
QUORUM, LEAST_WORDS, BLOCK_SEEDS = 6, 3, 2_000_000
#: Rare words of items, and words around seeds, that are looked at at once.
HITS, AROUND_WORDS = 1 << 16, 1 << 17
#: Alignment scores of a match, a changed word and a gap; share of an item's full score that marks a leak.
MATCH, CHANGE, GAP, LEAK = 2, -1, -1, 0.5

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _lower_chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks of the lower-case texts, made for one run of rows at a time."""
    for lo, hi in text_runs(batch.column("text")):
        low = pa.RecordBatch.from_arrays([pc.utf8_lower(batch.column("text").slice(lo, hi - lo))], ["text"])
        for a, b, data, offs in text_chunks(low, "text"):
            yield lo + a, lo + b, data, offs


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the words: runs of letters, digits and non-ASCII bytes."""
    starts, ends, row = flagged_spans(_WORD[data], offs)
    return row, span_hashes(data, starts, ends)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in _lower_chunks(batch):
            row, words = _words(data, offs)
            ends = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends), pa.array(words.view(np.int64)))], ["item_id", "words"])


def _found(seeds: np.ndarray, grams: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(seeds, grams), len(seeds) - 1)
    return seeds[at] == grams


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def least_matched(size: int, least: float) -> int:
    """How many words of an item an alignment worth ``least`` matches at least: matches alone add to its score."""
    return max(1, int(np.ceil(least * size - 1e-9)))


def rare_words(words: np.ndarray, documents: np.ndarray, least: float, quorum: int = QUORUM) -> tuple[np.ndarray, int]:
    """(places of an item's rarest words, how many of them every alignment worth ``least`` holds)."""
    matched = least_matched(len(words), least)
    q = max(1, min(quorum, matched))
    order = np.lexsort((np.arange(len(words)), words, documents))
    return np.sort(order[:len(words) - matched + q]), q


class Items:
    """The words of a block of items, the items of each rare word, and how far an alignment worth ``least`` reaches.

    ``documents`` has the number of documents with each word of ``vocabulary`` (sorted).
    """

    def __init__(self, ids: np.ndarray, words: list[np.ndarray], least: float, vocabulary: np.ndarray, documents: np.ndarray):
        self.ids, self.words, self.least = ids, words, least
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        # what gaps may cost an item of which all words match, and its own words
        self.reach = np.ceil(self.sizes * (1 + (1 - least) * MATCH / -GAP)).astype(np.int64)
        every = np.concatenate(words)
        self.vocabulary, self.codes = np.unique(every, return_inverse=True)
        counts = np.zeros(len(self.vocabulary), np.int64)
        if len(vocabulary):
            at = np.minimum(np.searchsorted(vocabulary, self.vocabulary), len(vocabulary) - 1)
            counts = np.where(vocabulary[at] == self.vocabulary, documents[at], 0)
        seeds, owners, self.quorum, self.matched = [], [], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for k, (size, first) in enumerate(zip(self.sizes.tolist(), self.firsts.tolist(), strict=True)):
            codes = self.codes[first:first + size]
            places, self.quorum[k] = rare_words(codes, counts[codes], least)
            self.matched[k] = least_matched(size, least)
            seeds.append(np.unique(codes[places]))
            owners.append(np.full(len(seeds[-1]), k))
        seeds, owners = np.concatenate(seeds), np.concatenate(owners)
        order = np.argsort(seeds, kind="stable")
        self.owner = owners[order]
        # of each word of the vocabulary: where its items begin among the owners, and how many there are
        self.seed_items = np.bincount(seeds, minlength=len(self.vocabulary))
        self.seed_firsts = np.cumsum(self.seed_items) - self.seed_items
        self.pairs = np.unique(np.repeat(np.arange(len(words)), self.sizes) * len(self.vocabulary) + self.codes)

    def around(self, row: np.ndarray, words: np.ndarray, n_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(row, item, start, end) of the passages around seeds that hold enough words of their item."""
        first = np.searchsorted(row, np.arange(n_rows + 1))
        known = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        known = np.where(self.vocabulary[known] == words, known, -1)
        at = np.flatnonzero((known >= 0) & (self.seed_items[known] > 0))
        seed = known[at]
        load = np.cumsum(self.seed_items[seed])
        widest = int(self.reach.max())
        begin = 0
        while begin < len(at):
            # rare words in runs of about HITS words times items; a run sees as far as a seed that begins in it reaches
            cut = max(begin + 1, int(np.searchsorted(load, (load[begin - 1] if begin else 0) + HITS, "right")))
            i, j, begin = begin, int(np.searchsorted(at, at[cut - 1] + widest, "right")), cut
            n = self.seed_items[seed[i:j]]
            item, place = self.owner[_spread(self.seed_firsts[seed[i:j]], n)], np.repeat(at[i:j], n)
            order = np.lexsort((place, item, row[place]))
            item, place = item[order], place[order]
            of, reach = row[place], self.reach[item]
            # the quorum's last word lies within reach of its first
            far = self.quorum[item] - 1
            last = np.minimum(np.arange(len(item)) + far, len(item) - 1)
            whole = (np.arange(len(item)) + far < len(item)) & (item[last] == item) & (of[last] == of) & (place[last] - place < reach)
            if not whole.any():
                continue
            # words of any quorum, chained where they are within reach
            part = np.zeros(len(item) + 1, np.int64)
            np.add.at(part, np.flatnonzero(whole), 1)
            np.add.at(part, last[whole] + 1, -1)
            held = np.cumsum(part)[:-1] > 0
            item, place, of, reach = item[held], place[held], of[held], reach[held]
            new = np.ones(len(item), bool)
            new[1:] = (of[1:] != of[:-1]) | (item[1:] != item[:-1]) | (place[1:] - place[:-1] > reach[1:])
            a = np.flatnonzero(new)
            b = np.append(a[1:], len(item)) - 1
            of, item, reach = of[a], item[a], reach[a]
            starts, ends = np.maximum(first[of], place[a] - reach), np.minimum(first[of + 1], place[b] + 1 + reach)
            yield from self._bounded(of, item, starts, ends, known)

    def _bounded(self, of: np.ndarray, item: np.ndarray, starts: np.ndarray, ends: np.ndarray, known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """The parts of these passages in which enough words of the item stand within an alignment's width, in runs of about AROUND_WORDS words."""
        width = ends - starts
        upto = np.cumsum(width)
        i = 0
        while i < len(item):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + AROUND_WORDS, "right")))
            place, pair = _spread(starts[i:j], width[i:j]), np.repeat(np.arange(i, j), width[i:j])
            some = known[place] >= 0
            place, pair = place[some], pair[some]
            own = _found(self.pairs, item[pair] * len(self.vocabulary) + known[place])
            place, pair = place[own], pair[own]
            far, reach = self.matched[item[pair]] - 1, self.reach[item[pair]]
            last = np.minimum(np.arange(len(pair)) + far, max(len(pair) - 1, 0))
            good = np.flatnonzero((np.arange(len(pair)) + far < len(pair)) & (pair[last] == pair) & (place[last] - place < reach))
            i = j
            if not len(good):
                continue
            # an alignment that holds these words lies between these places
            pair, begin, end = pair[good], place[last[good]] - reach[good] + 1, place[good] + reach[good]
            begin, end = np.maximum(begin, starts[pair]), np.minimum(end, ends[pair])
            new = np.ones(len(pair), bool)
            new[1:] = (pair[1:] != pair[:-1]) | (begin[1:] > end[:-1])
            a = np.flatnonzero(new)
            pair, begin, end = pair[a], begin[a], end[np.append(a[1:], len(pair)) - 1]
            keep = self._enough(item[pair], begin, end - begin, known)
            yield of[pair[keep]], item[pair[keep]], begin[keep], end[keep]

    def _enough(self, item: np.ndarray, starts: np.ndarray, width: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Which of the passages hold enough words of their item, each counted as often as the item has it."""
        size = self.sizes[item]
        which, pair = known[_spread(starts, width)], np.repeat(np.arange(len(item)), width)
        there = np.unique((pair * len(self.vocabulary) + which)[which >= 0])
        pair = np.repeat(np.arange(len(item)), size)
        held = _found(there, pair * len(self.vocabulary) + self.codes[_spread(self.firsts[item], size)])
        return np.bincount(pair[held], minlength=len(item)) >= self.matched[item]


def smith_waterman(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(best local score, end of that alignment in the passage) of each pair, a row of all pairs' tables at a time."""
    n = len(items)
    long, wide = max(map(len, items)), max(map(len, passages))
    a, b = np.zeros((n, long), np.int64), np.zeros((n, wide), np.int64)
    a_ok, b_ok = np.zeros((n, long), bool), np.zeros((n, wide), bool)
    for i, (x, y) in enumerate(zip(items, passages, strict=True)):
        a[i, :len(x)], a_ok[i, :len(x)] = x, True
        b[i, :len(y)], b_ok[i, :len(y)] = y, True
    slope = -GAP * np.arange(wide + 1, dtype=np.int32)
    row = np.zeros((n, wide + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(long):
        same = (b == a[:, i:i + 1]) & b_ok & a_ok[:, i:i + 1]
        up = row + GAP
        up[:, 1:] = np.maximum(up[:, 1:], row[:, :-1] + np.where(same, np.int32(MATCH), np.int32(CHANGE)))
        # gaps along the passage: the best of all cells to the left, less a gap for each step
        row = np.maximum(np.maximum.accumulate(np.maximum(up, 0) + slope, axis=1) - slope, 0).astype(np.int32)
        at = row.argmax(1)
        top = row[np.arange(n), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
    return best, end


def _align(items: list[np.ndarray], passages: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, start, end) of the best alignment of each pair; start and end only where the score is ``least`` or more."""
    scores, starts, ends = np.zeros(len(items)), np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    order = sorted(range(len(items)), key=lambda i: len(passages[i]))
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j + 1 - i) * len(passages[order[j]]) <= 1 << 14:
            j += 1
        pick = order[i:j]
        best, end = smith_waterman([items[k] for k in pick], [passages[k] for k in pick])
        scores[pick] = best / (MATCH * np.array([len(items[k]) for k in pick]))
        ends[pick] = end
        pick = [k for k in pick if scores[k] >= least]
        if pick:
            # the same alignment from its end backwards gives where it begins
            back = smith_waterman([items[k][::-1] for k in pick], [passages[k][:ends[k]][::-1] if ends[k] else passages[k][:1] for k in pick])[1]
            starts[pick] = ends[pick] - back
        i = j
    return scores, starts, ends


def _aligned(sent):
    """(doc_id, item_id, score, from_word, to_word) of the passages that score the least score or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for batch in batches:
            for lo, hi, data, offs in _lower_chunks(batch):
                row, words = _words(data, offs)
                first = np.searchsorted(row, np.arange(hi - lo))
                for of, item, starts, ends in block.around(row, words, hi - lo):
                    passages = [words[s:e] for s, e in zip(starts, ends, strict=True)]
                    scores, begins, stops = _align([block.words[k] for k in item], passages, block.least)
                    good = np.flatnonzero(scores >= block.least)
                    place = starts[good] - first[of[good]]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(lo + of[good], pa.int64())), pa.array(block.ids[item[good]], pa.int64()), pa.array(scores[good]),
                         pa.array(place + begins[good], pa.int64()), pa.array(place + stops[good], pa.int64())],
                        ["doc_id", "item_id", "score", "from_word", "to_word"])

    return run


def _documents_with(sent):
    """(word, n): how many texts of a task hold each word of the sorted vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        counts = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, _, data, offs in _lower_chunks(batch):
                row, words = _words(data, offs)
                hit = _found(vocabulary, words)
                there = np.unique(row[hit] * len(vocabulary) + np.searchsorted(vocabulary, words[hit]))
                counts += np.bincount(there % len(vocabulary), minlength=len(vocabulary))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary[some].view(np.int64)), pa.array(counts[some])], ["word", "n"])

    return run


def _blocks(docs: DataFrame, items: DataFrame, least: float, block_seeds: int) -> Iterator:
    """Broadcasts of the items, in blocks of about ``block_seeds`` words; the documents with each of a block's words are counted first."""
    spark = docs.sparkSession
    known = (items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null")
             .mapInArrow(_item_words, "item_id long, words array<long>").where(F.size("words") >= LEAST_WORDS).distinct())
    total = known.agg(F.sum(F.size("words")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_seeds))
    for block in range(blocks):
        part = known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow()
        if part.num_rows:
            words = [x.values.to_numpy().view(np.uint64) for x in part.column("words")]
            vocabulary = np.unique(np.concatenate(words))
            found = docs.select("text").mapInArrow(_documents_with(spark.sparkContext.broadcast(vocabulary)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
            held = found["word"].to_numpy(np.int64).view(np.uint64)
            order = np.argsort(held)
            yield spark.sparkContext.broadcast(Items(part.column("item_id").to_numpy(), words, least, held[order], found["n"].to_numpy(np.int64)[order]))


def aligned_passages(docs: DataFrame, items: DataFrame, least: float = LEAK, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """(doc_id, item_id, score, from_word, to_word): the best passage of every document and item with ``score >= least``.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored.
    score is the alignment's share of the item's full score, from_word and to_word bound
    the passage in words of the document. Null and empty texts, and items of fewer than
    three words, give nothing. Rows repeated under one id count once; of equally good passages
    the first is given. Texts of any length are read whole. Items are taken
    in blocks of about ``block_seeds`` words, for each of which the documents are read twice.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for sent in _blocks(docs, items, least, block_seeds):
        best = (docs.mapInArrow(_aligned(sent), "doc_id long, item_id long, score double, from_word long, to_word long").groupBy("doc_id", "item_id")
                .agg(F.max(F.struct("score", -F.col("from_word"), "to_word")).alias("b"))
                .select("doc_id", "item_id", "b.score", (-F.col("b.col2")).alias("from_word"), "b.to_word"))
        out = best if out is None else out.unionByName(best)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, score double, from_word long, to_word long")
    return out


def _clean_rows(sent):
    """The rows that hold no passage of the block's items."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for batch in batches:
            for lo, hi, data, offs in _lower_chunks(batch):
                row, words = _words(data, offs)
                clean = np.ones(hi - lo, bool)
                for of, item, starts, ends in block.around(row, words, hi - lo):
                    scores = _align([block.words[k] for k in item], [words[s:e] for s, e in zip(starts, ends, strict=True)], block.least)[0]
                    clean[of[scores >= block.least]] = False
                yield batch.slice(lo, hi - lo).filter(pa.array(clean))

    return run


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a passage of the benchmark go.

    Each row is judged where it lies, so no text moves, and rows that share an id or have none are told apart.
    """
    for sent in _blocks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), LEAK, BLOCK_SEEDS):
        docs = docs.mapInArrow(_clean_rows(sent), docs.schema)
    return docs
