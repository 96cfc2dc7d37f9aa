"""Secret scans by a linear-chain conditional random field.

Fixed rules find the base spans: assignments to names of secrets, access keys and long
hexadecimal runs. A conditional random field over the tokens of a text (O outside, B
first, I later token of a secret) learns from them what stands around a secret and
what it looks like, and adds the spans that the rules miss. A token's features are
its shape and length, the words and signs next to it, and shares of the whole text.
Every second pass hides the words before it, so that the names in the rules do not
carry all the weight and shape and signs alone can tell a secret.
The best tags are found by Viterbi. Where O leads by more than any two transitions
can return it is in the best path, so a text is decoded only between such tokens,
and the rest of it costs no more than its features.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_CODES, flagged_spans, span_hashes, text_chunks

#: The rules of the base spans, and the least letters of what they find.
KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_NAMES = (b"passw", b"secret", b"token", b"api")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: The field is fitted on windows of about so many texts with base spans and as many times two without, chosen by a hash of doc_id.
TRAIN_TEXTS = 512
#: Tokens of a window, windows of a text, passes, windows of a step, step size, penalty.
WINDOW, WINDOWS, EPOCHS, STEP_WINDOWS, RATE, L2 = 32, 4, 12, 64, 0.2, 1e-4
#: A span that the field adds has at least so many letters.
LEAST_ADDED = 6

O, B, I = range(3)  # noqa: E741


def _flags(chars: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_DIGIT, _LOW, _UP, _HIGH = _flags(range(0x30, 0x3A)), _flags(range(0x61, 0x7B)), _flags(range(0x41, 0x5B)), _flags(range(0x80, 0x100))
_SIGN, _HEX = _flags(b"_+/-"), _flags(b"0123456789abcdef")
_TOKEN = _DIGIT | _LOW | _UP | _HIGH | _SIGN
_ALNUM = _DIGIT | _LOW | _UP
#: One bit for each kind of letter inside tokens, and for each kind of sign between them.
_SHAPE = (_LOW * 1 | _UP * 2 | _DIGIT * 4 | (_SIGN | _flags(b".")) * 8 | _HIGH * 16).astype(np.uint8)
_GAP = (_flags(b"=") * 1 | _flags(b":") * 2 | _flags(b"\"'`") * 4 | _flags(b"\n\r") * 8 | _flags(b" \t") * 16).astype(np.uint8)
_GAP[~_TOKEN & (_GAP == 0)] = 32
_LENGTHS = np.array([2, 3, 4, 6, 8, 12, 16, 20, 24, 32, 40])

_WORDS = 1 << 12
#: Where the cells of each feature begin.
_SIZES = {"constant": 1, "shape": 32 * 12, "turns": 2 * 8 * 2, "before": _WORDS, "after": _WORDS, "gap before": 128, "gap after": 128, "word and gap": _WORDS, "text": 128, "mixed": 128}
_AT = dict(zip(_SIZES, np.cumsum([0, *_SIZES.values()]).tolist(), strict=False))
CELLS = sum(_SIZES.values())


def base_spans(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, kind, start, end, start of the secret itself) of the rules' spans, in bytes of ``data``."""
    starts, ends, rows = flagged_spans(_HEX[data], offs)
    long = np.flatnonzero(ends - starts >= LEAST_HEX)
    for k in long.tolist():
        yield int(rows[k]), 2, int(starts[k]), int(ends[k]), int(starts[k])
    raw = data.tobytes()
    for rule, kind, needles, hay in ((_ASSIGN, 0, _NAMES, raw.lower()), (_ACCESS, 1, (b"AKIA",), raw)):
        held = set()
        for needle in needles:
            at = hay.find(needle)
            while at >= 0:
                row = int(np.searchsorted(offs, at, "right")) - 1
                held.add(row)
                at = hay.find(needle, int(offs[row + 1]))  # on with the next row
        for row in sorted(held):
            lo = int(offs[row])
            for m in rule.finditer(raw[lo:int(offs[row + 1])]):
                value = m.start(1) if kind == 0 else m.start()
                if m.end() - value >= (LEAST_VALUE if kind == 0 else LEAST_ACCESS):
                    yield row, kind, lo + m.start(), lo + m.end(), lo + value


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row): runs of letters, digits and ``_+/-``, with points between letters or digits."""
    inside = _TOKEN[data]
    point = data == 0x2E
    if len(data) > 2:
        alnum = _ALNUM[data]
        point[1:-1] &= alnum[:-2] & alnum[2:]
    edges = np.concatenate((offs[:-1], offs[1:] - 1))
    point[edges[(edges >= 0) & (edges < len(data))]] = False
    return flagged_spans(inside | point, offs)


def _any_bits(bits: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bits that occur in each span; none in an empty one."""
    if not len(starts):
        return np.zeros(0, np.int64)
    pairs = np.stack((starts, ends), 1).ravel()
    return np.where(ends > starts, np.bitwise_or.reduceat(np.append(bits, np.uint8(0)), pairs)[::2], 0).astype(np.int64)


def _running(flags: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))


def features(data: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(token, feature) -> cell; a token's cells depend on its own text alone."""
    n = len(starts)
    size = ends - starts
    length = np.digitize(size, _LENGTHS)
    long = (size >= 12).astype(np.int64)
    shape_bits = _SHAPE[data]
    shape = _any_bits(shape_bits, starts, ends)
    digits, hexes = _running(_DIGIT[data]), _running(_HEX[data])
    turn = np.zeros(len(data), bool)
    turn[1:] = shape_bits[1:] != shape_bits[:-1]
    turns = _running(turn)
    turned = np.minimum(turns[ends] - turns[np.minimum(starts + 1, ends)], 15)
    is_hex = hexes[ends] - hexes[starts] == size
    words = (span_hashes(data, starts, ends, LOWER_CODES) >> np.uint64(52)).astype(np.int64)
    first, last = np.ones(n, bool), np.ones(n, bool)
    first[1:] = rows[1:] != rows[:-1]
    last[:-1] = first[1:]
    before = np.where(first, 0, np.roll(words, 1))
    after = np.where(last, 0, np.roll(words, -1))
    gap_before = _any_bits(_GAP[data], np.where(first, offs[rows], np.roll(ends, 1)), starts)
    gap_after = _any_bits(_GAP[data], ends, np.where(last, offs[rows + 1], np.roll(starts, -1)))
    bytes_of = np.maximum(offs[1:] - offs[:-1], 1)
    digit_share = np.minimum((digits[offs[1:]] - digits[offs[:-1]]) * 32 // bytes_of, 7)
    signs = _running((_GAP[data] & 3) > 0)
    sign_share = np.minimum((signs[offs[1:]] - signs[offs[:-1]]) * 256 // bytes_of, 7)
    text = (digit_share * 8 + sign_share)[rows]
    mixed = (size >= 16) & (turned >= 4) & ((shape & 4) > 0) & ((shape & 3) > 0)
    found = {
        "constant": np.zeros(n, np.int64), "shape": shape * 12 + length, "turns": (is_hex * 8 + turned // 2) * 2 + long,
        "before": before, "after": after, "gap before": gap_before * 2 + long, "gap after": gap_after * 2 + long,
        "word and gap": (before * 37 + gap_before * 101 + long) % _WORDS, "text": text * 2 + long, "mixed": gap_before * 2 + mixed,
    }
    return np.stack([found[f] + _AT[f] for f in _SIZES], 1).astype(np.int32)


def tag_labels(starts: np.ndarray, ends: np.ndarray, secrets: list[tuple[int, int]]) -> np.ndarray:
    """The tag of each token, given the (start, end) of the secrets."""
    tags = np.zeros(len(starts), np.int8)
    for s, e in sorted(secrets):
        lo, hi = int(np.searchsorted(ends, s, "right")), int(np.searchsorted(starts, e))
        tags[lo:hi] = np.where(tags[lo:hi] == O, I, tags[lo:hi])
        if lo < hi and (lo == 0 or tags[lo - 1] == O):
            tags[lo] = B
    return tags


@dataclass
class SecretField:
    """Weights of the cells for each tag, and of the transitions; a text begins and ends as if next to an O."""

    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, cells: np.ndarray) -> np.ndarray:
        out = np.zeros((len(cells), 3))
        for k in range(cells.shape[1]):
            out += self.weights[cells[:, k]]
        return out

    def most_gain(self) -> float:
        """What the transitions around a token can gain at most when its tag is not O."""
        t = self.moves
        return float((t[:, None, :] + t.T[None, :, :] - t[:, O][:, None, None] - t[O][None, :, None]).max())

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """The best tags of one sequence between two O."""
        n = len(scores)
        back = np.zeros((n, 3), np.int8)
        best = self.moves[O] + scores[0]
        for t in range(1, n):
            ways = best[:, None] + self.moves
            back[t] = ways.argmax(0)
            best = ways.max(0) + scores[t]
        tags = np.zeros(n, np.int8)
        tags[-1] = (best + self.moves[:, O]).argmax()
        for t in range(n - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags

    def decode(self, cells: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The best tags of the tokens of several texts."""
        scores = self.emissions(cells)
        tags = np.zeros(len(rows), np.int8)
        unsure = np.flatnonzero(scores[:, O] - scores[:, 1:].max(1) <= self.most_gain())
        if len(unsure):
            breaks = np.flatnonzero((np.diff(unsure) > 1) | (np.diff(rows[unsure]) > 0)) + 1
            for run in np.split(unsure, breaks):
                tags[run] = self.viterbi(scores[run])
        return tags


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def gradient(model: SecretField, cells: np.ndarray, tags: np.ndarray, used: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(negative log likelihood, its slope by emission (window, token, tag), by transition) of windows with ``used`` tokens."""
    n, size, _ = cells.shape
    scores = np.zeros((n, size, 3))
    for k in range(cells.shape[2]):
        scores += model.weights[cells[:, :, k]]
    padding = ~used
    scores[padding] = (0, -1e9, -1e9)  # what is beyond a window is O
    tags = np.where(padding, O, tags)
    ahead, behind = np.zeros((n, size, 3)), np.zeros((n, size, 3))
    ahead[:, 0] = model.moves[O] + scores[:, 0]
    behind[:, -1] = model.moves[:, O]
    for t in range(1, size):
        ahead[:, t] = _log_sum(ahead[:, t - 1, :, None] + model.moves, 1) + scores[:, t]
        behind[:, -1 - t] = _log_sum(model.moves + (scores[:, -t] + behind[:, -t])[:, None, :], 2)
    total = _log_sum(ahead[:, -1] + behind[:, -1], 1)
    shares = np.exp(ahead + behind - total[:, None, None])
    one = np.eye(3)[tags]
    padded = np.pad(tags, ((0, 0), (1, 1)))
    path = np.take_along_axis(scores, tags[:, :, None].astype(np.int64), 2).sum((1, 2)) + model.moves[padded[:, :-1], padded[:, 1:]].sum(1)
    pairs = np.exp(ahead[:, :-1, :, None] + model.moves + (scores + behind)[:, 1:, None, :] - total[:, None, None, None]).sum((0, 1))
    pairs[O] += shares[:, 0].sum(0)
    pairs[:, O] += shares[:, -1].sum(0)
    np.subtract.at(pairs, (padded[:, :-1], padded[:, 1:]), 1)
    return float((total - path).sum()), np.where(padding[:, :, None], 0, shares - one), pairs


def _fit(table: pa.Table) -> pa.Table:
    """Weights by AdaGrad over the windows in the order of their hash."""
    table = table.sort_by([("order", "ascending"), ("doc_id", "ascending"), ("at", "ascending")])
    tags = np.zeros((len(table), WINDOW), np.int64)
    used = np.zeros((len(table), WINDOW), bool)
    cells = np.zeros((len(table), WINDOW, len(_SIZES)), np.int64)
    for k, (t, c) in enumerate(zip(table.column("tags").to_pylist(), table.column("cells").to_pylist(), strict=True)):
        tags[k, :len(t)], used[k, :len(t)] = np.frombuffer(t, np.int8), True
        cells[k, :len(t)] = np.frombuffer(c, "<i4").reshape(len(t), -1)
    model = SecretField(np.zeros((CELLS, 3)), np.zeros((3, 3)))
    seen_w, seen_m = np.full((CELLS, 3), 1e-6), np.full((3, 3), 1e-6)
    names = [list(_SIZES).index(f) for f in ("before", "word and gap")]
    hidden = cells.copy()
    hidden[:, :, names] = [_AT["before"], _AT["word and gap"]]
    for epoch in range(EPOCHS):
        shown = (hidden, cells)[epoch % 2]
        for lo in range(0, len(table), STEP_WINDOWS):
            part = slice(lo, lo + STEP_WINDOWS)
            _, by_token, by_move = gradient(model, shown[part], tags[part], used[part])
            touched, where = np.unique(shown[part], return_inverse=True)
            slope = np.zeros((len(touched), 3))
            np.add.at(slope, where.ravel(), np.repeat(by_token.reshape(-1, 3), len(_SIZES), 0))
            slope += L2 * model.weights[touched]
            seen_w[touched] += slope * slope
            model.weights[touched] -= RATE * slope / np.sqrt(seen_w[touched])
            by_move += L2 * model.moves
            seen_m += by_move * by_move
            model.moves -= RATE * by_move / np.sqrt(seen_m)
    return pa.table({"weights": pa.array([model.weights.astype("<f8").tobytes()], pa.binary()), "moves": pa.array([model.moves.astype("<f8").tobytes()], pa.binary())})


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, and texts with base spans, of each run of rows."""
    for batch in batches:
        for lo, hi, data, offs in text_chunks(batch, "text"):
            held = len({row for row, *_ in base_spans(data, offs)})
            yield pa.RecordBatch.from_arrays([pa.array([hi - lo - held]), pa.array([held])], ["without", "held"])


def _windows(shares: tuple[float, float]):
    """Windows of the texts whose hash (``place``, 0 to 1) is below the share of their kind (without, with base spans)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, place, order = (batch.column(c).to_pylist() for c in ("doc_id", "place", "order"))
            for lo, _, data, offs in text_chunks(batch, "text"):
                starts, ends, rows = tokens(data, offs)
                cells = features(data, offs, starts, ends, rows)
                secrets: dict[int, list] = {}
                for row, _, _, e, value in base_spans(data, offs):
                    secrets.setdefault(row, []).append((value, e))
                out = []
                first = np.searchsorted(rows, np.arange(len(offs)))
                for r in range(len(offs) - 1):
                    a, b = int(first[r]), int(first[r + 1])
                    if a == b or place[lo + r] >= shares[r in secrets]:
                        continue
                    tags = tag_labels(starts[a:b], ends[a:b], secrets.get(r, []))
                    marks = np.flatnonzero(tags == B)
                    digits = np.flatnonzero(_DIGIT[data[starts[a:b]]] | _DIGIT[data[ends[a:b] - 1]])
                    # around secrets, around other tokens with digits, and one anywhere
                    around = np.concatenate((marks[:WINDOWS], digits[tags[digits] == O][:WINDOWS], [order[lo + r] % (b - a)]))
                    begins = np.unique(np.clip(around - WINDOW // 2, 0, max(0, b - a - WINDOW)))
                    out += [(ids[lo + r], order[lo + r], int(k), tags[k:k + WINDOW].tobytes(), cells[a + k:min(b, a + k + WINDOW)].tobytes()) for k in begins]
                columns = zip(*out, strict=True) if out else ([],) * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "order", "at", "tags", "cells"])

    return run


def learn(docs: DataFrame, train_texts: int = TRAIN_TEXTS) -> SecretField:
    """The field learned from the base spans of about ``train_texts`` texts that have some and twice as many that have none.

    A hash of doc_id picks the texts; of rows that share an id one text teaches.
    Null ids and texts teach nothing. Without any base span there is nothing to
    learn, and the field adds no span.
    """
    usable = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = usable.select("text").mapInArrow(_held, "without long, held long").agg(F.sum("without"), F.sum("held")).first()
    without, held = (int(x or 0) for x in counts)
    none = SecretField(np.zeros((CELLS, 3)), np.zeros((3, 3)))
    none.weights[0, O] = 1.0
    if not held:
        return none
    shares = (min(1.0, 2 * train_texts / max(without, 1)), min(1.0, train_texts / held))
    order = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 30))
    picked = usable.withColumn("order", order).withColumn("place", F.col("order") / (1 << 30)).where(F.col("place") < max(shares))
    picked = picked.groupBy("doc_id", "order", "place").agg(F.min("text").alias("text"))
    windows = picked.mapInArrow(_windows(shares), "doc_id long, order long, at long, tags binary, cells binary")
    fitted = windows.groupBy(F.lit(0).alias("one")).applyInArrow(lambda t: _fit(t), "weights binary, moves binary").first()
    if fitted is None:
        return none
    return SecretField(np.frombuffer(fitted["weights"], "<f8").reshape(CELLS, 3), np.frombuffer(fitted["moves"], "<f8").reshape(3, 3))


def added_spans(model: SecretField, data: np.ndarray, offs: np.ndarray, base: list[tuple[int, int, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(row, kind, start, end) of the spans that the field adds, in bytes; none overlaps a base span."""
    starts, ends, rows = tokens(data, offs)
    tags = model.decode(features(data, offs, starts, ends, rows), rows)
    tagged = np.flatnonzero(tags != O)
    if not len(tagged):
        return
    new = (np.diff(tagged) > 1) | (tags[tagged[1:]] == B) | (np.diff(rows[tagged]) > 0)
    begins, stops = tagged[np.concatenate(([True], new))], tagged[np.concatenate((new, [True]))]
    lows = np.array(sorted(s for _, _, s, _, _ in base), np.int64)
    # the furthest end of the base spans that begin up to each one
    highs = np.maximum.accumulate(np.array([e for _, _, _, e, _ in sorted(base, key=lambda x: x[2])], np.int64)) if base else lows
    for a, b in zip(begins.tolist(), stops.tolist(), strict=True):
        s, e, row = int(starts[a]), int(ends[b]), int(rows[a])
        while e < offs[row + 1] and data[e] == 0x3D and e - int(ends[b]) < 2:  # padding belongs to the secret
            e += 1
        k = int(np.searchsorted(lows, e))
        letters = int(((data[s:e] & 0xC0) != 0x80).sum())
        if letters >= LEAST_ADDED and not (k and highs[k - 1] > s):
            yield row, 3, s, e


def secret_spans(docs: DataFrame, model: SecretField) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) of every row of ``docs`` (doc_id, text; others are ignored).

    Offsets count code points, the end is exclusive; spans are in order of start, then of
    kind as in KINDS. Whole texts of any length are read; null and empty texts have
    no spans. Repeated rows are read alike, a null doc_id stays; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch, "text"):
                base = list(base_spans(data, offs))
                spans: list[list] = [[] for _ in range(hi - lo)]
                found = sorted([(row, s, kind, e) for row, kind, s, e, _ in base] + [(row, s, kind, e) for row, kind, s, e in added_spans(sent.value, data, offs, base)])
                if found:
                    letter = _running((data & 0xC0) != 0x80)
                    for row, s, kind, e in found:
                        from_ = letter[offs[row]]
                        spans[row].append({"kind": KINDS[kind], "start": int(letter[s] - from_), "end": int(letter[e] - from_)})
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(spans, pa.list_(span))], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def span_text(spans: Column) -> Column:
    """The spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: str, kind: str) -> Column:
    """How many of the spans are of ``kind``."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
