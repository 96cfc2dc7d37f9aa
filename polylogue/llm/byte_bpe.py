"""Byte-level BPE encoding and decoding with length-bucketed numpy matrices.

Texts are split by the tokenizer's pattern; distinct pieces are encoded once per
worker. Pieces of similar length share a padded matrix of token ids, one row a
piece. In each round every row merges its leftmost pair of least rank: pairs are
looked up in an open-addressing hash table, the merged cell is written and the
row compacted. Rows without a pair to merge leave the matrix.

A matrix needs as many rounds as its longest row has merges, so pieces beyond
MATRIX_MAX bytes (runs without spaces) are merged with a heap of (rank, position)
instead, in the same order.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest piece for the matrices, cells of a matrix, and pieces a worker remembers.
MATRIX_MAX, MATRIX_CELLS, CACHE_PIECES = 256, 1 << 18, 400_000
#: Pieces looked up at once; a text of more characters than TEXT_CHARS is split by an iterator.
RUN_PIECES, TEXT_CHARS = 1 << 17, 1 << 20


class ByteBpe:
    """Merge table of a rank file, with encode and decode over numpy arrays."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        top = max(self.ranks.values()) + 1
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        tokens = [b""] * top
        for t, r in self.ranks.items():
            tokens[r] = t
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_at = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))
        pairs = [(self.ranks[t[:i]] << 32 | self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t))
                 if t[:i] in self.ranks and t[i:] in self.ranks]
        self.pairs = dict(pairs)
        self._build_table(pairs)
        self._cache: dict[str, int] = {}
        self._reset()

    def _build_table(self, pairs: list[tuple[int, int]]) -> None:
        bits = (4 * len(pairs) - 1).bit_length()
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        for key, rank in pairs:
            at = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
            while self.keys[at] >= 0 and self.keys[at] != key:
                at = at + 1 & self.mask
            self.keys[at], self.values[at] = key, rank

    def _reset(self) -> None:
        self._cache.clear()
        self._ids, self._at = np.zeros(1 << 16, np.uint32), np.zeros(CACHE_PIECES + 1, np.int64)
        self._n_ids = 0

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge; a huge value where there is none (right < 0 is padding)."""
        none = np.iinfo(np.int32).max
        key = left << 32 | right
        at = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
        found = self.keys[at]
        out = np.where(found == key, self.values[at], none).astype(np.int32)
        todo = np.flatnonzero((found != key) & (found >= 0) & (right >= 0))
        while len(todo):
            at[todo] = at[todo] + 1 & self.mask
            found = self.keys[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        out[right < 0] = none
        return out

    def _merge_matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Token ids of pieces of at most ``width`` bytes."""
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        size = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(width) < size[:, None], self.byte_ids[raw], -1)
        none = np.iinfo(np.int32).max
        rank = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1) if width > 1 else np.full((n, 0), none, np.int32)
        rows, done = np.arange(n), [np.zeros(0, np.int64)] * n

        def finish(which: np.ndarray) -> None:
            for i in which:
                done[rows[i]] = ids[i, :size[i]].copy()

        while len(rows):
            if ids.shape[1] < 2:
                finish(np.arange(len(rows)))
                break
            at = rank.argmin(1)
            here = np.arange(len(rows))
            best = rank[here, at]
            live = best < none
            if not live.all():
                finish(np.flatnonzero(~live))
                ids, rank, rows, size, at, best = ids[live], rank[live], rows[live], size[live], at[live], best[live]
                here = np.arange(len(rows))
                if not len(rows):
                    break
            # the merged id replaces its left part; what follows the right part moves one cell to the left
            ids[here, at] = best
            cols = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), 1)
            size -= 1
            width = ids.shape[1]
            if width > 1:
                cols = np.arange(width - 1)
                rank = np.take_along_axis(rank, np.minimum(cols + (cols > at[:, None]), rank.shape[1] - 1), 1)
                right = np.minimum(at, width - 2)
                fresh = self.pair_ranks(ids[here, right], ids[here, right + 1])
                rank[here, right] = fresh
                left = at - 1
                ok = left >= 0
                rank[here[ok], left[ok]] = self.pair_ranks(ids[here[ok], left[ok]], ids[here[ok], at[ok]])
            keep = int(size.max())
            if keep < width:
                ids, rank = ids[:, :keep], rank[:, :max(keep - 1, 0)]
        return done

    def _merge_heap(self, piece: bytes) -> np.ndarray:
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        get = self.pairs.get
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or get(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], alive[j] = r, False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := get(r << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (s, i))
            if (b := before[i]) >= 0 and (s := get(ids[b] << 32 | r)) is not None:
                heapq.heappush(heap, (s, b))
        return np.array([x for x, a in zip(ids, alive, strict=True) if a], np.int64)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece, in order."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        i = 0
        while i < len(order):
            size = len(pieces[order[i]])
            if size > MATRIX_MAX:
                out[order[i]] = self._merge_heap(pieces[order[i]])
                i += 1
                continue
            width = min(MATRIX_MAX, size + max(1, size // 8))
            j = i
            while j < len(order) and len(pieces[order[j]]) <= width and (j - i) * width < MATRIX_CELLS:
                j += 1
            for k, ids in zip(order[i:j], self._merge_matrix([pieces[k] for k in order[i:j]], width), strict=True):
                out[k] = ids
            i = j
        return out

    def _remember(self, fresh: list[str]) -> None:
        found = self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in fresh])
        sizes = np.array([len(x) for x in found])
        total, first = int(sizes.sum()), len(self._cache)
        while self._n_ids + total > len(self._ids):
            self._ids = np.concatenate((self._ids, np.zeros_like(self._ids)))
        self._ids[self._n_ids:self._n_ids + total] = np.concatenate(found)
        if first + len(fresh) >= len(self._at):
            self._at = np.concatenate((self._at, np.zeros(first + len(fresh) + 1 - len(self._at) + CACHE_PIECES, np.int64)))
        self._at[first + 1:first + 1 + len(fresh)] = self._n_ids + np.cumsum(sizes)
        self._n_ids += total
        for i, p in enumerate(fresh):
            self._cache[p] = first + i

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text as unsigned 32-bit integers, special tokens as ordinary text."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; runs of pieces bound what is looked up at once."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        pieces: list[str] = []
        owner: list[tuple[int, int]] = []

        def flush() -> None:
            ids, at = self._ids_of(pieces)
            lo = 0
            for i, hi in owner:
                out[i].append(ids[at[lo]:at[hi]])
                lo = hi
            pieces.clear()
            owner.clear()

        for i, text in enumerate(texts):
            if len(text) <= TEXT_CHARS:
                pieces += self.pattern.findall(text)
            else:
                for m in self.pattern.finditer(text):
                    pieces.append(m[0])
                    if len(pieces) >= RUN_PIECES:
                        owner.append((i, len(pieces)))
                        flush()
            owner.append((i, len(pieces)))
            if len(pieces) >= RUN_PIECES:
                flush()
        flush()
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def _ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, where each piece's ids begin, with the end)."""
        if not pieces:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if len(self._cache) > CACHE_PIECES:
            self._reset()
        cache = self._cache
        index = list(map(cache.get, pieces))
        if None in index:
            self._remember(list({p: 0 for p, i in zip(pieces, index, strict=True) if i is None}))
            index = list(map(cache.get, pieces))
        index = np.array(index)
        start = self._at[index]
        size = self._at[index + 1] - start
        return _gathered(self._ids, start, size), np.concatenate(([0], np.cumsum(size)))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        at = ids.astype(np.int64)
        start = self.token_at[at]
        return _gathered(self.token_bytes, start, self.token_at[at + 1] - start).tobytes()


def _gathered(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices values[start:start + size], one after another."""
    ends = np.cumsum(size)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.repeat(start - (ends - size), size) + np.arange(ends[-1])]


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def _loaded(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBpe(path, pattern)
    return _LOADED[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every row of ``docs`` (doc_id, text; others are ignored).

    Null text counts as empty and has no tokens. With ``ids`` the ids themselves
    (array<long>) follow. ``path`` names the rank file on every executor. Each row is
    encoded on its own, so repeated rows and ids give repeated results and an empty
    table gives none. Texts of any length are encoded whole; of pairs of equal rank the leftmost merges.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n, digests, decoded, lists = [], [], [], []
                for got in bpe.encode_all([t or "" for t in part.column("text").to_pylist()]):
                    n.append(len(got))
                    digests.append(hashlib.sha256(got.astype("<u4").tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(got)).hexdigest())
                    if ids:
                        lists.append(got.astype(np.int64))
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns.append(pa.array(lists, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: token counts and digests of every document that is left."""
    import public_tokenizers

    return encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
