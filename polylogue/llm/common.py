"""Shared helpers: text chunks of Arrow batches, vectorised word hashes, components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polylogue.session import hadoop_path, scratch_path

#: Bytes of text that a task expands into numpy arrays at once; one longer text is its own chunk.
CHUNK_BYTES = 1 << 19

#: The C library's call that returns free memory, where there is one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

_MULT = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learned from: crc32 of the id as text, remainder 2 of 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared checkpoint folder and read again (cuts lineage)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables stored on the way to a result; ``drop`` removes them once nothing reads them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in self.paths:
            fs, p = hadoop_path(self.spark, path)
            fs.delete(p, True)
        self.paths.clear()


def salted_left_join(left: DataFrame, right: DataFrame, key: str, spread: str, salts: int = 16) -> DataFrame:
    """``left`` with the columns of the one row of ``right`` of its key; rows of a hot key are dealt to ``salts`` tasks."""
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int").alias("_salt")
    many = right.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    return left.select("*", salt).join(many, [key, "_salt"], "left").drop("_salt")


#: Rows to drop that are broadcast at most (two numbers each); beyond, they are joined.
GONE_MAX = 200_000


def without(docs: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``docs`` without the rows that have the ``keys`` of a row of ``gone`` (null equals null).

    The keys are stored first, so their number is known: few are broadcast and no text moves.
    """
    gone = stored(gone.distinct(), "gone")
    few = gone.limit(GONE_MAX + 1).count() <= GONE_MAX
    named = gone.select(*[F.col(k).alias(f"_gone_{k}") for k in keys])
    return docs.join(F.broadcast(named) if few else named, [docs[k].eqNullSafe(named[f"_gone_{k}"]) for k in keys], "left_anti")


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets) of runs of rows of about ``limit`` bytes; null reads as empty. The bytes are the batch's own."""
    texts = batch.column(column)
    for lo, hi in text_runs(texts, limit):
        part = texts.slice(lo, hi - lo)
        part = part.fill_null("") if part.null_count else part
        _, offs, data = part.buffers()
        offs = np.frombuffer(offs, np.int64 if pa.types.is_large_string(part.type) else np.int32)[part.offset:part.offset + len(part) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        yield lo, hi, data[offs[0]:offs[-1]], offs - offs[0]
    _release()


def text_runs(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, end row) of runs of about ``limit`` bytes; one longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
        yield lo, hi
        lo = hi


def _release() -> None:
    """Give memory that a batch has used and nothing holds back to the system: a worker serves one stage after another."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def text_lists(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows of about ``limit`` bytes; null reads as empty."""
    texts = batch.column(column)
    for lo, hi in text_runs(texts, limit):
        yield lo, pc.fill_null(texts.slice(lo, hi - lo), "").to_pylist()
    _release()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


#: A random 64-bit value per byte, and powers of the odd multiplier with their inverses.
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for i, base in enumerate((int(_MULT), pow(int(_MULT), -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def flagged_spans(flags: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of maximal runs of set flags; no run crosses a row's end."""
    if not len(flags):
        z = np.zeros(0, np.int64)
        return z, z, z
    first, last = flags.copy(), flags.copy()
    first[1:] &= ~flags[:-1]
    last[:-1] &= ~flags[1:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(flags))]
    first[cuts] = flags[cuts]
    last[cuts - 1] = flags[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
    """64-bit hashes of byte spans (in order, not overlapping), from running sums; blocks bound the memory."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK_BYTES, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _power_tables(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(codes[data[lo:hi]] * up[:hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Hash codes under which A-Z equal a-z.
LOWER_CODES = BYTE_CODES[_LOWER]


def space_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans and rows of the words between ASCII white space (0x20, 0x09-0x0D)."""
    return flagged_spans(~_SPACE[data], offs)


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct ``width``-word shingles, sorted by row and hash; ASCII case is folded.

    A text of fewer words has its whole sequence as one shingle; without words it has none.
    """
    starts, ends, row = space_words(data, offs)
    words = span_hashes(data, starts, ends, LOWER_CODES)
    n_rows = len(offs) - 1
    counts = np.bincount(row, minlength=n_rows)
    k = len(words) - width + 1
    rows_out, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    if k > 0:
        h = np.zeros(k, np.uint64)
        for i in range(width):
            h = (h + words[i:i + k]) * _MULT
        whole = row[:k] == row[width - 1:]
        rows_out.append(row[:k][whole])
        hashes.append(mix(h[whole]))
    first = np.concatenate(([0], np.cumsum(counts)))
    for r in np.flatnonzero((counts > 0) & (counts < width)):
        h = _U(counts[r])
        for x in words[first[r]:first[r + 1]]:
            with np.errstate(over="ignore"):
                h = (h + x) * _MULT
        rows_out.append(np.array([r]))
        hashes.append(mix(np.array([h ^ _U(0x5851F42D4C957F2D)], np.uint64)))
    row, h = np.concatenate(rows_out), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def components(spark: SparkSession, links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, label) of the nodes in ``links`` (a, b): label is the smallest id reachable.

    Every round gives a node the smallest label near it and then that label's own
    label, so paths halve; each round is written to the shared folder.
    """
    keep = (scratch or Scratch(spark)).stored
    edges = keep(links.select("a", "b").where("a <> b").distinct(), "links")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = keep(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id", "left").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        step = keep(step.join(jump, "label", "left").select("id", "was", F.least("label", "next").alias("label")), "labels")
        labels = step.select("id", "label")
        if step.where("was <> label").isEmpty():
            return labels
