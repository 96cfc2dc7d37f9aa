"""Exact dedup by content-defined chunk recipes.

A text is cut where a rolling hash of its last 32 bytes has a run of zero bits,
so equal passages give equal chunks wherever they stand. Each distinct chunk
crosses the network once per task that holds it; grouping by the chunk's own
bytes proves identity, and a chunk's identifier is its hash with its rank among
the (nearly always single) contents of that hash. A text is then the ordered
list of identifiers of its chunks, its recipe, and equal recipes mean equal
texts. Only recipes are compared and moved after that, never the long texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix, salted_left_join, span_hashes, stored, text_chunks, without

#: Mean chunk length beyond the least (bytes, a power of two), least and greatest length.
CHUNK_MEAN, CHUNK_MIN, CHUNK_MAX = 4096, 1024, 32768

_GEAR = (mix(np.arange(1000, 1256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def cut_points(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunk boundaries, chunks per row): boundaries depend on the bytes of a row alone."""
    roll = _GEAR[data]
    for step in (1, 2, 4, 8, 16):  # roll[i] covers the last 32 bytes
        shifted = roll.copy()
        shifted[step:] += roll[:-step] << np.uint32(step)
        roll = shifted
    marks = np.flatnonzero((roll >> np.uint32(32 - CHUNK_MEAN.bit_length() + 1)) == 0) + 1
    bounds, per_row = [0], np.zeros(len(offs) - 1, np.int64)
    first = np.searchsorted(marks, offs[:-1] + 31, "right")
    for r in range(len(offs) - 1):
        start, end, m = int(offs[r]), int(offs[r + 1]), int(first[r])
        n = 0
        while start < end:
            m = max(m, int(np.searchsorted(marks, start + CHUNK_MIN))) if end - start > CHUNK_MIN else len(marks)
            cut = min(end, start + CHUNK_MAX, int(marks[m]) if m < len(marks) else end)
            bounds.append(cut)
            start, n = cut, n + 1
        per_row[r] = n
    return np.array(bounds, np.int64), per_row


def _recipes(with_bytes: bool):
    """Rows' recipes, or (with_bytes) the distinct chunks of each run of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch, "text"):
                bounds, per_row = cut_points(data, offs)
                starts, ends = bounds[:-1], bounds[1:]
                h = span_hashes(data, starts, ends).view(np.int64)
                size = ends - starts
                if with_bytes:
                    seen = {}
                    view = data.tobytes()
                    for i, (key, s, e) in enumerate(zip(h.tolist(), starts.tolist(), ends.tolist(), strict=True)):
                        seen.setdefault((key, view[s:e]), i)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k for k, _ in seen], pa.int64()), pa.array([b for _, b in seen], pa.binary())], ["hash", "chunk"])
                    continue
                at = np.concatenate(([0], np.cumsum(per_row))).astype(np.int32)
                parts = pa.StructArray.from_arrays([pa.array(h), pa.array(size.astype(np.int32)), pa.array(np.zeros(len(h), np.int32))],
                                                   ["hash", "size", "rank"])
                view = memoryview(data)
                sha = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(sha), pa.ListArray.from_arrays(pa.array(at), parts)],
                    ["doc_id", "text_sha256", "recipe"])

    return run


_PART = "struct<hash:long,size:int,rank:int>"


def _ranked(docs: DataFrame, colliding: DataFrame):
    """Recipes of the texts that hold a chunk whose hash has several contents, with those chunks' ranks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch, "text"):
                bounds, per_row = cut_points(data, offs)
                h = span_hashes(data, bounds[:-1], bounds[1:]).view(np.int64)
                row = np.repeat(np.arange(lo, hi), per_row)
                pos = np.arange(len(h)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
                view = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row)), pa.array(pos), pa.array(h),
                     pa.array([view[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())],
                    ["doc_id", "pos", "hash", "chunk"])

    parts = docs.mapInArrow(run, "doc_id long, pos long, hash long, chunk binary").join(colliding, ["hash", "chunk"])
    return parts.groupBy("doc_id").agg(F.map_from_entries(F.collect_set(F.struct("pos", "rank"))).alias("ranks"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs`` (doc_id, text; others are ignored).

    Null text counts as empty; all empty texts are one group. keep_id is the
    largest doc_id of the group; a row repeated under that id is kept with it.
    Rows with a null doc_id count in group_size and are never the one to keep
    (keep_id is null where a group has no other). Texts of any length are compared whole, chunk by
    chunk. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = docs.select("text").mapInArrow(_recipes(True), "hash long, chunk binary")
    distinct = chunks.groupBy("hash", "chunk").agg(F.lit(1).alias("one"))
    shared = stored(distinct.groupBy("hash").agg(F.count("*").alias("contents")).where("contents > 1"), "colliding-hashes")
    recipes = stored(docs.mapInArrow(_recipes(False), f"doc_id long, text_sha256 string, recipe array<{_PART}>"), "recipes")
    if not shared.isEmpty():  # settle equal hashes of different chunks by their bytes
        contents = chunks.join(shared, "hash", "left_semi").distinct()
        ranks = contents.withColumn("rank", F.row_number().over(Window.partitionBy("hash").orderBy("chunk")) - 1)
        settled = _ranked(docs, ranks)
        recipes = (recipes.join(settled, "doc_id", "left").withColumn(
            "recipe", F.transform("recipe", lambda p, i: F.struct(p["hash"], p["size"], F.coalesce(F.col("ranks")[i.cast("long")], p["rank"]).alias("rank"))))
            .drop("ranks"))
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    copied = groups.where("group_size > 1")
    return (salted_left_join(recipes, copied, "recipe", "doc_id")
            .select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                    F.coalesce(F.col("group_size").isNull() | (F.col("doc_id") == F.col("keep_id")), F.lit(False)).alias("kept"), "text_sha256"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts only the row with the largest doc_id stays.

    Rows are dropped by id and text, so another text under the same id stays, as do
    rows that repeat both. Copies with a null id go where a row with an id
    holds the text; where none does they all stay.
    """
    groups = exact_duplicates(docs).where("not kept and keep_id is not null").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    marked = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_sha": F.sha2(F.coalesce("text", F.lit("")), 256)})
    return without(marked, groups, ["_id", "_sha"]).drop("_id", "_sha")
