"""Quality classifier: hashed word n-grams, FTRL updates, sparse dot products.

Words are runs of letters and digits, and runs of signs; one- and two-word
sequences are hashed into 2^18 cells, and a word that repeats the one before it
gives the same cell whatever the word. A cell's value is its count over the root
of the number of sequences, so a text's score is one sum of weights. Weights are
learned on SHARDS hash shards of a bounded sample of labelled rows, each by
follow-the-regularised-leader updates in a fixed order, and averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flagged_spans, held_out, mix, span_hashes, text_chunks

#: The model is fitted on about so many labelled rows and bytes of their texts at most, chosen by a hash of doc_id.
TRAIN_ROWS, TRAIN_BYTES = 16_000, 96 << 20
BITS, SHARDS, EPOCHS = 18, 4, 4
#: FTRL: learning rate, its smoothing, and the penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
#: Documents with at least this score are of good quality.
THRESHOLD = 0.7

_MULT = np.uint64(0x9E3779B97F4A7C15)
_SAME = np.uint64(0x51A3E)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SIGN = ~_LETTER
_SIGN[[0x20, *range(0x09, 0x0E)]] = False


def cells(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell) of every sequence, and the number of sequences of each row."""
    words = [flagged_spans(flags[data], offs) for flags in (_LETTER, _SIGN)]
    hashes = np.concatenate([span_hashes(data, s, e) for s, e, _ in words])
    starts, row = np.concatenate([w[0] for w in words]), np.concatenate([w[2] for w in words])
    order = np.argsort(starts, kind="stable")
    row, h = row[order], hashes[order]
    pair = row[1:] == row[:-1]
    two = np.where(h[1:] == h[:-1], _SAME, mix(h[:-1] * _MULT + h[1:]))[pair]
    rows = np.concatenate((row, row[1:][pair]))
    found = (np.concatenate((h, two)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
    return rows, found, np.bincount(rows, minlength=len(offs) - 1)


def _ftrl(table: pa.Table) -> pa.Table:
    """Weights (the last is the constant's) of one shard: EPOCHS passes in the order of a hash of doc_id."""
    table = table.sort_by([("order", "ascending"), ("doc_id", "ascending")])
    examples = []
    labels = table.column("quality").to_pylist()
    at = 0
    for batch in table.select(["text"]).to_batches():
        for lo, hi, data, offs in text_chunks(batch, "text"):
            rows, found, n = cells(data, offs)
            order = np.argsort(rows, kind="stable")
            ends = np.searchsorted(rows[order], np.arange(hi - lo + 1))
            for r in range(hi - lo):
                cell, count = np.unique(found[order[ends[r]:ends[r + 1]]], return_counts=True)
                examples.append((np.append(cell, 1 << BITS), np.append(count / np.sqrt(max(1, n[r])), 1.0), float(labels[at] == 1)))
                at += 1
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for _ in range(EPOCHS):
        for cell, x, y in examples:
            zc, root = z[cell], np.sqrt(n[cell])
            w = np.where(np.abs(zc) > L1, (np.sign(zc) * L1 - zc) / ((BETA + root) / ALPHA + L2), 0.0)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            grown = n[cell] + g * g
            z[cell] = zc + g - (np.sqrt(grown) - root) / ALPHA * w
            n[cell] = grown
    w = np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    return pa.table({"n": pa.array([len(examples)], pa.int64()), "weights": pa.array([w.astype("<f4").tobytes()], pa.binary())})


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> np.ndarray:
    """Weights learned from labelled rows outside the held-out fold.

    ``train_rows`` and ``train_bytes`` bound the rows (a hash of doc_id picks the share beyond
    them), so that a shard fits its task however long texts are. Null
    labels and ids teach nothing; an id labelled twice counts with the smaller label.
    Without any row all weights are 0 and every score is 0.5.
    """
    usable = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    share = min(1.0, train_rows / max(1, usable.count()))
    key = F.col("doc_id").cast("long")
    marks = (usable.where(F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 20)) < round(share * (1 << 20)))
             .groupBy(key.alias("doc_id")).agg(F.min("quality").cast("long").alias("quality")))
    train = docs.select(key.alias("doc_id"), "text").join(F.broadcast(marks), "doc_id")
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > train_bytes:
        train = train.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 20)) < int(train_bytes / size * (1 << 20)))
    order = F.xxhash64("doc_id", F.lit(5))
    parts = (train.select("doc_id", "text", "quality", order.alias("order")).withColumn("shard", F.pmod("order", F.lit(SHARDS)))
             .groupBy("shard").applyInArrow(_ftrl, "n long, weights binary").toPandas())
    if not len(parts):
        return np.zeros((1 << BITS) + 1, np.float32)
    return np.average([np.frombuffer(w, "<f4") for w in parts["weights"]], axis=0, weights=parts["n"]).astype(np.float32)


def score_quality(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text; others are ignored), 0 to 1.

    Null and empty texts get the constant's score. Repeated rows are scored alike;
    an empty table gives an empty result. Texts of any length are scored whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch, "text"):
                rows, found, n = cells(data, offs)
                total = np.bincount(rows, weights=w[found], minlength=hi - lo) / np.sqrt(np.maximum(n, 1)) + w[-1]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
