"""Embedding whitening by spectral divide and conquer.

The exact integer sums of the vectors and then their centred cross products are
added up on Spark, so only a matrix of dimension x dimension reaches the driver. There the
covariance is split: the polar factor of the shifted matrix, found by dynamically
weighted Halley iterations (QDWH), is the sign of its eigenvalues, half of it plus the
identity projects onto the invariant subspace above the shift, and the two blocks are
split in turn, the upper one first, until a block is a single component. Mean and
scaled components are broadcast (dimension x components numbers) and every vector is
projected where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Components returned.
COMPONENTS = 8
#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000

_EPS = np.finfo(float).eps


def _lattice(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their integer vectors) of the vectors without null or non-finite entries."""
    lists = batch.column(column).cast(pa.large_list(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)  # null entries read as nan
    rows = np.flatnonzero(sizes)
    if not len(rows):
        return rows, np.zeros((0, 0), np.int64)
    lengths = sizes[rows]
    bad = np.add.reduceat(~np.isfinite(values), np.cumsum(lengths) - lengths)
    good = bad == 0
    if not good.any():
        return rows[good], np.zeros((0, 0), np.int64)
    dims = np.unique(lengths[good])
    if len(dims) > 1:
        raise ValueError(f"vectors of several lengths: {dims.tolist()}")
    x = np.floor(SCALE * values[np.repeat(good, lengths)])
    if np.abs(x).max() >= 2.0 ** 53:
        raise ValueError(f"an entry beyond 2^53 / {SCALE} has no exact integer")
    return rows[good], x.astype(np.int64).reshape(-1, int(dims[0])) + SHIFT


def _sums(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(dims, i, n, total) of the vectors of a task."""
        totals: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            rows, x = _lattice(batch, column)
            if len(rows):
                d = x.shape[1]
                totals[d] = totals.get(d, 0) + x.sum(0)
                counts[d] = counts.get(d, 0) + len(rows)
        for d, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(np.full(d, counts[d])), pa.array(total)], ["dims", "i", "n", "total"])

    return run


def _cross(column: str, n: int, sums: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(i, j, total) with i <= j: the centred cross products of a task."""
        total = np.zeros((len(sums), len(sums)))
        for batch in batches:
            rows, x = _lattice(batch, column)
            if len(rows):
                centred = (n * x - sums) / n  # the difference is exact
                total += centred.T @ centred
        i, j = np.triu_indices(len(sums))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "total"])

    return run


def _matrix(cross: DataFrame, dims: int) -> np.ndarray:
    """The symmetric matrix of the summed entries (i, j, total), i <= j."""
    out = np.zeros((dims, dims))
    for r in cross.groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["total"]
    return out


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QDWH: by QR while the weights are large, then by Cholesky."""
    n = len(a)
    x, low = a / np.linalg.norm(a), _EPS
    eye = np.eye(n)
    for _ in range(30):
        gap = np.cbrt(4 * (1 - low * low) / low ** 4)
        root = np.sqrt(1 + gap)
        wa = root + np.sqrt(8 - 4 * gap + 8 * (2 - low * low) / (low * low * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack((np.sqrt(wc) * x, eye)))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        else:
            half = np.linalg.cholesky(eye + wc * x.T @ x)
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(half.T, np.linalg.solve(half, x.T)).T
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x, low = new, min(1.0, low * (wa + wb * low * low) / (1 + wc * low * low))
        if moved < _EPS ** (1 / 3) and 1 - low < 10 * _EPS:
            break
    return x


def _range(projector: np.ndarray, rank: int) -> np.ndarray:
    """An orthonormal basis of the projector's range, from columns picked by their rest."""
    rest, picked = projector.copy(), []
    for _ in range(rank):
        k = int(np.argmax((rest * rest).sum(0)))
        picked.append(k)
        q = rest[:, k] / np.linalg.norm(rest[:, k])
        rest -= np.outer(q, q @ rest)
    basis, _ = np.linalg.qr(projector[:, picked])
    return np.linalg.qr(projector @ basis)[0]


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below a shift; None where the eigenvalues cannot be told apart."""
    n = len(a)
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)
    # an eigenvalue lies beyond spread / sqrt(n - 1) on either side, so each of these shifts has some above and below
    for step in (0, 0.5, -0.5, 0.25, -0.25, 0.125, -0.125):
        sign = polar_factor(a - (mean + step * spread / np.sqrt(n)) * np.eye(n))
        above = (np.eye(n) + sign) / 2
        rank = round(np.trace(above))
        if 0 < rank < n and np.linalg.norm(above @ above - above) < 1e-9 * n:
            return _range(above, rank), _range(np.eye(n) - above, n - rank)
    return None


def principal_components(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the ``k`` largest, falling. Equal eigenvalues get some basis of their space."""
    scale = np.linalg.norm(cov)
    found, todo = [], [np.eye(len(cov))]
    while todo and len(found) < k:
        basis = todo.pop()
        block = basis.T @ cov @ basis
        block = (block + block.T) / 2
        n = len(block)
        flat = np.linalg.norm(block - np.trace(block) / n * np.eye(n)) <= 4 * _EPS * n * scale
        halves = None if n == 1 or flat else _split(block)
        if halves is None:
            found += [basis[:, j] for j in np.argsort(-np.diag(block), kind="stable")]
        else:
            todo += [np.linalg.qr(basis @ half)[0] for half in reversed(halves)]
    vectors = np.array(found[:k]).reshape(-1, len(cov)).T
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    values = np.einsum("ij,ij->j", vectors, cov @ vectors)
    values[values <= 4 * _EPS * len(cov) * scale] = 0  # no variance beyond rounding
    return values, vectors


@dataclass
class Whitening:
    """Count and sums of the fit list, the largest eigenvalues of its covariance, their vectors, and the trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all vectors of ``column``; None without any.

    Null and empty vectors, and those with null or non-finite entries, are left out;
    the others must have one length, else a ValueError is raised.
    """
    vectors = vectors.select(column)
    sums = vectors.mapInArrow(_sums(column), "dims long, i long, n long, total long").groupBy("dims", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    rows = sums.orderBy("dims", "i").collect()
    if not rows:
        return None
    if rows[0]["dims"] != rows[-1]["dims"]:
        raise ValueError(f"vectors of several lengths: {sorted({r['dims'] for r in rows})}")
    n, totals = rows[0]["n"], np.array([r["total"] for r in rows], np.int64)
    cov = _matrix(vectors.mapInArrow(_cross(column, n, totals), "i long, j long, total double"), len(totals)) / n
    values, components_ = principal_components(cov, components)
    return Whitening(n, totals, values, components_, float(np.trace(cov)))


def whiten(vectors: DataFrame, model: Whitening, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id_column, whitened array<double>, deviation decimal(38,0)) of every vector that ``fit`` reads.

    ``whitened`` has a value for each component, null for one without variance;
    ``deviation`` is the exact sum of (n * x - sums)^2.
    """
    kind = dict(vectors.dtypes)[id_column]
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        varies = m.values > 0
        scaled = np.divide(m.vectors, np.sqrt(m.values), out=np.full_like(m.vectors, np.nan), where=varies)
        for batch in batches:
            rows, x = _lattice(batch, column)
            if not len(rows):
                continue
            far = m.n * x - m.sums
            if float(np.abs(far).max()) ** 2 * far.shape[1] < 2.0 ** 62:
                deviation = pa.array((far * far).sum(1)).cast(pa.decimal128(38, 0))
            else:
                deviation = pa.array([Decimal(int(v)) for v in (far.astype(object) ** 2).sum(1)], pa.decimal128(38, 0))
            white = (far / m.n) @ scaled
            flat = pa.array(white.ravel(), from_pandas=True)  # nan, a component without variance, becomes null
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * white.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([batch.column(id_column).take(pa.array(rows)), lists, deviation], [id_column, "whitened", "deviation"])

    return vectors.select(id_column, column).mapInArrow(run, f"`{id_column}` {kind}, whitened array<double>, deviation decimal(38,0)")


def identity_error(whitened: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the covariance of ``whitened`` minus the identity, over components with variance."""
    k = int((model.values > 0).sum())  # values fall, so these come first
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))  # the last row and column sum the values themselves
        for batch in batches:
            w = batch.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[:, :k]
            w = np.hstack((w, np.ones((len(w), 1))))
            total += w.T @ w
        i, j = np.triu_indices(k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "total"])

    total = _matrix(whitened.select("whitened").mapInArrow(run, "i long, j long, total double"), k + 1) / model.n
    # the values were centred before; what is left of their mean goes too
    return float(np.abs(total[:k, :k] - np.outer(total[k, :k], total[k, :k]) - np.eye(k)).max())


def whitened_components(spark: SparkSession, vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact) of every usable vector and component.

    ``vectors`` has vec_id and embedding, other columns are ignored. Left out: null and
    empty vectors, and those with null or non-finite entries. Repeated rows count and
    come again, a null vec_id stays. Components are numbered from 1; with fewer
    dimensions there are fewer. One without variance has null whitened and explained 0 (null
    where no vector varies). ``deviation`` is null beyond the range of long, where only
    ``deviation_exact`` holds it. An empty table gives an empty result.
    """
    kinds = "component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    model = fit(vectors, components=components)
    if model is None:
        return spark.createDataFrame([], f"vec_id {dict(vectors.dtypes)['vec_id']}, {kinds}")
    white = whiten(vectors, model)
    error = identity_error(white, model)
    share = [float(v / model.trace) if model.trace else None for v in model.values]
    rows = white.select("vec_id", F.posexplode("whitened").alias("at", "value"), F.col("deviation").alias("exact"))
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), F.expr("try_cast(exact as bigint)").alias("deviation"),
                       F.col("value").alias("whitened"), F.get(F.array(*[F.lit(s).cast("double") for s in share]), F.col("at")).alias("explained"),
                       F.lit(error).cast("double").alias("identity_error"), F.col("exact").alias("deviation_exact"))
