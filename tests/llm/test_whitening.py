"""Spectral divide and conquer and the whitened rows against numpy's eigenvectors."""

import math
from decimal import Decimal

import numpy as np
import pytest

from polylogue.llm import qdwh_whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component string, whitened double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 5, "x", 0.5) for i, v in rows], SCHEMA)


def expected(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    centred = (n * x - s) / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    return x, s, e[::-1][:k], u[:, ::-1][:, :k], np.trace(cov), centred


def test_rows_of_the_query_equal_numpy(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(400, 12)) * np.linspace(0.05, 0.6, 12)).astype(np.float32).tolist()
    vectors += [vectors[0]] * 150  # one hot vector
    rows = [(i % 500, v) for i, v in enumerate(vectors)]  # ids repeat
    rows += [(900, None), (901, []), (902, [math.nan] * 12), (903, [math.inf, *[0.0] * 11]), (904, [None, *[0.1] * 11])]
    got = W.whitened_components(spark, table(spark, rows + [(None, vectors[1])]).repartition(5)).toPandas()
    vectors.append(vectors[1])
    x, s, e, u, trace, centred = expected(vectors)
    assert len(got) == 8 * len(vectors) and set(got["n"]) == {len(vectors)} and got["vec_id"].isna().sum() == 8
    assert not set(got["vec_id"].dropna()) & {900, 901, 902, 903, 904}
    first = got[got["vec_id"] == 107].sort_values("component")
    assert list(first["component"]) == list(range(1, 9))
    white = centred[107] @ u / np.sqrt(e)
    assert np.allclose(np.abs(first["whitened"]), np.abs(white), atol=1e-9)
    assert np.allclose(first["explained"], e / trace, rtol=1e-9)
    assert set(first["deviation"]) == {int(((len(x) * x[107] - s) ** 2).sum())} == {int(d) for d in first["deviation_exact"]}
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    # signs are the same for all rows
    by_id = got[got["vec_id"] == 111].sort_values("component")["whitened"].to_numpy()
    signs = np.sign(first["whitened"].to_numpy() * white)
    assert np.allclose(by_id, signs * (centred[111] @ u / np.sqrt(e)), atol=1e-9)


@pytest.mark.parametrize("values", [
    [9, 5, 4, 3, 2, 1], [2, 1, 0], [4, 4, 4, 1, 1], [7, 7], [3], [5, 5 - 1e-9, 1, 1e-12, 0, 0], [0, 0, 0], [1e8, 1e-8, 1], list(range(40, 0, -1))])
def test_components_of_a_known_spectrum(values):
    rng = np.random.default_rng(len(values))
    q, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
    for basis in (q, np.eye(len(values))):
        cov = basis @ np.diag(np.array(values, float)) @ basis.T
        e, v = W.principal_components((cov + cov.T) / 2, 4)
        want = np.sort(values)[::-1][:4]
        assert np.allclose(e, want, rtol=1e-10, atol=1e-13 * max(values))
        assert np.allclose(v.T @ v, np.eye(len(want)), atol=1e-12)
        assert np.allclose(cov @ v, v * want, atol=1e-12 * max(1e-300, max(values)))


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(9, 9)))
    e = np.array([5, 3, 1, 1e-6, -1e-6, -1, -2, -4, -8.0])
    got = W.polar_factor(q @ np.diag(e) @ q.T)
    assert np.allclose(got, q @ np.diag(np.sign(e)) @ q.T, atol=1e-8)


def test_empty_single_and_constant_tables(spark):
    assert W.whitened_components(spark, table(spark, [])).collect() == []
    assert W.whitened_components(spark, table(spark, [(1, None), (2, [])])).collect() == []
    one = W.whitened_components(spark, table(spark, [(1, [0.5, 0.25])])).collect()
    assert [(r["component"], r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in one] == [(1, None, None, None, 0), (2, None, None, None, 0)]
    flat = W.whitened_components(spark, table(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0])])).orderBy("vec_id", "component").collect()
    assert [abs(r["whitened"]) if r["whitened"] is not None else None for r in flat] == [1, None, 1, None]
    assert [r["explained"] for r in flat] == [1, 0, 1, 0] and flat[0]["identity_error"] < 1e-12


def test_lengths_must_agree(spark):
    with pytest.raises(Exception, match="several lengths"):
        W.fit(table(spark, [(1, [1.0, 2.0]), (2, [1.0])]).repartition(2))


def test_deviation_beyond_long_is_exact(spark):
    n = 10**10
    model = W.Whitening(n, np.array([n * 100_000, n * 100_003]), np.array([2.0, 1.0]), np.eye(2), 3.0)
    got = W.whiten(table(spark, [(1, [0.5, 0.25])]), model).first()
    assert got["deviation"] == Decimal((n * 512) ** 2 + (n * 253) ** 2)
