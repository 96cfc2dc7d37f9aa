"""BLEU: golden docstring cases, hand-computed smoothing, both statistic paths."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from polylogue.operators import bleu as B


def _row_stats(hyp: list, refs: list) -> list[int]:
    """Clipped matches m1..m4, totals t1..t4, hypothesis length, closest reference
    length and number of references of one row (small per-row helper)."""
    from collections import Counter

    hl = len(hyp)
    out = [0] * (len(B.STAT_COLS) + 1)
    best = None
    for ref in refs:
        cand = (abs(len(ref) - hl), len(ref))
        if best is None or cand < best:
            best = cand
    out[8], out[9], out[10] = hl, (best[1] if best else 0), len(refs)
    for n in range(1, min(hl, B.ORDER) + 1):
        hc = Counter(zip(*[hyp[k:] for k in range(n)])) if n > 1 else Counter(hyp)
        if len(refs) == 1:
            ref = refs[0]
            rc = Counter(zip(*[ref[k:] for k in range(n)])) if n > 1 else Counter(ref)
        else:
            rc = Counter()
            for ref in refs:
                rc |= Counter(zip(*[ref[k:] for k in range(n)])) if n > 1 else Counter(ref)
        out[n - 1] = sum(min(c, rc[g]) for g, c in hc.items() if g in rc)
        out[3 + n] = hl - n + 1
    return out

CASE1 = [("hello there general kenobi", ["hello there general kenobi", "hello there !"]),
         ("foo bar foobar", ["foo bar foobar", "foo bar foobar"])]
CASE2 = [("hello there general kenobi", ["hello there general kenobi", "hello there !"]),
         ("on our way to ankh morpork", ["goodbye ankh morpork", "ankh morpork"])]


def _df(spark, rows):
    return spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(rows)],
                                 "row_id long, prediction string, references array<string>")


def py_stats(rows, tok=str.split):
    """Independent statement of the statistics, for comparison."""
    m, t = [0] * 4, [0] * 4
    sys_len = ref_len = 0
    for hyp, refs in rows:
        h = tok(hyp)
        rs = [tok(r) for r in refs]
        sys_len += len(h)
        ref_len += min((abs(len(r) - len(h)), len(r)) for r in rs)[1]
        for n in range(1, 5):
            hc = Counter(tuple(h[i:i + n]) for i in range(len(h) - n + 1))
            rc = Counter()
            for r in rs:
                rc |= Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1))
            m[n - 1] += sum(min(c, rc[g]) for g, c in hc.items())
            t[n - 1] += max(len(h) - n + 1, 0)
    return m, t, sys_len, ref_len


def py_score(m, t, sys_len, ref_len, method="exp", value=None, eff=False):
    value = {"floor": 0.1, "add-k": 1}.get(method) if value is None else value
    if not any(m):
        return 0.0
    m, t = list(m), list(t)
    p = [0.0] * 4
    s = 1.0
    order = 4
    for n in range(4):
        if method == "add-k" and n > 0:
            m[n] += value
            t[n] += value
        if t[n] == 0:
            break
        if eff:
            order = n + 1
        if m[n] == 0:
            if method == "exp":
                s *= 2
                p[n] = 100.0 / (s * t[n])
            elif method == "floor":
                p[n] = 100.0 * value / t[n]
        else:
            p[n] = 100.0 * m[n] / t[n]
    bp = 1.0 if sys_len >= ref_len else (math.exp(1 - ref_len / sys_len) if sys_len else 0.0)
    return bp * math.exp(sum(math.log(x) if x > 0 else -9999999999 for x in p[:order]) / order)


@pytest.mark.parametrize("method", ["arrow", "native"])
def test_golden_case_1(spark, method):
    out = B.corpus_bleu(_df(spark, CASE1), [], ["row_id"], tokenize="13a", method=method).collect()[0]
    assert round(out["score"], 1) == 100.0


@pytest.mark.parametrize("method", ["arrow", "native"])
def test_golden_case_2(spark, method):
    out = B.corpus_bleu(_df(spark, CASE2), [], ["row_id"], method=method).collect()[0]
    assert out["score"] == pytest.approx(39.76353643835252, rel=1e-12)
    assert [out[f"m{n}"] for n in range(1, 5)] == [6, 4, 2, 1]
    assert [out[f"t{n}"] for n in range(1, 5)] == [10, 8, 6, 4]
    assert [out[f"p{n}"] for n in range(1, 5)] == pytest.approx([60.0, 50.0, 100 / 3, 25.0])
    assert (out["bp"], out["sys_len"], out["ref_len"]) == (1.0, 10, 7)


@pytest.mark.parametrize("method", ["none", "floor", "add-k", "exp"])
@pytest.mark.parametrize("eff", [False, True])
def test_smoothing_against_hand_formula(spark, method, eff):
    cases = [([3, 1, 0, 0], [4, 3, 2, 1], 4, 5), ([5, 0, 0, 0], [6, 5, 4, 3], 6, 6),
             ([2, 1, 0, 0], [2, 1, 0, 0], 2, 3), ([0, 0, 0, 0], [3, 2, 1, 0], 3, 2),
             ([7, 4, 2, 1], [9, 8, 7, 6], 9, 12), ([1, 0, 0, 0], [1, 0, 0, 0], 1, 1)]
    rows = [(i, *m, *t, s, r) for i, (m, t, s, r) in enumerate(cases)]
    cols = "id long, " + ", ".join(f"{c} long" for c in B.STAT_COLS)
    got = {r["id"]: r["score"] for r in B.bleu_score(spark.createDataFrame(rows, cols), method, None, eff).collect()}
    for i, (m, t, s, r) in enumerate(cases):
        assert got[i] == pytest.approx(py_score(m, t, s, r, method, None, eff), rel=1e-12, abs=1e-12)


def test_arrow_and_native_agree_on_data(spark, sf):
    from polylogue import fixtures as fx

    lp = fx.lang_pairs(spark, sf).select("lang", "pos", F.array("response", "context").alias("refs"),
                                         F.col("response").alias("prediction"))
    lp = lp.withColumn("prediction", F.substring("prediction", 1, 80))
    a = B.bleu_stats(lp, ["lang"], ["pos"], references="refs", method="arrow")
    b = B.bleu_stats(lp, ["lang"], ["pos"], references="refs", method="native")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_stats_match_python(spark):
    rows = CASE2 + [("a b c d e f", ["a b c", "c d e f g h"]), ("", ["x y", "z"])]
    got = B.bleu_stats(_df(spark, rows), [], ["row_id"], tokenize="none").collect()[0]
    m, t, s, r = py_stats(rows)
    assert [got[f"m{n}"] for n in range(1, 5)] == m
    assert [got[f"t{n}"] for n in range(1, 5)] == t
    assert (got["sys_len"], got["ref_len"]) == (s, r)


def test_group_stats_sum_to_union(spark):
    rows = CASE1 + CASE2
    df = _df(spark, rows).withColumn("g", F.col("row_id") % 2)
    per = B.bleu_stats(df, ["g"], ["row_id"]).collect()
    whole = B.bleu_stats(df, [], ["row_id"]).collect()[0]
    for c in B.STAT_COLS:
        assert sum(r[c] for r in per) == whole[c]


def test_unequal_reference_counts_fail(spark):
    df = spark.createDataFrame([(0, "a b", ["a b"]), (1, "c d", ["c d", "c"])],
                               "row_id long, prediction string, references array<string>")
    with pytest.raises(Exception, match="same number of references"):
        B.bleu_stats(df, [], ["row_id"]).collect()
    chk = B.check_reference_counts(df, "references").collect()[0]
    assert (chk["min_refs"], chk["max_refs"], chk["is_valid"]) == (1, 2, False)


def test_unknown_smoothing_rejected(spark):
    with pytest.raises(ValueError):
        B.score_columns("bogus")


def test_vectorised_batch_stats_equal_counters():
    """The numpy batch statistics equal the per-row counter statement."""
    import random

    import numpy as np
    import pyarrow as pa

    rng = random.Random(7)
    vocab = ["a", "b", "c", "d", "é", ".", "a b"[0]]
    for trial in range(200):
        rows = rng.randint(1, 10)
        hyps = [[rng.choice(vocab) for _ in range(rng.randint(0, 9))] for _ in range(rows)]
        refs = [[[rng.choice(vocab) for _ in range(rng.randint(0, 9))] for _ in range(rng.choice([0, 1, 2, 3]))]
                for _ in range(rows)]
        h = pa.array(hyps, pa.list_(pa.string()))
        r = pa.array(refs, pa.list_(pa.list_(pa.string())))
        if rows > 2 and trial % 2:
            h, r, hyps, refs = h.slice(1, rows - 2), r.slice(1, rows - 2), hyps[1:-1], refs[1:-1]
        want = np.array([_row_stats(x, y) for x, y in zip(hyps, refs)])
        assert (B._batch_stats(h, r) == want).all()
