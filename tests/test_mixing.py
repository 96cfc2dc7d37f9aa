"""Ratio interleave: hit rows against brute force, placement against a walk."""

import pytest
from pyspark.sql import functions as F

from polylogue.operators.mixing import hits_array, interleave


def brute_hits(n, k):
    step = n / k
    return [i for i in range(1, n + 1) if i % step == 0]


def test_reference_hits_equal_brute_force(spark):
    grid = [(n, k) for k in (1, 2, 3, 7, 10, 13, 100) for n in list(range(1, 230)) + [5031, 52280, 99991]]
    df = spark.createDataFrame(grid, "n long, k long")
    got = df.select("n", "k", hits_array(F.col("n"), F.col("k"), "reference").alias("h")).collect()
    for r in got:
        assert r["h"] == brute_hits(r["n"], r["k"]), (r["n"], r["k"])


@pytest.mark.parametrize("n,k,placed", [(100, 10, 10), (105, 10, 5), (101, 10, 0), (62, 10, 0), (100, 3, 0),
                                         (620, 10, 10), (5031, 10, 0), (52280, 10, 10)])
def test_known_shot_counts(n, k, placed):
    assert min(len(brute_hits(n, k)), k) == placed


def walk(src, shots, k, mode):
    """Sequential statement of the interleave for one target."""
    n = len(src)
    out, queue, count = [], list(shots), 0
    if mode == "spread":
        after = {}
        for j in range(1, k + 1):
            after.setdefault(j * n // k, []).append(j)
        for j in after.get(0, []):
            out.append(("shot", queue[j - 1]))
    for row in src:
        out.append(("src", row))
        count += 1
        if mode == "reference":
            if count % (n / k) == 0 and queue:
                out.append(("shot", queue.pop(0)))
        else:
            for j in after.get(count, []):
                out.append(("shot", shots[j - 1]))
    return out


@pytest.mark.parametrize("mode", ["reference", "spread"])
@pytest.mark.parametrize("n_src", [3, 30, 47, 50])
def test_interleave_matches_walk(spark, mode, n_src):
    k = 5
    rows = [("en", i, 1000 + i) for i in range(n_src)] + [("de", i, 2000 + i) for i in range(23)]
    df = spark.createDataFrame(rows, "lang string, pos long, pair_id long")
    got = interleave(df, "en", k, mode=mode).filter(F.col("tgt_lang") == "de").collect()
    shots = sorted(r["pair_id"] for r in got if r["is_shot"])
    want = walk([1000 + i for i in range(n_src)], shots, k, mode)
    assert [("shot" if r["is_shot"] else "src", r["pair_id"]) for r in sorted(got, key=lambda r: r["out_pos"])] == want
    assert sorted(r["out_pos"] for r in got) == list(range(len(want)))
    if mode == "spread":
        assert len(shots) == k


def test_exact_reference_reproduction(spark, sf):
    """Mersenne Twister shots + float-modulus placement equal a direct Python walk."""
    import random

    import __spark_entry__ as E
    from polylogue import fixtures as fx

    got = E.queries()["interleave_reference_mt19937"](spark, sf).collect()
    docs = sorted((r["lang"], r["doc_id"]) for r in fx.table(spark, sf, "documents").select("lang", "doc_id").collect())
    by = {}
    for lang, d in docs:
        by.setdefault(lang, []).append(d)
    src = by["en"]
    for tgt in sorted(set(by) - {"en", "pl"}):
        rows = by[tgt]
        if len(rows) < 10:
            continue
        random.seed(2023)
        picked = sorted(random.sample(range(len(rows)), 10))
        shots = [rows[p] for p in picked]
        want = walk(src, shots, 10, "reference")
        mine = sorted((r for r in got if r["tgt_lang"] == tgt), key=lambda r: r["out_pos"])
        assert [("shot" if r["is_shot"] else "src", r["doc_id"]) for r in mine] == want
