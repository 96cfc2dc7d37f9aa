"""Several tokenisers over the same texts: statistics are made once where they cut alike."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from polylogue.functions.token_spans import prepared
from polylogue.operators import bleu as B

METHODS = ["none", "13a", "char", "zh"]


def _texts(n, letters, k, seed):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
    refs = [[text() for _ in range(k)] for _ in range(n // 4)]
    return pa.array([rng.choice([text(), rng.choice(refs[i // 4])]) for i in range(n)]), pa.array([refs[i // 4] for i in range(n)], pa.list_(pa.string()))


@pytest.mark.parametrize(("letters", "k"), [("ab1. ,中", 1), ("ab1. ,中", 2), ("abcde  ", 1), ("ab &amp;.", 1), (" ", 1), ("ab中𠀀é.\n", 1)])
def test_statistics_are_those_of_each_alone(letters, k):
    hyp, refs = _texts(80, letters, k, 5)
    together = list(B._text_stats({m: (hyp, refs) for m in METHODS}))
    for m, found in zip(METHODS, together, strict=True):
        assert (found == B._batch_text_stats(hyp, refs, m)).all()


def test_rows_cut_alike_are_counted_once(monkeypatch):
    """Of 40 groups one holds a letter that zh sets apart and 13a does not: only its rows are counted again."""
    seen = []
    whole = B._sequence_stats
    monkeypatch.setattr(B, "_sequence_stats", lambda codes, lens, *rest: seen.append(len(lens)) or whole(codes, lens, *rest))
    hyp = [f"w{i} says so, {j}.5 times" for i in range(40) for j in range(4)]
    hyp[17] = "w4 中文 says so"
    refs = pa.array([[f"w{i} said so, twice"] for i in range(40) for _ in range(4)], pa.list_(pa.string()))
    first, second = B._text_stats({m: (pa.array(hyp), refs) for m in ("13a", "zh")})
    assert seen == [160, 4]
    assert np.flatnonzero((first != second).any(axis=1)).tolist() == [17]


@pytest.mark.parametrize("letters", ["ab", "abcdefgh .", "é中𠀀a"])
def test_packed_matches_are_those_of_plain_counting(letters):
    hyp, refs = _texts(200, letters, 1, 9)
    packed = B._batch_text_stats(hyp, refs, "char")
    for i in range(0, 200, 7):
        said, wanted = ([c for c in t if c.strip()] for t in (hyp[i].as_py(), refs[i][0].as_py()))
        for n in range(1, 5):
            count = lambda s: {g: [*zip(*(s[j:] for j in range(n)))].count(g) for g in zip(*(s[j:] for j in range(n)))}  # noqa: B023, E731
            have, want = count(said), count(wanted)
            assert packed[i, n - 1] == sum(min(c, want.get(g, 0)) for g, c in have.items())
            assert packed[i, 3 + n] == max(0, len(said) - n + 1)


def test_references_in_a_form_already(spark):
    rows = [(i, f"a-{i}, b: c", f"a-{i} b; c") for i in range(20)]
    df = spark.createDataFrame(rows, "i long, prediction string, r string").withColumn("references", F.array("r"))
    made = df.withColumn("intl", F.transform("references", lambda r: prepared(r, "intl")))
    found = [sorted(map(tuple, B.bleu_stats(x, ["i"], [], tokenize=["none", "intl"], **kw).collect())) for x, kw in ((df, {}), (made, {"made": {"intl": "intl"}}))]
    assert found[0] == found[1] and len(found[0]) == 40
