"""Property tests (hypothesis): text rules on arbitrary strings, sampling invariants."""

from hypothesis import given, settings
from hypothesis import strategies as st

from polylogue.functions import text as T

M1, M2 = "<extra_id_0>", "<extra_id_1>"
WS = "".join(chr(c) for c in T.WS_CODEPOINTS)
pieces = st.sampled_from(["a", "bb", "é", "3", ".", ",", "-", M1, M2, " ", "\t", "\n", "　", " ", "\x1c"])
texts = st.lists(pieces, max_size=12).map("".join)


def py_strip_masks(x):
    if x.startswith(M1 + " ") and x.endswith(" " + M2):
        return x[len(M1) + 1:-len(M2) - 1]
    if x.startswith(M1 + " "):
        return x[len(M1) + 1:]
    if x.endswith(" " + M2):
        return x[:-len(M2) - 1]
    return x


@settings(max_examples=4, deadline=None)
@given(st.lists(texts, min_size=1, max_size=150))
def test_text_rules_match_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, s string").orderBy("i")
    rows = df.select(T.strip_ws("s").alias("a"), T.split_ws("s").alias("b"),
                     T.clean_prediction("s", M1, M2).alias("c"),
                     T.ngrams(T.split_ws("s"), 2).alias("d")).collect()
    for v, r in zip(values, rows):
        assert r["a"] == v.strip()
        assert r["b"] == v.split()
        assert r["c"] == py_strip_masks(v).strip()
        t = v.split()
        assert r["d"] == [f"{t[i]} {t[i + 1]}" for i in range(len(t) - 1)]
