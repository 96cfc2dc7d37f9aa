"""Scalar text functions against plain Python statements of the same rules."""

import re

import pytest
from pyspark.sql import functions as F

from polylogue.functions import ids as I
from polylogue.functions import text as T
from polylogue.functions.tokenize import V13A_PLAIN, V13A_REGEX, tokenize

M1, M2 = "<extra_id_0>", "<extra_id_1>"
SAMPLES = [
    "", " ", "plain", "  two  words ", "\t tab nbsp　", "\x1c\x1dfile seps\x1e\x1f",
    "a b c", "x\u0085y", "line\nbreak\r\nend", "€ 3.50, 1,000.5 - 2-3 ok.", 'He said "hi" &amp; left!',
    f"{M1} masked {M2}", f"{M1} {M2}", f"{M1} only", f"only {M2}", f" {M1} lead", f"{M1}x", f"{M1} m2",
]


def _one(spark, expr, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, s string")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def py_strip_masks(x, m1, m2):
    if x.startswith(m1 + " ") and x.endswith(" " + m2):
        return x[len(m1) + 1:-len(m2) - 1]
    if x.startswith(m1 + " "):
        return x[len(m1) + 1:]
    if x.endswith(" " + m2):
        return x[:-len(m2) - 1]
    return x


def test_strip_and_split_match_python(spark):
    assert _one(spark, T.strip_ws("s"), SAMPLES) == [s.strip() for s in SAMPLES]
    assert _one(spark, T.split_ws("s"), SAMPLES) == [s.split() for s in SAMPLES]
    assert len(T.WS_CODEPOINTS) == 29 and all(chr(c).isspace() for c in T.WS_CODEPOINTS)
    assert sum(chr(c).isspace() for c in range(0x110000)) == 29


def test_strip_masks_four_cases(spark):
    assert _one(spark, T.strip_masks("s", M1, M2), SAMPLES) == [py_strip_masks(s, M1, M2) for s in SAMPLES]
    assert _one(spark, T.strip_masks("s", M1, None), SAMPLES) == SAMPLES  # needs both masks
    clean = _one(spark, T.clean_prediction("s", M1, M2), SAMPLES)
    assert clean == [py_strip_masks(s, M1, M2).strip() for s in SAMPLES]


@pytest.mark.parametrize("cfg,src,tgt", [
    (("ctx:", "rsp:", M1, M2), f"ctx: X rsp: {M1}", f"{M1} Y {M2}"),
    (("ctx:", "rsp:", None, None), "ctx: X rsp:", "Y"),
    ((None, None, M1, M2), f"X {M1}", f"{M1} Y {M2}"),
    ((None, None, None, None), "X", "Y"),
    (("ctx:", None, M1, None), "X", "Y"),  # lone prefix / lone mask are ignored
    (("", "rsp:", M1, ""), "X", "Y"),
])
def test_prompt_table(spark, cfg, src, tgt):
    df = spark.createDataFrame([("X", "Y")], "c string, r string")
    row = df.select(T.prompt_source("c", *cfg).alias("s"), T.prompt_target("r", *cfg).alias("t")).first()
    assert (row["s"], row["t"]) == (src, tgt)


def test_strip_inverts_target_template(spark):
    vals = ["a b", "x", "long text here"]
    wrapped = T.prompt_target(F.col("s"), "p", "q", M1, M2)
    assert _one(spark, T.clean_prediction(wrapped, M1, M2), vals) == vals


def test_ngrams_match_python(spark):
    vals = ["a b c d", "x", "", "p q p q p"]
    for n in (1, 2, 3, 4):
        got = _one(spark, T.ngrams(T.split_ws("s"), n), vals)
        want = [[" ".join(t[i:i + n]) for i in range(len(t) - n + 1)] for t in (v.split() for v in vals)]
        assert got == want


def py_13a(line):
    for old, new in V13A_PLAIN:
        line = line.replace(old, new)
    line = f" {line} "
    for pat, rep in V13A_REGEX:
        line = re.sub(pat, rep.replace("$1", r"\1").replace("$2", r"\2"), line)
    return line.split()


def test_13a_matches_python_regex(spark, sf):
    from polylogue import fixtures as fx

    texts = SAMPLES + ["Dr. Smith's 3-4 items (cost: $5.00); see <skipped> [x]/{y}~z^_`|@#%*+=?"]
    texts += [r["text"][:400] for r in fx.table(spark, sf, "documents").limit(50).collect()]
    assert _one(spark, tokenize("s", "13a"), texts) == [py_13a(t) for t in texts]
    assert _one(spark, tokenize("s", "char"), texts) == [[c for c in t if not c.isspace()] for t in texts]


def test_drop_marker_token_exact(spark):
    got = _one(spark, T.drop_token(F.split("s", " ")), ["▁ a ▁b ▁", "x"])
    assert got == [["a", "▁b"], ["x"]]


def test_id_list_functions(spark):
    df = spark.createDataFrame([([5, 6, 7],), ([],)], "ids array<bigint>")
    r = df.select(I.truncate("ids", 3).alias("t"), I.pad_to("ids", 5).alias("p")).collect()
    assert [x["t"] for x in r] == [[5, 6, 1], [1]]
    assert [x["p"] for x in r] == [[5, 6, 7, 0, 0], [0, 0, 0, 0, 0]]
    m = df.select(I.mask_pad(I.pad_to("ids", 4)).alias("m")).collect()
    assert [x["m"] for x in m] == [[5, 6, 7, -100], [-100] * 4]
    u = df.select(I.unmask_pad(I.mask_pad(I.pad_to("ids", 4))).alias("u")).collect()
    assert [x["u"] for x in u] == [[5, 6, 7, 0], [0] * 4]


def test_dynamic_batch_padding_of_labels(spark):
    rows = [(i, list(range(1, 2 + (i * 3) % 11))) for i in range(40)]
    df = spark.createDataFrame(rows, "pos long, labels array<bigint>")
    out = I.pad_batches(df, "labels", "pos", 16, 8, pad=I.IGNORE_ID, out="padded").collect()
    for r in out:
        batch = [x for x in rows if x[0] // 16 == r["pos"] // 16]
        width = -(-max(len(x[1]) for x in batch) // 8) * 8
        assert r["padded_len"] == width
        assert r["padded"] == r["labels"] + [I.IGNORE_ID] * (width - len(r["labels"]))
