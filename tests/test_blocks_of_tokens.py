"""Encoding by blocks: a token is looked up once for each block of rows."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from polylogue.operators import vocab as V


def test_a_token_moves_once_for_each_block(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i + j) % 50}" for j in range(30))) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    vocab = spark.createDataFrame([(f"w{i}", i + 3) for i in range(40)], "token string, id long")
    stored, keep = {}, V.written
    monkeypatch.setattr(V, "written", lambda d, name, *a: stored.setdefault(name, keep(d, name, *a)))
    got = {r["id"]: r["ids"] for r in V.encode(df, ["id"], "text", vocab, 20).collect()}
    assert got == {i: [int(t[1:]) + 3 if int(t[1:]) < 40 else 2 for t in text.split(" ")[:19]] + [1] for i, text in rows}
    assert stored["encoded-rows"].select("__block").distinct().count() == 4
    assert stored["block-vocabulary"].count() == 160  # of 76,000 places


def test_texts_of_a_row_are_encoded_together(spark):
    """Null and empty texts, null keys, rows that repeat their keys, several texts with lengths of their own."""
    rng = random.Random(8)
    text = lambda: rng.choice([None, "", "  ", " ".join(rng.choices(["a", "b", "é", "x.y"], k=rng.randint(1, 9)))])
    rows = [(rng.choice(["p", "q", None]), i // 2 if i < 40 else i, text(), text(), rng.randint(0, 6)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, pos long, s string, t string, most int")
    vocab = spark.createDataFrame([("a", 3), ("é", 4), (None, 9)], "token string, id long")
    ids = {"a": 3, "é": 4}
    want = {}
    for k, pos, s, t, most in rows:
        for name, x, n in (("src", s, most), ("tgt", t, 4)):
            want.setdefault((k, pos), {"src": [], "tgt": []})[name] += [(i, ids.get(w, 2)) for i, w in enumerate([w for w in (x or "").split(" ") if w][:max(n - 1, 0)])]
    for hot in (None, spark.createDataFrame([("a",), ("no",)], "token string")):
        found = V.encode_columns(df, ["k", "pos"], {"src": ("s", F.col("most")), "tgt": (F.col("t"), 4)}, vocab, hot)
        got = {(r["k"], r["pos"]): {c: r[c] for c in ("src", "tgt")} for r in found.collect()}
        assert got == {k: {c: [i for _, i in sorted(x)] + [1] for c, x in v.items()} for k, v in want.items()}


def test_tokens_of_blocks_that_a_task_reads_in_pieces():
    lists = lambda *x: pa.array(x, pa.list_(pa.string()))
    batch = lambda blocks, a, b: pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), lists(*a), lists(*b)], ["__block", "__t0", "__t1"])
    found = list(V._tokens_of_blocks([batch([1, 1, 2], [["a"], [], ["a", "b"]], [["a", "c"], ["c"], []]), batch([], [], []), batch([2, 3], [["b"], []], [["d"], ["a"]])]))
    assert [(x.column(0)[0].as_py(), sorted(x.column(1).to_pylist())) for x in found] == [(1, ["a", "c"]), (2, ["a", "b", "d"]), (3, ["a"])]
    assert list(V._tokens_of_blocks([])) == []
