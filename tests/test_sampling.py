"""Row index, guards, seeded samples."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from polylogue import fixtures as fx
from polylogue.operators import sampling as S
from polylogue.operators.index import file_order_index, with_row_index


def test_row_index_equals_row_number(spark, sf):
    docs = fx.table(spark, sf, "documents").select("lang", "doc_id")
    want = docs.withColumn("pos", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")) - 1)
    for width, fanout in [(1, 2), (3, None), (8, 4), (1 << 20, 4096)]:
        got = with_row_index(docs, "doc_id", by=["lang"], width=width, fanout=fanout)
        assert sorted(map(tuple, got.select("lang", "doc_id", "pos").collect())) == \
            sorted(map(tuple, want.select("lang", "doc_id", "pos").collect()))


def test_file_order_index_follows_lines(spark, tmp_path):
    p = tmp_path / "lines.txt"
    lines = [f"line {i}" for i in range(2500)]
    p.write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = file_order_index(spark.read.text(str(p))).select("pos", "value").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["pos"], r["value"]) for r in got) == list(enumerate(lines))


def test_sample_exactly_k_and_partition_independent(spark, sf):
    lp = fx.lang_pairs(spark, sf)
    a = S.sample_k(lp.repartition(1), 10).select("lang", "pos", "shot_ordinal").collect()
    b = S.sample_k(lp.repartition(7), 10).select("lang", "pos", "shot_ordinal").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    per = {}
    for r in a:
        per.setdefault(r["lang"], []).append(r)
    assert all(len(v) == 10 for v in per.values())
    for v in per.values():  # ordinals follow ascending position
        assert [r["shot_ordinal"] for r in sorted(v, key=lambda r: r["pos"])] == list(range(1, 11))


def test_small_groups_are_skipped(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(20)], "lang string, pos long")
    assert {r["lang"] for r in S.sample_k(df, 10).collect()} == {"b"}
    rep = {r["lang"]: r["is_sufficient"] for r in S.sufficiency(df, 10).collect()}
    assert rep == {"a": False, "b": True}


def test_mt19937_matches_stdlib(spark):
    counts = spark.createDataFrame([("de", 500), ("es", 37), ("xx", 3)], "lang string, n long")
    got = S.draw_positions_mt(spark, counts, 10, 2023, draws=2).collect()
    for lang, n in [("de", 500), ("es", 37)]:
        random.seed(2023)
        first = sorted(random.sample(range(n), 10))
        second = sorted(random.sample(range(n), 10))
        assert [r["pos"] for r in sorted(got, key=lambda r: (r["draw"], r["shot_ordinal"]))
                if r["lang"] == lang] == first + second
    assert not [r for r in got if r["lang"] == "xx"]


def test_first_n_and_sample_sizes(spark):
    df = spark.createDataFrame([("a", i) for i in range(30)], "lang string, k long")
    assert sorted(r["k"] for r in S.first_n(df, 5, ["lang"], "k").collect()) == [0, 1, 2, 3, 4]
    assert S.sample_sizes(df, 100, ["lang"]).first()["n_reported"] == 30
    assert S.sample_sizes(df, 7, ["lang"]).first()["n_reported"] == 7


def test_large_k_needs_no_session_setting(spark):
    df = spark.range(5000).select((F.col("id") % 2).cast("string").alias("lang"), F.col("id").alias("pos"))
    before = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    assert S.sample_k(df, 1500).count() == 3000
    assert spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold") == before
    plan = S.sample_k(df, 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_row_index_keeps_rows_of_the_null_group(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2), ("a", 9)], "lang string, k long")
    got = with_row_index(df, "k", by=["lang"], width=2).collect()
    assert sorted(((r["lang"] or ""), r["k"], r["pos"]) for r in got) == [("", 1, 0), ("", 3, 1), ("a", 2, 0), ("a", 9, 1)]


def test_file_order_past_five_digits(spark, tmp_path):
    numbers = [99998, 99999, 100000, 100001]
    for n in numbers:
        (tmp_path / f"part-{n:05d}-x.txt").write_text(f"line {n}\n")
    got = file_order_index(spark.read.text(str(tmp_path))).collect()
    assert [r["value"] for r in sorted(got, key=lambda r: r["pos"])] == [f"line {n}" for n in numbers]


def test_row_index_with_two_bucket_columns(spark):
    df = spark.createDataFrame([(i % 37, i) for i in range(400)], "a long, b long")
    df = df.withColumn("c", F.floor(F.col("b") / 50))
    want = {(a, b): i for i, (a, b) in enumerate(sorted((i % 37, i) for i in range(400)))}
    got = with_row_index(df, ["a", "b"], bucket=["a", "c"], fanout=4).collect()
    assert {(r["a"], r["b"]): r["pos"] for r in got} == want


def test_row_index_independent_of_partitioning(spark, sf):
    docs = fx.table(spark, sf, "documents").select("lang", "doc_id")
    a = with_row_index(docs.repartition(1), "doc_id", by=["lang"], width=4, fanout=3).collect()
    b = with_row_index(docs.repartition(13, "doc_id"), "doc_id", by=["lang"], width=4, fanout=3).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
