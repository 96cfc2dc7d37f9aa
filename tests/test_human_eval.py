"""Ballots and tallies."""

import pytest
from pyspark.sql import functions as F

from polylogue import fixtures as fx
from polylogue.operators import human_eval as H


def test_ballot_layout_and_roundtrip(spark, sf):
    b = fx.ballots(spark, sf, answered=False, k=40)
    rows = b.collect()
    by = {}
    for r in rows:
        by.setdefault((r["lang"], r["comparison"]), []).append(r)
    assert by and all(len(v) == 40 for v in by.values())
    assert {r["row_no"] for r in rows if r["comparison"] == "fs"} == set(range(1, 41))
    # answering "plain" everywhere (A on odd ids, B on even) tallies as all plain
    plain = b.withColumn("answer", F.when(F.col("random_id") % 2 == 1, "A").otherwise(" B "))
    t = H.tally(plain).collect()
    assert all(r["plain"] == r["total"] == 40 and r["prompt"] == 0 for r in t)
    prompt = b.withColumn("answer", F.when(F.col("random_id") % 2 == 1, "B").otherwise("A"))
    assert all(r["prompt"] == 40 for r in H.tally(prompt).collect())


def test_only_exact_a_or_b_counts(spark):
    df = spark.createDataFrame([(1, "A"), (1, " b"), (2, "Neutral"), (2, ""), (3, "\tB\n"), (4, "AB")],
                               "random_id long, answer string").withColumn("lang", F.lit("x")) \
        .withColumn("comparison", F.lit("fs"))
    r = H.tally(df).first()
    assert (r["plain"], r["neutral"], r["prompt"], r["total"]) == (1, 4, 1, 6)


def test_missing_prediction_fails_in_strict_mode(spark, sf):
    lp = fx.lang_pairs(spark, sf)
    preds = fx.clean_predictions(spark, sf).filter(~((F.col("system") == "fs") & (F.col("pos") % 3 == 0)))
    with pytest.raises(Exception, match="prediction is missing"):
        H.build_ballots(lp, preds, 40, languages=fx.languages(spark)).collect()


def test_mt19937_ballots_follow_the_reference_stream(spark):
    import random

    import __spark_entry__ as E

    sf = "/root/testdata/sf0.01"  # the smaller set has fewer than 100 test rows per language
    got = E.queries()["ballot_build_mt19937"](spark, sf).collect()
    assert got
    sizes = {r["lang"]: r["n"] for r in fx.lang_pairs(spark, sf).filter("split = 'test'").groupBy("lang").count()
             .withColumnRenamed("count", "n").collect()}
    for lang in {r["lang"] for r in got}:
        random.seed(2023)
        fs = sorted(random.sample(range(sizes[lang]), 100))
        mtl = sorted(random.sample(range(sizes[lang]), 100))
        assert sorted(r["random_id"] for r in got if r["lang"] == lang and r["comparison"] == "fs") == fs
        assert sorted(r["random_id"] for r in got if r["lang"] == lang and r["comparison"] == "mtl") == mtl
