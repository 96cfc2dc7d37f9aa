"""Sources and sinks: CSV fidelity, split loading, output guards, positions."""

import pytest
from pyspark.sql import functions as F

from polylogue.operators.apply import cached_table
from polylogue.session import scratch_path
from polylogue.sources import files as IO

TRICKY = [("1", 'say "hi", then\nleave', "  padded  "), ("2", "", "a,b"), ("3", "x\r\ny", '"')]


def test_csv_roundtrip_is_exact(spark):
    df = spark.createDataFrame(TRICKY, "id string, context string, response string")
    path = scratch_path(spark, "t-csv")
    IO.write_csv(df, path)
    back = IO.read_csv(spark, path).collect()
    assert sorted(map(tuple, back)) == sorted(TRICKY)


def test_refuses_existing_output_unless_overwrite(spark):
    df = spark.createDataFrame(TRICKY, "id string, context string, response string")
    path = scratch_path(spark, "t-guard")
    IO.write_csv(df, path)
    with pytest.raises(Exception):
        IO.write_csv(df, path)
    IO.write_csv(df, path, overwrite=True)


def test_lines_keep_positions(spark):
    df = spark.createDataFrame([("de", i, f"p{i}\nx") for i in range(300)], "lang string, pos long, t string")
    path = scratch_path(spark, "t-lines")
    IO.write_lines(df.repartition(5), path, "t", ["pos"], ["lang"])
    got = IO.read_lines(spark, path, ["lang"]).collect()
    assert sorted((r["pos"], r["line"]) for r in got) == [(i, f"p{i} x") for i in range(300)]


def test_load_splits_rejects_other_extensions(spark):
    with pytest.raises(ValueError, match="csv or a json"):
        IO.load_splits(spark, {"train": "/tmp/data.txt"})


def test_require_columns_names_options(spark):
    df = spark.createDataFrame([("a", "b")], "context string, response string")
    IO.require_columns(df, "context", "response")
    with pytest.raises(ValueError, match="context, response"):
        IO.require_columns(df, "text")


def test_cached_table_reused(spark):
    path = scratch_path(spark, "t-cache")
    assert cached_table(spark, spark.range(5), path).count() == 5
    made = cached_table(spark, spark.range(5), path).inputFiles()
    assert made == cached_table(spark, spark.range(5), path).inputFiles()
    # another plan, or changed inputs, never get the first one's rows
    assert cached_table(spark, spark.range(50), path).count() == 50
    source = scratch_path(spark, "t-cache-source")
    spark.range(3).write.parquet(source)
    assert cached_table(spark, spark.read.parquet(source), path).count() == 3
    spark.range(7).write.mode("overwrite").parquet(source)
    assert cached_table(spark, spark.read.parquet(source), path).count() == 7


def test_splits_with_different_columns(spark):
    path = scratch_path(spark, "t-splits")
    spark.createDataFrame([("a", "b")], "x string, y string").write.json(f"{path}/train.json")
    IO.write_csv(spark.createDataFrame([("c",)], "x string"), f"{path}/test.csv")
    got = IO.load_splits(spark, {"train": f"{path}/train.json", "test": f"{path}/test.csv"}).select("split", "x", "y").collect()
    assert sorted(map(tuple, got)) == [("test", "c", ""), ("train", "a", "b")]


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from polylogue.session import checkpoint_root

    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None, getConf=lambda: SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: d)))


def test_metric_files_have_split_prefix(spark):
    from polylogue.operators.report import write_metrics

    m = spark.createDataFrame([("de", "fs", "sacrebleu_score", 1.5)], "lang string, system string, metric string, "
                              "value double")
    path = scratch_path(spark, "t-metrics")
    write_metrics(m, path, "predict")
    assert spark.read.json(path).first()["metric"] == "predict_sacrebleu_score"


def test_discover_languages_flat_layout(spark, tmp_path):
    from polylogue.sources.catalog import discover_languages

    for name in ["en_train.csv", "de_train.csv", "de_test.csv", "pl_train.csv", "fr_train.csv", "_SUCCESS", ".hidden"]:
        (tmp_path / name).write_text("context,response\na,b\n")
    got = [r["lang"] for r in discover_languages(spark, str(tmp_path)).collect()]
    assert got == ["de", "fr"]


def test_written_pairs_equal_lazy_plan(spark, sf):
    from polylogue import fixtures as fx

    cols = ["pair_id", "lang", "doc_id", "context", "response", "split", "pos", "split_pos"]
    a = fx.lang_pairs(spark, sf).select(*cols).collect()
    b = fx.build_lang_pairs(spark, sf).select(*cols).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
