"""Shapes of physical plans, and results where they once went wrong."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from polylogue import fixtures as fx
from polylogue.operators.report import aligned_strictly, metrics_report
from polylogue.operators.vocab import build_vocab, decode, encode


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    return len(re.findall(r"FileScan|Scan parquet", plan(df)))


@pytest.mark.parametrize(("name", "most"), [("prompt_source", 1), ("prompt_target", 1), ("encode_pairs", 2), ("pad_batch", 5)])
def test_inputs_are_scanned_once(spark, sf, name, most):
    assert scans(E.queries()[name](spark, sf)) <= most


@pytest.mark.parametrize("name", ["interleave_spread", "interleave_reference", "interleave_reference_pairs"])
def test_interleave_has_no_cross_join(spark, sf, name):
    text = plan(E.queries()[name](spark, sf))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_sentence_scores_need_no_shuffle_of_their_own(spark):
    from polylogue.operators.bleu import sentence_bleu

    df = spark.createDataFrame([(1, "a b c d e", "a b c d e"), (2, "x", "y")], "id long, h string, r string")
    out = sentence_bleu(df, ["id"], "h", "r")
    assert "Exchange" not in plan(out)
    assert {r["id"]: round(r["score"], 6) for r in out.collect()} == {1: 100.0, 2: 0.0}


def test_long_conversations_keep_their_pairs_apart(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}") for c in (1, 2) for t in range(220)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    pairs = fx.dialogue_pairs(spark, str(tmp_path))
    assert pairs.count() == pairs.select("pair_id").distinct().count() == 220


def test_a_document_of_a_million_lines(spark, tmp_path):
    rows = [(1, "\n".join(["a", "b"] * 500_010), "en"), (2, "c\nd", "en"), (2**62, "e\nf", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    pairs = fx.pairs_from_documents(spark, str(tmp_path))
    assert pairs.count() == pairs.select("pair_id").distinct().count() == 1_000_021


def test_a_system_without_words_stays_in_the_report(spark):
    pairs = [("de", i, f"a b c {i} d") for i in range(4)]
    preds = [("de", "good", i, f"a b c {i} d") for i in range(4)] + [("de", "empty", i, "") for i in range(4)]
    p = spark.createDataFrame(preds, "lang string, system string, pos long, prediction string")
    scored = aligned_strictly(p, spark.createDataFrame(pairs, "lang string, pos long, response string"), ["lang", "pos"], "response")
    got = {(r["system"], r["metric"]): r["value"] for r in metrics_report(p, scored, ["lang", "system"], ["pos"]).collect()}
    assert got["empty", "samples"] == 4 and got["empty", "sacrebleu_score"] == 0 and got["empty", "distinct_1"] is None
    assert got["good", "sacrebleu_score"] == 100 and got["good", "distinct_1"] == 40.0


def test_a_prediction_without_reference_is_an_error(spark):
    p = spark.createDataFrame([("de", 0, "a"), ("de", 1, "b")], "lang string, pos long, prediction string")
    r = spark.createDataFrame([("de", 0, "a")], "lang string, pos long, response string")
    with pytest.raises(Exception, match="no reference"):
        aligned_strictly(p, r, ["lang", "pos"], "response").collect()


def test_brevity_follows_lengths_alone(spark):
    from polylogue.operators.bleu import corpus_bleu

    df = spark.createDataFrame([("x", 0, "p q", "a b c d e f g h i j k l")], "s string, pos long, prediction string, response string")
    r = corpus_bleu(df, ["s"], ["pos"], references="response").first()
    assert r["score"] == 0 and r["bp"] == pytest.approx(2.718281828459045 ** (1 - 12 / 2))


def test_decode_returns_the_cut_text(spark):
    texts = [(i, " ".join(f"w{(i * j) % 977}" for j in range(1, 60))) for i in range(200)]
    df = spark.createDataFrame(texts, "id long, text string")
    vocab = build_vocab(df, ["text"])
    ids = vocab.collect()
    assert sorted(r["id"] for r in ids) == list(range(3, 3 + len(ids)))
    back = decode(encode(df, ["id"], "text", vocab, 20), ["id"], "ids", vocab).collect()
    assert {r["id"]: r["text"] for r in back} == {i: " ".join(t.split()[:19]) for i, t in texts}


def test_labels_are_cleaned_like_predictions(spark, sf):
    from polylogue.plans.q_metrics import _cleaned

    df = spark.createDataFrame([(f"{fx.MASK1} a b {fx.MASK2}", " c ")], "context string, response string")
    assert tuple(_cleaned(df).first()) == ("a b", "c")


def test_a_registered_metric_is_reported(spark):
    from polylogue.operators import report as R

    @R.metric("longest", ["longest"])
    def longest(predictions, scored, keys, row_keys, reference):
        return predictions.groupBy(*keys).agg(F.max(F.length("prediction")).cast("double").alias("longest"))

    try:
        p = spark.createDataFrame([("de", 0, "abc", "abc")], "lang string, pos long, prediction string, response string")
        got = R.metrics_report(p, p, ["lang"], ["pos"], metrics=("bleu", "longest")).where("metric = 'longest'").first()
        assert got["value"] == 3
    finally:
        del R.METRICS["longest"]
