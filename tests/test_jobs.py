"""Evaluation, training tables and tallies over files, against plain statements."""

import bisect
import json
import math

import pytest
from pyspark.sql import functions as F

from polylogue import jobs
from polylogue.operators.mixing import candidates_before, hits_table, interleave
from polylogue.sources import files as IO
from test_plans import plan

M1, M2 = "<extra_id_0>", "<extra_id_1>"


@pytest.fixture(scope="module")
def evaluated(spark, tmp_path_factory):
    """Two languages, two runs each; the files a generator and a corpus leave."""
    root = tmp_path_factory.mktemp("evaluate")
    tests = {"de": [f"wort {i} ist hier drin" for i in range(12)], "fr": [f"{M1} le mot {i} est la {M2}" for i in range(9)]}
    runs = {("de", "fs"): [f" {t} " for t in tests["de"]], ("de", "mtl"): ["ganz anders"] * 12, ("fr", "fs"): [f"{M1} le mot {i} est la" for i in range(9)], ("fr", "mtl"): [""] * 9}
    for lang, rows in tests.items():
        df = spark.createDataFrame([(i, "c", t) for i, t in enumerate(rows)], "pos long, context string, response string")
        IO.single_file(df, f"{root}/{lang}_test.csv", ["pos"])
    for (lang, system), rows in runs.items():
        (root / lang / system).mkdir(parents=True)
        (root / lang / system / "generated_predictions.txt").write_text("\n".join(rows) + "\n")
    catalog = spark.createDataFrame([(lang, s, f"{root}/{lang}/{s}/generated_predictions.txt") for lang, s in runs], "lang string, setting string, path string")
    return str(root), tests, runs, catalog


@pytest.mark.parametrize("most", [None, 5])
def test_evaluation_leaves_the_files_of_each_run(spark, evaluated, tmp_path, most):
    root, tests, runs, catalog = evaluated
    references = jobs.read_language_files(spark, root, "test", ["de", "fr"])
    report = jobs.evaluate(spark, references, catalog, str(tmp_path), "eval", most)
    for (lang, system), lines in runs.items():
        found = json.loads((tmp_path / lang / system / "eval_results.json").read_text())
        n = len(lines) if most is None else min(most, len(lines))
        assert set(found) == {"eval_" + m for m in ("sacrebleu_score", "sacrebleu_1", "sacrebleu_2", "sacrebleu_bp", "samples", "distinct-1", "distinct-2")}
        assert found["eval_samples"] == n
        if system == "fs":  # equal to the labels once mask tokens and white space are gone
            assert math.isclose(found["eval_sacrebleu_score"], 100) and found["eval_sacrebleu_bp"] == 1
        if lines[0] == "":
            assert found["eval_distinct-1"] is None and found["eval_sacrebleu_score"] == 0
        clean = [t.removeprefix(M1 + " ").removesuffix(" " + M2).strip() for t in lines][:n]
        assert (tmp_path / lang / system / "generated_predictions.txt").read_text().split("\n")[:n] == clean
    de = {r["metric"]: r["value"] for r in report.filter("lang = 'de' and system = 'mtl'").collect()}
    assert de["eval_distinct-1"] == pytest.approx(100 * 2 / (2 * (most or 12))) and len(de) == 7


def test_large_plain_files_are_read_by_ranges(spark, evaluated, tmp_path, monkeypatch):
    root, tests, _, _ = evaluated
    rows = [(i, f"c{i}", f'r "{i}"\nsecond line, {i}') for i in range(300)]
    IO.single_file(spark.createDataFrame(rows, "pos long, context string, response string"), f"{tmp_path}/da_test.csv", ["pos"])
    plain = sorted(map(tuple, jobs.read_language_files(spark, str(tmp_path), "test", ["da"]).select("lang", "pos", "context", "response").collect()))
    monkeypatch.setattr(jobs, "SPLIT_BYTES", 1)
    split = sorted(map(tuple, jobs.read_language_files(spark, str(tmp_path), "test", ["da"]).select("lang", "pos", "context", "response").collect()))
    assert split == plain == [("da", *r) for r in rows]


def test_a_prediction_without_a_label_is_an_error(spark, evaluated, tmp_path):
    root, _, _, catalog = evaluated
    references = jobs.read_language_files(spark, root, "test", ["de", "fr"]).filter("pos <> 3")
    with pytest.raises(Exception, match="no reference"):
        jobs.evaluate(spark, references, catalog, str(tmp_path))


def test_training_tables_in_batches(spark):
    rows = [(lang, split, i, f"{lang}{split}{i}", " ".join(["a"] * (i % 7 + 1)), " ".join(["b"] * (i % 11 + 1)))
            for lang in ("x", "y") for split in ("train", "test") for i in range(23)]
    pairs = spark.createDataFrame(rows, "lang string, split string, split_pos long, id string, context string, response string")
    vocab = spark.createDataFrame([("a", 3), ("b", 4)], "token string, id long")
    got = jobs.training_tables(pairs, vocab, "id", max_source=6, max_target=5, max_target_eval=9, batch_size=8, max_samples={"test": 10}).collect()
    by_id = {r["id"]: r for r in got}
    assert len(got) == 2 * 23 + 2 * 10
    for lang, split, i, key, context, response in rows:
        if split == "test" and i >= 10:
            assert key not in by_id
            continue
        r = by_id[key]
        batch = [k for k in range(8 * (i // 8), 8 * (i // 8) + 8) if k < (23 if split == "train" else 10)]
        src = lambda k: min(k % 7 + 1, 5) + 1
        tgt = lambda k, most=(5 if split == "train" else 9): min(k % 11 + 1, most - 1) + 1
        wide = [math.ceil(max(f(k) for k in batch) / 8) * 8 for f in (src, tgt)]
        assert r["batch_id"] == i // 8
        assert r["input_ids"] == [3] * (src(i) - 1) + [1] + [0] * (wide[0] - src(i))
        assert r["attention_mask"] == [1] * src(i) + [0] * (wide[0] - src(i))
        assert r["labels"] == [4] * (tgt(i) - 1) + [1] + [-100] * (wide[1] - tgt(i))


def test_preprocess_takes_the_first_samples(spark):
    rows = [(i, f"k{i}", "a " * (i % 3 + 1), "b") for i in range(50)]
    pairs = spark.createDataFrame(rows, "n long, id string, context string, response string").repartition(3)
    vocab = spark.createDataFrame([("a", 3), ("b", 4)], "token string, id long")
    got = {r["id"]: r["input_ids"] for r in jobs.preprocess(pairs, vocab, ["id"], 6, 4, max_samples=7, order=["n"]).collect()}
    assert set(got) == {f"k{i}" for i in range(7)} and got["k2"] == [3, 3, 3, 1, 0, 0]
    assert jobs.preprocess(pairs, vocab, ["id"], 6, 4).count() == 50


# ---------------------------------------------------------------- interleave with many shots
def plain_interleave(n, k):
    """The reference's walk: (source row or shot) in output order."""
    out, shot = [], 0
    for i in range(1, n + 1):
        out.append(("row", i - 1))
        if i % (n / k) == 0:
            shot += 1
            out.append(("shot", shot))
    return out


@pytest.mark.parametrize(("n", "k"), [(6000, 2000), (6000, 1500), (5031, 1118), (7001, 1100), (4096, 2048), (1200, 1200)])
def test_places_from_a_table(spark, n, k):
    table = hits_table(spark, n, k).collect()
    hits = [i for i in range(1, n + 1) if i % (n / k) == 0]
    assert sorted(r["hit"] for r in table if r["hit"] is not None) == hits and len(table) == k + 1
    passed = {r["candidate"]: r["passed"] for r in table}
    rows = spark.range(1, n + 1).select("id", candidates_before(F.col("id"), n, k).alias("c")).collect()
    for r in rows:
        assert passed[r["c"]] == bisect.bisect_left(hits, r["id"])


@pytest.mark.parametrize("mode", ["reference", "spread"])
def test_interleave_with_more_shots_than_literals(spark, mode):
    n, k = 3000, 1500
    corpus = spark.range(n).select(F.lit("en").alias("lang"), F.col("id").alias("pos"), F.concat(F.lit("e"), "id").alias("pair_id")).unionByName(
        spark.range(k + 100).select(F.lit("de").alias("lang"), F.col("id").alias("pos"), F.concat(F.lit("d"), "id").alias("pair_id")))
    out = interleave(corpus, "en", k, mode=mode)
    rows = sorted((r["out_pos"], r["is_shot"], r["pair_id"]) for r in out.collect())
    assert [p for p, _, _ in rows] == list(range(n + k))
    assert [("shot" if s else "row") for _, s, _ in rows] == [x for x, _ in plain_interleave(n, k)]
    shots = [int(key[1:]) for _, s, key in rows if s]
    assert len(set(shots)) == k and shots == sorted(shots)


def test_the_plan_does_not_grow_with_the_shots(spark):
    corpus = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"), F.floor(F.col("id") / 2).alias("pos"), F.col("id").cast("string").alias("pair_id"))
    sizes = [len(plan(interleave(corpus, "en", k, mode="reference"))) for k in (2000, 16_000)]
    assert abs(sizes[1] - sizes[0]) < 400
