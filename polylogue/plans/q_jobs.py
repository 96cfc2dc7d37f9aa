"""Whole jobs over files that are written from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from .. import jobs
from ..operators.vocab import build_vocab
from ..session import hadoop_path, scratch_path
from ..sources import files as IO
from ..sources.catalog import run_catalog
from .oracle_ctes import add_cte, with_ctes
from .q_human import TALLY_COLS
from .q_metrics import BS, metrics_sql
from .q_sampling import _interleave_sql
from .q_text import _vocab
from .registry import query
from .sqltext import ngram_list, split_space, split_ws, strip_masks, strip_ws, tokenize

M1, M2 = fx.MASK1, fx.MASK2


@query("job_corpora", with_ctes(f"""
SELECT 'few_shot' AS kind, lang, shot_ordinal - 1 AS pos, pair_id FROM shots WHERE lang <> 'en'
UNION ALL SELECT 'multitask', tgt_lang, out_pos, pair_id FROM ({_interleave_sql("train_pairs", "pair_id", "spread")})
""", "train_pairs", "shots"))
def job_corpora_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training files of each language -> few-shot and multitask files, read back with line positions."""
    root = scratch_path(spark, "job-corpora")
    train = fx.train_pairs(spark, sf_dir).select("lang", "pos", "pair_id", "context", "response")
    IO.write_per_key(train, f"{root}/in", "lang", "{}_train.csv", order=["pos"])
    jobs.build_corpora(spark, f"{root}/in", f"{root}/out")
    few = IO.read_positioned(spark, f"{root}/out/few_shot/*", "csv", dir_col="__dir")
    multi = IO.read_positioned(spark, f"{root}/out/multitask/*", "csv", dir_col="__dir")
    return (few.select(F.lit("few_shot").alias("kind"), F.regexp_extract("__dir", r"/([^/_]+)_fs_10\.csv$", 1).alias("lang"), "pos", "pair_id")
            .unionByName(multi.select(F.lit("multitask").alias("kind"), F.regexp_extract("__dir", r"en_([^/_]+)_10_train\.csv$", 1).alias("lang"), "pos", "pair_id")))


_JOB_BALLOTS = f"""
WITH d AS (
  SELECT lang, comparison, pos, context, row_number() OVER (PARTITION BY lang, comparison ORDER BY pos) AS ord
  FROM (SELECT t.lang, t.split_pos AS pos, t.context, c.draw AS comparison, count(*) OVER (PARTITION BY t.lang, c.draw) AS n,
          row_number() OVER (PARTITION BY t.lang, c.draw ORDER BY md5(concat_ws('|', '2023', t.lang, c.draw, CAST(t.split_pos AS VARCHAR))), t.split_pos) AS rn
        FROM test_pairs t JOIN languages USING (lang), (VALUES ('fs'), ('mtl')) AS c(draw)) WHERE rn <= 20 AND n >= 20),
p AS (SELECT p.lang, p.system, t.split_pos AS pos, regexp_replace(p.prediction, '\\r\\n|\\r|\\n', ' ', 'g') AS prediction
  FROM prc p JOIN test_pairs t USING (lang, pos)),
b AS (SELECT d.lang, d.comparison, d.pos AS random_id, d.context,
    CASE WHEN d.pos % 2 = 1 THEN a.prediction ELSE b.prediction END AS response_a,
    CASE WHEN d.pos % 2 = 1 THEN b.prediction ELSE a.prediction END AS response_b,
    (CASE d.comparison WHEN 'fs' THEN 0 ELSE 1 END) * 20 + d.ord AS row_no
  FROM d JOIN p a ON a.lang = d.lang AND a.pos = d.pos AND a.system = d.comparison
  JOIN p b ON b.lang = d.lang AND b.pos = d.pos AND b.system = d.comparison || '_prompt')
"""


def _written_ballots(spark: SparkSession, sf_dir: str) -> str:
    """Test files and run files -> ballot files; the folder they are in."""
    root = scratch_path(spark, "job-ballots")
    tests = fx.lang_pairs(spark, sf_dir).filter("split = 'test'")
    IO.write_per_key(tests.select("lang", "split_pos", "pair_id", "context", "response"), f"{root}/tests", "lang", "{}_test.csv", order=["split_pos"])
    lines = fx.clean_predictions(spark, sf_dir).join(tests.select("lang", "pos", "split_pos"), ["lang", "pos"])
    _written_runs(spark, lines, tests, root)
    # the third column of a test file is the context
    jobs.build_ballots_from_runs(spark, f"{root}/tests", f"{root}/runs", f"{root}/ballots", fx.languages(spark), k=20, context=2)
    return f"{root}/ballots"


@query("job_ballots", with_ctes(_JOB_BALLOTS + "SELECT lang, row_no, random_id, context, response_a, response_b FROM b", "test_pairs", "languages", "prc"))
def job_ballots_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ballot files made from test files and run files, read back."""
    back = IO.read_positioned(spark, f"{_written_ballots(spark, sf_dir)}/*", "csv", dir_col="__dir")
    return back.select(F.regexp_extract("__dir", r"human_eval_([^/]+)\.csv$", 1).alias("lang"), (F.col("pos") + 1).alias("row_no"),
                       F.col("`Random ID`").cast("long").alias("random_id"), F.col("Context").alias("context"),
                       F.col("`Response A`").alias("response_a"), F.col("`Response B`").alias("response_b"))


_JOB_VOTES = _JOB_BALLOTS + """, v AS (SELECT lang, comparison,
  CASE WHEN row_no % 3 = 0 THEN (CASE WHEN random_id % 2 = 1 THEN 'plain' ELSE 'prompt' END)
       WHEN row_no % 3 = 1 THEN (CASE WHEN random_id % 2 = 1 THEN 'prompt' ELSE 'plain' END) ELSE 'neutral' END AS v FROM b)
"""


@query("job_tally", with_ctes(_JOB_VOTES + f"SELECT lang, comparison, {TALLY_COLS} FROM v GROUP BY lang, comparison", "test_pairs", "languages", "prc"))
def job_tally_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered ballot files -> tallies: every third line votes A, the next B."""
    return jobs.tally_files(spark, _written_answers(spark, sf_dir), block_size=20)


def _written_answers(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the answered ballot files."""
    ballots = IO.read_positioned(spark, f"{_written_ballots(spark, sf_dir)}/*", "csv", dir_col="__dir")
    answer = jobs.BALLOT_HEADER[-1]
    row = F.col("pos") + 1
    answered = ballots.withColumn(answer, F.when(row % 3 == 0, "A").when(row % 3 == 1, " B").otherwise("Neutral"))
    lang = F.regexp_extract("__dir", r"human_eval_([^/]+)\.csv$", 1)
    folder = scratch_path(spark, "job-answers")
    IO.write_per_key(answered.select(lang.alias("lang"), "pos", *[F.col(f"`{h}`") for h in jobs.BALLOT_HEADER]), folder, "lang", "human_eval_{}.csv", order=["pos"])
    return folder


@query("job_tally_family", with_ctes(_JOB_VOTES + f"""
SELECT family, comparison, {TALLY_COLS} FROM v JOIN languages USING (lang) GROUP BY family, comparison""", "test_pairs", "languages", "prc"))
def job_tally_family_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered ballot files -> tallies of each language family."""
    return jobs.tally_files(spark, _written_answers(spark, sf_dir), block_size=20, families=fx.languages(spark))


_SRC, _TGT = f"'Context: ' || context || ' Response: {M1}'", f"'{M1} ' || response || ' {M2}'"


@query("job_preprocess", with_ctes(f"""
, x AS (SELECT pair_id, context, response FROM dialogue_pairs),
s AS (SELECT pair_id, 'src' AS side, {split_space(_SRC)}[1:63] AS t FROM x UNION ALL SELECT pair_id, 'tgt', {split_space(_TGT)}[1:31] FROM x),
e AS (SELECT pair_id, side, list(coalesce(v.id, 2) ORDER BY i) AS ids
  FROM (SELECT pair_id, side, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM s) u LEFT JOIN vocab v USING (token) GROUP BY pair_id, side),
w AS (SELECT pair_id, max(CASE WHEN side = 'src' THEN list_concat(ids, [1]) END) AS a, max(CASE WHEN side = 'tgt' THEN list_concat(ids, [1]) END) AS b FROM e GROUP BY pair_id)
SELECT pair_id, array_to_string(list_concat(a, list_transform(range(64 - len(a)), lambda i: 0)), ' ') AS input_ids, len(a) AS n_input,
  array_to_string(list_concat(b, list_transform(range(32 - len(b)), lambda i: -100)), ' ') AS labels FROM w
""", "dialogue_pairs", "vocab").replace(")\n\n, x AS", "),\nx AS", 1))
def job_preprocess_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template, ids, cut, padding and label mask of all pairs as one operator."""
    out = jobs.preprocess(fx.dialogue_pairs(spark, sf_dir), _vocab(spark, sf_dir), ["pair_id"], 64, 32, "Context:", "Response:", (M1, M2))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    return out.select("pair_id", text("input_ids"), F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_input"), text("labels"))


# ---------------------------------------------------------------- evaluation
EVAL_SAMPLES = 40
for _split, _most in (("test", None), ("validation", EVAL_SAMPLES)):
    _cut = f"AND l.split_pos < {_most}" if _most else ""
    # a line of the generated file has no line breaks
    add_cte(f"job_prc_{_split}", ["predictions", "lang_pairs"], f"""
      SELECT p.lang, p.system, p.pos, {strip_ws(strip_masks("regexp_replace(p.prediction, '\\r\\n|\\r|\\n', ' ', 'g')", M1, M2))} AS prediction
      FROM predictions p JOIN lang_pairs l ON l.lang = p.lang AND l.pos = p.pos JOIN languages f ON f.lang = p.lang WHERE l.split = '{_split}' {_cut}""")
    add_cte(f"job_tok_{_split}", [f"job_prc_{_split}"], f"SELECT lang, system, pos, list_filter({split_ws('prediction')}, lambda t: t <> '▁') AS t FROM job_prc_{_split}")
    add_cte(f"job_rows_{_split}", [f"job_prc_{_split}", "lang_pairs"], f"""
      SELECT p.lang, p.system, p.pos, {tokenize('p.prediction', '13a', False)} AS h, [{tokenize(strip_ws(strip_masks('l.response', M1, M2)), '13a', False)}] AS refs
      FROM job_prc_{_split} p JOIN lang_pairs l ON l.lang = p.lang AND l.pos = p.pos""")


def _job_metrics_sql(split: str, prefix: str) -> str:
    return (f"SELECT lang, system, '{prefix}_' || replace(metric, 'distinct_', 'distinct-') AS metric, value FROM ("
            + metrics_sql(f"job_prc_{split}", f"job_tok_{split}", f"job_rows_{split}") + ")")


@query("job_evaluate", with_ctes(f"""
{_job_metrics_sql("test", "predict")} UNION ALL {_job_metrics_sql("validation", "eval")}
UNION ALL SELECT lang, system, 'lines', CAST(count(*) AS DOUBLE) FROM job_prc_test GROUP BY lang, system
UNION ALL SELECT lang, system, 'characters', CAST(sum(length(prediction)) AS DOUBLE) FROM job_prc_test GROUP BY lang, system
""", "languages", "job_tok_test", "job_rows_test", "job_tok_validation", "job_rows_validation"))
def job_evaluate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test files and run files -> metrics and prediction files of each run, read back; the validation runs up to a number of samples."""
    pairs = fx.lang_pairs(spark, sf_dir).join(F.broadcast(fx.languages(spark).select("lang")), "lang")
    codes = [r["lang"] for r in pairs.select("lang").distinct().collect()]
    found = None
    runs = (("test", "predict", None), ("validation", "eval", EVAL_SAMPLES))
    splits = tuple(r[0] for r in runs)
    places = pairs.filter(F.col("split").isin(*splits)).select("lang", "pos", "split", "split_pos")
    # outputs of these languages alone, made where they are used, cross the join once for both splits
    raw = fx.build_predictions(spark, sf_dir, pairs, splits).join(places, ["lang", "pos"])
    generated = scratch_path(spark, "job-evaluate-runs")
    IO.write_lines(raw, generated, "prediction", ["split_pos"], ["split", "lang", "system"])
    for split, prefix, most in runs:
        root = scratch_path(spark, f"job-evaluate-{split}")
        part = pairs.filter(F.col("split") == split)
        IO.write_per_key(part.select("lang", "split_pos", "pair_id", "context", "response"), f"{root}/files", "lang", f"{{}}_{split}.csv", order=["split_pos"])
        catalog = _placed_runs(spark, f"{generated}/split={split}", part, root)
        references = jobs.read_language_files(spark, f"{root}/files", split, codes)
        report = jobs.evaluate(spark, references, catalog, f"{root}/out", prefix, most, (M1, M2))
        back = _read_results(spark, f"{root}/out", prefix, report)
        found = back if found is None else found.unionByName(back)
        if split == "test":
            lines = _placed(spark.read.text(f"{root}/out/*/*/generated_predictions.txt"), F.col("value"))
            sums = lines.groupBy("lang", "system").agg(F.count("*").cast("double").alias("lines"), F.sum(F.char_length("value")).cast("double").alias("characters"))
            found = found.unionByName(sums.unpivot(["lang", "system"], ["lines", "characters"], "metric", "value"))
    return found


def _written_runs(spark: SparkSession, predictions: DataFrame, rows: DataFrame, root: str) -> DataFrame:
    """Run files as a generator leaves them, and their catalogue."""
    IO.write_lines(predictions, f"{root}/all", "prediction", ["split_pos"], ["lang", "system"])
    return _placed_runs(spark, f"{root}/all", rows, root)


def _placed_runs(spark: SparkSession, lines: str, rows: DataFrame, root: str) -> DataFrame:
    """The catalogue of the runs below ``root``, whose lines come from the folders by language and system in ``lines``."""
    catalog = run_catalog(rows.select("lang"), fx.languages(spark), f"{root}/runs")
    for r in catalog.collect():  # each run's folder goes where the generator leaves its file
        fs, target = hadoop_path(spark, r["path"])
        fs.mkdirs(target.getParent())
        if not fs.rename(hadoop_path(spark, f"{lines}/lang={r['lang']}/system={r['setting']}")[1], target):
            raise OSError(f"no run for {r['path']}")
    return catalog


def _read_results(spark: SparkSession, out: str, prefix: str, report: DataFrame) -> DataFrame:
    """(lang, system, metric, value) of the result files; their names are those of ``report``."""
    names = [r["metric"] for r in report.select("metric").distinct().collect()]
    schema = ", ".join(f"`{n}` double" for n in names)
    rows = spark.read.schema(schema).option("multiLine", "true").json(f"{out}/*/*/{prefix}_results.json")
    values = [F.col(f"`{n}`") for n in names]
    return _placed(rows, *values).unpivot(["lang", "system"], values, "metric", "value")


def _placed(rows: DataFrame, *columns: F.Column) -> DataFrame:
    """(lang, system, columns...) of a file scan below folders ``<lang>/<system>``."""
    place = F.col("_metadata.file_path")
    return rows.select(*[F.regexp_extract(place, r"/([^/]+)/([^/]+)/[^/]+$", i + 1).alias(c) for i, c in enumerate(("lang", "system"))], *columns)


# ---------------------------------------------------------------- training tables
add_cte("lp_vocab", ["lang_pairs"], f"""
  SELECT token, row_number() OVER (ORDER BY c DESC, token) + 2 AS id FROM (SELECT token, count(*) AS c
    FROM (SELECT unnest(list_concat({split_space('context')}, {split_space('response')})) AS token FROM lang_pairs WHERE split = 'train') GROUP BY token)
""")
add_cte("lp_sides", ["lang_pairs", "lp_vocab"], f"""
  SELECT lang, split, split_pos, pair_id, side, coalesce(list(coalesce(v.id, 2) ORDER BY i) FILTER (i IS NOT NULL), []) AS ids
  FROM (SELECT lang, split, split_pos, pair_id, side, token, i FROM (
      SELECT lang, split, split_pos, pair_id, 'src' AS side, {split_space(_SRC)}[1:47] AS t FROM lang_pairs
      UNION ALL SELECT lang, split, split_pos, pair_id, 'tgt', {split_space(_TGT)}[1:CASE WHEN split = 'train' THEN 23 ELSE 39 END] FROM lang_pairs) x
    LEFT JOIN LATERAL (SELECT unnest(x.t) AS token, generate_subscripts(x.t, 1) AS i) u ON true) y
  LEFT JOIN lp_vocab v USING (token) GROUP BY ALL
""")


@query("job_training_tables", with_ctes("""
SELECT lang, split, pair_id, batch_id, array_to_string(list_concat(a, list_transform(range(wa - len(a)), lambda i: 0)), ' ') AS input_ids,
  len(a) AS n_input, array_to_string(list_concat(b, list_transform(range(wb - len(b)), lambda i: -100)), ' ') AS labels
FROM (SELECT *, CAST(ceil(max(len(a)) OVER w / 8) * 8 AS BIGINT) AS wa, CAST(ceil(max(len(b)) OVER w / 8) * 8 AS BIGINT) AS wb
  FROM (SELECT lang, split, pair_id, split_pos // 16 AS batch_id,
      max(CASE WHEN side = 'src' THEN list_concat(ids, [1]) END) AS a, max(CASE WHEN side = 'tgt' THEN list_concat(ids, [1]) END) AS b
    FROM lp_sides GROUP BY ALL) WINDOW w AS (PARTITION BY lang, split, batch_id))
""", "lp_sides"))
def job_training_tables_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All splits of all languages as batches of model inputs; targets of training are cut at 24 ids, others at 40."""
    pairs = fx.lang_pairs(spark, sf_dir)
    vocab = fx.materialized(spark, sf_dir, "lang_vocab", lambda: build_vocab(pairs.filter("split = 'train'"), ["context", "response"]))
    out = jobs.training_tables(pairs, vocab, "pair_id", max_source=48, max_target=24, max_target_eval=40, prefix="Context:", target_prefix="Response:", masks=(M1, M2))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    return out.select("lang", "split", "pair_id", "batch_id", text("input_ids"),
                      F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_input"), text("labels"))
