"""Ballot and tally queries, and the run catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import human_eval as H
from ..sources.catalog import run_catalog
from . import q_sampling  # noqa: F401  (registers 'test_pairs')
from .oracle_ctes import add_cte, with_ctes
from .registry import query
from .sqltext import WS_SQL

add_cte("ballot_draws", ["test_pairs", "languages"], """
  SELECT lang, draw AS comparison, pos, context, row_number() OVER (PARTITION BY lang, draw ORDER BY pos) AS ord
  FROM (SELECT lp.lang, lp.pos, lp.context, d.draw,
               row_number() OVER (PARTITION BY lp.lang, d.draw
                                  ORDER BY md5(concat_ws('|', '2023', lp.lang, d.draw, CAST(lp.pos AS VARCHAR))), lp.pos) AS rn,
               count(*) OVER (PARTITION BY lp.lang, d.draw) AS n
        FROM test_pairs lp, (VALUES ('fs'), ('mtl')) AS d(draw)
        WHERE lp.lang IN (SELECT lang FROM languages))
  WHERE rn <= 100 AND n >= 100
""")
add_cte("ballots0", ["ballot_draws", "prc"], """
  SELECT d.lang, d.comparison, d.pos AS random_id, d.context,
         CASE WHEN d.pos % 2 = 1 THEN pl.prediction ELSE pr.prediction END AS response_a,
         CASE WHEN d.pos % 2 = 1 THEN pr.prediction ELSE pl.prediction END AS response_b,
         '' AS answer,
         CAST((CASE d.comparison WHEN 'fs' THEN 0 ELSE 1 END) * 100 + d.ord AS BIGINT) AS row_no
  FROM ballot_draws d
  JOIN prc pl ON pl.lang = d.lang AND pl.pos = d.pos AND pl.system = d.comparison
  JOIN prc pr ON pr.lang = d.lang AND pr.pos = d.pos AND pr.system = d.comparison || '_prompt'
""")
add_cte("ballots", ["ballots0"], """
  SELECT * REPLACE (
    CASE WHEN substr(md5(concat_ws('|', lang, comparison, CAST(random_id AS VARCHAR))), 1, 1) IN ('0','1','2','3','4','5') THEN 'A'
         WHEN substr(md5(concat_ws('|', lang, comparison, CAST(random_id AS VARCHAR))), 1, 1) IN ('6','7','8','9','a') THEN ' B '
         WHEN substr(md5(concat_ws('|', lang, comparison, CAST(random_id AS VARCHAR))), 1, 1) IN ('b','c','d') THEN 'Neutral'
         ELSE '' END AS answer)
  FROM ballots0
""")
add_cte("votes", ["ballots"], f"""
  SELECT *, CASE WHEN trim(answer, {WS_SQL}) = 'A' THEN (CASE WHEN random_id % 2 = 1 THEN 'plain' ELSE 'prompt' END)
                 WHEN trim(answer, {WS_SQL}) = 'B' THEN (CASE WHEN random_id % 2 = 1 THEN 'prompt' ELSE 'plain' END)
                 ELSE 'neutral' END AS v
  FROM ballots
""")

TALLY_COLS = """count(*) FILTER (WHERE v = 'plain') AS plain, count(*) FILTER (WHERE v = 'neutral') AS neutral,
  count(*) FILTER (WHERE v = 'prompt') AS prompt, count(*) AS total"""


@query("ballot_build", with_ctes(
    "SELECT lang, comparison, random_id, context, response_a, response_b FROM ballots0", "ballots0"))
def ballot_build_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.ballots(spark, sf_dir, answered=False).select(
        "lang", "comparison", "random_id", "context", "response_a", "response_b")


@query("vote_tally", with_ctes(f"SELECT lang, comparison, {TALLY_COLS} FROM votes GROUP BY lang, comparison", "votes"))
def vote_tally_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.tally(fx.ballots(spark, sf_dir))


@query("vote_tally_positional", with_ctes(f"""
SELECT lang, CASE WHEN row_no <= 100 THEN 'fs' ELSE 'mtl' END AS comparison, {TALLY_COLS}
FROM votes GROUP BY ALL""", "votes"))
def vote_tally_positional_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison is taken from the ballot line number only."""
    b = fx.ballots(spark, sf_dir).drop("comparison")
    return H.tally(H.with_positional_comparison(b))


@query("vote_tally_family", with_ctes(f"""
SELECT l.family, v.comparison, {TALLY_COLS} FROM votes v JOIN languages l USING (lang) GROUP BY ALL
""", "votes", "languages"))
def vote_tally_family_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.tally_by_family(fx.ballots(spark, sf_dir), fx.languages(spark))


@query("run_catalog", with_ctes("""
SELECT l.family, l.lang, s.setting, s.is_prompt,
       CASE s.setting
         WHEN 'fs' THEN 'results/fs ' || lower(l.family) || '/few_shot_' || l.lang || '_10/generated_predictions.txt'
         WHEN 'fs_prompt' THEN 'results/fs ' || lower(l.family) || '/few_shot_' || l.lang || '_10_prompt/generated_predictions.txt'
         WHEN 'mtl' THEN 'results/mtl ' || lower(l.family) || '/multitask_en_' || l.lang || '_10/generated_predictions.txt'
         ELSE 'results/mtl ' || lower(l.family) || '/multitask_en_' || l.lang || '_10_prompt/generated_predictions.txt'
       END AS path
FROM (SELECT DISTINCT lang FROM lang_pairs) d JOIN languages l USING (lang),
     (VALUES ('fs', false), ('fs_prompt', true), ('mtl', false), ('mtl_prompt', true)) AS s(setting, is_prompt)
""", "lang_pairs", "languages"))
def run_catalog_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages found in the data, with their family, times the four settings."""
    langs = fx.lang_pairs(spark, sf_dir).select("lang")
    return run_catalog(langs, fx.languages(spark), "results")


@query("ballot_build_mt19937")
def ballot_build_mt_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 exactly as the reference: two successive Mersenne Twister draws per language, of lines of its test file."""
    lp = fx.lang_pairs(spark, sf_dir).filter("split = 'test'").withColumnsRenamed({"pos": "whole_pos", "split_pos": "pos"})
    lines = lp.select("lang", F.col("whole_pos").alias("pos"), F.col("pos").alias("line"))
    preds = fx.clean_predictions(spark, sf_dir).join(lines, ["lang", "pos"]).drop("pos").withColumnRenamed("line", "pos")
    b = H.build_ballots(lp.drop("whole_pos"), preds, languages=fx.languages(spark), sampler="mt19937")
    return b.select("lang", "comparison", "random_id", "context", "response_a", "response_b")
