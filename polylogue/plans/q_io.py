"""Source/sink round trips, split loading, language discovery and the batch-apply surface.

Each round trip writes below the shared checkpoint folder, then reads the files
back; the returned DataFrame is the read side.
"""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import human_eval as H
from ..operators.apply import Reversed, apply_generator, batched_map, cached_table, generate_resumable
from ..operators.mixing import interleave
from ..session import scratch_path
from ..sources import files as IO
from ..sources.catalog import discover_languages
from ..sources.csv_split import read_csv_split
from .oracle_ctes import with_ctes
from .q_human import ballot_build_query  # noqa: F401  (registers the ballot CTEs)
from .q_sampling import _interleave_sql  # noqa: F401  (also registers 'shots')
from .registry import query
from .sqltext import split_ws


@query("positional_select", with_ctes("SELECT pair_id, context FROM dialogue_pairs", "dialogue_pairs"))
def positional_select_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by position (0 and 3)."""
    dp = fx.dialogue_pairs(spark, sf_dir)
    return dp.select(dp.columns[0], dp.columns[3])


@query("csv_roundtrip", with_ctes("SELECT pair_id, context, response FROM dialogue_pairs", "dialogue_pairs"))
def csv_roundtrip_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-line, quoted cells survive a write and a read unchanged."""
    path = scratch_path(spark, "csv_roundtrip")
    IO.write_csv(fx.dialogue_pairs(spark, sf_dir).select("pair_id", "context", "response"), path)
    back = IO.read_csv(spark, path)
    return back.select("pair_id", "context", "response")


@query("overwrite_guard", with_ctes("SELECT pair_id, context, response FROM lang_pairs WHERE split = 'test'", "lang_pairs"))
def overwrite_guard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: an output that exists is refused, and replaced only on request."""
    path = scratch_path(spark, "guard")
    lp = fx.lang_pairs(spark, sf_dir).select("split", "pair_id", "context", "response")
    test = lp.filter("split = 'test'").drop("split")
    IO.write_csv(lp.filter("split <> 'test'").drop("split"), path)
    try:
        IO.write_csv(test, path)
    except AnalysisException:
        IO.write_csv(test, path, overwrite=True)
        return IO.read_csv(spark, path)
    raise AssertionError("an existing output was overwritten")


@query("column_check", with_ctes("SELECT pair_id, context, response FROM lang_pairs", "lang_pairs"))
def column_check_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named columns are there; one that is not is refused."""
    lp = fx.lang_pairs(spark, sf_dir)
    IO.require_columns(lp, "context", "response")
    try:
        IO.require_columns(lp, "context", "summary")
    except ValueError:
        return lp.select("pair_id", "context", "response")
    raise AssertionError("an absent column was accepted")


@query("cached_table", with_ctes("""
SELECT split, pair_id FROM lang_pairs WHERE split IN ('train', 'test')
""", "lang_pairs"))
def cached_table_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One copy per plan below one path; asked again, a plan gets its own copy."""
    path = scratch_path(spark, "cache")
    lp = fx.lang_pairs(spark, sf_dir).select("split", "pair_id")
    first = cached_table(spark, lp.filter("split = 'train'"), path)
    other = cached_table(spark, lp.filter("split = 'test'"), path)
    again = cached_table(spark, lp.filter("split = 'train'"), path)
    if first.inputFiles() != again.inputFiles():
        raise AssertionError("a copy was made twice")
    return again.unionByName(other)


@query("predictions_roundtrip", with_ctes("""
SELECT lang, system, pos, regexp_replace(prediction, '\\r\\n|\\r|\\n', ' ', 'g') AS prediction FROM prc
""", "prc"))
def predictions_roundtrip_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction per line in position order, read back with positions."""
    path = scratch_path(spark, "predictions")
    by = ["lang", "system"]
    IO.write_lines(fx.clean_predictions(spark, sf_dir), path, "prediction", order=["pos"], by=by)
    return IO.read_lines(spark, path, by=by).select("lang", "system", "pos", F.col("line").alias("prediction"))


@query("interleave_roundtrip", with_ctes(
    "SELECT tgt_lang, out_pos, pair_id FROM (" + _interleave_sql("train_pairs", "pair_id", "spread") + ")",
    "train_pairs"))
def interleave_roundtrip_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: one CSV per target named ``en_<tgt>_10_train.csv``, rows in output
    order; read back, the line position is the output position."""
    path = scratch_path(spark, "multitask")
    mixed = interleave(fx.train_pairs(spark, sf_dir), "en", 10, mode="spread", key="pair_id",
                       payload=["context", "response"])
    IO.write_per_key(mixed.drop("is_shot"), path, "tgt_lang", "en_{}_10_train.csv", order=["out_pos"])
    back = IO.read_positioned(spark, f"{path}/*", "csv", dir_col="__dir")
    return back.select(F.regexp_extract("__dir", r"en_([^_/]+)_10_train\.csv$", 1).alias("tgt_lang"),
                       F.col("pos").alias("out_pos"), "pair_id")


@query("ballot_roundtrip", with_ctes(
    "SELECT lang, comparison, random_id, response_a, response_b FROM ballots0", "ballots0"))
def ballot_roundtrip_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: ballots with the reference header, one file per language, comparison
    blocks in line order; the comparison is recovered from the line number."""
    path = scratch_path(spark, "ballots")
    b = fx.ballots(spark, sf_dir, answered=False)
    out = b.select("lang", "row_no", *[F.col(c).cast("string").alias(h)
                                        for c, h in zip(H.BALLOT_COLUMNS, H.BALLOT_HEADER)])
    IO.write_csv(IO.ordered(out, ["lang"], ["row_no"]).drop("row_no"), path, partition_by=["lang"])
    back = IO.read_positioned(spark, path, "csv", by=["lang"])
    return back.select(
        F.col("lang").cast("string").alias("lang"),
        F.when(F.col("pos") < 100, "fs").otherwise("mtl").alias("comparison"),
        F.col(H.BALLOT_HEADER[0]).cast("long").alias("random_id"),
        F.col(H.BALLOT_HEADER[2]).alias("response_a"), F.col(H.BALLOT_HEADER[3]).alias("response_b"))


@query("load_splits", with_ctes("""
SELECT split, pair_id, context, response, CASE WHEN split = 'test' THEN lang ELSE '' END AS lang FROM lang_pairs
""", "lang_pairs"))
def load_splits_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: train and test as CSV, validation as JSON, loaded into one table. Only the
    test file has a language column; its cells are empty elsewhere."""
    root = scratch_path(spark, "splits")
    lp = fx.lang_pairs(spark, sf_dir).select("split", "pair_id", "context", "response", "lang")
    files = {"train": f"{root}/train.csv", "validation": f"{root}/validation.json", "test": f"{root}/test.csv"}
    for split, p in files.items():
        part = lp.filter(F.col("split") == split).drop("split", *([] if split == "test" else ["lang"]))
        if p.endswith(".json"):
            part.write.json(p)
        else:
            IO.write_csv(part, p)
    schema = "pair_id string, context string, response string"
    return IO.load_splits(spark, files, schema).select("split", "pair_id", "context", "response", "lang")


@query("lang_catalog", with_ctes("""
SELECT DISTINCT lang FROM lang_pairs WHERE split = 'train' AND lang NOT IN ('en', 'pl')
""", "lang_pairs"))
def lang_catalog_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages from file names ``<lang>_train.csv``, without source and block list."""
    root = scratch_path(spark, "corpus")
    lp = fx.lang_pairs(spark, sf_dir).filter(F.col("split") == "train").select("lang", "context", "response")
    IO.write_per_key(lp, root, "lang", "{}_train.csv")
    return discover_languages(spark, root, "en", ["pl"])


def _lengths(pdf: pd.DataFrame) -> pd.DataFrame:
    text = pdf["response"].fillna("")
    return pd.DataFrame({"pair_id": pdf["pair_id"], "n_chars": text.str.len().astype("int64"),
                         "n_tokens": text.map(lambda t: len(t.split())).astype("int64")})


@query("batched_map", with_ctes(f"""
SELECT pair_id, CAST(length(response) AS BIGINT) AS n_chars, CAST(len({split_ws('response')}) AS BIGINT) AS n_tokens
FROM dialogue_pairs""", "dialogue_pairs"))
def batched_map_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user function over Arrow batches adds character and token counts."""
    dp = fx.dialogue_pairs(spark, sf_dir)
    return batched_map(dp, _lengths, "pair_id string, n_chars long, n_tokens long", ["pair_id", "response"])


@query("apply_generator", with_ctes(f"""
SELECT pair_id, array_to_string(list_reverse({split_ws('context')}), ' ') AS prediction
FROM lang_pairs WHERE split = 'test'""", "lang_pairs"))
def apply_generator_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generator built once per task runs over the test split in batches."""
    test = fx.lang_pairs(spark, sf_dir).filter(F.col("split") == "test")
    return apply_generator(test, Reversed, "context", ["pair_id"], num_beams=4)


@query("few_shot_roundtrip", with_ctes("SELECT lang, shot_ordinal - 1 AS pos, pair_id FROM shots", "shots"))
def few_shot_roundtrip_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: the k-shot sample of every language as ``<lang>_fs_10.csv`` in position
    order (one distributed write), read back with line positions."""
    from ..operators.sampling import sample_k

    path = scratch_path(spark, "fs")
    shots = sample_k(fx.train_pairs(spark, sf_dir), 10).select("lang", "shot_ordinal", "pair_id", "context", "response")
    IO.write_per_key(shots, path, "lang", "{}_fs_10.csv", order=["shot_ordinal"])
    back = IO.read_positioned(spark, f"{path}/*", "csv", dir_col="__dir")
    return back.select(F.regexp_extract("__dir", r"/([^/_]+)_fs_10\.csv$", 1).alias("lang"), "pos", "pair_id")


@query("csv_split_scan", with_ctes("SELECT pair_id, context, response FROM dialogue_pairs", "dialogue_pairs"))
def csv_split_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted cells with line breaks, read by byte ranges in parallel."""
    path = scratch_path(spark, "csv_split")
    IO.write_csv(fx.dialogue_pairs(spark, sf_dir).select("pair_id", "context", "response"), path)
    return read_csv_split(spark, path).select("pair_id", "context", "response")


@query("single_file_output", with_ctes("""
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY pos) - 1 AS pos, pair_id, context, response FROM train_pairs
""", "train_pairs"))
def single_file_output_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1-K3: one CSV file ``<lang>_train.csv`` per language, read back by byte ranges with record numbers."""
    root = scratch_path(spark, "single_files")
    train = fx.train_pairs(spark, sf_dir).select("lang", "pos", "pair_id", "context", "response")
    names = IO.single_files(train, root, "lang", "{}_train.csv", ["pos"])
    back = read_csv_split(spark, [f"{root}/{n}" for n in names])
    return back.select(F.regexp_extract("file", r"/([^/_]+)_train\.csv$", 1).alias("lang"), "pos", "pair_id", "context", "response")


@query("overwrite_staged", with_ctes("""
SELECT 'kept' AS state, pair_id, response FROM lang_pairs WHERE split = 'train'
UNION ALL SELECT 'replaced', pair_id, response FROM lang_pairs WHERE split = 'test'
""", "lang_pairs"))
def overwrite_staged_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rewrite that fails midway leaves the old output; one that does not replaces it."""
    path = scratch_path(spark, "staged")
    lp = fx.lang_pairs(spark, sf_dir).select("split", "pair_id", "response")
    train, test = (lp.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
    IO.write_csv(train, path)
    broken = test.withColumn("response", F.when(F.xxhash64("pair_id") % 50 == 0, F.raise_error(F.lit("stopped midway"))).otherwise(F.col("response")))
    try:
        IO.write_csv(broken.unionByName(train.limit(0)), path, overwrite=True)
    except Exception as e:  # the kind of error depends on where the task stopped
        if "stopped midway" not in str(e):
            raise
    kept = scratch_path(spark, "staged-kept")
    IO.read_csv(spark, path).write.parquet(kept)
    IO.write_csv(test, path, overwrite=True)
    columns = ["pair_id", "response"]
    return (spark.read.parquet(kept).select(F.lit("kept").alias("state"), *columns)
            .unionByName(IO.read_csv(spark, path).select(F.lit("replaced").alias("state"), *columns)))


class _Stops(Reversed):
    """Fails on the texts of some rows, as a lost machine would."""

    def __call__(self, texts, num_beams=None):
        if any(len(t) % 17 == 5 for t in texts):
            raise RuntimeError("stopped midway")
        return super().__call__(texts, num_beams)


@query("generate_resume", with_ctes(f"""
SELECT pair_id, array_to_string(list_reverse({split_ws('context')}), ' ') AS prediction, CAST(1 AS BIGINT) AS times
FROM lang_pairs WHERE split = 'test'""", "lang_pairs"))
def generate_resume_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a run that stops midway a second one generates the rest; every row is there once."""
    path = scratch_path(spark, "generated")
    test = fx.lang_pairs(spark, sf_dir).filter(F.col("split") == "test")
    generate_resumable(test.filter("lang = 'de'"), Reversed, "context", ["pair_id"], path, ranges=4)
    try:
        generate_resumable(test, _Stops, "context", ["pair_id"], path, ranges=4)
    except Exception as e:
        if "stopped midway" not in str(e):
            raise
    rows = generate_resumable(test, Reversed, "context", ["pair_id"], path, ranges=4)
    return rows.groupBy("pair_id").agg(F.max("prediction").alias("prediction"), F.count("*").alias("times"))
