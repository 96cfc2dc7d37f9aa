"""Whole jobs over folders: corpora, ballots, tallies and training tables.

Each job joins the operators into what a user of the reference runs as one script.
Paths may lie in any store that Spark reads.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.ids import IGNORE_ID, mask_pad, pad_batches, pad_to, target_max_length
from .functions.text import clean_prediction, prompt_source, prompt_target
from .operators.human_eval import BALLOT_COLUMNS, BALLOT_HEADER, build_ballots, tally, tally_by_family, with_positional_comparison
from .operators.mixing import interleave
from .operators.report import aligned_strictly, metrics_report
from .operators.sampling import DEFAULT_SEED, first_n, sample_k
from .operators.vocab import encode_columns
from .session import hadoop_path, written
from .sources import files as IO
from .sources.catalog import discover_languages, run_catalog
from .sources.csv_split import read_csv_split


#: Plain files from this size on are read by byte ranges in parallel.
SPLIT_BYTES = 64 << 20


def read_language_files(spark: SparkSession, folder: str, suffix: str, languages: Sequence[str]) -> DataFrame:
    """(lang, pos, columns...) of ``folder/<lang>_<suffix>.csv`` of the languages: one scan for all, two where plain files are large."""
    paths = [f"{folder}/{code}_{suffix}.csv" for code in languages]
    if _large_files(spark, paths):
        rows = read_csv_split(spark, paths).withColumnRenamed("file", "__dir")
    else:
        rows = IO.read_positioned(spark, paths, "csv", dir_col="__dir")
    lang = F.regexp_extract("__dir", rf"/([^/_]+)_{suffix}\.csv$", 1)
    return rows.withColumn("lang", lang).drop("__dir")


def _large_files(spark: SparkSession, paths: Sequence[str]) -> bool:
    """Are all of these plain files, and one of them so large that one task should not read it?"""
    found = [fs.getFileStatus(p) for fs, p in (hadoop_path(spark, path) for path in paths)]
    return bool(found) and all(st.isFile() for st in found) and max(st.getLen() for st in found) >= SPLIT_BYTES


def build_corpora(spark: SparkSession, folder: str, out: str, source: str = "en", k: int = 10, seed: int = DEFAULT_SEED,
                  mode: str = "spread", blocklist: Sequence[str] = ("pl",), overwrite: bool = False) -> list[str]:
    """Few-shot sets ``<lang>_fs_<k>.csv`` and multitask sets ``<source>_<lang>_<k>_train.csv`` of every
    language found in ``folder`` (files or folders ``<lang>_train.csv``), written below ``out``.

    Languages with fewer than ``k`` rows get no set. Returns the names written.
    """
    found = [r["lang"] for r in discover_languages(spark, folder, source, blocklist).collect()]
    corpus = read_language_files(spark, folder, "train", [source, *found])
    columns = [c for c in corpus.columns if c not in ("lang", "pos")]
    shots = sample_k(corpus.filter(F.col("lang").isin(found)), k, seed)
    made = IO.write_per_key(shots.select("lang", "shot_ordinal", *columns), f"{out}/few_shot", "lang", f"{{}}_fs_{k}.csv",
                            order=["shot_ordinal"], overwrite=overwrite)
    mixed = interleave(corpus, source, k, seed, mode, key=columns[0], payload=columns[1:], blocklist=blocklist)
    return made + IO.write_per_key(mixed.drop("is_shot"), f"{out}/multitask", "tgt_lang", f"{source}_{{}}_{k}_train.csv",
                                   order=["out_pos"], overwrite=overwrite)


def read_runs(spark: SparkSession, catalog: DataFrame) -> DataFrame:
    """(lang, system, pos, prediction) of the prediction files that the catalogue names, one scan for all."""
    runs = catalog.select("lang", F.col("setting").alias("system"), "path").collect()  # four per language
    lines = IO.read_positioned(spark, [r["path"] for r in runs], "text", dir_col="__dir")
    # the scan reports escaped addresses with scheme and host; both sides are reduced to the plain path
    plain = [hadoop_path(spark, r["path"]) for r in runs]
    of = spark.createDataFrame([(r["lang"], r["system"], fs.makeQualified(p).toUri().getPath()) for r, (fs, p) in zip(runs, plain, strict=True)],
                               "lang string, system string, __at string")
    at = F.url_decode(F.regexp_replace(F.regexp_replace("__dir", r"^[A-Za-z0-9+.-]+:(//[^/]*)?", ""), r"\+", "%2B"))
    # a row for each run, so its broadcast is bounded; the lines stay where they are read
    return lines.withColumn("__at", at).join(F.broadcast(of), "__at").select("lang", "system", "pos", F.col("value").alias("prediction"))


def build_ballots_from_runs(spark: SparkSession, tests: str, root: str, out: str, families: DataFrame, k: int = 100,
                            seed: int = DEFAULT_SEED, context: int = 2, shots: int = 10, source: str = "en", overwrite: bool = False,
                            masks: tuple[str, str] = ("<extra_id_0>", "<extra_id_1>")) -> list[str]:
    """Blinded ballots ``human_eval_<lang>.csv`` below ``out`` from the test files ``<lang>_test.csv`` in ``tests``
    (column ``context`` by position) and the runs below ``root``; ``families`` has lang and family."""
    found = discover_languages(spark, tests, source, ())
    catalog = run_catalog(found, families, root, shots, source)
    languages = [r["lang"] for r in catalog.select("lang").distinct().collect()]
    rows = read_language_files(spark, tests, "test", sorted(languages))
    rows = rows.select("lang", "pos", F.col(rows.columns[context]).alias("context"))
    predictions = read_runs(spark, catalog).withColumn("prediction", clean_prediction(F.col("prediction"), *masks))
    ballots = build_ballots(rows, predictions, k, seed)
    named = ballots.select("lang", "row_no", *[F.col(c).cast("string").alias(h) for c, h in zip(BALLOT_COLUMNS, BALLOT_HEADER, strict=True)])
    return IO.write_per_key(named, out, "lang", "human_eval_{}.csv", order=["row_no"], overwrite=overwrite)


def tally_files(spark: SparkSession, folder: str, block_size: int = 100, families: DataFrame | None = None) -> DataFrame:
    """(lang, comparison, plain, neutral, prompt, total) of the answered ballots ``human_eval_<lang>.csv`` in
    ``folder``; the comparison follows from the line. With ``families`` (lang, family) the tallies are those of
    each family instead, over the languages that have one."""
    rows = IO.read_positioned(spark, f"{folder}/human_eval_*.csv", "csv", dir_col="__dir")
    named = rows.select(F.regexp_extract("__dir", r"human_eval_([^/]+)\.csv$", 1).alias("lang"), (F.col("pos") + 1).alias("row_no"),
                        *[F.col(f"`{h}`").alias(c) for c, h in zip(BALLOT_COLUMNS, BALLOT_HEADER, strict=True)])
    placed = with_positional_comparison(named, block_size)
    return tally(placed) if families is None else tally_by_family(placed, families)


def _encoded_sides(rows: DataFrame, vocab: DataFrame, keys: list[str], max_source: F.Column, max_target: F.Column, prefix: str | None,
                   target_prefix: str | None, masks: tuple[str, str] | None) -> DataFrame:
    """(keys..., __src, __tgt): the ids of the templates around context and response, both looked up in one pass."""
    m1, m2 = masks or (None, None)
    return encode_columns(rows, keys, {"__src": (prompt_source(F.col("context"), prefix, target_prefix, m1, m2), max_source),
                                       "__tgt": (prompt_target(F.col("response"), prefix, target_prefix, m1, m2), max_target)}, vocab)


def training_tables(pairs: DataFrame, vocab: DataFrame, key: str, by: Sequence[str] = ("lang", "split"), pos: str = "split_pos", split: str = "split",
                    max_source: int = 1024, max_target: int = 128, max_target_eval: int | None = None, prefix: str | None = None,
                    target_prefix: str | None = None, masks: tuple[str, str] | None = None, max_samples: Mapping[str, int] | None = None,
                    batch_size: int = 16, multiple: int | None = 8, ignore_pad: bool = True) -> DataFrame:
    """(by..., key, pos, batch_id, input_ids, attention_mask, labels): the model's inputs of all rows of every split, in batches.

    The template is put around context and response and both are encoded and cut; targets of the training split at
    ``max_target``, those of the others at ``max_target_eval`` (default: the same). ``batch_size`` rows that follow each
    other in ``pos`` form a batch, padded to its longest row rounded up to ``multiple``; labels are padded
    with -100, or with the pad id where padding is not to be ignored. ``max_samples`` keeps the
    first rows of the groups of the splits that it names; by default all rows are kept.
    """
    by = list(by)
    rows = pairs
    for name, n in (max_samples or {}).items():
        rows = rows.filter((F.col(split) != name) | (F.col(pos) < n))  # positions begin at 0 in every group
    keys = [*by, key, pos]
    both = _encoded_sides(rows, vocab, keys, F.lit(max_source), target_max_length(F.col(split), max_target, max_target_eval), prefix, target_prefix, masks)
    padded = pad_batches(both, "__src", pos, batch_size, multiple, out="input_ids", by=by)
    padded = pad_batches(padded.withColumnRenamed("padded_len", "__width"), "__tgt", pos, batch_size, multiple, IGNORE_ID if ignore_pad else 0, "labels", by)
    seen = F.concat(F.transform("__src", lambda x: F.lit(1).cast("long")), F.array_repeat(F.lit(0).cast("long"), (F.col("__width") - F.size("__src")).cast("int")))
    return padded.select(*keys, "batch_id", "input_ids", seen.alias("attention_mask"), "labels")


def evaluate(spark: SparkSession, references: DataFrame, runs: DataFrame, out: str, prefix: str = "predict", max_samples: int | None = None,
             masks: tuple[str, str] = ("<extra_id_0>", "<extra_id_1>"), overwrite: bool = False) -> DataFrame:
    """Metrics of runs against test files, and the files that an evaluation leaves: returns (lang, system, metric, value).

    ``references`` has lang, pos and response, as ``read_language_files`` reads them; ``runs`` is a catalogue (lang, setting, path) of
    generated lines. Predictions and labels are freed of mask tokens and outer white space and aligned
    by position; a prediction without a label is an error. ``max_samples`` takes the first rows of each language.
    Below ``out/<lang>/<setting>`` go ``<prefix>_results.json`` and ``generated_predictions.txt``, the
    cleaned predictions; the number of rows is reported as ``<prefix>_samples``.
    """
    first = lambda df: df if max_samples is None else df.filter(F.col("pos") < max_samples)
    labels = first(references).select("lang", "pos", clean_prediction(F.col("response"), *masks).alias("response"))
    # read from the files once: metrics, samples and lines all use it
    lines = written(first(read_runs(spark, runs)).withColumn("prediction", clean_prediction(F.col("prediction"), *masks)), "evaluated-runs", "zstd")
    scored = aligned_strictly(lines, labels, ["lang", "pos"], "response")
    report = metrics_report(lines, scored, ["lang", "system"], ["pos"], reference="response")
    report = written(report.select("lang", "system", F.concat(F.lit(f"{prefix}_"), F.regexp_replace("metric", "^distinct_", "distinct-")).alias("metric"), "value"), "evaluation")
    found: dict[tuple[str, str], dict[str, float]] = {}
    for r in report.collect():  # seven numbers for each run
        found.setdefault((r["lang"], r["system"]), {})[r["metric"]] = r["value"]
    for (lang, system), values in found.items():
        IO.write_small(spark, f"{out}/{lang}/{system}/{prefix}_results.json", json.dumps(values, indent=4, sort_keys=True), overwrite)
    run = F.concat_ws("/", "lang", "system")
    IO.single_line_files(lines.withColumn("__run", run), "prediction", "__run", ["pos"],
                         {f"{lang}/{system}": f"{out}/{lang}/{system}/generated_predictions.txt" for lang, system in found}, f"{out}/lines", overwrite)
    return report


def preprocess(pairs: DataFrame, vocab: DataFrame, keys: Sequence[str], max_source: int = 1024, max_target: int = 128, prefix: str | None = None,
               target_prefix: str | None = None, masks: tuple[str, str] | None = None, max_samples: int | None = None,
               order: Sequence[str] = (), by: Sequence[str] = (), pad: bool = True) -> DataFrame:
    """(keys..., input_ids, attention_mask, labels): the template put around context and response, both
    encoded, cut, padded to full length, and padding masked in the labels.

    ``max_samples`` keeps the first rows in ``order`` of each group ``by`` before anything is encoded.
    """
    keys = list(keys)
    rows = pairs if max_samples is None else first_n(pairs, max_samples, list(by), list(order))
    both = _encoded_sides(rows, vocab, keys, F.lit(max_source), F.lit(max_target), prefix, target_prefix, masks)
    ones = F.transform("__src", lambda x: F.lit(1).cast("long"))
    if not pad:
        return both.select(*keys, F.col("__src").alias("input_ids"), ones.alias("attention_mask"), F.col("__tgt").alias("labels"))
    return both.select(*keys, pad_to("__src", max_source).alias("input_ids"), pad_to(ones, max_source).alias("attention_mask"),
                       mask_pad(pad_to("__tgt", max_target)).alias("labels"))
