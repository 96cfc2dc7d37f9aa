"""Metric queries: distinct-n, BLEU (all options), metric report, best run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import bleu as B
from ..operators.distinct import ERROR, distinct_from_sketches, distinct_n, merged_sketches, ngram_sketches
from ..functions.text import clean_prediction
from ..functions.token_spans import prepared
from ..operators.report import aligned_strictly, best_run, metrics_report, write_metrics
from ..operators.user_metric import aggregate_metric
from ..session import scratch_path, written
from ..sources.buckets import bucketed, co_located
from . import bleu_sql as BS
from .oracle_ctes import add_cte, with_ctes
from .registry import query
from .sqltext import ngram_list, r6, split_ws, strip_masks, strip_ws, tokenize


def _r6(df: DataFrame, cols) -> DataFrame:
    return df.select(*[F.round(F.col(c), 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def _text_rows(spark: SparkSession, sf_dir: str, refs=("response",), split: str | None = None) -> DataFrame:
    """Every prediction of (lang, system, pos) with the reference texts ``__refs`` of (lang, pos). With ``split``
    only that split is evaluated; else a prediction without a reference is an error."""
    lp = _cleaned(fx.lang_pairs(spark, sf_dir))
    if split:
        lp = lp.filter(F.col("split") == split)
    ref = lp.select("lang", "pos", F.array(*refs).alias("__refs"))
    # both sides cross the join as text, several times smaller than token arrays
    prc = fx.clean_predictions(spark, sf_dir)
    return prc.join(ref, ["lang", "pos"]) if split else aligned_strictly(prc, ref, ["lang", "pos"], "__refs")


def _cleaned(pairs: DataFrame) -> DataFrame:
    """Labels are cleaned as predictions are: mask tokens and outer white space go."""
    return pairs.withColumns({c: clean_prediction(F.col(c), fx.MASK1, fx.MASK2) for c in ("context", "response")})


def _stats(spark: SparkSession, sf_dir: str, lowercase: bool = False, **kw) -> DataFrame:
    return B.bleu_stats(_text_rows(spark, sf_dir, **kw), ["lang", "system"], ["pos"], references="__refs", lowercase=lowercase)


def _scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned predictions aligned with the reference response of the same (lang, pos)."""
    lp = fx.lang_pairs(spark, sf_dir)
    prc = fx.clean_predictions(spark, sf_dir, lp)
    return aligned_strictly(prc, _cleaned(lp).select("lang", "pos", "context", "response"), ["lang", "pos"], "response")


# ---------------------------------------------------------------- distinct-n
add_cte("prc_tok", ["prc"], f"""
  SELECT lang, system, pos, list_filter({split_ws('prediction')}, lambda t: t <> '▁') AS t FROM prc
""")
DISTINCT_SQL = with_ctes(f"""
SELECT lang, system,
  {r6("100.0 * count(DISTINCT gram) FILTER (WHERE n = 1) / nullif(count(*) FILTER (WHERE n = 1), 0)")} AS distinct_1,
  {r6("100.0 * count(DISTINCT gram) FILTER (WHERE n = 2) / nullif(count(*) FILTER (WHERE n = 2), 0)")} AS distinct_2
FROM (SELECT lang, system, 1 AS n, unnest(t) AS gram FROM prc_tok
      UNION ALL SELECT lang, system, 2 AS n, unnest({ngram_list('t', 2)}) AS gram FROM prc_tok)
GROUP BY lang, system
""", "prc_tok")


def distinct_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prc = fx.clean_predictions(spark, sf_dir)
    return _r6(distinct_n(prc, ["lang", "system"]), {"distinct_1", "distinct_2"})


query("distinct_n", DISTINCT_SQL)(distinct_query)


# ---------------------------------------------------------------- BLEU
def _rows_cte(name: str, tok: str = "13a", lower: bool = False, multi: bool = False, split: str | None = None):
    label = {c: strip_ws(strip_masks(f"l.{c}", fx.MASK1, fx.MASK2)) for c in ("response", "context")}
    refs = (f"[{tokenize(label['response'], tok, lower)}, {tokenize(label['context'], tok, lower)}]" if multi
            else f"[{tokenize(label['response'], tok, lower)}]")
    where = f"WHERE l.split = '{split}'" if split else ""
    add_cte(name, ["prc", "lang_pairs"], f"""
      SELECT p.lang, p.system, p.pos, {tokenize('p.prediction', tok, lower)} AS h, {refs} AS refs
      FROM prc p JOIN lang_pairs l ON l.lang = p.lang AND l.pos = p.pos {where}
    """)


_rows_cte("bl_rows")
BLEU_STATS_SQL = with_ctes(
    "SELECT * FROM " + BS.stats_sql("bl_rows", ["lang", "system"], ["pos"]), "bl_rows")


@query("bleu_stats", BLEU_STATS_SQL)
def bleu_stats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir)


SCORE_COLS = ["score", "p1", "p2", "p3", "p4", "bp"]
BLEU_CORPUS_SQL = with_ctes(
    f"SELECT lang, system, {BS.score_select(SCORE_COLS)} FROM "
    + BS.stats_sql("bl_rows", ["lang", "system"], ["pos"]), "bl_rows")


@query("bleu_corpus", BLEU_CORPUS_SQL)
def bleu_corpus_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3 through the whole metric, with ``force`` (F19) set."""
    out = B.corpus_bleu(_text_rows(spark, sf_dir), ["lang", "system"], ["pos"], references="__refs", force=True, keep_stats=False)
    return _r6(out, set(SCORE_COLS))


SMOOTHINGS = [("none", None), ("floor", None), ("add-k", None), ("exp", None)]
BLEU_SMOOTH_SQL = with_ctes(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{m}' AS smooth_method, lang, system, {BS.score_select(['score'], smooth_method=m, smooth_value=v)} "
        f"FROM " + BS.stats_sql("bl_rows", ["lang", "system"], ["pos"]) for m, v in SMOOTHINGS) + ")",
    "bl_rows")


@query("bleu_smoothing", BLEU_SMOOTH_SQL)
def bleu_smoothing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four smoothing methods scored from one statistics table (one pass)."""
    stats = _stats(spark, sf_dir)
    per = F.array(*[F.struct(F.lit(m).alias("smooth_method"),
                             F.round(B.score_columns(m, v)["score"], 6).alias("score")) for m, v in SMOOTHINGS])
    return stats.select("lang", "system", F.explode(per).alias("x")).select(
        "x.smooth_method", "lang", "system", "x.score")


add_cte("dp_rows", ["dialogue_pairs"], f"""
  SELECT pair_id, {tokenize('context')} AS h, [{tokenize('response')}] AS refs FROM dialogue_pairs
""")
BLEU_SENTENCE_SQL = with_ctes(
    f"SELECT pair_id, {BS.score_select(['score'], smooth_method='exp', use_effective_order=True)} FROM "
    + BS.stats_sql("dp_rows", ["pair_id"], []), "dp_rows")


@query("bleu_sentence", BLEU_SENTENCE_SQL)
def bleu_sentence_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence-level BLEU: every pair is its own group, effective order on."""
    dp = fx.dialogue_pairs(spark, sf_dir)
    out = B.sentence_bleu(dp, ["pair_id"], "context", "response")
    return out.select("pair_id", F.round("score", 6).alias("score"))


_rows_cte("bl_rows_multi", multi=True)
BLEU_MULTI_SQL = with_ctes(
    f"SELECT lang, system, {BS.score_select(['score'])}, ref_len FROM "
    + BS.stats_sql("bl_rows_multi", ["lang", "system"], ["pos"]), "bl_rows_multi")


@query("bleu_multi_ref", BLEU_MULTI_SQL)
def bleu_multi_ref_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.bleu_score(_stats(spark, sf_dir, refs=("response", "context")), keep_stats=True)
    return out.select("lang", "system", F.round("score", 6).alias("score"), "ref_len")


_rows_cte("bl_rows_lower", lower=True)
BLEU_LOWER_SQL = with_ctes(
    f"SELECT lang, system, {BS.score_select(['score'])} FROM "
    + BS.stats_sql("bl_rows_lower", ["lang", "system"], ["pos"]), "bl_rows_lower")


@query("bleu_lowercase", BLEU_LOWER_SQL)
def bleu_lowercase_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.bleu_score(_stats(spark, sf_dir, lowercase=True))
    return out.select("lang", "system", F.round("score", 6).alias("score"))


BLEU_TOKENIZERS = ["none", "13a", "intl", "char", "zh"]
for _t in BLEU_TOKENIZERS:
    _rows_cte(f"bl_rows_{_t}", tok=_t)
BLEU_TOK_SQL = with_ctes(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{t}' AS tokenizer, lang, system, {BS.score_select(['score'])} FROM "
        + BS.stats_sql(f"bl_rows_{t}", ["lang", "system"], ["pos"]) for t in BLEU_TOKENIZERS) + ")",
    *[f"bl_rows_{t}" for t in BLEU_TOKENIZERS])


@query("bleu_tokenizers", BLEU_TOK_SQL)
def bleu_tokenizers_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """five tokenisers over one join of the texts."""
    # the references move before the rules of intl run over them, and before each meets the outputs of every system
    ref = _cleaned(fx.lang_pairs(spark, sf_dir)).select("lang", "pos", F.array("response").alias("__refs")).repartition("lang", "pos")
    ref = ref.withColumn("__intl", F.transform("__refs", lambda r: prepared(r, "intl")))
    rows = fx.clean_predictions(spark, sf_dir).join(ref, ["lang", "pos"])
    out = B.bleu_score(B.bleu_stats(rows, ["lang", "system"], ["pos"], references="__refs", tokenize=BLEU_TOKENIZERS, made={"intl": "__intl"}))
    return out.select("tokenizer", "lang", "system", F.round("score", 6).alias("score"))


REF_CHECK_SQL = with_ctes("""
SELECT lang, CAST(min(k) AS BIGINT) AS min_refs, CAST(max(k) AS BIGINT) AS max_refs, min(k) = max(k) AS is_valid
FROM (SELECT lang, CASE WHEN lang <> 'en' AND line_pos % 2 = 1 THEN 2 ELSE 1 END AS k FROM lang_pairs)
GROUP BY lang
""", "lang_pairs")


@query("reference_count_check", REF_CHECK_SQL)
def reference_count_check_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16 on lists with a second reference at odd lines, but for one language."""
    lp = fx.lang_pairs(spark, sf_dir)
    two = (F.col("lang") != "en") & (F.col("line_pos") % 2 == 1)
    refs = lp.select("lang", F.when(two, F.array("response", "context")).otherwise(F.array("response")).alias("references"))
    return B.check_reference_counts(refs, "references", ["lang"])


# ---------------------------------------------------------------- report
def metrics_sql(prc: str, tokens: str, rows: str) -> str:
    """The metric table over cleaned predictions, their tokens, and rows with the tokens of prediction and references."""
    return f"""
SELECT lang, system, metric, value FROM (
  SELECT s.lang, s.system, d.distinct_1, d.distinct_2, b.score AS sacrebleu_score, b.p1 AS sacrebleu_1,
         b.p2 AS sacrebleu_2, b.bp AS sacrebleu_bp, CAST(s.samples AS DOUBLE) AS samples
  FROM (SELECT lang, system, count(*) AS samples FROM {prc} GROUP BY ALL) s
  JOIN (SELECT lang, system, {BS.score_select(['score', 'p1', 'p2', 'bp'])}
        FROM {BS.stats_sql(rows, ["lang", "system"], ["pos"])}) b USING (lang, system)
  LEFT JOIN (SELECT lang, system,
          {r6("100.0 * count(DISTINCT gram) FILTER (WHERE n = 1) / nullif(count(*) FILTER (WHERE n = 1), 0)")} AS distinct_1,
          {r6("100.0 * count(DISTINCT gram) FILTER (WHERE n = 2) / nullif(count(*) FILTER (WHERE n = 2), 0)")} AS distinct_2
        FROM (SELECT lang, system, 1 AS n, unnest(t) AS gram FROM {tokens}
              UNION ALL SELECT lang, system, 2 AS n, unnest({ngram_list('t', 2)}) AS gram FROM {tokens})
        GROUP BY lang, system) d USING (lang, system)
) UNPIVOT INCLUDE NULLS (value FOR metric IN (distinct_1, distinct_2, sacrebleu_score, sacrebleu_1, sacrebleu_2,
                               sacrebleu_bp, samples))
"""


METRICS_SQL = with_ctes(metrics_sql("prc", "prc_tok", "bl_rows"), "prc_tok", "bl_rows")


@query("metrics_report", METRICS_SQL)
def metrics_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prc = fx.clean_predictions(spark, sf_dir)
    return metrics_report(prc, _text_rows(spark, sf_dir), ["lang", "system"], ["pos"], reference="__refs")


_rows_cte("bl_rows_val", split="validation")
BEST_RUN_SQL = with_ctes(f"""
SELECT lang, arg_min(system, (-score, system)) AS system, max(score) AS score
FROM (SELECT lang, system, {BS.score_select(['score'])}
      FROM {BS.stats_sql("bl_rows_val", ["lang", "system"], ["pos"])})
GROUP BY lang
""", "bl_rows_val")


@query("best_run", BEST_RUN_SQL)
def best_run_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language, the system with the best validation BLEU (ties: system name)."""
    scores = B.bleu_score(_stats(spark, sf_dir, split="validation"))
    scores = scores.select("lang", "system", F.round("score", 6).alias("score"))
    return best_run(scores, ["lang"], "system", "score")


METRIC_FILES_SQL = ("SELECT lang, system, prefix || '_' || metric AS metric, value FROM ("
                    + METRICS_SQL + ") m, (VALUES ('train'), ('eval'), ('predict')) AS p(prefix)")


@query("metrics_files", METRIC_FILES_SQL)
def metrics_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: the metric table, made once, saved as JSON lines under each of the three prefixes, read back."""
    path = scratch_path(spark, "metrics")
    metrics_report_query(spark, sf_dir).write.parquet(f"{path}/all")
    report = spark.read.parquet(f"{path}/all")
    prefixes = ("train", "eval", "predict")
    for prefix in prefixes:
        write_metrics(report, f"{path}/{prefix}_results.json", prefix)
    back = spark.read.schema("lang string, system string, metric string, value double").json([f"{path}/{p}_results.json" for p in prefixes])
    return back.select("lang", "system", "metric", "value")


# ---------------------------------------------------------------- stored sketches, user metrics, co-located joins
@query("distinct_n_sketch", with_ctes(f"""
SELECT lang, system, n, count(*) AS total, TRUE AS within
FROM (SELECT lang, system, 1 AS n, unnest(t) AS gram FROM prc_tok UNION ALL SELECT lang, system, 2, unnest({ngram_list('t', 2)}) FROM prc_tok)
GROUP BY lang, system, n
""", "prc_tok"))
def distinct_n_sketch_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 from stored sketches of parts, one of which comes twice; ``within``: the estimate is within ERROR of the exact count."""
    prc = fx.clean_predictions(spark, sf_dir).withColumn("part", F.pmod("pos", F.lit(4)))
    keys = ["lang", "system"]
    early = written(ngram_sketches(prc.filter("part < 3"), keys, "part"), "sketches")
    stored = written(merged_sketches(early, ngram_sketches(prc.filter("part >= 2"), keys, "part"), keys, "part"), "sketches")
    exact = distinct_n(prc, keys)
    found = distinct_from_sketches(stored, keys).join(exact, keys)
    share = F.when(F.col("n") == 1, F.col("distinct_1")).otherwise(F.col("distinct_2"))
    unique = F.round(share * F.col("total") / 100)
    return found.select(*keys, "n", "total", (F.abs(F.col("estimate") - unique) <= F.greatest(ERROR * unique, F.lit(1.0))).alias("within"))


class LengthRatio:
    """A metric as a user writes it: words of a prediction against words of its reference, per row and over all, and the longest prediction."""

    def init(self):
        return (0, 0.0, 0, 0, 0)

    def update(self, state, rows):
        said = [len(t.split(" ")) for t in rows.column("prediction").to_pylist()]
        wanted = [len(t.split(" ")) for t in rows.column("response").to_pylist()]
        ratios = sum(a / b for a, b in zip(said, wanted, strict=True))
        return self.merge(state, (len(said), ratios, sum(said), sum(wanted), max(said)))

    def merge(self, a, b):
        return (a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] + b[3], max(a[4], b[4]))

    def finish(self, state):
        n, ratios, said, wanted, longest = state
        return {"mean_ratio": ratios / n, "total_ratio": said / wanted, "longest": longest, "samples": n}


@query("metric_user_defined", with_ctes(f"""
SELECT lang, system, {r6('avg(a / b)')} AS mean_ratio, {r6('sum(a) / sum(b)')} AS total_ratio, max(a)::DOUBLE AS longest, count(*)::DOUBLE AS samples
FROM (SELECT p.lang, p.system, len(string_split(p.prediction, ' '))::DOUBLE AS a, len(string_split({strip_ws(strip_masks('l.response', fx.MASK1, fx.MASK2))}, ' '))::DOUBLE AS b
  FROM prc p JOIN lang_pairs l ON l.lang = p.lang AND l.pos = p.pos)
GROUP BY lang, system
""", "prc", "lang_pairs"))
def metric_user_defined_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's aggregate by language and system, merged in a tree."""
    out = aggregate_metric(_scored_rows(spark, sf_dir), ["lang", "system"], ["prediction", "response"], LengthRatio(), ["mean_ratio", "total_ratio", "longest", "samples"])
    return _r6(out, {"mean_ratio", "total_ratio"})


@query("metrics_copartitioned", BLEU_CORPUS_SQL)
def metrics_copartitioned_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU over predictions and references that lie in buckets of (lang, pos), joined without an exchange."""
    rows = _copartitioned_rows(spark, sf_dir)
    out = B.corpus_bleu(rows, ["lang", "system"], ["pos"], references="__refs", keep_stats=False)
    return _r6(out, set(SCORE_COLS))


def _copartitioned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    on, buckets = ["lang", "pos"], 32
    ref = bucketed(_cleaned(fx.lang_pairs(spark, sf_dir)).select(*on, F.array("response").alias("__refs")), on, buckets, "references")
    prc = bucketed(fx.clean_predictions(spark, sf_dir), on, buckets, "predictions")
    return co_located(prc, ref, on)
