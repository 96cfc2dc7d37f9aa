"""The queries of the operators, with their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polylogue.session import scratch_path

from . import (
    arc_warc,
    byte_bpe,
    chunk_dedup,
    decontaminate,
    extendible_shards,
    jaccard_join,
    line_templates,
    qdwh_whitening,
    quality_ftrl,
    quote_threads,
    secret_crf,
    spelling_variants,
    toxicity,
)
from .common import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_decontaminate")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and test item it holds a passage of."""
    return decontaminate.aligned_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op2_line_templates", line_templates.ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the lines of recurring templates."""
    out = line_templates.without_recurring_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


@_query("op3_extendible_shards", extendible_shards.ORACLE)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of each document."""
    return extendible_shards.extendible_shards(_table(spark, sf_dir, "documents"), "doc_id", F.octet_length("text"))


@_query("op4_quality_ftrl")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document."""
    docs = _table(spark, sf_dir, "documents")
    scored = quality_ftrl.score_quality(docs, quality_ftrl.learn(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality_ftrl.THRESHOLD).cast("int").alias("predicted"))


@_query("op5_quote_threads", quote_threads.ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message with its parent, without quotations."""
    out = quote_threads.quote_threads(_table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", "role", "parent_turn", "linked", "depth", "place", "quoted_lines", F.sha2("text", 256).alias("text_sha256"))


@_query("op6_chunk_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of each document."""
    return chunk_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


@_query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document."""
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
                         "abuse", "misspelled", "quoted")


@_query("op8_jaccard_join", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.c)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r USING (doc_id) GROUP BY d.doc_id
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near copies of each document."""
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


@_query("op9_arc_warc")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as it comes back from the archives."""
    return arc_warc.pages_through_warc(_table(spark, sf_dir, "pages"), scratch_path(spark, "warcs"))


@_query("op10_byte_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document."""
    return byte_bpe.tokenised(spark, _table(spark, sf_dir, "documents"), sf_dir)


@_query("op11_qdwh_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding's whitened components."""
    return qdwh_whitening.whitened_components(spark, _table(spark, sf_dir, "embeddings"))


@_query("op12_spelling_variants", spelling_variants.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word with its form and root."""
    return spelling_variants.spelling_variants(_table(spark, sf_dir, "documents"))


@_query("op13_secret_crf")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of each document."""
    docs = _table(spark, sf_dir, "documents")
    found = secret_crf.secret_spans(docs, secret_crf.learn(docs))
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select("doc_id", *(secret_crf.count_of("spans", k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
                        F.sha2(secret_crf.span_text(base), 256).alias("base_sha256"), secret_crf.span_text(F.col("spans")).alias("spans"),
                        secret_crf.count_of("spans", "crf").alias("n_crf"))


@_query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
