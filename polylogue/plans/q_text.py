"""Prompt, cleaning, tokenisation, n-gram and token-id queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import ids as I
from ..functions import text as T
from ..functions.tokenize import tokenize
from ..operators.index import with_row_index
from ..operators.vocab import build_vocab, decode, encode
from ..session import scratch_path
from .oracle_ctes import add_cte, with_ctes
from .registry import query
from .sqltext import q, split_space, split_ws, strip_masks, strip_ws
from .sqltext import tokenize as tok_sql

M1, M2 = fx.MASK1, fx.MASK2
# Four prompt configurations (prefix, target prefix, mask 1, mask 2).
PROMPT_CONFIGS = [
    ("prompt_and_masks", "Context:", "Response:", M1, M2),
    ("prompt_only", "Context:", "Response:", None, None),
    ("masks_only", None, None, M1, M2),
    ("plain", None, None, None, None),
]


def _prompt_src_sql(x: str, prefix, tp, m1, m2) -> str:
    masks = bool(m1 and m2)
    if prefix and tp:
        tail = f" {tp} {m1}" if masks else f" {tp}"
        return f"{q(prefix + ' ')} || {x} || {q(tail)}"
    if masks:
        return f"{x} || {q(' ' + m1)}"
    return x


def _prompt_tgt_sql(x: str, prefix, tp, m1, m2) -> str:
    return f"{q(m1 + ' ')} || {x} || {q(' ' + m2)}" if (m1 and m2) else x


@query("prompt_source", with_ctes(" UNION ALL ".join(
    f"SELECT '{c[0]}' AS config, pair_id, {_prompt_src_sql('context', *c[1:])} AS source FROM dialogue_pairs"
    for c in PROMPT_CONFIGS), "dialogue_pairs"))
def prompt_source_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    dp = fx.dialogue_pairs(spark, sf_dir)
    per = F.array(*[F.struct(F.lit(c[0]).alias("config"), T.prompt_source(F.col("context"), *c[1:]).alias("source")) for c in PROMPT_CONFIGS])
    return dp.select("pair_id", F.explode(per).alias("x")).select("x.config", "pair_id", "x.source")


@query("prompt_target", with_ctes(" UNION ALL ".join(
    f"SELECT '{c[0]}' AS config, pair_id, {_prompt_tgt_sql('response', *c[1:])} AS target FROM dialogue_pairs"
    for c in PROMPT_CONFIGS), "dialogue_pairs"))
def prompt_target_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    dp = fx.dialogue_pairs(spark, sf_dir)
    per = F.array(*[F.struct(F.lit(c[0]).alias("config"), T.prompt_target(F.col("response"), *c[1:]).alias("target")) for c in PROMPT_CONFIGS])
    return dp.select("pair_id", F.explode(per).alias("x")).select("x.config", "pair_id", "x.target")


@query("strip_masks", with_ctes(
    f"SELECT lang, system, pos, {strip_masks('prediction', M1, M2)} AS text FROM predictions", "predictions"))
def strip_masks_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pr = fx.predictions(spark, sf_dir)
    return pr.select("lang", "system", "pos", T.strip_masks(F.col("prediction"), M1, M2).alias("text"))


_PADDED_PRED = "chr(9) || chr(160) || prediction || chr(12288) || ' '"


@query("strip_text", with_ctes(
    f"SELECT lang, system, pos, {strip_ws(_PADDED_PRED)} AS text FROM predictions", "predictions"))
def strip_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pr = fx.predictions(spark, sf_dir)
    padded = F.concat(F.lit("\t "), F.col("prediction"), F.lit("　 "))
    return pr.select("lang", "system", "pos", T.strip_ws(padded).alias("text"))


def _tok_query(method: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        dp = fx.dialogue_pairs(spark, sf_dir)
        t = dp.select("pair_id", tokenize(F.col("response"), method).alias("t"))
        return t.select("pair_id", F.size("t").cast("long").alias("n_tokens"),
                        F.array_join("t", " ").alias("tokens"))

    sql = with_ctes(f"""SELECT pair_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens
        FROM (SELECT pair_id, {tok_sql('response', method)} AS t FROM dialogue_pairs)""", "dialogue_pairs")
    return run, sql


for _name, _m in [("tokenize_whitespace", "whitespace"), ("tokenize_13a", "13a"), ("tokenize_char", "char"),
                  ("tokenize_intl", "intl"), ("tokenize_zh", "zh")]:
    _fn, _sql = _tok_query(_m)
    query(_name, _sql)(_fn)


@query("drop_marker_token", with_ctes(f"""
SELECT pair_id, array_to_string(list_filter(
  flatten(list_transform(t, lambda x, i: CASE WHEN i % 3 = 0 THEN ['▁', x] ELSE [x] END)), lambda y: y <> '▁'), ' ')
  AS tokens
FROM (SELECT pair_id, {split_ws('response')} AS t FROM dialogue_pairs)""", "dialogue_pairs"))
def drop_marker_token_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a marker token inserted before every third token is removed again."""
    dp = fx.dialogue_pairs(spark, sf_dir).select("pair_id", T.split_ws("response").alias("t"))
    marked = F.flatten(F.transform("t", lambda x, i: F.when((i + 1) % 3 == 0, F.array(F.lit("▁"), x))
                                   .otherwise(F.array(x))))
    return dp.select("pair_id", F.array_join(T.drop_token(marked), " ").alias("tokens"))


@query("ngrams", with_ctes(f"""
SELECT pair_id, n, CAST(i - 1 AS BIGINT) AS idx, array_to_string(t[i:i + n - 1], ' ') AS gram
FROM (SELECT pair_id, t, n, unnest(range(1, len(t) - n + 2)) AS i
      FROM (SELECT pair_id, {split_ws('response')} AS t FROM dialogue_pairs), (VALUES (1), (2)) AS o(n))""",
    "dialogue_pairs"))
def ngrams_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    dp = fx.dialogue_pairs(spark, sf_dir).select("pair_id", T.split_ws("response").alias("t"))
    grams = F.array(*[F.struct(F.lit(n).alias("n"), T.ngrams(F.col("t"), n).alias("g")) for n in (1, 2)])
    return (dp.select("pair_id", F.explode(grams).alias("x"))
            .select("pair_id", F.col("x.n").alias("n"), F.posexplode("x.g").alias("idx", "gram"))
            .withColumn("idx", F.col("idx").cast("long")))


@query("truncate_tokens", with_ctes(f"""
SELECT split, pair_id, array_to_string(list_concat({split_space('context')}[1:31], ['</s>']), ' ') AS source,
       array_to_string(list_concat({split_space('response')}[1:CASE WHEN split = 'train' THEN 15 ELSE 23 END], ['</s>']), ' ') AS target
FROM lang_pairs""", "lang_pairs"))
def truncate_tokens_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source length 32; target 16 for training, 24 for validation and test."""
    lp = fx.lang_pairs(spark, sf_dir)
    src = I.truncate(T.split_space(F.col("context")), 32, end="</s>")
    tgt = I.truncate(T.split_space(F.col("response")), I.target_max_length(F.col("split"), 16, 24), end="</s>")
    return lp.select("split", "pair_id", F.array_join(src, " ").alias("source"), F.array_join(tgt, " ").alias("target"))


# ---------------------------------------------------------------- token ids
add_cte("vocab", ["dialogue_pairs"], f"""
  SELECT token, row_number() OVER (ORDER BY c DESC, token) + 2 AS id
  FROM (SELECT token, count(*) AS c
        FROM (SELECT unnest({split_space('context')}) AS token FROM dialogue_pairs
              UNION ALL SELECT unnest({split_space('response')}) FROM dialogue_pairs)
        GROUP BY token)
""")
add_cte("dp_sides", ["dialogue_pairs"], f"""
  SELECT pair_id, 'src' AS side, {split_space('context')} AS t FROM dialogue_pairs
  UNION ALL SELECT pair_id, 'tgt', {split_space('response')} FROM dialogue_pairs
""")
add_cte("dp_ids", ["dp_sides", "vocab"], """
  SELECT s.pair_id, s.side, coalesce(e.ids, []) AS ids
  FROM dp_sides s LEFT JOIN (
    SELECT pair_id, side, list(coalesce(v.id, 2) ORDER BY i) AS ids
    FROM (SELECT pair_id, side, i, t[i] AS token FROM (SELECT pair_id, side, t, unnest(range(1, len(t) + 1)) AS i FROM dp_sides)) x
    LEFT JOIN vocab v USING (token)
    GROUP BY pair_id, side) e USING (pair_id, side)
""")


def _enc_cte(name: str, src_max: int, tgt_max: int) -> None:
    add_cte(name, ["dp_ids"], f"""
      SELECT pair_id,
        max(CASE WHEN side = 'src' THEN list_concat(ids[1:{src_max - 1}], [1]) END) AS input_ids,
        max(CASE WHEN side = 'tgt' THEN list_concat(ids[1:{tgt_max - 1}], [1]) END) AS labels
      FROM dp_ids GROUP BY pair_id
    """)


_enc_cte("enc", 1024, 128)
_enc_cte("enc128", 128, 128)


def _vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of the dialogue pairs, written once as a tokenizer's is."""
    return fx.materialized(spark, sf_dir, "vocab", lambda: build_vocab(fx.dialogue_pairs(spark, sf_dir), ["context", "response"]),
                           source="conversations")


def _encoded(spark: SparkSession, sf_dir: str, src_max: int = 1024, tgt_max: int = 128):
    """Both sides of the pairs in one pass: a row per side, encoded, then side by side again."""
    dp, vocab = fx.dialogue_pairs(spark, sf_dir), _vocab(spark, sf_dir)
    sides = F.array(F.struct(F.lit("src").alias("side"), F.col("context").alias("text"), F.lit(src_max).alias("most")),
                    F.struct(F.lit("tgt").alias("side"), F.col("response").alias("text"), F.lit(tgt_max).alias("most")))
    rows = dp.select("pair_id", F.explode(sides).alias("x")).select("pair_id", "x.*")
    ids = encode(rows, ["pair_id", "side"], "text", vocab, F.col("most"))
    both = ids.groupBy("pair_id").agg(F.max(F.when(F.col("side") == "src", F.col("ids"))).alias("input_ids"),
                                      F.max(F.when(F.col("side") == "tgt", F.col("ids"))).alias("labels"))
    return both, vocab


def _ids_str(c) -> F.Column:
    return F.array_join(F.col(c).cast("array<string>"), " ")


@query("vocab_order", with_ctes("SELECT token, id FROM vocab", "vocab"))
def vocab_order_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the whole vocabulary in its order, with buckets of 64 tokens so that many are split."""
    return build_vocab(fx.dialogue_pairs(spark, sf_dir), ["context", "response"], most=64)


@query("encode_pairs", with_ctes("""
SELECT pair_id, array_to_string(input_ids, ' ') AS input_ids, array_to_string(labels, ' ') AS labels FROM enc
""", "enc"))
def encode_pairs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    enc, _ = _encoded(spark, sf_dir)
    return enc.select("pair_id", _ids_str("input_ids").alias("input_ids"), _ids_str("labels").alias("labels"))


@query("decode_ids", with_ctes("""
SELECT e.pair_id, coalesce((SELECT string_agg(v.token, ' ' ORDER BY u.i)
                            FROM (SELECT unnest(e.labels) AS id, unnest(range(len(e.labels))) AS i) u
                            JOIN vocab v ON v.id = u.id), '') AS text
FROM enc e""", "enc", "vocab"))
def decode_ids_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    enc, vocab = _encoded(spark, sf_dir)
    return decode(enc, ["pair_id"], "labels", vocab)


@query("pad_fixed", with_ctes("""
SELECT pair_id, array_to_string(list_concat(input_ids, list_transform(range(128 - len(input_ids)), lambda x: 0)), ' ') AS ids
FROM enc128""", "enc128"))
def pad_fixed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    enc, _ = _encoded(spark, sf_dir, 128, 128)
    return enc.select("pair_id", F.array_join(I.pad_to("input_ids", 128).cast("array<string>"), " ").alias("ids"))


_PADDED_LABELS = "list_concat(labels, list_transform(range(128 - len(labels)), lambda x: 0))"


@query("mask_labels", with_ctes(f"""
SELECT pair_id, array_to_string(list_transform({_PADDED_LABELS}, lambda v: CASE WHEN v = 0 THEN -100 ELSE v END), ' ') AS ids
FROM enc128""", "enc128"))
def mask_labels_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    enc, _ = _encoded(spark, sf_dir, 128, 128)
    masked = I.mask_pad(I.pad_to("labels", 128))
    return enc.select("pair_id", F.array_join(masked.cast("array<string>"), " ").alias("ids"))


@query("unmask_labels", with_ctes(f"""
SELECT pair_id, array_to_string({_PADDED_LABELS}, ' ') AS ids, 128 - len(labels) AS n_masked FROM enc128""", "enc128"))
def unmask_labels_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10 on a written table of masked labels."""
    enc, _ = _encoded(spark, sf_dir, 128, 128)
    path = scratch_path(spark, "masked_labels")
    enc.select("pair_id", I.mask_pad(I.pad_to("labels", 128)).alias("labels")).write.parquet(path)
    back = spark.read.parquet(path)
    return back.select("pair_id", F.array_join(I.unmask_pad("labels").cast("array<string>"), " ").alias("ids"),
                       F.size(F.filter("labels", lambda x: x == I.IGNORE_ID)).cast("long").alias("n_masked"))


@query("pad_batch", with_ctes("""
SELECT pair_id, batch_id, padded_len,
       array_to_string(list_concat(input_ids, list_transform(range(padded_len - len(input_ids)), lambda x: 0)), ' ') AS ids
FROM (SELECT *, CAST(ceil(max(len(input_ids)) OVER (PARTITION BY batch_id) / 8) * 8 AS BIGINT) AS padded_len
      FROM (SELECT *, (row_number() OVER (ORDER BY split_part(pair_id, ':', 1)::BIGINT, split_part(pair_id, ':', 2)::BIGINT) - 1) // 16 AS batch_id
            FROM enc))""", "enc"))
def pad_batch_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batches of 16 rows in order of conversation and turn, padded to the batch's
    longest row rounded up to a multiple of 8. The keys are numbered on their own and
    joined to the encoded rows, so that these are made once."""
    enc, _ = _encoded(spark, sf_dir)
    keys = fx.dialogue_pairs(spark, sf_dir).select("pair_id", "conv_id", "turn", F.floor(F.col("conv_id") / 64).alias("__c"), F.floor(F.col("turn") / 1024).alias("__t"))
    placed = with_row_index(keys, ["conv_id", "turn"], bucket=["__c", "conv_id", "__t"])
    indexed = enc.join(placed.select("pair_id", "pos"), "pair_id")
    out = I.pad_batches(indexed, "input_ids", "pos", 16, 8)
    return out.select("pair_id", "batch_id", "padded_len",
                      F.array_join(F.col("padded").cast("array<string>"), " ").alias("ids"))
