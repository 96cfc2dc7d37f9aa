"""Row index, counts, guards, samples and interleave queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import fixtures as fx
from ..operators import sampling as S
from ..operators.index import with_row_index
from ..operators.mixing import interleave
from .oracle_ctes import add_cte, with_ctes
from .registry import query

SEED = S.DEFAULT_SEED
K = 10
#: More than S.RANKED / S.TOP_PARTS.
K_LARGE = 1100


def _md5_rank(part: str, draw: str | None = None) -> str:
    key = f"'{SEED}', lang" + (f", {draw}" if draw else "") + ", CAST(pos AS VARCHAR)"
    return f"row_number() OVER (PARTITION BY {part} ORDER BY md5(concat_ws('|', {key})), pos)"


@query("row_index", with_ctes("SELECT lang, pair_id, pos FROM lang_pairs", "lang_pairs"))
def row_index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1 on the pairs: position per language in pair_id order, computed here
    from the documents (not read from the written pair table)."""
    return fx.build_lang_pairs(spark, sf_dir).select("lang", "pair_id", "pos")


@query("row_index_documents", """
SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM documents
""")
def row_index_documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1 with narrow buckets (8 ids) so that many buckets and both window levels are used."""
    docs = fx.table(spark, sf_dir, "documents").select("lang", "doc_id")
    return with_row_index(docs, "doc_id", by=["lang"], width=8, fanout=4)


@query("head_n", with_ctes("""
SELECT lang, split, pair_id FROM (
  SELECT lang, split, pair_id, row_number() OVER (PARTITION BY lang, split ORDER BY doc_id, line_pos) AS rn FROM lang_pairs)
WHERE rn <= 50
""", "lang_pairs"))
def head_n_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lp = fx.lang_pairs(spark, sf_dir)
    return S.first_n(lp, 50, ["lang", "split"], ["doc_id", "line_pos"]).select("lang", "split", "pair_id")


@query("head_n_large", with_ctes("""
SELECT lang, pair_id FROM (SELECT lang, pair_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id, line_pos) AS rn FROM lang_pairs)
WHERE rn <= 5000
""", "lang_pairs"))
def head_n_large_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5 with an n beyond what one task ranks: the cut-off is found by counting."""
    return S.first_n(fx.lang_pairs(spark, sf_dir), 5000, ["lang"], ["doc_id", "line_pos"]).select("lang", "pair_id")


@query("sample_sizes", with_ctes("""
SELECT lang, split, least(100, count(*)) AS n_reported FROM lang_pairs GROUP BY lang, split
""", "lang_pairs"))
def sample_sizes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sample_sizes(fx.lang_pairs(spark, sf_dir), 100, ["lang", "split"])


@query("lang_counts", with_ctes("SELECT lang, count(*) AS n FROM lang_pairs GROUP BY lang", "lang_pairs"))
def lang_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.group_counts(fx.lang_pairs(spark, sf_dir), ["lang"])


@query("sufficiency_report", with_ctes("""
SELECT lang, count(*) AS n, CAST(1000 AS BIGINT) AS k, count(*) >= 1000 AS is_sufficient
FROM lang_pairs GROUP BY lang
""", "lang_pairs"))
def sufficiency_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sufficiency(fx.lang_pairs(spark, sf_dir), 1000, ["lang"])


add_cte("train_pairs", ["lang_pairs"], "SELECT * REPLACE (split_pos AS pos) FROM lang_pairs WHERE split = 'train'")
add_cte("test_pairs", ["lang_pairs"], "SELECT * FROM lang_pairs WHERE split = 'test'")
add_cte("shots", ["train_pairs"], f"""
  SELECT lang, pos, pair_id, row_number() OVER (PARTITION BY lang ORDER BY pos) AS shot_ordinal
  FROM (SELECT *, {_md5_rank('lang')} AS rn, count(*) OVER (PARTITION BY lang) AS n FROM train_pairs)
  WHERE rn <= {K} AND n >= {K}
""")


@query("few_shot_sample", with_ctes("SELECT lang, shot_ordinal, pos, pair_id FROM shots", "shots"))
def few_shot_sample_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = fx.train_pairs(spark, sf_dir)
    return S.sample_k(train, K, SEED, ["lang"], "pos").select("lang", "shot_ordinal", "pos", "pair_id")


@query("few_shot_large", with_ctes(f"""
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY pos) AS shot_ordinal, pos, pair_id
FROM (SELECT *, {_md5_rank('lang')} AS rn, count(*) OVER (PARTITION BY lang) AS n FROM lang_pairs) WHERE rn <= {K_LARGE} AND n >= {K_LARGE}
""", "lang_pairs"))
def few_shot_large_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 with a k beyond what one task ranks: selection by counts, ordinals by the row index."""
    lp = fx.lang_pairs(spark, sf_dir)
    return S.sample_k(lp, K_LARGE, SEED, ["lang"], "pos").select("lang", "shot_ordinal", "pos", "pair_id")


@query("pick_rows", with_ctes("""
SELECT t.lang, t.pos, s.shot_ordinal, t.context, t.response FROM train_pairs t JOIN shots s USING (lang, pos)
""", "train_pairs", "shots"))
def pick_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows at drawn positions; the draw sees positions only."""
    train = fx.train_pairs(spark, sf_dir)
    draws = S.sample_k(train.select("lang", "pos"), K, SEED, ["lang"], "pos")
    return S.pick_rows(train, draws).select("lang", "pos", "shot_ordinal", "context", "response")


@query("few_shot_sample_mt19937")
def few_shot_sample_mt_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 with the reference's exact generator (Mersenne Twister, seed 2023)."""
    lp = fx.train_pairs(spark, sf_dir)
    draws = S.draw_positions_mt(spark, S.group_counts(lp, ["lang"]), K, SEED)
    return S.pick_rows(lp, draws.drop("draw")).select("lang", "shot_ordinal", "pos", "pair_id")


@query("ballot_sample", with_ctes(f"""
SELECT lang, draw, pos FROM (
  SELECT lang, draw, pos, {_md5_rank('lang, draw', 'draw')} AS rn, count(*) OVER (PARTITION BY lang, draw) AS n
  FROM test_pairs, (VALUES ('fs'), ('mtl')) AS d(draw))
WHERE rn <= 100 AND n >= 100
""", "test_pairs"))
def ballot_sample_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lp = fx.lang_pairs(spark, sf_dir).filter("split = 'test'")
    return S.sample_k(lp, 100, SEED, ["lang"], "pos", draws=["fs", "mtl"]).select("lang", "draw", "pos")


def _interleave_sql(corpus: str, key: str, mode: str, k: int = K) -> str:
    """Independent statement: hits by brute force over 1..N, then order all rows."""
    if mode == "reference":
        hits = f"""SELECT t.lang AS tgt_lang, i AS h, row_number() OVER (PARTITION BY t.lang ORDER BY i) AS t_ord
            FROM tg t, src_n, range(1, src_n.n + 1) r(i)
            WHERE CAST(i AS DOUBLE) % (CAST(src_n.n AS DOUBLE) / {k}) = 0"""
    else:
        hits = f"""SELECT t.lang AS tgt_lang, (j * src_n.n) // {k} AS h, j AS t_ord
            FROM tg t, src_n, range(1, {k} + 1) r(j)"""
    return f"""
    WITH c AS (SELECT lang, count(*) AS n FROM {corpus} GROUP BY lang),
    src_n AS (SELECT n FROM c WHERE lang = 'en'),
    tg AS (SELECT lang FROM c WHERE lang <> 'en' AND lang <> 'pl' AND n >= {k}),
    sh AS (SELECT lang, pos, {key}, row_number() OVER (PARTITION BY lang ORDER BY pos) AS t_ord
           FROM (SELECT *, {_md5_rank('lang')} AS rn FROM {corpus} WHERE lang IN (SELECT lang FROM tg))
           WHERE rn <= {k}),
    hits AS ({hits}),
    allrows AS (
      SELECT t.lang AS tgt_lang, s.pos + 1 AS after_row, 0 AS is_shot_i, 0 AS t_ord, s.{key}
      FROM {corpus} s, tg t WHERE s.lang = 'en'
      UNION ALL
      SELECT h.tgt_lang, h.h, 1, h.t_ord, sh.{key}
      FROM hits h JOIN sh ON sh.lang = h.tgt_lang AND sh.t_ord = h.t_ord)
    SELECT tgt_lang, row_number() OVER (PARTITION BY tgt_lang ORDER BY after_row, is_shot_i, t_ord) - 1 AS out_pos,
           {key}, is_shot_i = 1 AS is_shot
    FROM allrows"""


add_cte("docs_pos", [], "SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM documents")


@query("interleave_reference", with_ctes(_interleave_sql("docs_pos", "doc_id", "reference"), "docs_pos"))
def interleave_reference_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 with the float-modulus rule on the documents (en N=620 at sf0.01: 10 shots)."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return interleave(with_row_index(docs, "doc_id", by=["lang"], width=1024), "en", K, SEED, mode="reference", key="doc_id",
                      counts=S.group_counts(docs, ["lang"]))


@query("interleave_reference_pairs", with_ctes(_interleave_sql("train_pairs", "pair_id", "reference"), "train_pairs"))
def interleave_reference_pairs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 reference mode on the training pairs; the float rule drops shots unless k divides N."""
    return interleave(fx.train_pairs(spark, sf_dir), "en", K, SEED, mode="reference", key="pair_id")


#: More than mixing.LITERALS; 5,031 rows / 1,118 = 4.5, so that every second candidate of sf0.01 passes the float test.
K_TABLE = 1118


@query("interleave_reference_large", with_ctes(_interleave_sql("lang_pairs", "pair_id", "reference", K_TABLE), "lang_pairs"))
def interleave_reference_large_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 reference mode with places from a joined table; the plan does not grow with k."""
    return interleave(fx.lang_pairs(spark, sf_dir), "en", K_TABLE, SEED, mode="reference", key="pair_id")


@query("interleave_spread", with_ctes(_interleave_sql("train_pairs", "pair_id", "spread"), "train_pairs"))
def interleave_spread_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 + M4 in spread mode: every target gets all k shots."""
    return interleave(fx.train_pairs(spark, sf_dir), "en", K, SEED, mode="spread", key="pair_id")


@query("interleave_reference_mt19937")
def interleave_reference_mt_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 + M3 exactly as the reference: Mersenne Twister shots (seed 2023, k=10)
    placed by the float-modulus rule, on the documents."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "lang")
    counts = S.group_counts(docs, ["lang"])
    targets = counts.filter((counts.lang != "en") & (counts.lang != "pl"))
    docs = with_row_index(docs, "doc_id", by=["lang"], width=1024)
    draws = S.draw_positions_mt(spark, targets, K, SEED).drop("draw")
    shots = S.pick_rows(docs, draws)
    return interleave(docs, "en", K, SEED, mode="reference", key="doc_id", shots=shots, counts=counts)
