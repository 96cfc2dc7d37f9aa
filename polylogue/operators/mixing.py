"""M3/M4: ratio interleave of a source corpus with k few-shot rows of each target.

Output positions are computed, not produced by a sequential walk: with 1-based
source row i and ascending hit rows h_1..h_m (the source rows after which a
shot is written), source row i lands at i + #{t: h_t < i} and shot t at
h_t + t (both 1-based; ``out_pos`` is 0-based). The sizes of the languages, one
row each, are read first; source rows are then repeated by exploding the list of
target languages, which needs no join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .index import bucket_offsets
from .sampling import DEFAULT_SEED, group_counts, sample_k

MODES = ("spread", "reference")
#: Up to so many shots their places are numbers in the plan; beyond, a table that is joined.
LITERALS = 1024


def hits_table(spark: SparkSession, n_src: int, k: int) -> DataFrame:
    """(candidate, hit, passed): for each of the candidate rows 0..k of mode ``reference`` the source row (1-based) that it
    stands for, where it passes the float test, and how many up to it pass. Made by Spark, so neither the plan nor the driver grows with ``k``."""
    j = F.col("id")
    row = lambda m: F.expr(f"(2 * ({m}) * {n_src} + {k}) div {2 * k}")
    step = float(n_src / k)
    c = row("id")
    passes = (j >= 1) & c.between(1, n_src) & ((j == 1) | (c != row("id - 1"))) & (c.cast("double") % F.lit(step) == 0.0)
    marked = spark.range(k + 1).select(j.alias("candidate"), c.alias("row"), passes.alias("ok"))
    bucket = F.floor(F.col("candidate") / (1 << 16))
    sizes = marked.groupBy(bucket.alias("__b")).agg(F.count_if("ok").alias("__n"))
    before = bucket_offsets(sizes, [], "__b", "__n", "__before").select("__b", "__before")
    upto = F.count_if("ok").over(Window.partitionBy("__b").orderBy("candidate").rowsBetween(Window.unboundedPreceding, 0))
    counted = marked.withColumn("__b", bucket).withColumn("__upto", upto).join(F.broadcast(before), "__b")
    return counted.select("candidate", F.when(F.col("ok"), F.col("row")).alias("hit"), (F.col("__before") + F.col("__upto")).alias("passed"))


def candidates_before(i: F.Column, n_src: int, k: int) -> F.Column:
    """How many candidate rows of mode ``reference`` stand before the 1-based source row ``i``: candidate j is at floor(j*N/k + 1/2)."""
    ceiling = F.call_function("div", (2 * i - 1) * F.lit(k).cast("long") + (2 * n_src - 1), F.lit(2 * n_src).cast("long"))
    return F.least(ceiling - 1, F.lit(k).cast("long"))


def hits_array(n_src: F.Column, k: F.Column, mode: str) -> F.Column:
    """Ascending 1-based source rows after which shots 1, 2, ... are written.

    ``spread``: shot j after row floor(j*N/k), j = 1..k; all k shots are placed.
    ``reference``: rows i in 1..N with ``i % (N/k) == 0`` in floating point, the
    exact rows of the float modulus test. Only the k rows nearest to m*N/k
    (m = 1..k) can pass, so those k candidates are tested instead of N rows.
    Fewer than k hits means the surplus shots are not written.
    """
    m = F.sequence(F.lit(1).cast("long"), k.cast("long"))
    if mode == "spread":
        return F.transform(m, lambda j: F.floor(j * n_src / k).cast("long"))
    if mode == "reference":
        step = n_src.cast("double") / k.cast("double")
        cands = F.array_distinct(F.transform(m, lambda j: F.floor((2 * j * n_src + k) / (2 * k)).cast("long")))
        return F.array_sort(F.filter(cands, lambda c: (c >= 1) & (c <= n_src)
                                     & (c.cast("double") % step == F.lit(0.0))))
    raise ValueError(f"unknown mode {mode!r}; choose one of: {', '.join(MODES)}")


def placed_before(i: F.Column, n_src: int, k: int, mode: str) -> F.Column:
    """How many shots stand before the 1-based source row ``i``."""
    if mode == "spread":
        # #{j in 1..k : floor(j*N/k) < i} = floor((i*k - 1) / N)
        return F.floor((i * k - 1) / F.lit(n_src))
    if mode != "reference":
        raise ValueError(f"unknown mode {mode!r}; choose one of: {', '.join(MODES)}")
    # candidate j stands at floor(j*N/k + 1/2); row i has ceil((2i-1)k/2N) - 1 of them before it,
    # of which those that pass the float test count: a prefix sum, looked up
    step, passed, last = n_src / k, [0], 0
    for j in range(1, k + 1):
        c = (2 * j * n_src + k) // (2 * k)
        passed.append(passed[-1] + int(1 <= c <= n_src and c != last and c % step == 0.0))
        last = c
    return F.element_at(F.array(*[F.lit(p) for p in passed]), (candidates_before(i, n_src, k) + 1).cast("int")).cast("long")


def interleave(corpus: DataFrame, source_lang: str, k: int, seed: int = DEFAULT_SEED,
               mode: str = "spread", key: str = "pair_id", payload: Sequence[str] = (),
               lang: str = "lang", pos: str = "pos", blocklist: Sequence[str] = ("pl",),
               shots: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Interleave all rows of ``source_lang`` with k sampled rows of every other language.

    ``corpus`` needs ``lang``, a 0-based ``pos`` per language and ``key``; ``counts``
    (lang, n) saves counting it where its rows cost something to make.
    Returns (tgt_lang, out_pos, key, is_shot, *payload), one block per target.
    Targets with fewer than k rows are skipped (the sufficiency guard). In mode
    ``reference`` shots for which no row passes the float test are not written.
    """
    payload = list(payload)
    counts = group_counts(corpus.select(lang), [lang]) if counts is None else counts
    sizes = {r[lang]: r["n"] for r in counts.collect()}  # one row per language
    n_src = sizes.get(source_lang, 0)
    targets = sorted(t for t, n in sizes.items() if t not in (None, source_lang, *blocklist) and n >= k)
    if not n_src or not targets:
        return corpus.select(F.col(lang).alias("tgt_lang"), F.col(pos).cast("long").alias("out_pos"), key,
                             F.lit(False).alias("is_shot"), *payload).limit(0)
    i = F.col(pos) + 1
    source = corpus.filter(F.col(lang) == source_lang)
    joined = mode == "reference" and k > LITERALS
    if joined:
        table = hits_table(corpus.sparkSession, n_src, k)
        source = source.withColumn("candidate", candidates_before(i, n_src, k)).join(table.select("candidate", "passed"), "candidate")
    src_out = source.select(
        F.explode(F.array(*[F.lit(t) for t in targets])).alias("tgt_lang"),
        (i + (F.col("passed") if joined else placed_before(i, n_src, k, mode)) - 1).cast("long").alias("out_pos"), key, F.lit(False).alias("is_shot"), *payload)
    if shots is None:
        shots = sample_k(corpus.filter(F.col(lang).isin(targets)), k, seed, [lang], pos)
    if k > LITERALS:
        # a shot's place follows from its number: by the table, or as floor(j*N/k)
        if joined:
            placed = shots.join(table.filter("hit is not null").select(F.col("passed").alias("shot_ordinal"), "hit"), "shot_ordinal")
        else:
            placed = shots.withColumn("hit", F.expr(f"(shot_ordinal * {n_src}) div {k}"))
        shot_out = placed.filter(F.col(lang).isin(targets)).select(
            F.col(lang).alias("tgt_lang"), (F.col("hit") + F.col("shot_ordinal") - 1).alias("out_pos"), key, F.lit(True).alias("is_shot"), *payload)
        return src_out.unionByName(shot_out)
    hits = hits_array(F.lit(n_src).cast("long"), F.lit(k).cast("long"), mode)
    shot_out = (shots.filter(F.col(lang).isin(targets)).withColumn("__hits", hits)
                .filter(F.col("shot_ordinal") <= F.size("__hits"))
                .select(F.col(lang).alias("tgt_lang"),
                        (F.element_at("__hits", F.col("shot_ordinal").cast("int")) + F.col("shot_ordinal") - 1)
                        .alias("out_pos"),
                        key, F.lit(True).alias("is_shot"), *payload))
    return src_out.unionByName(shot_out)


def write_order(df: DataFrame) -> DataFrame:
    """K2 layout: one range of (tgt_lang, out_pos) per task, sorted inside, so a
    partitioned write yields each target's rows in output order."""
    return df.repartitionByRange("tgt_lang", "out_pos").sortWithinPartitions("tgt_lang", "out_pos")
