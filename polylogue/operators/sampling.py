"""Counts, guards, first-n and seeded k-row samples per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from ..session import written
from .index import null_safe_join, with_row_index

DEFAULT_SEED = 2023


def group_counts(df: DataFrame, by: Sequence[str] = ("lang",), out: str = "n") -> DataFrame:
    """A1: rows per group (partial counts before the shuffle)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(out))


def sufficiency(df: DataFrame, k: int, by: Sequence[str] = ("lang",)) -> DataFrame:
    """Per group, its size, the required ``k`` and whether ``n >= k``."""
    return group_counts(df, by).select(*by, "n", F.lit(k).cast("long").alias("k"),
                                       (F.col("n") >= F.lit(k)).alias("is_sufficient"))


# Parts into which a group's rows are dealt before the final ranking, and the rows that one task
# ranks at most; beyond, the cut-off is found by counting.
TOP_PARTS, RANKED = 64, 1 << 16
# Buckets of a round of counting, and groups whose cut-offs are broadcast (a few numbers each).
BUCKETS, GROUPS = 1 << 16, 1 << 16


def _smallest(df: DataFrame, by: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """The first ``k`` rows of every group in ``order``, which must be unique in it. For small ``k``: first of each of TOP_PARTS
    parts of the group, then of what these leave, at most RANKED rows; Spark
    also limits each task's rows before they move. Beyond, ``select_smallest``.
    """
    if k * TOP_PARTS > RANKED:
        return select_smallest(df, by, order, k)
    part = df.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(TOP_PARTS)))
    inner = Window.partitionBy(*by, "__part").orderBy(*order)
    some = part.withColumn("__rn", F.row_number().over(inner)).filter(F.col("__rn") <= k).drop("__part")
    return some.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__rn") <= k).drop("__rn")


def leading_number(df: DataFrame, column: str) -> Column:
    """A long in the order of ``column``: integers (halved, so that differences fit), or the first seven bytes of a string. NULL comes first."""
    kind = df.schema[column].dataType
    if isinstance(kind, IntegralType):
        number = F.shiftright(F.col(column).cast("long"), 1)
    elif isinstance(kind, StringType):
        head = F.rpad(F.hex(F.substring(F.encode(F.col(column), "UTF-8"), 1, 7)), 14, "0")
        number = F.conv(head, 16, 10).cast("long")
    else:
        raise TypeError(f"rows are selected in the order of integers or strings, not of {kind.simpleString()}")
    return F.coalesce(number, F.lit(-(1 << 62)).cast("long"))


def cut_offs(keyed: DataFrame, by: Sequence[str], k: int, ranked: int = RANKED, buckets: int = BUCKETS) -> DataFrame:
    """(by..., __n, __lo, __hi, __size, __need): of a group's ``__n`` rows, those with ``__x`` below ``__lo`` are among its
    first ``k``, and ``__need`` of the ``__size`` ones from ``__lo`` to ``__hi``.

    Distributed selection: a round counts the rows of each of ``buckets`` equal ranges of the key and goes on in
    the one that the ``k``-th row is in, until that holds ``ranked`` rows, a single key, or only wanted
    rows. No row moves, only counts do; keys that are evenly spread are settled by one round up to
    ``buckets`` x ``ranked`` rows of a group.
    """
    by = list(by)
    state = written(keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"), F.count(F.lit(1)).alias("__size"))
                     .withColumn("__need", F.least(F.col("__n"), F.lit(k).cast("long"))), "cut-offs")
    unsettled = (F.col("__size") > ranked) & (F.col("__hi") > F.col("__lo")) & (F.col("__need") < F.col("__size"))
    width = F.expr(f"(__hi - __lo) div {buckets} + 1")
    while not state.filter(unsettled).isEmpty():
        rows = null_safe_join(keyed.select(*by, "__x"), _sent(state.filter(unsettled)), by).filter(F.col("__x").between(F.col("__lo"), F.col("__hi")))
        far = F.col("__x") - F.col("__lo")
        counts = (rows.withColumn("__b", far - F.pmod(far, width))
                  .groupBy(*by, "__n", "__lo", "__hi", "__need", "__b").agg(F.count(F.lit(1)).alias("__c")))
        upto = F.sum("__c").over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0))
        hit = counts.withColumn("__upto", upto).filter((F.col("__upto") >= F.col("__need")) & (F.col("__upto") - F.col("__c") < F.col("__need")))
        lo = F.col("__lo") + F.col("__b")
        found = hit.select(*by, "__n", lo.alias("__lo"), F.least(lo + width - 1, F.col("__hi")).alias("__hi"), F.col("__c").alias("__size"),
                           (F.col("__need") - F.col("__upto") + F.col("__c")).alias("__need"))
        state = written(state.filter(~unsettled).unionByName(found), "cut-offs")
    return state


def _sent(state: DataFrame) -> DataFrame:
    """The table of groups, broadcast while it is small."""
    return F.broadcast(state) if state.count() <= GROUPS else state


def select_smallest(df: DataFrame, by: Sequence[str], order: Sequence[str], k: int, least: int = 0,
                    ranked: int = RANKED, buckets: int = BUCKETS) -> DataFrame:
    """The first ``k`` rows of every group of ``least`` rows or more, for any ``k``: those below the group's cut-off, and
    of the ones at it as many as are missing. Only these last are ranked."""
    if not by:
        return select_smallest(df.withColumn("__all", F.lit(0)), ["__all"], order, k, least, ranked, buckets).drop("__all")
    by, order = list(by), list(order)
    keyed = df.withColumn("__x", leading_number(df, order[0]))
    state = cut_offs(keyed, by, k, ranked, buckets).filter(F.col("__n") >= least)
    near = null_safe_join(keyed, _sent(state), by)
    extra = [c for c in state.columns if c not in by] + ["__x"]
    inside = F.col("__x").between(F.col("__lo"), F.col("__hi"))
    whole = F.col("__need") == F.col("__size")
    below = near.filter((F.col("__x") < F.col("__lo")) | (inside & whole)).drop(*extra)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    edge = near.filter(inside & ~whole).withColumn("__rn", rank).filter(F.col("__rn") <= F.col("__need")).drop("__rn", *extra)
    return below.unionByName(edge)


def first_n(df: DataFrame, n: int, by: Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """P5: the first ``n`` rows of every group in ``order``."""
    return _smallest(df, by, [order] if isinstance(order, str) else list(order), n)


def sample_sizes(df: DataFrame, n: int | None, by: Sequence[str]) -> DataFrame:
    """The reported sample size, min(n or group size, group size)."""
    counts = group_counts(df, by, "__n")
    want = F.col("__n") if n is None else F.lit(n).cast("long")
    return counts.select(*by, F.least(want, F.col("__n")).alias("n_reported"))


def _hash_key(seed: int, by: Sequence[str], pos: str, draw: str | None) -> F.Column:
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") for c in by]
    if draw is not None:
        parts.append(F.col(draw))
    parts.append(F.col(pos).cast("string"))
    return F.md5(F.concat_ws("|", *parts))


def sample_k(df: DataFrame, k: int, seed: int = DEFAULT_SEED, by: Sequence[str] = ("lang",),
             pos: str = "pos", draws: Sequence[str] | None = None,
             ordinal: str = "shot_ordinal") -> DataFrame:
    """M1/M2: exactly ``k`` rows per group (and per draw), without replacement.

    A row's rank is ``md5(seed|group|draw|pos)`` with ``pos`` as tie-break; the k
    smallest are kept (see ``_smallest``). The rank depends only on the row, not on
    partitioning. Groups with fewer than ``k`` rows yield nothing (the sufficiency guard).
    ``ordinal`` numbers the kept rows 1..k in ascending ``pos``.
    """
    by = list(by)
    src = df
    part = list(by)
    if draws:
        src = df.withColumn("draw", F.explode(F.array(*[F.lit(d) for d in draws])))
        part = by + ["draw"]
    ranked = src.withColumn("__h", _hash_key(seed, by, pos, "draw" if draws else None))
    if k * TOP_PARTS > RANKED:  # neither ranked nor numbered in one task
        chosen = written(select_smallest(ranked, part, ["__h", pos], k, least=k).drop("__h"), "sample")
        return with_row_index(chosen, pos, by=part, out="__at").withColumn(ordinal, F.col("__at") + 1).drop("__at")
    top = _smallest(ranked, part, ["__h", pos], k)
    # a group is kept only if it has k rows: count the survivors (at most k per group)
    full = Window.partitionBy(*part)
    top = top.withColumn("__cnt", F.count(F.lit(1)).over(full)).filter(F.col("__cnt") == k)
    ordw = Window.partitionBy(*part).orderBy(pos)
    return (top.withColumn(ordinal, F.row_number().over(ordw).cast("long"))
            .drop("__h", "__cnt"))


def draw_positions_mt(spark: SparkSession, counts: DataFrame, k: int, seed: int = DEFAULT_SEED,
                      by: str = "lang", draws: int = 1) -> DataFrame:
    """M1/M2 with Python's Mersenne Twister, reproducing ``random.seed(seed)`` then
    ``sorted(random.sample(range(n), k))`` per group (``draws`` successive calls).

    Eager: the per-group counts (one row per group) come to the driver, which
    draws k numbers per group; the result (k x draws rows per group) is a small
    table meant for a broadcast semi-join.
    """
    import random

    rows = []
    for r in counts.select(by, "n").collect():
        if r["n"] < k:
            continue
        rng = random.Random(seed)
        for d in range(draws):
            for ordinal, p in enumerate(sorted(rng.sample(range(r["n"]), k)), start=1):
                rows.append((r[by], d, ordinal, p))
    return spark.createDataFrame(rows, f"{by} string, draw int, shot_ordinal long, pos long")


def pick_rows(df: DataFrame, draws: DataFrame, keys: Sequence[str] = ("lang", "pos")) -> DataFrame:
    """Rows of ``df`` at the drawn positions (Spark broadcasts ``draws`` if it is small)."""
    return df.join(draws, list(keys), "inner")
