"""Zero-based row position without a single-task window.

A plain ``row_number() OVER (PARTITION BY lang ORDER BY key)`` sends a whole
language to one task; one language can be most of the corpus. Instead rows are
cut into buckets (ranges of the order key, or file blocks), counted per bucket,
the small bucket table gets an exclusive prefix sum, and rows are numbered
inside their bucket only. The result equals the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

_B = "__pl_bucket"
_SB = "__pl_super"
_N = "__pl_n"
_OFF = "__pl_off"


def _exclusive_sum(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Equi-join in which NULL equals NULL; the columns of ``left`` stay."""
    renamed = right.withColumnsRenamed({c: f"__pl_r_{c}" for c in on})
    match = [left[c].eqNullSafe(renamed[f"__pl_r_{c}"]) for c in on]
    return left.join(renamed, match).drop(*[f"__pl_r_{c}" for c in on])


def bucket_offsets(counts: DataFrame, by: Sequence[str], bucket: str | Sequence[str], value: str,
                   out: str = _OFF, fanout: int | None = 4096) -> DataFrame:
    """Exclusive prefix sum of ``value`` over ``bucket`` (one or more columns) within ``by``.

    If the first bucket column is numeric and ``fanout`` is given, a second level of
    super-buckets of that column keeps every window small: the top window sees
    (#buckets / fanout) rows per key and each inner window ``fanout`` values of it.
    """
    by = list(by)
    bucket = [bucket] if isinstance(bucket, str) else list(bucket)
    if not fanout or dict(counts.dtypes)[bucket[0]] == "string":
        return _exclusive_sum(counts, by, bucket, value, out)
    sup = counts.withColumn(_SB, F.floor(F.col(bucket[0]) / F.lit(fanout)))
    top = (sup.groupBy(*by, _SB).agg(F.sum(value).alias("__pl_sv"))
           .transform(lambda d: _exclusive_sum(d, by, [_SB], "__pl_sv", "__pl_soff"))
           .drop("__pl_sv"))
    inner = _exclusive_sum(sup, by + [_SB], bucket, value, "__pl_ioff")
    return (null_safe_join(inner, top, by + [_SB])
            .withColumn(out, F.col("__pl_soff") + F.col("__pl_ioff"))
            .drop("__pl_soff", "__pl_ioff", _SB))


def nested_offsets(counts: DataFrame, levels: Sequence[str], value: str, out: str = _OFF) -> DataFrame:
    """Exclusive prefix sum of ``value`` in the order of ``levels``, each of which refines the one before it.

    A window sees only the values of one level below one value of the level above, so
    none grows with the table. ``levels`` must identify a row and hold no NULL.
    """
    levels = list(levels)
    found, parts = counts, []
    for i in range(len(levels)):
        upto = levels[:i + 1]
        sums = counts.groupBy(*upto).agg(F.sum(value).alias("__pl_sum"))
        part = f"__pl_part{i}"
        parts.append(part)
        found = found.join(_exclusive_sum(sums, levels[:i], [levels[i]], "__pl_sum", part).drop("__pl_sum"), upto)
    return found.withColumn(out, sum((F.col(p) for p in parts[1:]), F.col(parts[0]))).drop(*parts)


def with_row_index(df: DataFrame, order: str | Sequence[str], by: Sequence[str] = (),
                   bucket: Column | Sequence[str] | None = None, width: int = 1 << 16,
                   out: str = "pos", fanout: int | None = 4096) -> DataFrame:
    """Add ``out`` = 0-based row number within ``by`` in ``order``.

    ``order`` must be unique within ``by``. By default the bucket is
    ``floor(order / width)`` for a single numeric order column, so a bucket
    holds at most ``width`` rows. ``bucket`` may instead name columns (for
    example a file's number and block start) that are constant over contiguous
    runs of ``order``. Rows whose ``by`` is NULL are a group of their own.
    """
    by = list(by)
    order_cols = [order] if isinstance(order, str) else list(order)
    if bucket is None:
        if len(order_cols) != 1:
            raise ValueError("a bucket is required for a multi-column order")
        tagged = df.withColumn(_B, F.floor(F.col(order_cols[0]) / F.lit(width)))
        bucket_cols = [_B]
    elif isinstance(bucket, Column):
        tagged = df.withColumn(_B, bucket)
        bucket_cols = [_B]
    else:
        tagged = df
        bucket_cols = list(bucket)
    counts = tagged.groupBy(*by, *bucket_cols).agg(F.count(F.lit(1)).alias(_N))
    offsets = bucket_offsets(counts, by, bucket_cols, _N, _OFF, fanout)
    w = Window.partitionBy(*by, *bucket_cols).orderBy(*order_cols)
    return (null_safe_join(tagged, offsets.drop(_N), by + bucket_cols)
            .withColumn(out, (F.col(_OFF) + F.row_number().over(w) - 1).cast("long"))
            .drop(_OFF, *[c for c in bucket_cols if c == _B]))


def file_order_index(df: DataFrame, by: Sequence[str] = (), out: str = "pos",
                     dir_col: str | None = None) -> DataFrame:
    """Row position in file order for a file scan without a key column.

    Order is (part number, file path, split start, row order inside the split); the
    number is that of Spark's part files, compared as a number, so files past
    part-99999 keep their place. Other files come first, by path. The bucket is
    the split, whose rows one task reads in order and numbers as they come; the
    splits' first positions are sums over a table of one row for each, which is broadcast, so
    no row of the files moves. With ``dir_col`` the
    logical file becomes a column of that name and positions restart in each: the
    folder of Spark's part files, any other file itself.
    ``df`` must be the file scan itself (its ``_metadata`` is read here).
    """
    extra = []
    if dir_col:
        extra.append(F.regexp_replace(F.col("_metadata.file_path"), "/part-[^/]*$", "").alias(dir_col))
    tagged = df.select(
        "*", *extra,
        F.coalesce(F.expr("try_cast(regexp_extract(_metadata.file_name, '^part-([0-9]+)', 1) AS bigint)"), F.lit(-1)).alias("__pl_part"),
        F.col("_metadata.file_path").alias("__pl_file"),
        F.col("_metadata.file_block_start").alias("__pl_block"),
    )
    groups, split = list(by) + ([dir_col] if dir_col else []), ["__pl_part", "__pl_file", "__pl_block"]
    counts = tagged.groupBy(*groups, *split).agg(F.count(F.lit(1)).alias(_N))
    offsets = bucket_offsets(counts, groups, split, _N).drop(_N)
    # a column of the files that has the name of ``out`` is replaced
    return (null_safe_join(_ranked(tagged, {"__pl_rank": [*groups, *split]}), F.broadcast(offsets), groups + split)
            .withColumn(out, F.col("__pl_rank") + F.col(_OFF)).drop(_OFF, "__pl_rank", *split))


def with_local_ranks(df: DataFrame, by: Mapping[str, Sequence[str]]) -> DataFrame:
    """``df`` with its partition's number ``__pl_part`` and, as each column of ``by``, a row's 0-based place among the
    rows of its partition that agree with it in the columns named.

    Rows are numbered as they come, so ``df`` should be sorted in its partitions; nothing is shuffled.
    Once stored, ``with_global_ranks`` turns the places into those of the whole table.
    """
    return _ranked(df.withColumn("__pl_part", F.spark_partition_id()), by)


def _ranked(df: DataFrame, by: Mapping[str, Sequence[str]]) -> DataFrame:
    """``df`` with each column of ``by``: a row's place among those of its partition that agree with it in the columns named."""
    by = {out: list(cols) for out, cols in by.items()}
    # columns go by number, as Python functions take none whose name has a dot
    number = {c: f"c{i}" for i, c in enumerate(df.columns)}
    ranks = {f"r{i}": [number[c] for c in cols] for i, cols in enumerate(by.values())}
    fields = [StructField(number[f.name], f.dataType) for f in df.schema] + [StructField(r, LongType()) for r in ranks]
    return df.toDF(*number.values()).mapInArrow(lambda batches: _numbered(batches, ranks), StructType(fields)).toDF(*number, *by)


def _numbered(batches, by: dict[str, list[str]]):
    import numpy as np
    import pyarrow as pa

    seen: dict[tuple, int] = {}  # rows so far of every group of the partition
    for rb in batches:
        for out, cols in by.items():
            code = np.zeros(rb.num_rows, np.int64)
            for c in cols:  # null is a value of its own
                found = rb.column(c).dictionary_encode(null_encoding="encode")
                code = code * len(found.dictionary) + np.asarray(found.indices)
            ranks = np.empty(rb.num_rows, np.int64)
            for g in np.unique(code):
                at = np.flatnonzero(code == g)
                group = (out, *[rb.column(c)[int(at[0])].as_py() for c in cols])
                first = seen.get(group, 0)
                ranks[at] = np.arange(first, first + len(at))
                seen[group] = first + len(at)
            rb = rb.append_column(out, pa.array(ranks))
        yield rb


def with_global_ranks(stored: DataFrame, by: Mapping[str, Sequence[str]]) -> DataFrame:
    """``stored``, written from ``with_local_ranks`` of sorted ranges, with places counted over all partitions.

    The partitions' numbers must follow the order. Only a small table of the groups of each partition moves.
    """
    out = stored
    for name, cols in by.items():
        cols = list(cols)
        counts = stored.groupBy(*cols, "__pl_part").agg(F.count(F.lit(1)).alias(_N))
        offsets = _exclusive_sum(counts, cols, ["__pl_part"], _N, _OFF).drop(_N)
        out = null_safe_join(out, F.broadcast(offsets), [*cols, "__pl_part"]).withColumn(name, F.col(name) + F.col(_OFF)).drop(_OFF)
    return out.drop("__pl_part")
