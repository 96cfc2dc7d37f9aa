"""J2/J4 without a shuffle: tables that are bucketed and sorted by their join keys.

Predictions of many systems are scored against the same references again and again. Written
once in buckets of (lang, pos), every later join reads bucket i of both sides in one task:
no exchange, whatever their size, and a hot language spreads over all buckets because
the position is part of the key.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..session import scratch_path


def bucketed(df: DataFrame, keys: Sequence[str], buckets: int, name: str, path: str | None = None) -> DataFrame:
    """``df`` as a catalogue table below ``path`` (default: the shared scratch folder), hashed into ``buckets`` of ``keys`` and sorted in each.

    Rows are dealt to tasks as they are to buckets, so a bucket is one file. Two tables join
    without an exchange if keys and number of buckets are the same; choose it so that a bucket
    of the larger table fits a task.
    """
    spark = df.sparkSession
    table = f"polylogue_{name}_{uuid.uuid4().hex[:12]}"
    place = path or scratch_path(spark, table)
    (df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").option("path", place).saveAsTable(table))
    return spark.table(table)


def co_located(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join of two ``bucketed`` tables, bucket by bucket."""
    return left.join(right.hint("merge"), list(keys), how)
