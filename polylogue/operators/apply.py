"""User functions over Arrow batches, a generator applied per task,
and a write-once cache of a transformed table."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fingerprint, hadoop_path, scratch_path
from ..sources.files import write_staged


def batched_map(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
                columns: Sequence[str] | None = None) -> DataFrame:
    """``fn`` maps a pandas batch to a pandas batch with new columns.
    Parallelism is the partition count; batches arrive through Arrow."""
    src = df.select(*columns) if columns else df

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)

    return src.mapInPandas(run, schema)


def apply_generator(df: DataFrame, factory: Callable[[], Callable[..., Sequence[str]]], text: str,
                    keys: Sequence[str], out: str = "prediction", **generate_kwargs) -> DataFrame:
    """``factory()`` builds the generator once per task (for example, loads a
    model); it is then called on every Arrow batch of texts with
    ``generate_kwargs`` (``max_length``, ``num_beams``, ...)."""
    keys = list(keys)
    key_schema = ", ".join(f"`{k}` {t}" for k, t in df.select(*keys).dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gen = factory()
        for pdf in batches:
            res = pdf[keys].copy()
            res[out] = list(gen(pdf[text].fillna("").tolist(), **generate_kwargs))
            yield res

    return df.select(*keys, text).mapInPandas(run, f"{key_schema}, `{out}` string")


class Reversed:
    """Deterministic stand-in generator: the whitespace tokens of the whole text, last first."""

    def __call__(self, texts: Sequence[str], num_beams: int | None = None) -> list[str]:
        del num_beams
        return [" ".join(reversed(t.split())) for t in texts]


def cached_table(spark: SparkSession, df: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Write ``df`` to Parquet below ``path`` once and read it back. A copy is
    reused, unless ``overwrite``, if it was made by the same plan over files of the
    same names, sizes and times. This also cuts the lineage."""
    inputs = "|".join(fingerprint(spark, f) for f in sorted(df.inputFiles()))
    own = f"{path}/{hashlib.sha1(f'{df.semanticHash()}|{df.schema.json()}|{inputs}'.encode()).hexdigest()[:16]}"
    fs, done = hadoop_path(spark, f"{own}/_SUCCESS")
    if overwrite or not fs.exists(done):
        write_staged(spark, own, df.write.parquet)
    return spark.read.parquet(own)


def _finished(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the ranges below ``path`` that were committed."""
    fs, base = hadoop_path(spark, path)
    ranges = [st.getPath().toString() for st in fs.listStatus(base)] if fs.exists(base) else []
    whole = [r for r in sorted(ranges) if fs.exists(hadoop_path(spark, f"{r}/_SUCCESS")[1])]
    return spark.read.schema(schema).parquet(*whole) if whole else spark.createDataFrame([], schema)


def generate_resumable(df: DataFrame, factory: Callable[[], Callable[..., Sequence[str]]], text: str, keys: Sequence[str], path: str,
                       ranges: int = 16, out: str = "prediction", **generate_kwargs) -> DataFrame:
    """X3 with commits: (keys..., out) of every row of ``df``, generated below ``path`` in ``ranges`` of a hash of the keys.

    Each range is a job of its own over all tasks, whose success marker commits its rows. A call after a failure, or
    with rows that came since, anti-joins what is committed and generates the rest only. ``keys`` must
    identify a row. What a range left unfinished is not read.
    """
    spark, keys = df.sparkSession, list(keys)
    schema = ", ".join(f"`{k}` {t}" for k, t in df.select(*keys).dtypes) + f", `{out}` string"
    there = _finished(spark, path, schema).select(*[F.col(k).alias(f"__done_{k}") for k in keys])
    rest = df.select(*keys, text).join(there, [df[k].eqNullSafe(there[f"__done_{k}"]) for k in keys], "left_anti")
    todo = scratch_path(spark, "to-generate")
    rest.withColumn("__range", F.pmod(F.xxhash64(*keys), F.lit(ranges)).cast("int")).write.partitionBy("__range").parquet(todo)
    fs, base = hadoop_path(spark, todo)
    for name in sorted(st.getPath().getName() for st in fs.listStatus(base) if st.getPath().getName().startswith("__range=")):
        rows = spark.read.schema(df.select(*keys, text).schema).parquet(f"{todo}/{name}")
        apply_generator(rows, factory, text, keys, out, **generate_kwargs).write.parquet(f"{path}/{name[2:]}-{uuid.uuid4().hex[:12]}")
    return _finished(spark, path, schema)
