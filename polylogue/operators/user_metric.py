"""A metric that a user writes as a mergeable aggregate.

The reference hands all predictions and labels to one callback. Here the callback is
an aggregate: a state that takes rows batch by batch, can be merged with another state,
and gives named values at the end. Each task folds its rows into one state per
group, and only states move: they are merged in a tree, so no task sees all rows of a
group or all its states.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States merged at once on the way up, and groups that a task holds before it passes their states on.
FAN_IN, HELD = 64, 4096
#: Rounds below the last one; FAN_IN ** (ROUNDS + 1) tasks are merged without any merge seeing more than FAN_IN states of a group.
ROUNDS = 2


class Aggregate(Protocol):
    """What a metric has to offer. States must be picklable, and ``merge`` associative and commutative."""

    def init(self) -> Any:
        """The state of no rows."""

    def update(self, state: Any, rows: pa.Table) -> Any:
        """``state`` with some more rows of the group."""

    def merge(self, a: Any, b: Any) -> Any:
        """One state for the rows of both."""

    def finish(self, state: Any) -> dict[str, float | None]:
        """The values of the metric; a name that is missing, or None, becomes NULL."""


def _groups(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key values, rows) of the groups in a batch; NULL is a value of its own."""
    codes = [batch.column(k).dictionary_encode(null_encoding="encode") for k in keys]
    index = pa.table({f"k{i}": c.indices for i, c in enumerate(codes)} | {"row": pa.array(range(batch.num_rows), pa.int64())})
    table = pa.Table.from_batches([batch])
    if not keys:
        yield (), table
        return
    for group in index.group_by([f"k{i}" for i in range(len(keys))], use_threads=False).aggregate([("row", "list")]).to_pylist():
        yield tuple(c.dictionary[group[f"k{i}"]].as_py() for i, c in enumerate(codes)), table.take(pa.array(group["row_list"], pa.int64()))


def _states(keys: list[str], metric: Aggregate, schema: pa.Schema, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, Any] = {}

        def flush() -> pa.RecordBatch:
            columns = list(zip(*states, strict=True)) if states else [[] for _ in keys]
            out = [pa.array(c, schema.field(k).type) for c, k in zip(columns, keys, strict=True)]
            packed = pa.array([pickle.dumps(s) for s in states.values()], pa.binary())
            states.clear()
            return pa.RecordBatch.from_arrays([*out, packed], [*keys, "__state"])

        for batch in batches:
            if not batch.num_rows:
                continue
            for key, rows in _groups(batch, keys):
                states[key] = metric.update(states[key] if key in states else metric.init(), rows)
            if len(states) > held:
                yield flush()
        yield flush()

    return run


def aggregate_metric(df: DataFrame, keys: Sequence[str], columns: Sequence[str], metric: Aggregate, names: Sequence[str],
                     fan_in: int = FAN_IN, held: int = HELD, rounds: int = ROUNDS) -> DataFrame:
    """(keys..., names...): the values that ``metric`` gives for the ``columns`` of every group of ``df``, as doubles.

    States go up in rounds: those of ``fan_in`` tasks are merged per group, then those of as many such
    blocks, and so on. NULL keys are groups of their own; an empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    keys, names = list(keys), list(names)
    rows = df.select(*keys, *columns)
    key_schema = "".join(f"`{k}` {t}, " for k, t in rows.select(*keys).dtypes)
    arrow = to_arrow_schema(rows.select(*keys).schema)
    states = rows.mapInArrow(_states(keys, metric, arrow, held), f"{key_schema}__state binary").withColumn("__block", F.spark_partition_id())

    def merged(table: pa.Table) -> Any:
        packed = table.column("__state").to_pylist()
        state = pickle.loads(packed[0])
        for p in packed[1:]:
            state = metric.merge(state, pickle.loads(p))
        return state

    def up(table: pa.Table) -> pa.Table:
        return pa.table([table.column(k).slice(0, 1) for k in keys] + [pa.array([pickle.dumps(merged(table))], pa.binary()), pa.array([table.column("__block")[0].as_py()], pa.int32())],
                        names=[*keys, "__state", "__block"])

    def top(table: pa.Table) -> pa.Table:
        values = metric.finish(merged(table))
        return pa.table([table.column(k).slice(0, 1) for k in keys] + [pa.array([values.get(n)], pa.float64()) for n in names], names=[*keys, *names])

    for _ in range(rounds):
        states = (states.withColumn("__block", F.floor(F.col("__block") / fan_in).cast("int"))
                  .groupBy(*keys, "__block").applyInArrow(up, f"{key_schema}__state binary, __block int"))
    return states.groupBy(*keys).applyInArrow(top, key_schema + ", ".join(f"`{n}` double" for n in names))
