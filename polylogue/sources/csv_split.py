"""S1 for large files: a quoted CSV read in parallel, whatever its size.

A line break inside quotes does not end a record, so a range of a file cannot be
parsed without knowing whether it begins inside quotes. Every physical line is a
function of that state (at the start of a record, or inside quotes); a first scan
reports for each range what it does to either state and how many records it ends,
a prefix combination over these few numbers fixes the state and the record number at
which each range begins, and a second scan parses the ranges in parallel. Only the
pieces of records that cross a range's end move.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: States at the start of a physical line.
RECORD, QUOTED = 0, 1
#: Ranges whose states are broadcast (a path and a few numbers each); beyond, they are joined.
RANGES = 1 << 18
#: A quoted cell up to its closing quote.
_CLOSE = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')


def line_end(line: str, state: int, delimiter: str = ",") -> int:
    """The state after ``line`` (without its line break): a quote opens only at the start of a cell and closes when it is not doubled;
    after that, up to the delimiter, quotes are letters."""
    at = 0
    while True:
        if state == QUOTED or line.startswith('"', at):
            closed = _CLOSE.match(line, at + (state != QUOTED))
            if closed is None:
                return QUOTED
            at = closed.end()
        state = RECORD
        at = line.find(delimiter, at) + 1
        if not at:
            return RECORD


def _runs(files: list[str], blocks: list[int]) -> Iterator[tuple[str, int, int, int]]:
    """(file, range, first row, end row) of the runs of rows of one range."""
    lo = 0
    for i in range(1, len(files) + 1):
        if i == len(files) or blocks[i] != blocks[lo] or files[i] != files[lo]:
            yield files[lo], blocks[lo], lo, i
            lo = i


def _effects(delimiter: str):
    """(file, block, lines, and for either first state: last state, records ended) of the ranges of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            lines = batch.column("value")
            quoted = pc.match_substring(lines, '"').to_pylist()
            for file, block, lo, hi in _runs(batch.column("file").to_pylist(), batch.column("block").to_pylist()):
                # [lines, state if RECORD, ended if RECORD, state if QUOTED, ended if QUOTED]
                effect = found.setdefault((file, block), [0, RECORD, 0, QUOTED, 0])
                effect[0] += hi - lo
                for i in range(lo, hi):
                    if quoted[i]:
                        line = lines[i].as_py()
                        ends = [line_end(line, s, delimiter) for s in (RECORD, QUOTED)]
                    else:  # without quotes nothing changes
                        ends = [RECORD, QUOTED]
                    for at in (1, 3):
                        effect[at] = ends[effect[at]]
                        effect[at + 1] += effect[at] == RECORD
        columns = [list(c) for c in zip(*((f, b, *e) for (f, b), e in found.items()), strict=True)] or [[]] * 7
        kinds = [pa.string(), *[pa.int64()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "block", "lines", "to_record", "ends_record", "to_quoted", "ends_quoted"])

    return run


_EFFECTS = "file string, block long, lines long, to_record long, ends_record long, to_quoted long, ends_quoted long"


def range_starts(effects: DataFrame) -> DataFrame:
    """(file, block, lines, state, first): the state at which each range begins and the number of its first record.

    A range maps (RECORD, QUOTED) to a pair of states: it keeps, swaps or forgets them. So the state at its start is that of the last range
    before it that forgets, changed by the parity of the swaps since.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    forgets = F.col("to_record") == F.col("to_quoted")
    swaps = (F.col("to_record") == QUOTED) & (F.col("to_quoted") == RECORD)
    turns = F.coalesce(F.sum(F.when(swaps, 1).otherwise(0)).over(before), F.lit(0))
    marked = effects.withColumn("turns", turns)
    # what the state would be with no swap at all, as left by the last range that forgets
    own = F.when(forgets, (F.col("to_record") + F.col("turns")) % 2)
    state = (F.coalesce(F.last(own, ignorenulls=True).over(before), F.lit(RECORD)) + F.col("turns")) % 2
    fixed = marked.withColumn("state", state)
    ended = fixed.withColumn("ended", F.when(F.col("state") == QUOTED, F.col("ends_quoted")).otherwise(F.col("ends_record")))
    return ended.select("file", "block", "lines", "state", F.coalesce(F.sum("ended").over(before), F.lit(0)).alias("first"))


def _records(delimiter: str):
    """(file, record, at, text, whole): records that lie in a range, and pieces of those that cross its ends."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, record, begun, held, seen, expected = None, RECORD, 0, False, [], 0, 0
        out: list[tuple] = []

        def close() -> None:
            """The last record of a range goes on in the next."""
            if key is not None and seen != expected:  # None: a range that the first scan did not have
                raise ValueError(f"{key[0]}: the ranges of the two scans differ")
            if held:
                out.append((key[0], record, key[1], "\n".join(held), False))
                held.clear()

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            result = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "record", "at", "text", "whole"])
            out.clear()
            return result

        for batch in batches:
            files, blocks, lines = (batch.column(c).to_pylist() for c in ("file", "block", "value"))
            totals, states, firsts = (batch.column(c).to_pylist() for c in ("lines", "state", "first"))
            for file, block, lo, hi in _runs(files, blocks):
                if (file, block) != key:
                    close()
                    key, state, record, seen, expected = (file, block), states[lo], firsts[lo], 0, totals[lo]
                    begun = state == RECORD  # does the record that is read begin in this range?
                seen += hi - lo
                for line in lines[lo:hi]:
                    held.append(line)
                    state = line_end(line, state, delimiter) if '"' in line else state
                    if state == RECORD:
                        out.append((file, record, block, "\n".join(held), begun))
                        held.clear()
                        record, begun = record + 1, True
            yield batch_of()
        close()
        yield batch_of()

    return run


def _cells(columns: Sequence[str], delimiter: str, extra: Sequence[str]):
    """The cells of each record, '' where it has none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(2**31 - 1)
        for batch in batches:
            rows = list(csv.reader(batch.column("text").to_pylist(), delimiter=delimiter))
            cells = [pa.array([r[i] if i < len(r) else "" for r in rows], pa.string()) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in extra), *cells], [*extra, *columns])

    return run


def physical_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, block, value): the lines of the files in ranges as Spark splits them, in order within a range."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def header(spark: SparkSession, path: str | Sequence[str], delimiter: str = ",") -> list[str]:
    """The cells of the first record of the first file."""
    return spark.read.options(header="true", multiLine="true", quote='"', escape='"', sep=delimiter).csv(path).columns


def read_csv_split(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None, delimiter: str = ",") -> DataFrame:
    """(file, pos, columns...): the records of CSV files with a header, every cell a string, ``pos`` the 0-based record number in its file.

    Cells are those of Python's csv module: quotes are doubled inside quotes, a quoted cell may
    hold line breaks, a quote inside an unquoted cell is a letter. A cell that a record does not have is '',
    surplus cells are left out, and a blank line is a record of empty cells. Lines end with a line feed, with or without a
    carriage return before it. ``columns`` are those of the first file's header unless given. The first
    scan runs at once, and its few numbers for each range are stored. Should the splits differ in the second scan, it fails.
    """
    columns = header(spark, path, delimiter) if columns is None else list(columns)
    lines = physical_lines(spark, path)
    kept = scratch_path(spark, "csv-ranges")
    lines.mapInArrow(_effects(delimiter), _EFFECTS).write.parquet(kept)
    effects = spark.read.schema(_EFFECTS).parquet(kept)
    starts = range_starts(effects)
    if effects.count() <= RANGES:
        placed = lines.join(F.broadcast(starts), ["file", "block"], "left")
    else:
        placed = (lines.withColumn("row", F.monotonically_increasing_id()).join(starts, ["file", "block"], "left")
                  .repartition("file", "block").sortWithinPartitions("file", "block", "row").drop("row"))
    records = placed.mapInArrow(_records(delimiter), "file string, record long, at long, text string, whole boolean")
    pieces = records.filter(~F.col("whole")).groupBy("file", "record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n").alias("text"))
    every = records.filter("whole").select("file", "record", "text").unionByName(pieces)
    return every.filter("record > 0").select("file", (F.col("record") - 1).alias("pos"), "text").mapInArrow(
        _cells(columns, delimiter, ["file", "pos"]), "file string, pos long, " + ", ".join(f"`{c}` string" for c in columns))
