"""CSV/JSON/text files with the reference's conventions.

CSV cells are strings; quoted cells may span lines. Row order inside a file is
data here (positions, ballot blocks), so writers lay rows out in order and
readers recover the line position from the file layout.
"""

from __future__ import annotations

import json
import os
import shutil
import urllib.parse
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import file_order_index
from ..session import hadoop_path

CSV_READ = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "inferSchema": "false",
            "mode": "FAILFAST"}
CSV_WRITE = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
             "ignoreTrailingWhiteSpace": "false", "emptyValue": "", "quoteAll": "false"}
SPLIT_FORMATS = ("csv", "json")


def _put(spark: SparkSession, path: str, write: Callable[[str], None], overwrite: bool) -> None:
    """K6: refuse an existing output unless overwrite is requested; it is then replaced once the new one is whole."""
    if overwrite:
        write_staged(spark, path, write)
    else:
        write(path)


def read_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Header CSV, every column a string, empty and missing cells as ''."""
    df = spark.read.options(**CSV_READ).csv(path)
    return df.na.fill("", subset=[f.name for f in df.schema.fields if f.dataType.simpleString() == "string"])


def write_csv(df: DataFrame, path: str, overwrite: bool = False, partition_by: Sequence[str] = ()) -> None:
    """K1/K3: CSV with a header, cells kept verbatim (no trimming, '' stays '')."""
    w = df.write.mode("errorifexists").options(**CSV_WRITE)
    if partition_by:
        w = w.partitionBy(*partition_by)
    _put(df.sparkSession, path, w.csv, overwrite)


def ordered(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range-partition and sort so that a write puts rows in (by, order) order:
    part files of one group follow each other in order of their numbers."""
    cols = list(by) + list(order)
    return df.repartitionByRange(*cols).sortWithinPartitions(*cols)


def read_positioned(spark: SparkSession, path: str, fmt: str = "csv", by: Sequence[str] = (),
                    dir_col: str | None = None) -> DataFrame:
    """A file read with its 0-based line position (header excluded) per ``by``
    group (and per folder with ``dir_col``), recovered from (file number, split,
    order inside the split)."""
    if fmt == "csv":
        df = read_csv(spark, path)
    elif fmt == "text":
        df = spark.read.text(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return file_order_index(df, by=by, out="pos", dir_col=dir_col)


def write_lines(df: DataFrame, path: str, text: str, order: Sequence[str], by: Sequence[str] = (),
                overwrite: bool = False) -> None:
    """K4: one line per row in ``order``. A line break inside a value would shift
    every later line, so it becomes a space."""
    clean = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n|\r|\n", " ")
    out = ordered(df.select(*by, *order, clean.alias("value")), by, order).drop(*order)
    w = out.write.mode("errorifexists")
    if by:
        w = w.partitionBy(*by)
    _put(df.sparkSession, path, w.text, overwrite)


def read_lines(spark: SparkSession, path: str, by: Sequence[str] = ()) -> DataFrame:
    """The lines of text files with their 0-based position per ``by``
    (partition columns of the layout)."""
    return read_positioned(spark, path, "text", by).withColumnRenamed("value", "line")


def load_splits(spark: SparkSession, files: Mapping[str, str], schema: str | None = None) -> DataFrame:
    """S3: train/validation/test files, CSV or JSON by extension, as one table
    with a ``split`` column; a cell that a file does not have is ''. Other extensions are refused.

    With ``schema`` (a DDL string, normally all strings) JSON is read without the
    schema-inference pass, which would otherwise scan every file twice."""
    parts = []
    for split, path in files.items():
        ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
        if ext not in SPLIT_FORMATS:
            raise ValueError(f"split {split!r}: expected a csv or a json file, not {path!r}")
        if ext == "csv":
            df = read_csv(spark, path)
        else:
            df = spark.read.schema(schema).json(path) if schema else spark.read.json(path)
        parts.append(df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).withColumn("split", F.lit(split)))
    if not parts:
        raise ValueError("no split file was named")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.na.fill("")


def require_columns(df: DataFrame, *names: str) -> None:
    """Fail early, naming the available columns, if a column is absent."""
    for n in names:
        if n is None:
            raise ValueError("a column name is missing")
        if n not in df.columns:
            raise ValueError(f"no column {n!r}; there are: {', '.join(df.columns)}")


def rename_partitions(spark: SparkSession, root: str, key: str, name_format: str) -> list[str]:
    """Turn ``root/key=value`` folders into ``root/<name_format.format(value)>``,
    giving one named output per value as the reference's one-file-per-language
    layout. A rename moves names only on HDFS and local disks; object stores copy."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(conf)
    done = []
    for st in fs.listStatus(base):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith(key + "="):
            target = name_format.format(name.split("=", 1)[1])
            if not fs.rename(st.getPath(), jvm.org.apache.hadoop.fs.Path(base, target)):
                raise OSError(f"{name} could not be renamed to {target} below {root}")
            done.append(target)
    return sorted(done)


def write_per_key(df: DataFrame, root: str, key: str, name_format: str, order: Sequence[str] = (),
                  overwrite: bool = False) -> list[str]:
    """K1/K2: one CSV output per key value named by ``name_format`` (for example
    ``{}_train.csv``), written by one distributed job, rows in ``order``."""
    spark = df.sparkSession
    data = ordered(df, [key], order) if order else df
    write_csv(data, root, overwrite=overwrite, partition_by=[key])
    return rename_partitions(spark, root, key, name_format)


#: Bytes that a task copies at once into a single file.
COPY_BYTES = 8 << 20


def single_file(df: DataFrame, path: str, order: Sequence[str], overwrite: bool = False) -> None:
    """K1-K3: ``df`` without the ``order`` columns as one CSV file ``path`` with a header, its rows in ``order`` (see ``single_files``)."""
    work = _work_of(df, path, overwrite)
    data = df.repartitionByRange(*order).sortWithinPartitions(*order).drop(*order)
    data.write.options(**_BARE).csv(f"{work}/rows")
    _joined(df.sparkSession, data.columns, {path: f"{work}/rows"}, work, overwrite)


def single_files(df: DataFrame, root: str, key: str, name_format: str, order: Sequence[str], overwrite: bool = False) -> list[str]:
    """K1/K2: for every value of ``key`` one CSV file named by ``name_format`` below ``root``, with a header, its rows in ``order``. Returns the names.

    All rows are written by one job as parts without header, in ranges of (key, order). The parts then
    become files without passing the driver: by the file system's own concatenation where it has one (HDFS), or, on
    a disk that driver and executors share, by tasks that copy each part to its place in the file; a
    task that is run again writes the same bytes. A file appears under its name when it is complete.
    """
    spark = df.sparkSession
    fs, base = hadoop_path(spark, root)
    fs.mkdirs(base)
    work = _work_of(df, f"{root}/files", overwrite)
    columns = [c for c in df.columns if c not in (key, *order)]
    ordered(df, [key], order).select(key, *columns).write.options(**_BARE).partitionBy(key).csv(f"{work}/rows")
    folders = [st.getPath() for st in fs.listStatus(hadoop_path(spark, f"{work}/rows")[1]) if st.isDirectory() and st.getPath().getName().startswith(key + "=")]
    named = {name_format.format(f.getName().split("=", 1)[1]): f.toString() for f in folders}
    _joined(spark, columns, {f"{root}/{name}": folder for name, folder in named.items()}, work, overwrite)
    return sorted(named)


_BARE = CSV_WRITE | {"header": "false"}


def _work_of(df: DataFrame, path: str, overwrite: bool) -> str:
    """A new folder beside ``path`` for the parts."""
    fs, target = hadoop_path(df.sparkSession, path)
    if fs.exists(target) and not overwrite:
        raise FileExistsError(f"{path} exists")
    if fs.getScheme() not in ("hdfs", "file"):
        raise NotImplementedError(f"no way to join files on {fs.getScheme()}")
    return f"{path}.parts-{uuid.uuid4().hex[:12]}"


def single_line_files(df: DataFrame, text: str, key: str, order: Sequence[str], paths: Mapping[str, str], work: str, overwrite: bool = False) -> None:
    """K4: for every value of ``key`` the file ``paths[value]`` with a line per row, in ``order`` (see ``single_files``); a value without a path is left out."""
    spark = df.sparkSession
    work = _work_of(df, work, True)
    numbers = spark.createDataFrame([(value, i) for i, value in enumerate(paths)], f"`{key}` string, __file int")
    write_lines(df.join(F.broadcast(numbers), key), f"{work}/rows", text, order, ["__file"])
    fs, _ = hadoop_path(spark, work)
    folders = {}
    for i, path in enumerate(paths.values()):
        folder = f"{work}/rows/__file={i}"
        fs.mkdirs(hadoop_path(spark, folder)[1])  # a run without rows is an empty file
        fs.mkdirs(hadoop_path(spark, path)[1].getParent())
        folders[path] = folder
    _joined(spark, None, folders, work, overwrite)


def _joined(spark: SparkSession, columns: Sequence[str] | None, folders: Mapping[str, str], work: str, overwrite: bool) -> None:
    """Each file of ``folders`` from a header (with ``columns``) and the parts of its folder; ``work`` goes."""
    if columns is not None:
        titles = spark.createDataFrame([(i, *columns) for i in range(len(folders))], "file int, " + ", ".join(f"c{i} string" for i in range(len(columns))))
        titles.coalesce(1).write.options(**_BARE).partitionBy("file").csv(f"{work}/titles")
    copies, made = [], {}
    for i, (path, folder) in enumerate(folders.items()):
        parts = [*(_parts(spark, f"{work}/titles/file={i}") if columns is not None else []), *_parts(spark, folder)]
        made[path] = f"{work}/whole-{i}"
        at = 0
        for part, size in parts:
            copies.append((part, made[path], at))
            at += size
    fs, at = hadoop_path(spark, work)
    if fs.getScheme() == "hdfs":
        kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path, whole in made.items():
            parts = [part for part, target, _ in copies if target == whole]
            if not parts:
                continue
            rest = spark.sparkContext._gateway.new_array(kind, len(parts) - 1)
            for k, part in enumerate(parts[1:]):
                rest[k] = kind(part)
            if len(rest):
                fs.concat(kind(parts[0]), rest)
            made[path] = parts[0]
    elif copies:
        _copied(spark, copies)
    for path, whole in made.items():
        target = hadoop_path(spark, path)[1]
        if not fs.exists(hadoop_path(spark, whole)[1]):
            fs.create(hadoop_path(spark, whole)[1], True).close()
        if overwrite:
            fs.delete(target, True)
        if fs.exists(target) or not fs.rename(hadoop_path(spark, whole)[1], target):
            raise OSError(f"{whole} could not be renamed to {path}")
    fs.delete(at, True)


def _parts(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(path, bytes) of the part files of ``folder`` in order of their numbers."""
    fs, base = hadoop_path(spark, folder)
    found = [(st.getPath().getName(), st.getPath().toString(), st.getLen()) for st in fs.listStatus(base) if st.isFile()]
    numbered = sorted((int(n.split("-")[1].split(".")[0]), p, size) for n, p, size in found if n.startswith("part-"))
    return [(p, size) for _, p, size in numbered if size]


def _copied(spark: SparkSession, copies: Sequence[tuple[str, str, int]]) -> None:
    """The bytes of each (part, file, place) at that place of the file, each copied by a task."""
    local = lambda p: urllib.parse.unquote(urllib.parse.urlparse(p).path) if p.startswith("file:") else p
    places = [(i, local(part), local(target), at) for i, (part, target, at) in enumerate(copies)]

    def copy(batches):
        for batch in batches:
            for row in batch.to_pylist():
                # opened for update, so that no task cuts what another has written
                with open(row["part"], "rb") as src, os.fdopen(os.open(row["target"], os.O_RDWR | os.O_CREAT, 0o644), "r+b") as dst:
                    dst.seek(row["at"])
                    shutil.copyfileobj(src, dst, COPY_BYTES)
            yield batch.slice(0, 0)

    schema = "i int, part string, target string, at long"
    spark.createDataFrame(places, schema).repartition(len(places), "i").mapInArrow(copy, schema).write.format("noop").mode("overwrite").save()


# ---------------------------------------------------------------- staged rewrites
MANIFEST = "_manifest.json"


def write_staged(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Replace the folder ``path`` by what ``write`` puts into the folder it is given; a write that fails leaves the old output.

    The new folder is written beside the old one and sealed with a manifest of its files and their sizes. Only then the
    old one is moved aside, the new one takes its name, and the old one goes. Whoever is stopped between these
    steps is made good by the next call, or by ``recover``. Renames move names only on HDFS and local disks.
    """
    recover(spark, path)
    fs, target = hadoop_path(spark, path)
    tag = uuid.uuid4().hex[:12]
    staging, old = f"{path}.staging-{tag}", f"{path}.old-{tag}"
    try:
        write(staging)
        _seal(spark, staging)
    except BaseException:
        fs.delete(hadoop_path(spark, staging)[1], True)
        raise
    if fs.exists(target):
        _moved(spark, path, old)
    _moved(spark, staging, path)
    fs.delete(hadoop_path(spark, old)[1], True)


def _files(spark: SparkSession, folder: str) -> dict[str, int]:
    """Bytes of every file below ``folder``, by its path from there."""
    fs, base = hadoop_path(spark, folder)
    root = fs.makeQualified(base).toString().rstrip("/") + "/"
    out, todo = {}, fs.listFiles(base, True)
    while todo.hasNext():
        f = todo.next()
        out[f.getPath().toString().removeprefix(root)] = f.getLen()
    return out


def write_small(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """A small text file (a report) of the driver's; folders above it are made."""
    fs, at = hadoop_path(spark, path)
    if fs.exists(at) and not overwrite:
        raise FileExistsError(f"{path} exists")
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def _seal(spark: SparkSession, folder: str) -> None:
    write_small(spark, f"{folder}/{MANIFEST}", json.dumps(_files(spark, folder), sort_keys=True), True)


def is_sealed(spark: SparkSession, folder: str) -> bool:
    """Has ``folder`` a manifest, and every file of it with its size?"""
    fs, at = hadoop_path(spark, f"{folder}/{MANIFEST}")
    if not fs.exists(at):
        return False
    stream = fs.open(at)
    try:
        listed = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    there = _files(spark, folder)
    return all(there.get(name) == size for name, size in listed.items())


def _moved(spark: SparkSession, source: str, target: str) -> None:
    fs, a = hadoop_path(spark, source)
    if not fs.rename(a, hadoop_path(spark, target)[1]):
        raise OSError(f"{source} could not be renamed to {target}")


def recover(spark: SparkSession, path: str) -> None:
    """Finish or undo a swap that was stopped: a sealed new folder takes the name, else the old one gets it back."""
    fs, target = hadoop_path(spark, path)
    if fs.exists(target) or not fs.exists(target.getParent()):
        return
    name = target.getName()
    beside = [st.getPath().getName() for st in fs.listStatus(target.getParent())]
    root = path.rstrip("/")[:-len(name)]
    for old in [f"{root}{n}" for n in beside if n.startswith(f"{name}.old-")]:
        staging = f"{path}.staging-{old.rsplit('-', 1)[1]}"
        if is_sealed(spark, staging):
            _moved(spark, staging, path)
            fs.delete(hadoop_path(spark, old)[1], True)
        else:
            _moved(spark, old, path)
        return
